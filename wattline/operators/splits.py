"""Ordered subsets: latest rows, train/test parts and time folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.operators.ordered import arrange
from wattline.session import rows_per_task
from wattline.sources.readings import ROW, SERIES, TS


def _time_order(df: DataFrame) -> list[str]:
    return [c for c in (TS, ROW) if c in df.columns]


def latest(df: DataFrame, n: int, order: Sequence[str] | None = None) -> DataFrame:
    """The last ``n`` rows in time; each task keeps only its own top ``n``."""
    order = order or _time_order(df)
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def latest_per_key(df: DataFrame, n: int, keys: Sequence[str] = (SERIES,),
                   order: Sequence[str] | None = None) -> DataFrame:
    """The last ``n`` rows of each key.

    A salted first round keeps ``n`` rows per (key, salt), so a hot key is spread over
    many tasks and the second round sees at most ``n`` rows per salt.
    """
    order = [F.col(c).desc() for c in (order or _time_order(df))]
    parts = max(1, df.sparkSession.sparkContext.defaultParallelism)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(parts)))
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    kept = salted.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= n).drop("_n", "_salt")
    second = Window.partitionBy(*keys).orderBy(*order)
    return kept.withColumn("_n", F.row_number().over(second)).filter(F.col("_n") <= n).drop("_n")


def ordered_split(df: DataFrame, test_share: float = 0.2, keys: Sequence[str] = (SERIES,),
                  order: Sequence[str] | None = None) -> DataFrame:
    """``part`` is train for the first rows of a key and test for the last ceil(n * share)."""
    placed = arrange(df, keys, order or _time_order(df)).with_position_and_total("_p", "_n_all")
    train = F.col("_p") < F.col("_n_all") - F.ceil(F.col("_n_all") * F.lit(test_share))
    return placed.withColumn("part", F.when(train, "train").otherwise("test")).drop("_p", "_n_all")


def rolling_origin(df: DataFrame, start: int = 720, horizon: int = 24, step: int = 24,
                   keys: Sequence[str] = (SERIES,), order: Sequence[str] | None = None) -> DataFrame:
    """One row per (fold, test row): fold f trains on [0, start + f*step) and tests the next ``horizon`` rows.

    A row's folds follow from its position alone, so nothing is joined: it belongs to at
    most ceil(horizon / step) folds.
    """
    placed = arrange(df, keys, order or _time_order(df)).with_position_and_total("_p", "_n_all")
    newest = F.floor((F.col("_p") - start) / step)
    oldest = F.greatest(F.lit(0).cast("bigint"), F.floor((F.col("_p") - start - horizon) / step) + 1)
    last_fold = F.ceil((F.col("_n_all") - horizon - start) / step) - 1
    newest = F.least(newest, last_fold)
    folds = placed.filter((F.col("_p") >= start) & (newest >= oldest)).withColumn(
        "fold", F.explode(F.sequence(oldest, newest)))
    origin = F.lit(start) + F.col("fold") * step
    return folds.withColumns({"train_rows": origin, "step": F.col("_p") - origin}).drop("_p", "_n_all")


def expanding_folds(df: DataFrame, splits: int = 5, keys: Sequence[str] = (SERIES,),
                    order: Sequence[str] | None = None) -> DataFrame:
    """``test_fold`` 1..splits (0: never tested). Fold k trains on all rows with a smaller number."""
    placed = arrange(df, keys, order or _time_order(df)).with_position_and_total("_p", "_n_all")
    size = F.floor(F.col("_n_all") / (splits + 1))
    first = F.col("_n_all") - size * splits
    fold = F.when(F.col("_p") < first, F.lit(0)).otherwise(F.floor((F.col("_p") - first) / size) + 1)
    return placed.withColumn("test_fold", fold.cast("int")).drop("_p", "_n_all")


def scatter(key: str = ROW) -> Column:
    """A multiplicative hash of an integer key: same value on every run and partitioning."""
    return F.pmod((F.pmod(F.col(key), F.lit(2**31)) + 1) * F.lit(2654435761), F.lit(2**32))


def hash_halves(df: DataFrame, key: str = ROW) -> DataFrame:
    """Deterministic halves by row id, independent of the partitioning."""
    return df.withColumn("half", (F.floor(scatter(key) / F.lit(2**31)) + 1).cast("int"))


def hash_sample(df: DataFrame, n: int, key: str = ROW) -> DataFrame:
    """A fixed pseudo-random sample of ``n`` rows; each task keeps only its own ``n`` smallest."""
    return df.orderBy(scatter(key), F.col(key)).limit(n)


def every_kth(df: DataFrame, order: Sequence[str | Column], keys: Sequence[str] = (), points: int = 100) -> DataFrame:
    """Thin a curve to every (n // points)-th row per key, starting with the first."""
    placed = arrange(df, keys, order).with_position_and_total("_p", "_n_all")
    step = F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("_n_all") / points))
    return placed.filter(F.pmod(F.col("_p"), step) == 0).drop("_p", "_n_all")
