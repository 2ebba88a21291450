"""Joins of readings with side tables, labels, horizons and one-row statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.operators.ordered import lookup_join, spread_join
from wattline.session import rows_per_task
from wattline.sources.readings import ROW, SERIES, TS


_BROADCAST_ROWS = 50_000


def with_side_table(left: DataFrame, right: DataFrame, on: Sequence[str] | None = None,
                    suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Left join by key; columns present on both sides get suffixes, equal right keys multiply rows.

    Without a given key the join is on series and time where both sides have the series, else on time.
    A time that very many rows share is spread over several tasks.
    """
    if on is None:
        on = [SERIES, TS] if SERIES in left.columns and SERIES in right.columns else [TS]
    shared = [c for c in right.columns if c in left.columns and c not in on]
    left = left.withColumnsRenamed({c: c + suffixes[0] for c in shared})
    right = right.withColumnsRenamed({c: c + suffixes[1] for c in shared})
    return spread_join(left, right, on, rows_per_task(left.sparkSession))


def with_label(df: DataFrame, labels: DataFrame, key: str, label: str, default: str = "unknown") -> DataFrame:
    """Look a code up in a (key, label) table; unknown codes get the default."""
    small = labels.select(key, label)
    joined = df.join(_broadcast_if_small(small), key, "left")
    return joined.withColumn(label, F.coalesce(F.col(label), F.lit(default)))


def _broadcast_if_small(df: DataFrame) -> DataFrame:
    """A (key, label) table of up to 50,000 narrow rows is broadcast, a larger one joined by a shuffle."""
    limit = min(_BROADCAST_ROWS, rows_per_task(df.sparkSession))
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def last_row(df: DataFrame, keys: Sequence[str] = (SERIES,), order: Sequence[str] | None = None) -> DataFrame:
    """The newest row per key by one aggregate, combined before the shuffle."""
    order = [c for c in (order or (TS, ROW)) if c in df.columns]
    rest = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return newest.select(*keys, "_row.*")


def horizon_rows(df: DataFrame, hours: int = 24, keys: Sequence[str] = (SERIES,), ts: str = TS) -> DataFrame:
    """The newest row per key repeated for each of the next ``hours`` hours; ``step`` runs from 1."""
    newest = last_row(df, keys)
    ahead = newest.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(hours))))
    return ahead.withColumn(ts, F.col(ts) + F.make_dt_interval(F.lit(0), F.col("step")))


def attach_statistics(df: DataFrame, stats: dict[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """Compute aggregates once (per key) and add them to every row."""
    made = [c.alias(n) for n, c in stats.items()]
    if not keys:
        one = df.agg(*made).select(F.struct("*")).scalar()
        return df.withColumns({n: one[n] for n in stats})
    per_key = df.groupBy(*keys).agg(*made, F.count(F.lit(1)).alias("_rows_of_key"))
    return lookup_join(df, per_key, list(keys), "_rows_of_key", rows_per_task(df.sparkSession)).drop("_rows_of_key")
