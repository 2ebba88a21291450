"""De-duplication, filling, outlier repair and resampling of readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.operators.ordered import arrange
from wattline.operators.quantile import quantiles
from wattline.session import rows_per_task
from wattline.sources.readings import ROW, SERIES, TS, measure_columns

_GRID_BLOCK = 100_000
_BINS_PER_TASK = 50_000
_MOST_TASKS = 100_000


def first_per_time(df: DataFrame, keys: Sequence[str] = (SERIES,), ts: str = TS, row: str = ROW) -> DataFrame:
    """Keep the first row of each (key, time).

    The winner is found by an aggregate, which combines before the shuffle, so a time
    shared by very many rows does not land in one task as a window would.
    """
    by = [*keys, ts]
    rest = [c for c in df.columns if c not in by]
    kept = df.groupBy(*by).agg(F.min_by(F.struct(*rest), F.col(row)).alias("_first"))
    return kept.select(*by, "_first.*").select(*df.columns)


def drop_equal_rows(df: DataFrame, row: str = ROW) -> DataFrame:
    """One of each set of equal rows; the row id does not count as a difference, its lowest value stays."""
    if row not in df.columns:
        return df.dropDuplicates()
    rest = [c for c in df.columns if c != row]
    return df.groupBy(*rest).agg(F.min(row).alias(row)).select(*df.columns)


def fill_gaps(df: DataFrame, columns: Sequence[str] | None = None, keys: Sequence[str] = (SERIES,),
              order: Sequence[str] = (TS, ROW), backward: bool = True, longest: int | None = None) -> DataFrame:
    """Carry the last known value forward, then the next one backward, per key."""
    columns = list(columns or measure_columns(df))
    steps = {f"_f_{c}": ("last", c) for c in columns}
    if backward:
        steps |= {f"_b_{c}": ("next", c) for c in columns}
    filled = arrange(df, keys, [o for o in order if o in df.columns], longest=longest).running(steps)
    made = {c: F.coalesce(f"_f_{c}", f"_b_{c}") if backward else F.col(f"_f_{c}") for c in columns}
    return filled.withColumns(made).drop(*steps)


def replace_far_values(df: DataFrame, columns: Sequence[str] = ("consumption_kwh", "voltage"),
                       cut: float = 4.0) -> DataFrame:
    """Values more than ``cut`` population deviations away become the median of the others."""
    columns = [c for c in columns if c in df.columns]
    moments = df.agg(
        *[F.avg(c).alias(f"{c}_m") for c in columns], *[F.stddev_pop(c).alias(f"{c}_s") for c in columns]
    ).select(F.struct("*")).scalar()
    marked = df.withColumns({
        c: F.when(~F.coalesce(F.abs(F.try_divide(F.col(c) - moments[f"{c}_m"], moments[f"{c}_s"])) > cut, F.lit(False)),
                  F.col(c))
        for c in columns
    })
    middle = quantiles(marked, {c: (c, 0.5) for c in columns}).select(F.struct("*")).scalar()
    return marked.withColumns({c: F.coalesce(F.col(c), middle[c]) for c in columns})


def clip_extremes(df: DataFrame, columns: Sequence[str] = ("consumption_kwh", "voltage", "temperature"),
                  cut: float = 5.0, tails: tuple[float, float] = (0.001, 0.999)) -> DataFrame:
    """Clip a column to its tail quantiles, but only if some value is beyond ``cut`` sample deviations."""
    columns = [c for c in columns if c in df.columns]
    stats = []
    for c in columns:
        far = F.try_divide(F.greatest(F.max(c) - F.avg(c), F.avg(c) - F.min(c)), F.stddev_samp(c))
        stats.append(F.coalesce(far > cut, F.lit(False)).alias(c))
    needed = df.agg(*stats).select(F.struct("*")).scalar()
    bounds = {}
    for c in columns:
        bounds[f"{c}_lo"], bounds[f"{c}_hi"] = (c, tails[0]), (c, tails[1])
    edge = quantiles(df, bounds).select(F.struct("*")).scalar()
    return df.withColumns({
        c: F.when(needed[c] & F.col(c).isNotNull(),
                  F.least(F.greatest(F.col(c), edge[f"{c}_lo"]), edge[f"{c}_hi"])).otherwise(F.col(c))
        for c in columns
    })


def bin_start(ts, seconds: int):
    return F.timestamp_seconds(F.floor(F.unix_timestamp(ts) / seconds) * seconds)


def resample(df: DataFrame, seconds: int = 3600, keys: Sequence[str] = (SERIES,), ts: str = TS,
             columns: Sequence[str] | None = None, fill: bool = True) -> DataFrame:
    """Mean of the numeric columns per time bin, every bin between a key's first and last present.

    Empty bins are then filled forward.  The grid is generated in blocks, so no array and
    no task holds the whole span of a long series.
    """
    keys, columns = list(keys), list(columns or measure_columns(df))
    binned = df.groupBy(*keys, bin_start(F.col(ts), seconds).alias(ts)).agg(*[F.avg(c).alias(c) for c in columns])
    longest, total = _grid_size(df, seconds, keys, ts)
    full = time_grid(df, seconds, keys, ts, longest, total).join(binned, [*keys, ts], "left")
    return fill_gaps(full, columns, keys, [ts], backward=False, longest=longest) if fill else full


def _spans(df: DataFrame, seconds: int, keys: Sequence[str], ts: str) -> DataFrame:
    """(keys, _a, _b): numbers of a key's first and last bin."""
    return df.groupBy(*keys).agg(
        F.floor(F.unix_timestamp(F.min(ts)) / seconds).alias("_a"),
        F.floor(F.unix_timestamp(F.max(ts)) / seconds).alias("_b"),
    )


def _grid_size(df: DataFrame, seconds: int, keys: Sequence[str], ts: str) -> tuple[int, int]:
    """Bins of the longest key and of all keys, from first and last times alone."""
    bins = F.col("_b") - F.col("_a") + 1
    row = _spans(df, seconds, keys, ts).agg(F.max(bins), F.sum(bins)).first()
    return row[0] or 0, row[1] or 0


def grid_length(df: DataFrame, seconds: int = 3600, keys: Sequence[str] = (SERIES,), ts: str = TS) -> int:
    """Bins of the longest key after :func:`resample`; ordered operators take it as ``longest``."""
    return _grid_size(df, seconds, keys, ts)[0]


def time_grid(df: DataFrame, seconds: int, keys: Sequence[str], ts: str, longest: int, total: int) -> DataFrame:
    """One row per key and bin from the key's first to its last bin.

    The table of spans is tiny and grows many times over when its bins are listed, so it is first
    spread over as many tasks as the ``total`` bins need: by key while a key fits a task, so that
    later windows need no further shuffle, and by block where keys are longer.
    """
    spark = df.sparkSession
    last_block = F.floor((F.col("_b") - F.col("_a")) / _GRID_BLOCK)
    blocks = _spans(df, seconds, keys, ts).select(
        *keys, "_a", "_b", F.explode(F.sequence(F.lit(0).cast("bigint"), last_block)).alias("_k"))
    width = min(_MOST_TASKS, max(spark.sparkContext.defaultParallelism, -(-total // _BINS_PER_TASK)))
    if width == int(spark.conf.get("spark.sql.shuffle.partitions")):
        width += 1  # the same number would be dropped as redundant, and adaptive execution would merge the tiny spans
    spread = [*keys] if longest <= rows_per_task(spark) else [*keys, "_k"]
    first = F.col("_a") + F.col("_k") * _GRID_BLOCK
    bins = blocks.repartition(width, *spread).select(*keys, F.explode(F.sequence(
        first, F.least(F.col("_b"), first + _GRID_BLOCK - 1))).alias("_bin"))
    return bins.select(*keys, F.timestamp_seconds(F.col("_bin") * seconds).alias(ts))


def drop_incomplete(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def clean(df: DataFrame) -> DataFrame:
    """The basic path: first row per time, fill both ways, repair outliers."""
    return replace_far_values(fill_gaps(first_per_time(df)))


def clean_validated(df: DataFrame) -> DataFrame:
    """The path for validated sources: drop equal rows, fill both ways, clip extremes."""
    return clip_extremes(fill_gaps(drop_equal_rows(df)))
