"""Exact quantiles with linear interpolation, at any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.operators.ordered import arrange, largest_group
from wattline.session import rows_per_task

_ACCURACY = 10_000


def quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]], keys: Sequence[str] = (),
              limit: int | None = None) -> DataFrame:
    """One row per key (one row in all without keys): name -> (column, probability).

    Up to ``limit`` rows per key Spark's ``percentile`` answers in one aggregate.  It keeps
    every distinct value of a group in memory, so larger groups take a distributed route:
    count equal values, run a cumulative count over them in order, pick the two ranks.
    Without keys a first pass brackets the quantile so that only rows near it are sorted.
    """
    keys = list(keys)
    limit = limit or rows_per_task(df.sparkSession)
    if largest_group(df, keys) <= limit:
        return _in_one_pass(df, wanted, keys)
    parts = [_by_rank(df, name, column, p, keys, limit) for name, (column, p) in wanted.items()]
    if keys:
        result = parts[0]
        for part in parts[1:]:
            result = result.join(part, keys, "full")
        return result
    row = {name: part.first()[0] for name, part in zip(wanted, parts)}
    schema = ", ".join(f"`{n}` double" for n in wanted)
    return df.sparkSession.createDataFrame([tuple(row[n] for n in wanted)], schema)


def _in_one_pass(df: DataFrame, wanted: dict[str, tuple[str, float]], keys: list[str]) -> DataFrame:
    """All probabilities of a column share one percentile aggregate."""
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    shares = {c: sorted({p for k, p in wanted.values() if k == c}) for c in columns}
    made = [F.percentile(F.col(c).cast("double"), F.array(*map(F.lit, shares[c]))).alias(f"_q{i}") for i, c in enumerate(columns)]
    one = df.groupBy(*keys).agg(*made) if keys else df.agg(*made)
    return one.select(*keys, *[
        F.get(f"_q{columns.index(c)}", F.lit(shares[c].index(p))).alias(n) for n, (c, p) in wanted.items()])


def _by_rank(df: DataFrame, name: str, column: str, p: float, keys: list[str], limit: int) -> DataFrame:
    values = df.select(*keys, F.col(column).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    base, total = F.lit(0), None
    if not keys:
        margin = 2.0 / _ACCURACY
        low, high, count = values.agg(
            F.percentile_approx("_v", max(p - margin, 0.0), _ACCURACY),
            F.percentile_approx("_v", min(p + margin, 1.0), _ACCURACY),
            F.count("_v"),
        ).first()
        below, inside = values.agg(
            F.sum((F.col("_v") < low).cast("bigint")),
            F.sum(F.col("_v").between(low, high).cast("bigint")),
        ).first()
        rank = p * (count - 1)
        if below <= int(rank) and rank <= below + inside - 1:
            values, base = values.filter(F.col("_v").between(low, high)), F.lit(below)
        total = F.lit(count)
    counts = values.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    ranked = arrange(counts, keys, ["_v"], limit).running({"_upto": ("sum", "_n")})
    if total is None:
        sizes = counts.groupBy(*keys).agg(F.sum("_n").alias("_all"))
        ranked, total = ranked.join(sizes, keys), F.col("_all")
    rank = F.lit(p) * (total - 1)
    upto = F.col("_upto") + base
    picked = ranked.groupBy(*keys).agg(
        F.min(F.when(upto > F.floor(rank), F.col("_v"))).alias("_lo"),
        F.min(F.when(upto > F.ceil(rank), F.col("_v"))).alias("_hi"),
        F.max(rank - F.floor(rank)).alias("_part"),
    )
    return picked.select(*keys, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_part")).alias(name))
