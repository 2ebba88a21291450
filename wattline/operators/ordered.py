"""Order-dependent work on keyed series without ever sorting a whole hot key in one task.

``arrange`` counts the rows of the largest key first.  While every key fits one
task, ordinary windows partitioned by the key are used: one shuffle, one sort.
When a key is larger, rows are range-partitioned on (key, order) and numbered
once, the numbered table is written to the shared folder, and every later step
works on pieces of at most ``piece`` consecutive rows:

* bounded look-back and look-ahead copy the few rows next to a border into the
  neighbouring piece;
* running aggregates carry a one-row summary per piece forward;
* positions come from the numbering itself.

Both forms give the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from wattline.session import materialize, rows_per_task

_POS, _CUT, _CORE = "_pos", "_cut", "_core"
_MOST_HOT = 50_000
_BITS_IN_PARTITION = 33  # layout of monotonically_increasing_id


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Row count of the largest key; counts are combined before the shuffle."""
    if not keys:
        return df.count()
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.max("n")).first()[0] or 0


def _partition_by(keys: Sequence[str]):
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


class Ordered:
    """Rows of each key in a total order. Build it with :func:`arrange`."""

    def __init__(self, df: DataFrame, keys: list[str], order: list, piece: int | None):
        self.df, self.keys, self.order, self.piece = df, keys, order, piece

    @property
    def is_cut(self) -> bool:
        return self.piece is not None

    def _whole(self) -> WindowSpec:
        return _partition_by(self.keys).orderBy(*self.order)

    def _cut_of(self) -> Column:
        return F.floor(F.col(_POS) / F.lit(self.piece))

    def _clean(self, df: DataFrame) -> DataFrame:
        return df.drop(_POS, _CUT, _CORE)

    def with_position(self, name: str) -> DataFrame:
        """0-based position of a row in its key."""
        if not self.is_cut:
            return self.df.withColumn(name, (F.row_number().over(self._whole()) - 1).cast("bigint"))
        return self._clean(self.df.withColumn(name, F.col(_POS)))

    def with_position_and_total(self, position: str, total: str) -> DataFrame:
        if not self.is_cut:
            every = _partition_by(self.keys)
            return self.with_position(position).withColumn(total, F.count(F.lit(1)).over(every))
        pieces = self.df.withColumn(_CUT, self._cut_of())
        sizes = pieces.groupBy(*self.keys, _CUT).agg(F.count(F.lit(1)).alias("_rows_here"))
        sizes = sizes.withColumn(total, F.sum("_rows_here").over(_partition_by(self.keys))).drop("_rows_here")
        return self._clean(pieces.join(sizes, [*self.keys, _CUT]).withColumn(position, F.col(_POS)))

    def near(self, columns: dict[str, callable] | Sequence[dict[str, callable]], back: int = 0, ahead: int = 0,
             drop: Sequence[str] = ()) -> DataFrame:
        """Add window columns that reach at most ``back``/``ahead`` rows away.

        ``columns`` maps a name to a function from an ordered WindowSpec to a Column. Of several
        such maps the later ones may use the columns of the earlier ones; all of them together reach
        no further than ``back``/``ahead``. Columns in ``drop`` are left out in the end.
        """
        steps = [columns] if isinstance(columns, dict) else list(columns)

        def added(df: DataFrame, window: WindowSpec) -> DataFrame:
            for step in steps:
                df = df.withColumns({n: make(window) for n, make in step.items()})
            return df.drop(*drop)

        if not self.is_cut:
            return added(self.df, self._whole())
        if max(back, ahead) > self.piece:
            raise ValueError("a piece must hold at least as many rows as the window reaches")
        here, size = self._cut_of(), F.lit(self.piece)
        places = F.array(
            here,
            F.when(F.col(_POS) >= (here + 1) * size - back, here + 1),
            F.when((here > 0) & (F.col(_POS) < here * size + ahead), here - 1),
        )
        spread = self.df.withColumn(_CUT, F.explode(F.array_compact(places)))
        spread = spread.withColumn(_CORE, F.col(_CUT) == here)
        done = added(spread, Window.partitionBy(*self.keys, _CUT).orderBy(_POS))
        return self._clean(done.filter(_CORE))

    def running(self, columns: dict[str, tuple[str, str]]) -> DataFrame:
        """Add running aggregates: name -> (kind, column).

        Kinds: ``sum``, ``min``, ``max`` up to and including the row; ``last``, the latest
        non-null value so far; ``next``, the first non-null value from the row onwards.
        """
        so_far = (Window.unboundedPreceding, Window.currentRow)
        onwards = (Window.currentRow, Window.unboundedFollowing)
        if not self.is_cut:
            base = self._whole()
            return self.df.withColumns(
                {n: _over(kind, F.col(c), base.rowsBetween(*(onwards if kind == "next" else so_far)))
                 for n, (kind, c) in columns.items()}
            )
        pieces = self.df.withColumn(_CUT, self._cut_of())
        inside = Window.partitionBy(*self.keys, _CUT).orderBy(_POS)
        summary = pieces.groupBy(*self.keys, _CUT).agg(
            *[_summarise(kind, F.col(c)).alias(f"_s_{n}") for n, (kind, c) in columns.items()]
        )
        across = _partition_by(self.keys).orderBy(_CUT)
        carried = summary.select(
            *self.keys, _CUT,
            *[_over(kind, F.col(f"_s_{n}"),
                    across.rowsBetween(1, Window.unboundedFollowing) if kind == "next"
                    else across.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_c_{n}")
              for n, (kind, _) in columns.items()],
        )
        joined = pieces.join(carried, [*self.keys, _CUT])
        joined = joined.withColumns(
            {n: _over(kind, F.col(c), inside.rowsBetween(*(onwards if kind == "next" else so_far)))
             for n, (kind, c) in columns.items()}
        )
        joined = joined.withColumns(
            {n: _combine(kind, F.col(n), F.col(f"_c_{n}")) for n, (kind, _) in columns.items()}
        )
        return self._clean(joined.drop(*[f"_c_{n}" for n in columns]))


def _over(kind: str, value: Column, window: WindowSpec) -> Column:
    if kind == "last":
        return F.last(value, ignorenulls=True).over(window)
    if kind == "next":
        return F.first(value, ignorenulls=True).over(window)
    return {"sum": F.sum, "min": F.min, "max": F.max}[kind](value).over(window)


def _summarise(kind: str, value: Column) -> Column:
    known = F.when(value.isNotNull(), F.col(_POS))
    if kind == "last":
        return F.max_by(value, known)
    if kind == "next":
        return F.min_by(value, known)
    return {"sum": F.sum, "min": F.min, "max": F.max}[kind](value)


def _combine(kind: str, inside: Column, carried: Column) -> Column:
    if kind == "sum":
        return F.when(inside.isNull(), carried).otherwise(inside + F.coalesce(carried, F.lit(0)))
    if kind in ("last", "next"):
        return F.coalesce(inside, carried)
    return F.least(inside, carried) if kind == "min" else F.greatest(inside, carried)


def arrange(df: DataFrame, keys: Sequence[str], order: Sequence, limit: int | None = None,
            longest: int | None = None) -> Ordered:
    """Prepare ordered work on ``df``; ``order`` must be unique within a key.

    ``longest`` is the row count of the largest key where the caller knows it, which saves the count.
    """
    keys, order = list(keys), list(order)
    limit = limit or rows_per_task(df.sparkSession)
    largest = longest if longest is not None else largest_group(df, keys)
    if largest <= limit:
        return Ordered(df, keys, order, None)
    return Ordered(_numbered(df, keys, order, limit), keys, order, limit)


def _numbered(df: DataFrame, keys: list[str], order: list, limit: int) -> DataFrame:
    """Add ``_pos`` by one range shuffle and a written table; no task holds a whole key."""
    parallel = df.sparkSession.sparkContext.defaultParallelism
    pieces = int(max(parallel, min(100_000, -(-df.count() // limit))))
    sort_by = [F.col(k) for k in keys] + [F.col(o) if isinstance(o, str) else o for o in order]
    laid = (
        df.repartitionByRange(pieces, *sort_by)
        .sortWithinPartitions(*sort_by)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    laid = materialize(laid, "ordered")
    laid = laid.withColumn("_part", F.shiftright("_at", _BITS_IN_PARTITION))
    runs = laid.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    earlier = _partition_by(keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    placed = laid.join(runs, [*keys, "_part"])
    return placed.withColumn(_POS, F.col("_before") + F.col("_at") - F.col("_first")).drop(
        "_at", "_part", "_before", "_first"
    )


def percent_rank_of_ties(df: DataFrame, value: str, name: str, keys: Sequence[str] = (),
                         limit: int | None = None) -> DataFrame:
    """Average rank of ties divided by the number of non-null values.

    Equal values are counted first, so the ordered work runs over distinct values only.
    """
    keys = list(keys)
    limit = limit or rows_per_task(df.sparkSession)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_ties"))
    ranked = arrange(counts, keys, [value], limit).running({"_upto": ("sum", "_ties")})
    totals = counts.groupBy(*keys).agg(F.sum("_ties").alias("_all"))
    if keys:
        ranked = ranked.join(totals, keys)
    else:
        ranked = ranked.withColumn("_all", totals.scalar())
    ranked = ranked.withColumn(
        name, (F.col("_upto") - (F.col("_ties") - 1) / 2) / F.col("_all")
    ).drop("_upto", "_all")
    return lookup_join(df, ranked, [*keys, value], "_ties", limit).drop("_ties")


def lookup_join(rows: DataFrame, table: DataFrame, on: list[str], count: str, limit: int) -> DataFrame:
    """Left join rows to a table with one line per key and its row count.

    Keys with more than ``limit`` rows are broadcast, so no shuffle partition receives a hot key; the
    others join by shuffle. If there are more than 50,000 of them the most frequent are broadcast, and
    each other key has less than a 50,000th of all rows.
    """
    hottest = table.filter(F.col(count) > limit).select(count).orderBy(F.desc(count)).limit(_MOST_HOT + 1)
    facts = hottest.agg(F.count(F.lit(1)).alias("n"), F.min(count).alias("least")).first()
    if not facts["n"]:
        return rows.join(table, on, "left")
    if facts["n"] > _MOST_HOT:
        limit = facts["least"]
    hot = F.broadcast(table.filter(F.col(count) > limit))
    cold = table.filter(F.col(count) <= limit)
    return rows.join(hot, on).unionByName(
        rows.join(hot.select(*on), on, "left_anti").join(cold, on, "left")
    )


def spread_join(left: DataFrame, right: DataFrame, on: Sequence[str], limit: int) -> DataFrame:
    """Left join that gives no task all rows of a frequent key.

    The rows of a key with more than ``limit`` rows on the left are dealt over shares by a hash of the
    row, and the key's rows on the right are repeated once a share. Shares are broadcast, at most 50,000
    lines: beyond that the most frequent keys are spread, and each other key has less than a 50,000th of
    all rows. Null keys match nothing and are spread too.
    """
    on = list(on)
    sizes = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > limit)
    shares = materialize(sizes.orderBy(F.desc("_rows"), *on).limit(_MOST_HOT).select(
        *on, F.ceil(F.col("_rows") / F.lit(limit)).alias("_shares")), "hot-keys")
    if not shares.limit(1).count():
        return left.join(right, on, "left")
    shares, one = F.broadcast(shares), F.lit(1).cast("bigint")
    row = F.xxhash64(*[f.name for f in left.schema.fields if "map<" not in f.dataType.simpleString()])
    known = F.lit(True)
    for key in on:
        known = known & F.col(key).isNotNull()
    dealt = left.join(shares, on, "left").withColumn(
        "_share", F.when(known, F.pmod(row, F.coalesce("_shares", one))).otherwise(row)).drop("_shares")
    repeated = right.join(shares, on, "left").withColumn(
        "_share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_shares", one) - 1))).drop("_shares")
    return dealt.join(repeated, [*on, "_share"], "left").drop("_share")
