"""Profiling and validation of reading tables from few aggregate passes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.operators.ordered import arrange, largest_group
from wattline.operators.quantile import quantiles
from wattline.session import materialize, rows_per_task
from wattline.sources.readings import REQUIRED_COLUMNS, ROW, SERIES, TS

# Thresholds of the validation rules.
MISSING_ERROR_PCT = 20.0
SHORT_DAYS, FULL_DAYS = 7, 30
LEAST_ROWS = 24
OUTLIER_Z = 3.0
NEVER_NEGATIVE = ("consumption_kwh", "voltage", "power")


def long_form(wide: DataFrame, columns: Sequence[str], stats: Sequence[str], label: str = "column") -> DataFrame:
    """Turn one wide row of ``<column>__<stat>`` into one row per column."""
    lines = F.array(*[
        F.struct(F.lit(c).alias(label), *[F.col(f"{c}__{s}").alias(s) for s in stats]) for c in columns
    ])
    return wide.select(F.inline(lines))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in (SERIES, ROW)]


def missing_columns(df: DataFrame, kind: str = "smart_meter") -> list[str]:
    required = REQUIRED_COLUMNS.get(kind, REQUIRED_COLUMNS["smart_meter"])
    return [c for c in required if c not in df.columns]


def column_check(df: DataFrame, kind: str = "smart_meter") -> DataFrame:
    """(column, present, known) for each required column; ``known`` counts its non-null cells."""
    required = REQUIRED_COLUMNS.get(kind, REQUIRED_COLUMNS["smart_meter"])
    wide = df.agg(
        *[F.lit(c in df.columns).alias(f"{c}__present") for c in required],
        *[(F.count(c) if c in df.columns else F.lit(0).cast("bigint")).alias(f"{c}__known") for c in required],
    )
    return long_form(wide, required, ["present", "known"])


def shape_and_span(df: DataFrame, ts: str = TS) -> DataFrame:
    """Rows, columns, first and last time, whole days between them."""
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.lit(len(df.columns)).cast("bigint").alias("total_columns"),
        F.min(ts).alias("start"),
        F.max(ts).alias("end"),
    ).withColumn("duration_days", F.floor((F.unix_micros("end") - F.unix_micros("start")) / F.lit(86_400_000_000)))


def frequency_label(seconds: Column) -> Column:
    """``15min``, ``1h (hourly)`` and so on from a typical interval in seconds."""
    def whole(per: int) -> Column:
        return F.floor(seconds / per).cast("string")

    return (
        F.when(seconds < 60, F.concat(whole(1), F.lit("s (sub-minute)")))
        .when(seconds < 3600, F.concat(whole(60), F.lit("min")))
        .when(seconds < 86400, F.concat(whole(3600), F.lit("h (hourly)")))
        .when(seconds.isNotNull(), F.concat(whole(86400), F.lit("d (daily)")))
    )


def rows_per_time(df: DataFrame, keys: Sequence[str] = (), ts: str = TS) -> DataFrame:
    """(keys, time, _rows) of all known times."""
    return df.filter(F.col(ts).isNotNull()).groupBy(*keys, ts).agg(F.count(F.lit(1)).alias("_rows"))


def intervals(df: DataFrame, keys: Sequence[str] = (), ts: str = TS, times: DataFrame | None = None) -> DataFrame:
    """Seconds since the previous distinct or equal time, counted: (keys, seconds, n).

    Equal times differ by zero, so rows are first counted per time: the ordered step runs
    over distinct times, and a time shared by many rows costs one row. ``times`` are these
    counts where the caller has them.
    """
    keys = list(keys)
    times = rows_per_time(df, keys, ts) if times is None else times
    stepped = arrange(times, keys, [ts]).near({
        "_gap": lambda w: (F.unix_micros(F.col(ts)) - F.unix_micros(F.lag(ts).over(w))) / F.lit(1e6)
    }, back=1)
    between = stepped.filter(F.col("_gap").isNotNull()).groupBy(*keys, F.col("_gap").alias("seconds")).agg(
        F.count(F.lit(1)).alias("n"))
    within = times.groupBy(*keys).agg(F.sum(F.col("_rows") - 1).alias("n")).filter("n > 0")
    return between.unionByName(within.withColumn("seconds", F.lit(0.0)))


def weighted_median(counts: DataFrame, value: str, n: str, keys: Sequence[str] = ()) -> DataFrame:
    """Median of values that occur ``n`` times each."""
    keys = list(keys)
    merged = counts.groupBy(*keys, value).agg(F.sum(n).alias("_n"))
    ranked = arrange(merged, keys, [value]).running({"_upto": ("sum", "_n")})
    totals = merged.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    ranked = ranked.join(totals, keys) if keys else ranked.withColumn("_all", totals.scalar())
    low, high = F.floor((F.col("_all") - 1) / 2), F.ceil((F.col("_all") - 1) / 2)
    picked = ranked.groupBy(*keys).agg(
        F.min(F.when(F.col("_upto") > low, F.col(value))).alias("_lo"),
        F.min(F.when(F.col("_upto") > high, F.col(value))).alias("_hi"),
    )
    return picked.select(*keys, ((F.col("_lo") + F.col("_hi")) / 2).alias("median"))


def gaps(df: DataFrame, keys: Sequence[str] = (SERIES,), ts: str = TS, times: DataFrame | None = None) -> DataFrame:
    """Per key: typical interval, its label and how many intervals exceed twice that."""
    keys = list(keys)
    steps = intervals(df, keys, ts, times)
    limit = rows_per_task(df.sparkSession)
    if largest_group((df if times is None else times).select(*keys), keys) <= limit:  # so a key has at most as many different intervals
        per = steps.groupBy(*keys).agg(
            F.percentile("seconds", F.lit(0.5), F.col("n")).alias("median_seconds"),
            F.collect_list(F.struct("seconds", "n")).alias("_steps"))
        wide = F.filter("_steps", lambda s: s["seconds"] > F.col("median_seconds") * 2)
        return per.select(
            *keys, "median_seconds", F.aggregate(wide, F.lit(0).cast("bigint"), lambda a, s: a + s["n"]).alias("gaps"),
            frequency_label(F.col("median_seconds")).alias("frequency"))
    middle = weighted_median(steps, "seconds", "n", keys)
    if keys:
        joined = steps.join(middle, keys)
    else:  # one row on the right
        joined = steps.withColumn("_k", F.lit(0)).join(F.broadcast(middle.withColumn("_k", F.lit(0))), "_k")
    found = joined.groupBy(*keys).agg(
        F.first("median").alias("median_seconds"),
        F.sum(F.when(F.col("seconds") > F.col("median") * 2, F.col("n")).otherwise(0)).alias("gaps"),
    )
    return found.withColumn("frequency", frequency_label(F.col("median_seconds")))


def missing_share(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    wide = df.agg(*[(F.avg(F.col(c).isNull().cast("int")) * 100).alias(f"{c}__missing_pct") for c in columns])
    pct = F.col("missing_pct")
    level = F.when(pct > MISSING_ERROR_PCT, "error").when(pct > 0, "warning").otherwise("ok")
    return long_form(wide, columns, ["missing_pct"]).withColumn("level", level)


def negative_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    wide = df.agg(*[F.count_if(F.col(c) < 0).alias(f"{c}__negative") for c in columns])
    return long_form(wide, columns, ["negative"])


def constant_columns(df: DataFrame, columns: Sequence[str], empty_counts: bool = False) -> DataFrame:
    """A column is constant when its least and greatest values agree; no distinct count is needed."""
    made = []
    for c in columns:
        constant = F.min(c) == F.max(c)
        made.append(F.coalesce(constant, F.lit(empty_counts)).alias(f"{c}__constant"))
    return long_form(df.agg(*made), columns, ["constant"])


def column_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    made = []
    for c in columns:
        made += [
            F.min(c).cast("double").alias(f"{c}__min"), F.max(c).cast("double").alias(f"{c}__max"),
            F.avg(c).alias(f"{c}__mean"), F.stddev_samp(c).alias(f"{c}__std"),
            (F.avg(F.col(c).isNull().cast("int")) * 100).alias(f"{c}__missing_pct"),
        ]
    return long_form(df.agg(*made), columns, ["min", "max", "mean", "std", "missing_pct"])


_ONE, _TWO = "_digest_one", "_digest_two"


def _digests(df: DataFrame) -> list[Column]:
    """128 bits of a whole row; equal rows have equal digests."""
    cells = [F.to_json(F.struct(c)) if "map<" in kind else F.col(c) for c, kind in df.dtypes]
    nulls = [F.col(c).isNull() for c in df.columns]
    return [F.xxhash64(*cells, *nulls).alias(_ONE), F.xxhash64(F.lit(7), *nulls, *cells).alias(_TWO)]


def row_marks(df: DataFrame, keys: Sequence[str] = (), ts: str = TS) -> DataFrame:
    """(keys, time, digests, n): the narrow table behind the counts of equal rows and of equal times, and behind the gaps."""
    return df.select(*keys, ts, *_digests(df)).groupBy(*keys, ts, _ONE, _TWO).agg(F.count(F.lit(1)).alias("n"))


def equal_rows(df: DataFrame, marks: DataFrame) -> DataFrame:
    """One row: rows beyond the first of each set of equal ones.

    Only rows whose digest occurs twice are compared in full, so that a table is not shuffled whole.
    """
    twice = marks.where("n > 1").select(F.col(_ONE).alias("_one"), F.col(_TWO).alias("_two")).distinct()
    if twice.limit(_FEW + 1).count() <= _FEW:
        twice = F.broadcast(twice)
    marked = df.select("*", *_digests(df))
    same = marked.join(twice, (F.col(_ONE) == F.col("_one")) & (F.col(_TWO) == F.col("_two")), "left_semi").drop(_ONE, _TWO)
    counts = same.groupBy(*[F.to_json(F.struct(c)).alias(c) if "map<" in kind else F.col(c) for c, kind in df.dtypes]).count()
    return counts.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_rows"))


#: Digests that are broadcast at most; they are two numbers each.
_FEW = 100_000


def duplicate_counts(df: DataFrame, keys: Sequence[str] = (), ts: str = TS, marks: DataFrame | None = None) -> DataFrame:
    """Rows beyond the first of each equal row, and of each (key, time)."""
    marks = materialize(row_marks(df, keys, ts), "row-marks") if marks is None else marks
    timed = marks.groupBy(*keys, ts).agg(F.sum("n").alias("n")).agg(F.sum(F.col("n") - 1).alias("duplicate_times"))
    return timed.select(equal_rows(df, marks).scalar().alias("duplicate_rows"), F.coalesce("duplicate_times", F.lit(0)).alias("duplicate_times"))


def coverage(df: DataFrame, ts: str = TS) -> DataFrame:
    """Rule on covered days, and the least number of rows."""
    days, rows = F.col("duration_days"), F.col("total_rows")
    rule = F.when(days < SHORT_DAYS, "below_7_days").when(days < FULL_DAYS, "below_30_days").otherwise("ok")
    return shape_and_span(df, ts).select(
        "total_rows", "duration_days", rule.alias("coverage"), (rows < LEAST_ROWS).alias("too_few_rows"))


def outlier_summary(df: DataFrame, columns: Sequence[str], cut: float = OUTLIER_Z, least: int = 0,
                    softened: bool = False, moments: Column | None = None) -> DataFrame:
    """Count and share of values beyond ``cut`` sample deviations, columns without any left out.

    ``softened`` adds 1e-8 to the deviation and, with ``least``, skips columns with few values. ``moments`` has mean and
    deviation of each column (``<column>_m``, ``<column>_s``) where the caller knows them.
    """
    if moments is None:
        moments = df.agg(
            *[F.avg(c).alias(f"{c}_m") for c in columns], *[F.stddev_samp(c).alias(f"{c}_s") for c in columns]
        ).select(F.struct("*")).scalar()
    made = []
    for c in columns:
        spread = moments[f"{c}_s"] + F.lit(1e-8) if softened else moments[f"{c}_s"]
        made.append(F.count_if(F.abs(F.try_divide(F.col(c) - moments[f"{c}_m"], spread)) > cut).alias(f"{c}__count"))
        made.append(F.count(c).alias(f"{c}__known"))
        made.append(F.count(F.lit(1)).alias(f"{c}__rows"))
    found = long_form(df.agg(*made), columns, ["count", "known", "rows"])
    return found.filter((F.col("count") > 0) & (F.col("known") >= least)).select(
        "column", "count", (F.col("count") / F.col("rows") * 100).alias("percentage"))


def validate(df: DataFrame, kind: str = "smart_meter", ts: str = TS, bad_times: int = 0,
             need_rows: bool = False) -> DataFrame:
    """Every rule that fired: (rule, level, column, value). Errors make the table invalid.

    The table is read three times: once for all facts of single columns, once for the narrow table of times and digests
    that gaps and duplicates are read from, once to count outliers by the moments of the first pass. Rows whose digest
    occurs twice are read once more.
    """
    spark, schema = df.sparkSession, "rule string, level string, `column` string, value double"
    lacking = missing_columns(df, kind)
    if lacking:
        return spark.createDataFrame([("missing_column", "error", c, None) for c in lacking], schema)
    required = [c for c in REQUIRED_COLUMNS.get(kind, REQUIRED_COLUMNS["smart_meter"]) if c != ts]
    aggregates = [F.count(F.lit(1)).alias("rows"),
                  F.floor((F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / F.lit(86_400_000_000)).alias("days")]
    for c in required:
        aggregates += [
            (F.avg(F.col(c).isNull().cast("int")) * 100).alias(f"{c}__missing"),
            F.count_if(F.col(c) < 0).alias(f"{c}__negative"),
            (F.min(c) == F.max(c)).alias(f"{c}__constant"),
        ]
    numbers = numeric_columns(df)
    for c in numbers:
        aggregates += [F.avg(c).alias(f"{c}__m"), F.stddev_samp(c).alias(f"{c}__s")]
    one = materialize(df.agg(*aggregates), "profile")

    def line(rule, level, column, value, fired):
        return F.when(fired, F.struct(
            F.lit(rule).alias("rule"), F.lit(level).alias("level") if isinstance(level, str) else level.alias("level"),
            F.lit(column).cast("string").alias("column"), value.cast("double").alias("value")))

    lines = []
    for c in required:
        missing, negative = F.col(f"{c}__missing"), F.col(f"{c}__negative")
        lines.append(line("missing_values", F.when(missing > MISSING_ERROR_PCT, "error").otherwise("warning"),
                          c, missing, missing > 0))
        if c in NEVER_NEGATIVE:
            lines.append(line("negative_values", "error", c, negative, negative > 0))
        lines.append(line("constant_column", "warning", c, F.lit(1), F.col(f"{c}__constant")))
    short = F.col("days") < SHORT_DAYS
    lines.append(line("covers_under_7_days", "warning", ts, F.col("days"), short))
    lines.append(line("covers_under_30_days", "warning", ts, F.col("days"), ~short & (F.col("days") < FULL_DAYS)))
    if need_rows:
        lines.append(line("too_few_rows", "error", None, F.col("rows"), F.col("rows") < LEAST_ROWS))
    if bad_times:
        lines.append(line("unreadable_times", "error", ts, F.lit(bad_times), F.lit(True)))
    parts = [one.select(F.inline(F.array_compact(F.array(*lines))))]

    by = [c for c in (SERIES,) if c in df.columns]
    body = df.select(*[c for c in df.columns if c != ROW])
    marks = materialize(row_marks(body, by, ts), "row-marks")
    times = materialize(marks.filter(F.col(ts).isNotNull()).groupBy(*by, ts).agg(F.sum("n").alias("_rows")), "rows-per-time")
    gap = gaps(df, by, ts, times)
    gap = (gap.agg(F.sum("gaps").alias("gaps")) if by else gap).select(F.col("gaps").cast("double").alias("value"))
    parts.append(gap.filter("value > 0").select(
        F.lit("time_gaps").alias("rule"), F.lit("warning").alias("level"), F.lit(ts).alias("column"), "value"))
    parts.append(equal_rows(body, marks).filter("duplicate_rows > 0").select(
        F.lit("duplicate_rows").alias("rule"), F.lit("warning").alias("level"),
        F.lit(None).cast("string").alias("column"), F.col("duplicate_rows").cast("double").alias("value")))
    far = outlier_summary(df, numbers, moments=one.select(F.struct(*[
        F.col(f"{c}__{stat}").alias(f"{c}_{stat}") for c in numbers for stat in "ms"])).scalar())
    parts.append(far.select(F.lit("outliers").alias("rule"), F.lit("warning").alias("level"), "column",
                            F.col("count").cast("double").alias("value")))
    return reduce(DataFrame.unionByName, parts)


def verdict(findings: DataFrame) -> DataFrame:
    """Errors, warnings and whether the table is usable."""
    return findings.agg(
        F.count_if(F.col("level") == "error").alias("errors"),
        F.count_if(F.col("level") == "warning").alias("warnings"),
    ).withColumn("is_valid", F.col("errors") == 0)


def quality_report(df: DataFrame, kind: str = "smart_meter", ts: str = TS) -> DataFrame:
    """(section, item, metric, value) rows of the data-quality report."""
    def rows(frame, section, item, pairs):
        cells = F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("string").alias("value")) for m, v in pairs])
        return frame.select(F.lit(section).alias("section"), item.alias("item"), F.inline(cells))

    def shown(c):
        return F.format_string("%.2f", F.col(c))

    required = [c for c in REQUIRED_COLUMNS[kind] if c != ts]
    by = [c for c in (SERIES,) if c in df.columns]
    findings = validate(df, kind, ts)
    span = shape_and_span(df, ts)
    steps = weighted_median(intervals(df, by, ts), "seconds", "n")
    parts = [
        rows(verdict(findings), "status", F.lit("all"),
             [("is_valid", F.col("is_valid")), ("errors", F.col("errors")), ("warnings", F.col("warnings"))]),
        rows(span, "dataset", F.lit("all"),
             [("total_rows", F.col("total_rows")), ("total_columns", F.col("total_columns")),
              ("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss")),
              ("end", F.date_format("end", "yyyy-MM-dd HH:mm:ss")), ("duration_days", F.col("duration_days"))]),
        rows(steps, "dataset", F.lit("all"), [("sampling_frequency", frequency_label(F.col("median")))]),
        rows(column_stats(df, required), "columns", F.col("column"),
             [("min", shown("min")), ("max", shown("max")), ("mean", shown("mean")), ("std", shown("std")),
              ("missing_pct", F.format_string("%.1f", F.col("missing_pct")))]),
        rows(outlier_summary(df, numeric_columns(df)), "outliers", F.col("column"),
             [("count", F.col("count")), ("percentage", F.format_string("%.2f", F.col("percentage")))]),
        findings.select(F.concat(F.col("level"), F.lit("s")).alias("section"),
                        F.coalesce("column", F.lit("all")).alias("item"), F.col("rule").alias("metric"),
                        F.format_string("%.2f", F.col("value")).alias("value")),
    ]
    return reduce(DataFrame.unionByName, parts)


def render_report(report: DataFrame) -> str:
    """Markdown of a report table, which has a few dozen rows at most."""
    text, section = ["# Data Quality Report"], None
    for row in report.orderBy("section", "item", "metric").collect():
        if row["section"] != section:
            section = row["section"]
            text += ["", f"## {section.title()}", ""]
        text.append(f"- **{row['item']}** {row['metric']}: {row['value']}")
    return "\n".join(text)


def bin_index(value: Column, low: Column, high: Column, bins: int) -> Column:
    """0-based equal-width bin; the last bin is closed on the right."""
    raw = F.floor(F.try_divide(value - low, high - low) * bins)
    return F.when(value == high, F.lit(bins - 1).cast("bigint")).otherwise(F.least(raw, F.lit(bins - 1).cast("bigint")))


def compare_tables(left: DataFrame, right: DataFrame, columns: Sequence[str], bins: int = 50) -> DataFrame:
    """Mean, deviation and KL divergence of each column between two tables.

    Both tables are stacked once; per column the rows shrink to at most ``2 * bins`` counts.
    """
    def stack(df, side):
        cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])
        return df.select(F.lit(side).alias("side"), F.inline(cells)).filter(F.col("v").isNotNull())

    both = stack(left, "left").unionByName(stack(right, "right"))
    wide = both.groupBy("column").agg(
        F.min("v").alias("lo"), F.max("v").alias("hi"),
        *[fn(F.when(F.col("side") == side, F.col("v"))).alias(f"{side}_{name}")
          for side in ("left", "right") for name, fn in (("mean", F.avg), ("std", F.stddev_samp))],
    )
    bounds = F.broadcast(wide.select("column", "lo", "hi"))  # one row per compared column
    counted = both.join(bounds, "column").groupBy("column", bin_index(
        F.col("v"), F.col("lo"), F.col("hi"), bins).alias("bin")).agg(
        F.count_if(F.col("side") == "left").alias("p"), F.count_if(F.col("side") == "right").alias("q"))
    grid = wide.select("column", "lo", "hi", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))).alias("bin"))
    cells = grid.join(counted, ["column", "bin"], "left").na.fill(0, ["p", "q"])
    totals = cells.groupBy("column").agg(F.sum("p").alias("np"), F.sum("q").alias("nq"))
    width = (F.col("hi") - F.col("lo")) / bins
    dense = cells.join(totals, "column").withColumns({
        "pd": F.try_divide(F.col("p") / F.col("np"), width) + F.lit(1e-10),
        "qd": F.try_divide(F.col("q") / F.col("nq"), width) + F.lit(1e-10)})
    sums = dense.groupBy("column").agg(F.sum("pd").alias("sp"), F.sum("qd").alias("sq"))
    shared = dense.join(sums, "column").withColumns({"ps": F.col("pd") / F.col("sp"), "qs": F.col("qd") / F.col("sq")})
    kl = shared.groupBy("column").agg(F.sum(F.col("ps") * F.log(F.col("ps") / F.col("qs"))).alias("kl"))
    return wide.join(kl, "column").select("column", "left_mean", "right_mean", "left_std", "right_std", "kl")


def classify_errors(findings: DataFrame) -> DataFrame:
    """One status code from the failed rules: missing file, bad columns, else unreadable content."""
    rules = F.collect_set(F.when(F.col("level") == "error", F.col("rule")))
    code = (
        F.when(F.size("rules") == 0, "OK")
        .when(F.array_contains("rules", "missing_file"), "MISSING_FILE")
        .when(F.array_contains("rules", "cannot_open"), "CORRUPTED_FILE")
        .when(F.array_contains("rules", "missing_column"), "INVALID_COLUMNS")
        .otherwise("CORRUPTED_FILE")
    )
    return findings.agg(rules.alias("rules")).select(code.alias("error_code"), F.size("rules").alias("failed_rules"))


def drop_unreadable_times(df: DataFrame, text: str, ts: str = TS) -> tuple[DataFrame, DataFrame]:
    """(rows with a readable time, one-row count of the others)."""
    from wattline.functions.temporal import guess_day_first, parse_timestamp

    if text not in df.columns:
        raise KeyError(f"column '{text}' not found in {df.columns}")
    parsed = df.withColumn(ts, parse_timestamp(F.col(text), guess_day_first(df, text)))
    counts = parsed.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(ts).isNull()).alias("unreadable"))
    return parsed.filter(F.col(ts).isNotNull()), counts
