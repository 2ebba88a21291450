"""Profiling and validation queries (two passes over the readings at most, plus ordered gaps)."""

from pyspark.sql import functions as F

from wattline.operators import quality
from wattline.plans.catalogue import LINES, READINGS, query
from wattline.sources.readings import line_readings, readings

KWH = "consumption_kwh"
MEASURES = [KWH, "voltage", "load_factor", "temperature"]


def _per_column(template, columns, cte=READINGS, source="rd"):
    return f"WITH {cte} " + " UNION ALL ".join(template.format(c=c, t=source) for c in columns)


@query("C1_required_columns", """
SELECT 'ts' AS "column", TRUE AS present, count(ts) AS known FROM events
UNION ALL SELECT 'consumption_kwh', TRUE, count(value) FROM events
UNION ALL SELECT 'voltage', FALSE, 0
""", ints="known")
def _(spark, folder):
    return quality.column_check(readings(spark, folder).drop("voltage"), "full")


@query("C2_shape_and_span", f"""
WITH {READINGS} SELECT count(*) AS total_rows, CAST(8 AS BIGINT) AS total_columns, min(ts) AS start, max(ts) AS "end",
  CAST(floor(epoch(max(ts) - min(ts)) / 86400) AS BIGINT) AS duration_days FROM rd
""", times='start "end"')
def _(spark, folder):
    return quality.shape_and_span(readings(spark, folder))


_GAPS = """d AS (SELECT series_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY series_id ORDER BY ts)) AS us FROM {t}),
m AS (SELECT series_id, quantile_cont(us / 1000000.0, 0.5) AS median_seconds FROM d WHERE us IS NOT NULL GROUP BY 1),
g AS (SELECT m.series_id, median_seconds, count(*) FILTER (WHERE us / 1000000.0 > 2 * median_seconds) AS gaps
      FROM m JOIN d ON m.series_id = d.series_id GROUP BY 1, 2)"""
_LABEL = """CASE WHEN median_seconds < 60 THEN CAST(floor(median_seconds) AS BIGINT) || 's (sub-minute)'
  WHEN median_seconds < 3600 THEN CAST(floor(median_seconds / 60) AS BIGINT) || 'min'
  WHEN median_seconds < 86400 THEN CAST(floor(median_seconds / 3600) AS BIGINT) || 'h (hourly)'
  ELSE CAST(floor(median_seconds / 86400) AS BIGINT) || 'd (daily)' END AS frequency"""


@query("C3_gaps_per_series", f"""
WITH {READINGS}, {_GAPS.format(t='rd')} SELECT series_id, median_seconds, gaps, {_LABEL} FROM g
""", floats="median_seconds")
def _(spark, folder):
    return quality.gaps(readings(spark, folder))


@query("C3_gaps_with_equal_times", f"""
WITH {LINES}, {_GAPS.format(t='lr')} SELECT series_id, median_seconds, gaps, {_LABEL} FROM g
""", floats="median_seconds")
def _(spark, folder):
    return quality.gaps(line_readings(spark, folder))


@query("C4_sampling_frequency", f"""
WITH {READINGS}, d AS (SELECT epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts)) AS us FROM rd),
g AS (SELECT quantile_cont(us / 1000000.0, 0.5) AS median_seconds FROM d WHERE us IS NOT NULL)
SELECT median_seconds, {_LABEL} FROM g
""", floats="median_seconds")
def _(spark, folder):
    return quality.gaps(readings(spark, folder), keys=[]).select("median_seconds", "frequency")


@query("C5_missing_share", _per_column("""
SELECT '{c}' AS "column", 100.0 * (count(*) - count({c})) / count(*) AS missing_pct,
  CASE WHEN 100.0 * (count(*) - count({c})) / count(*) > 20 THEN 'error'
       WHEN count({c}) < count(*) THEN 'warning' ELSE 'ok' END AS level FROM {t}
""", MEASURES), floats="missing_pct")
def _(spark, folder):
    return quality.missing_share(readings(spark, folder), MEASURES)


@query("C6_negative_values", f"""
WITH r AS (SELECT c_acctbal AS balance, CAST(c_custkey AS DOUBLE) AS custkey FROM customer)
SELECT 'balance' AS "column", count(*) FILTER (WHERE balance < 0) AS negative FROM r
UNION ALL SELECT 'custkey', count(*) FILTER (WHERE custkey < 0) FROM r
""")
def _(spark, folder):
    accounts = spark.read.parquet(f"{folder}/customer.parquet").select(
        F.col("c_acctbal").alias("balance"), F.col("c_custkey").cast("double").alias("custkey"))
    return quality.negative_counts(accounts, ["balance", "custkey"])


@query("C7_constant_columns", _per_column("""
SELECT '{c}' AS "column", count(DISTINCT {c}) = 1 AS constant FROM (SELECT *, 230.0 AS nominal FROM {t})
""", MEASURES + ["nominal"]))
def _(spark, folder):
    table = readings(spark, folder).withColumn("nominal", F.lit(230.0))
    return quality.constant_columns(table, MEASURES + ["nominal"])


@query("C8_column_stats", _per_column("""
SELECT '{c}' AS "column", min({c}) AS min, max({c}) AS max, avg({c}) AS mean, stddev_samp({c}) AS std,
  100.0 * (count(*) - count({c})) / count(*) AS missing_pct FROM {t}
""", MEASURES), floats="min max mean std missing_pct")
def _(spark, folder):
    return quality.column_stats(readings(spark, folder), MEASURES)


@query("C9_duplicates", f"""
WITH {LINES}, b AS (SELECT series_id, ts, consumption_kwh, status FROM lr)
SELECT (SELECT count(*) FROM b) - (SELECT count(*) FROM (SELECT DISTINCT * FROM b)) AS duplicate_rows,
       (SELECT count(*) FROM b) - (SELECT count(*) FROM (SELECT DISTINCT series_id, ts FROM b)) AS duplicate_times
""")
def _(spark, folder):
    return quality.duplicate_counts(line_readings(spark, folder).select("series_id", "ts", KWH, "status"), ["series_id"])


@query("C10_coverage", f"""
WITH {READINGS}, s AS (SELECT count(*) AS total_rows,
  CAST(floor(epoch(max(ts) - min(ts)) / 86400) AS BIGINT) AS duration_days FROM rd)
SELECT *, CASE WHEN duration_days < 7 THEN 'below_7_days' WHEN duration_days < 30 THEN 'below_30_days' ELSE 'ok' END AS coverage,
  total_rows < 24 AS too_few_rows FROM s
""")
def _(spark, folder):
    return quality.coverage(readings(spark, folder))


_OUTLIERS = """
SELECT '{c}' AS "column", count(*) FILTER (WHERE abs(({c} - a) / s) > 3) AS count,
  100.0 * count(*) FILTER (WHERE abs(({c} - a) / s) > 3) / count(*) AS percentage
FROM {t}, (SELECT avg({c}) AS a, stddev_samp({c}) AS s FROM {t}) HAVING count(*) FILTER (WHERE abs(({c} - a) / s) > 3) > 0
"""


@query("C11_outliers", _per_column(_OUTLIERS, MEASURES), floats="percentage")
def _(spark, folder):
    return quality.outlier_summary(readings(spark, folder), MEASURES)


@query("C11_outliers_softened",
       _per_column(_OUTLIERS.replace("/ s)", "/ (s + 1e-8))"), MEASURES), floats="percentage")
def _(spark, folder):
    return quality.outlier_summary(readings(spark, folder), MEASURES, least=10, softened=True)


_FINDINGS = f"""WITH {READINGS}, {_GAPS.format(t='rd')},
s AS (SELECT CAST(floor(epoch(max(ts) - min(ts)) / 86400) AS DOUBLE) AS days,
  100.0 * (count(*) - count(voltage)) / count(*) AS mv FROM rd),
far AS ({" UNION ALL ".join(_OUTLIERS.format(c=c, t="rd") for c in MEASURES)}),
f AS (
  SELECT 'missing_values' AS rule, CASE WHEN mv > 20 THEN 'error' ELSE 'warning' END AS level, 'voltage' AS "column", mv AS value
  FROM s WHERE mv > 0
  UNION ALL SELECT CASE WHEN days < 7 THEN 'covers_under_7_days' ELSE 'covers_under_30_days' END, 'warning', 'ts', days FROM s WHERE days < 30
  UNION ALL SELECT 'time_gaps', 'warning', 'ts', sum(gaps) FROM g HAVING sum(gaps) > 0
  UNION ALL SELECT 'outliers', 'warning', "column", count FROM far)"""


@query("C12_findings", _FINDINGS + " SELECT * FROM f", floats="value")
def _(spark, folder):
    return quality.validate(readings(spark, folder), "full")


@query("C12_short_table", f"""
WITH {READINGS}, s AS (SELECT CAST(floor(epoch(max(ts) - min(ts)) / 86400) AS DOUBLE) AS days FROM rd WHERE ts < TIMESTAMP '2024-01-04')
SELECT CASE WHEN days < 7 THEN 'covers_under_7_days' ELSE 'covers_under_30_days' END AS rule, days AS value FROM s WHERE days < 30
""", floats="value")
def _(spark, folder):
    found = quality.validate(readings(spark, folder).filter("ts < TIMESTAMP '2024-01-04'"), "full")
    return found.filter(F.col("rule").startswith("covers")).select("rule", "value")


@query("C12_verdict", _FINDINGS + """
SELECT count(*) FILTER (WHERE level = 'error') AS errors, count(*) FILTER (WHERE level = 'warning') AS warnings,
  count(*) FILTER (WHERE level = 'error') = 0 AS is_valid FROM f
""")
def _(spark, folder):
    return quality.verdict(quality.validate(readings(spark, folder), "full"))


def _two(x, digits=2):
    return f"printf('%.{digits}f', {x})"


@query("C13_quality_report", _FINDINGS + f""",
v AS (SELECT count(*) FILTER (WHERE level = 'error') AS e, count(*) FILTER (WHERE level = 'warning') AS w FROM f),
dd AS (SELECT epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY series_id ORDER BY ts)) AS us FROM rd),
mm AS (SELECT quantile_cont(us / 1000000.0, 0.5) AS median_seconds FROM dd WHERE us IS NOT NULL),
cs AS (SELECT 'consumption_kwh' AS c, min(consumption_kwh) AS mn, max(consumption_kwh) AS mx, avg(consumption_kwh) AS av,
         stddev_samp(consumption_kwh) AS sd, 100.0 * (count(*) - count(consumption_kwh)) / count(*) AS mi FROM rd
       UNION ALL SELECT 'voltage', min(voltage), max(voltage), avg(voltage), stddev_samp(voltage),
         100.0 * (count(*) - count(voltage)) / count(*) FROM rd)
SELECT 'status' AS section, 'all' AS item, 'is_valid' AS metric, CASE WHEN e = 0 THEN 'true' ELSE 'false' END AS value FROM v
UNION ALL SELECT 'status', 'all', 'errors', CAST(e AS VARCHAR) FROM v
UNION ALL SELECT 'status', 'all', 'warnings', CAST(w AS VARCHAR) FROM v
UNION ALL SELECT 'dataset', 'all', 'total_rows', CAST(count(*) AS VARCHAR) FROM rd
UNION ALL SELECT 'dataset', 'all', 'total_columns', '8'
UNION ALL SELECT 'dataset', 'all', 'start', strftime(min(ts), '%Y-%m-%d %H:%M:%S') FROM rd
UNION ALL SELECT 'dataset', 'all', 'end', strftime(max(ts), '%Y-%m-%d %H:%M:%S') FROM rd
UNION ALL SELECT 'dataset', 'all', 'duration_days', CAST(CAST(days AS BIGINT) AS VARCHAR) FROM s
UNION ALL SELECT 'dataset', 'all', 'sampling_frequency', frequency FROM (SELECT {_LABEL} FROM mm)
UNION ALL SELECT 'columns', c, 'min', {_two('mn')} FROM cs
UNION ALL SELECT 'columns', c, 'max', {_two('mx')} FROM cs
UNION ALL SELECT 'columns', c, 'mean', {_two('av')} FROM cs
UNION ALL SELECT 'columns', c, 'std', {_two('sd')} FROM cs
UNION ALL SELECT 'columns', c, 'missing_pct', {_two('mi', 1)} FROM cs
UNION ALL SELECT 'outliers', "column", 'count', CAST(count AS VARCHAR) FROM far
UNION ALL SELECT 'outliers', "column", 'percentage', {_two('percentage')} FROM far
UNION ALL SELECT level || 's', coalesce("column", 'all'), rule, {_two('value')} FROM f
""")
def _(spark, folder):
    return quality.quality_report(readings(spark, folder), "full")


@query("C14_table_comparison", """
WITH parts AS (
  SELECT 'consumption_kwh' AS "column", l_quantity AS v, l_shipdate < TIMESTAMP '1998-01-01' AS p FROM lineitem
  UNION ALL SELECT 'cost', l_extendedprice, l_shipdate < TIMESTAMP '1998-01-01' FROM lineitem),
b AS (SELECT "column", min(v) AS lo, max(v) AS hi, count(*) FILTER (WHERE p) AS np, count(*) FILTER (WHERE NOT p) AS nq,
        avg(v) FILTER (WHERE p) AS left_mean, avg(v) FILTER (WHERE NOT p) AS right_mean,
        stddev_samp(v) FILTER (WHERE p) AS left_std, stddev_samp(v) FILTER (WHERE NOT p) AS right_std FROM parts GROUP BY 1),
h AS (SELECT "column", least(floor((v - lo) / (hi - lo) * 50), 49) AS bin, count(*) FILTER (WHERE p) AS cp,
        count(*) FILTER (WHERE NOT p) AS cq FROM parts JOIN b USING ("column") GROUP BY 1, 2),
g AS (SELECT "column", unnest(generate_series(0, 49)) AS bin FROM b),
d AS (SELECT g."column", coalesce(cp, 0) / np / ((hi - lo) / 50) + 1e-10 AS pd, coalesce(cq, 0) / nq / ((hi - lo) / 50) + 1e-10 AS qd
      FROM g JOIN b USING ("column") LEFT JOIN h ON g."column" = h."column" AND g.bin = h.bin),
s AS (SELECT "column", sum(pd) AS sp, sum(qd) AS sq FROM d GROUP BY 1)
SELECT "column", left_mean, right_mean, left_std, right_std, kl FROM b
JOIN (SELECT "column", sum(pd / sp * ln((pd / sp) / (qd / sq))) AS kl FROM d JOIN s USING ("column") GROUP BY 1) USING ("column")
""", floats="left_mean right_mean left_std right_std kl")
def _(spark, folder):
    lines = line_readings(spark, folder)
    early = F.col("ts") < F.lit("1998-01-01").cast("timestamp")
    return quality.compare_tables(lines.filter(early), lines.filter(~early), [KWH, "cost"])


@query("C15_error_codes", """
SELECT 'bare' AS source, 'INVALID_COLUMNS' AS error_code, CAST(1 AS BIGINT) AS failed_rules
UNION ALL SELECT 'debts', CASE WHEN count(*) FILTER (WHERE c_acctbal < 0) > 0 THEN 'CORRUPTED_FILE' ELSE 'OK' END,
  CASE WHEN count(*) FILTER (WHERE c_acctbal < 0) > 0 THEN 1 ELSE 0 END FROM customer
UNION ALL SELECT 'meters', 'OK', 0
""", ints="failed_rules")
def _(spark, folder):
    meters = readings(spark, folder)
    accounts = spark.read.parquet(f"{folder}/customer.parquet").select(
        F.timestamp_seconds(F.col("c_custkey") * 3600).alias("ts"), F.col("c_acctbal").alias(KWH))
    parts = [("bare", meters.drop(KWH)), ("debts", accounts), ("meters", meters)]
    done = [quality.classify_errors(quality.validate(t)).withColumn("source", F.lit(n)) for n, t in parts]
    return done[0].unionByName(done[1]).unionByName(done[2])


@query("C16_unreadable_times", """
SELECT count(*) AS rows, count(*) FILTER (WHERE event_type = 'error') AS unreadable FROM events
""")
def _(spark, folder):
    texts = readings(spark, folder).withColumn(
        "timestamp", F.when(F.col("status") == "error", F.lit("not a time")).otherwise(
            F.date_format("ts", "dd-MM-yyyy HH:mm")))
    return quality.drop_unreadable_times(texts.drop("ts"), "timestamp")[1]


@query("B1_readable_times", """
SELECT event_id AS row_id, date_trunc('minute', ts) AS ts FROM events WHERE event_type <> 'error'
""", times="ts")
def _(spark, folder):
    texts = readings(spark, folder).withColumn(
        "timestamp", F.when(F.col("status") == "error", F.lit("not a time")).otherwise(
            F.date_format("ts", "dd-MM-yyyy HH:mm")))
    return quality.drop_unreadable_times(texts.drop("ts"), "timestamp")[0].select("row_id", "ts")
