"""Scans, sinks, scalar functions, joins, search and sorting."""

from pyspark.sql import functions as F

from wattline.functions import labels, numbers, search, temporal
from wattline.functions.labels import domain_ratios
from wattline.operators import features, join, quality, splits
from wattline.operators.quantile import quantiles
from wattline.plans.catalogue import HOURLY, LINES, READINGS, query
from wattline.session import scratch_path
from wattline.sources import readings as src
from wattline.sources import results
from wattline.sources.readings import hourly_total, iot_side, line_readings, readings

KWH = "consumption_kwh"


# --- A: sources and sinks ------------------------------------------------------------------

def _csv_copy(df, spark, label, layout="yyyy-MM-dd HH:mm:ss"):
    path = scratch_path(spark, label)
    df.withColumn("timestamp", F.date_format("ts", layout)).drop("ts").write.option("header", True).csv(path)
    return path


@query("A1_meter_csv_scan", f"""
WITH {READINGS} SELECT row_id, series_id, date_trunc('second', ts) AS ts, consumption_kwh, voltage, status FROM rd
""", floats="consumption_kwh voltage", times="ts")
def _(spark, folder):
    table = readings(spark, folder).select("row_id", "series_id", "ts", KWH, "voltage", "status")
    return src.scan_csv(spark, _csv_copy(table, spark, "meter-csv"))


@query("A1_day_first_csv_scan", f"""
WITH {READINGS} SELECT row_id, date_trunc('minute', ts) AS ts, consumption_kwh FROM rd
""", floats="consumption_kwh", times="ts")
def _(spark, folder):
    table = readings(spark, folder).select("row_id", "ts", KWH)
    return src.scan_csv(spark, _csv_copy(table, spark, "day-first-csv", "dd-MM-yyyy HH:mm"))


@query("A1_columns_in_other_order", f"""
WITH {READINGS} SELECT row_id, series_id, date_trunc('second', ts) AS ts, consumption_kwh,
  CASE WHEN row_id % 3 < 2 THEN voltage END AS voltage, CASE WHEN row_id % 3 > 0 THEN load_factor END AS load_factor FROM rd
""", floats="consumption_kwh voltage load_factor", times="ts")
def _(spark, folder):
    """Three files: other column orders, and columns that only some of them have."""
    table = readings(spark, folder).withColumn("timestamp", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    path = scratch_path(spark, "mixed-headers")
    layouts = (["row_id", "series_id", "timestamp", KWH, "voltage"], ["voltage", "load_factor", KWH, "timestamp", "series_id", "row_id"],
               ["load_factor", "timestamp", "row_id", KWH, "series_id"])
    for i, names in enumerate(layouts):
        table.filter(F.col("row_id") % 3 == i).select(*names).write.mode("append").option("header", True).csv(path)
    return src.scan_csv(spark, path).select("row_id", "series_id", "ts", KWH, "voltage", "load_factor")


@query("A1_layout_of_each_file", f"""
WITH {READINGS} SELECT row_id, date_trunc('day', ts) AS ts, consumption_kwh FROM rd
""", floats="consumption_kwh", times="ts")
def _(spark, folder):
    """A day-first file beside a month-first file; each has dates that settle its own layout."""
    path = scratch_path(spark, "mixed-layouts")
    for half, layout in enumerate(("dd/MM/yyyy", "MM/dd/yyyy")):
        stamped = readings(spark, folder).filter(F.col("row_id") % 2 == half).select("row_id", KWH, F.date_format("ts", layout).alias("timestamp"))
        stamped.coalesce(1).write.mode("append").option("header", True).csv(path)
    return src.scan_csv(spark, path).select("row_id", "ts", KWH)


@query("A1_unreadable_rows_are_counted", f"""
WITH {READINGS} SELECT count(*) FILTER (WHERE row_id % 11 <> 0) AS kept, count(*) FILTER (WHERE row_id % 11 = 0) AS unreadable,
  CAST(count(*) FILTER (WHERE row_id % 11 = 0) AS DOUBLE) AS reported FROM rd
""", floats="reported")
def _(spark, folder):
    text = F.when(F.col("row_id") % 11 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    path = scratch_path(spark, "unreadable")
    readings(spark, folder).select("row_id", "series_id", text.alias("timestamp"), KWH).write.option("header", True).csv(path)
    scanned = src.scan_csv(spark, path, keep_bad_rows=True)
    bad = scanned.filter("ts IS NULL").count()
    said = quality.validate(scanned.filter("ts IS NOT NULL"), bad_times=bad).filter("rule = 'unreadable_times'").select("value").scalar()
    return scanned.agg(F.count_if(F.col("ts").isNotNull()).alias("kept"), F.count_if(F.col("ts").isNull()).alias("unreadable")).withColumn("reported", said)


_IOT = """iot AS (SELECT date_trunc('hour', CAST(ts AS TIMESTAMP)) AS ts, avg(value) AS pressure,
  CAST(count(*) AS DOUBLE) AS flow_rate FROM events WHERE event_type = 'purchase' GROUP BY 1)"""


@query("A2_iot_csv_scan", f"WITH {_IOT} SELECT ts, pressure, flow_rate FROM iot", floats="pressure flow_rate", times="ts")
def _(spark, folder):
    return src.scan_iot_csv(spark, _csv_copy(iot_side(spark, folder), spark, "iot-csv"))


@query("A3_feature_table_round_trip", f"""
WITH {READINGS} SELECT row_id, series_id, ts, consumption_kwh, load_factor FROM rd
WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-12'
""", floats="consumption_kwh load_factor", times="ts")
def _(spark, folder):
    path = scratch_path(spark, "features")
    results.write_features(readings(spark, folder).select("row_id", "series_id", "ts", KWH, "load_factor"), path, 4)
    return results.read_features(spark, path, "2024-01-10", "2024-01-12")


@query("A4_run_results_round_trip", f"""
WITH {HOURLY} SELECT 'frame' AS artefact, count(*) AS rows, sum(consumption_kwh) AS total FROM ht
UNION ALL SELECT 'predictions', count(*), sum(consumption_kwh) FROM rd
""", floats="total")
def _(spark, folder):
    root = scratch_path(spark, "runs")
    results.save_run({"frame": hourly_total(spark, folder), "predictions": readings(spark, folder)}, root, "run-1")
    tables = results.load_run(spark, root, "run-1")
    parts = [t.agg(F.count(F.lit(1)).alias("rows"), F.sum(KWH).alias("total")).withColumn("artefact", F.lit(n))
             for n, t in tables.items()]
    return parts[0].unionByName(parts[1])


@query("A5_upload_replaces", f"""
WITH {LINES} SELECT series_id, count(*) AS rows, sum(consumption_kwh) AS total FROM lr GROUP BY 1
""", floats="total")
def _(spark, folder):
    landing = scratch_path(spark, "landing")
    stamped = F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp")
    for table in (readings(spark, folder), line_readings(spark, folder)):
        results.replace_upload(table.select("series_id", stamped, KWH), landing)
    return src.scan_csv(spark, landing).groupBy("series_id").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(KWH).alias("total"))


@query("A8_lineage_columns", f"""
WITH {READINGS} SELECT row_id, 'real_sensor' AS data_source, TRUE AS stamped FROM rd
""")
def _(spark, folder):
    marked = src.with_lineage(readings(spark, folder))
    return marked.select("row_id", "data_source", F.col("ingestion_time").isNotNull().alias("stamped"))


@query("A9_quoted_export", """
SELECT event_id, props || ', "' || event_type || '"' AS note, value FROM events
""", floats="value")
def _(spark, folder):
    path = scratch_path(spark, "export")
    noted = spark.read.parquet(f"{folder}/events.parquet").select(
        "event_id", F.concat("props", F.lit(', "'), "event_type", F.lit('"')).alias("note"), "value")
    results.export_csv(noted, path)
    return spark.read.schema("event_id bigint, note string, value double").option("header", True).option(
        "quote", '"').option("escape", '"').csv(path)


@query("A10_settings_merge", """
WITH d AS (SELECT * FROM (VALUES ('alert_consumption_threshold', 500.0), ('alert_anomaly_score_threshold', 0.7),
  ('alert_voltage_deviation', 10.0), ('alert_load_factor_threshold', 0.9)) AS v(name, value)),
o AS (SELECT 'alert_consumption_threshold' AS name, quantile_cont(value, 0.85) AS value FROM events
      UNION ALL SELECT 'extra', avg(value) FROM events)
SELECT coalesce(d.name, o.name) AS name, coalesce(CAST(o.value AS DOUBLE), CAST(d.value AS DOUBLE)) AS value
FROM d FULL JOIN o ON d.name = o.name
""", floats="value")
def _(spark, folder):
    table = readings(spark, folder)
    high = quantiles(table, {"value": (KWH, 0.85)}).select(F.lit("alert_consumption_threshold").alias("name"), "value")
    extra = table.agg(F.avg(KWH).alias("value")).select(F.lit("extra").alias("name"), "value")
    return results.merge_settings(high.unionByName(extra), spark)


@query("A11_cached_results", """
SELECT event_type AS status, count(*) AS n FROM events GROUP BY 1
""")
def _(spark, folder):
    root = scratch_path(spark, "cache")
    table = readings(spark, folder)
    results.put_cached(table.groupBy("status").agg(F.max("row_id").alias("n")), root, "status-counts")
    results.put_cached(table.groupBy("status").agg(F.count(F.lit(1)).alias("n")), root, "status-counts")
    results.put_cached(table.groupBy("status").agg(F.min("row_id").alias("n")), root, "status-counts", ttl_hours=-1)
    results.put_cached(table.groupBy("status").agg(F.min("row_id").alias("n")), root, "other")
    return results.get_cached(spark, root, "status-counts")


# --- B: scalar functions and filters -------------------------------------------------------

@query("B2_calendar_features", """
SELECT event_id AS row_id, hour(ts) AS hour, isodow(ts) - 1 AS day_of_week, dayofyear(ts) AS day_of_year, month(ts) AS month,
  year(ts) AS year, quarter(ts) AS quarter, weekofyear(ts) AS week_of_year, CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend,
  CASE WHEN hour(ts) IN (7, 8, 9, 17, 18, 19, 20) THEN 1 ELSE 0 END AS is_peak_hour FROM events
""", ints="hour day_of_week day_of_year month year quarter week_of_year is_weekend is_peak_hour")
def _(spark, folder):
    return temporal.calendar_features(readings(spark, folder).select("row_id", "ts")).drop("ts")


@query("B3_cyclical_features", """
SELECT event_id AS row_id, sin(2 * pi() * hour(ts) / 24) AS hour_sin, cos(2 * pi() * hour(ts) / 24) AS hour_cos,
  sin(2 * pi() * month(ts) / 12) AS month_sin, cos(2 * pi() * month(ts) / 12) AS month_cos,
  sin(2 * pi() * (isodow(ts) - 1) / 7) AS dow_sin, cos(2 * pi() * (isodow(ts) - 1) / 7) AS dow_cos FROM events
""", floats="hour_sin hour_cos month_sin month_cos dow_sin dow_cos")
def _(spark, folder):
    made = temporal.cyclical_features(temporal.calendar_features(readings(spark, folder).select("row_id", "ts")))
    return made.select("row_id", *[f"{p}_{f}" for p in ("hour", "month", "dow") for f in ("sin", "cos")])


@query("B4_domain_ratios", f"""
WITH {READINGS} SELECT row_id, consumption_kwh / (abs(temperature) + 1) AS consumption_per_degree,
  consumption_kwh / (load_factor + 1e-8) AS apparent_power FROM rd
""", floats="consumption_per_degree apparent_power")
def _(spark, folder):
    return domain_ratios(readings(spark, folder)).select("row_id", "consumption_per_degree", "apparent_power")


@query("B5_min_max_normalise", f"""
WITH {READINGS}, b AS (SELECT min(consumption_kwh) AS cl, max(consumption_kwh) AS ch, min(voltage) AS vl, max(voltage) AS vh FROM rd)
SELECT row_id, (consumption_kwh - cl) / (ch - cl + 1e-8) AS consumption_kwh, (voltage - vl) / (vh - vl + 1e-8) AS voltage FROM rd, b
""", floats="consumption_kwh voltage")
def _(spark, folder):
    return features.normalize(readings(spark, folder), [KWH, "voltage"]).select("row_id", KWH, "voltage")


@query("B5_min_max_parameters", f"""
WITH {READINGS} SELECT 'consumption_kwh' AS "column", min(consumption_kwh) AS min, max(consumption_kwh) AS max FROM rd
UNION ALL SELECT 'voltage', min(voltage), max(voltage) FROM rd
""", floats="min max")
def _(spark, folder):
    return features.min_max_parameters(readings(spark, folder), [KWH, "voltage"])


@query("B6_column_roles", """
WITH h AS (SELECT * FROM events ORDER BY event_id LIMIT 50),
s AS (SELECT count(value) / 50.0 + count(*) FILTER (WHERE value >= 0) / greatest(count(value), 1) * 0.1 AS v FROM h)
SELECT 'time' AS role, 'ts_time' AS "column", CAST(NULL AS DOUBLE) AS score UNION ALL
SELECT 'consumption', 'value', v FROM s UNION ALL SELECT 'voltage', NULL, NULL
""", floats="score")
def _(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet").withColumnRenamed("ts", "ts_time")
    return search.column_roles(events.select("event_id", "ts_time", "event_type", "value"), ["event_id"])


@query("B7_number_parsing", """
SELECT l_orderkey, l_linenumber, l_extendedprice, round(l_extendedprice, 2) AS grouped, round(l_extendedprice, 2) AS continental,
  round(l_extendedprice, 2) AS comma, (floor(l_extendedprice) + 1000) * 1000 + 7 AS thousands, -round(l_extendedprice, 2) AS negative,
  CAST(NULL AS DOUBLE) AS dash
FROM lineitem
""", floats="l_extendedprice grouped continental comma thousands negative dash", digits=2)
def _(spark, folder):
    price = F.col("l_extendedprice")
    english = F.format_number(price, 2)
    swapped = F.translate(english, ",.", ".,")
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    whole = F.regexp_replace(F.format_number((F.floor(price) + 1000) * 1000 + 7, 0), "$", " kWh")
    return lines.select(
        "l_orderkey", "l_linenumber", "l_extendedprice",
        numbers.parse_number(F.concat(F.lit("kWh "), english)).alias("grouped"),
        numbers.parse_number(swapped).alias("continental"),
        numbers.parse_number(F.regexp_replace(F.format_string("%.2f", price), r"\\.", ",")).alias("comma"),
        numbers.parse_number(whole).alias("thousands"),
        numbers.parse_number(F.concat(F.lit("-"), english)).alias("negative"),
        numbers.parse_number(F.lit(" - ")).alias("dash"),
    )


@query("B8_date_parsing", """
SELECT event_id AS row_id, date_trunc('second', ts) AS iso, date_trunc('day', ts) AS slashed,
  CAST(CASE WHEN day(ts) > 12 THEN CAST(ts AS DATE) ELSE make_date(year(ts), day(ts), month(ts)) END AS TIMESTAMP) AS day_first,
  date_trunc('day', ts) AS year_first FROM events
""", times="iso slashed day_first year_first")
def _(spark, folder):
    layouts = {"iso": "yyyy-MM-dd'T'HH:mm:ss", "slashed": "MM/dd/yyyy", "day_first": "dd-MM-yyyy", "year_first": "yyyy/M/d"}
    return readings(spark, folder).select("row_id", *[
        temporal.parse_loose_date(F.date_format("ts", layout)).alias(name) for name, layout in layouts.items()])


@query("B9_date_range", f"""
WITH {READINGS} SELECT row_id FROM rd WHERE status = 'error' OR (ts >= '2024-01-05' AND ts < '2024-01-10')
""")
def _(spark, folder):
    partly = readings(spark, folder).withColumn("ts", F.when(F.col("status") != "error", F.col("ts")))
    return search.within_dates(partly, "2024-01-05", "2024-01-09").select("row_id")


@query("B10_trailing_days", f"""
WITH {READINGS} SELECT row_id, ts FROM rd WHERE ts >= (SELECT max(ts) FROM rd) - INTERVAL 7 DAY AND consumption_kwh > 200
""", times="ts")
def _(spark, folder):
    flagged = readings(spark, folder).withColumn("anomaly_flag", (F.col(KWH) > 200).cast("int"))
    return search.trailing_days(flagged, 7, "anomaly_flag").select("row_id", "ts")


@query("B12_search_sort_page", """
SELECT event_id, event_type, value FROM (SELECT * FROM events WHERE lower(event_type) LIKE '%er%' OR CAST(value AS VARCHAR) LIKE '%er%'
  OR CAST(event_id AS VARCHAR) LIKE '%er%') ORDER BY value DESC, event_id LIMIT 25 OFFSET 50
""", floats="value")
def _(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet").select("event_id", "event_type", "value")
    found = search.sort_typed(search.search_rows(events, "ER"), "value", False, ["event_id"])
    return search.page(found, 2, 25)


@query("B13_feature_columns", """
SELECT 'feature' AS role, "column", n FROM (
  SELECT 'consumption_kwh' AS "column", count(value) AS n FROM events
  UNION ALL SELECT 'load_factor', count(*) FROM events UNION ALL SELECT 'temperature', count(*) FROM events
  UNION ALL SELECT 'voltage', count(*) FILTER (WHERE event_id % 8 <> 0) FROM events)
""")
def _(spark, folder):
    table = readings(spark, folder)
    picked = src.measure_columns(table)
    wide = table.agg(*[F.count(c).alias(c) for c in picked])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in picked])
    return wide.select(F.lit("feature").alias("role"), F.inline(cells))


@query("B14_severity_ladder", """
SELECT event_id AS row_id, CASE WHEN s <= 0.1 THEN 'normal' WHEN s <= 0.3 THEN 'low' WHEN s <= 0.6 THEN 'medium' ELSE 'high' END AS severity,
  CASE WHEN s <= 0.25 THEN 'normal' WHEN s <= 0.5 THEN 'low' WHEN s <= 0.75 THEN 'medium' ELSE 'high' END AS detector_severity
FROM (SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) / 100 AS s FROM events)
""")
def _(spark, folder):
    score = F.col("load_factor")
    return readings(spark, folder).select("row_id", labels.severity(score).alias("severity"),
                                          labels.severity(score, labels.DETECTOR_EDGES).alias("detector_severity"))


HEALTH_SQL = f"""{READINGS}, q AS (SELECT quantile_cont(consumption_kwh, 0.85) AS q85 FROM rd),
hl AS (SELECT *, CASE WHEN points <= 0 THEN 'healthy' WHEN points <= 2 THEN 'warning' ELSE 'critical' END AS health FROM (
  SELECT rd.*, q85, CASE WHEN consumption_kwh > q85 THEN 2 ELSE 0 END
    + CASE WHEN voltage BETWEEN 225 AND 235 THEN 0 ELSE 1 END + CASE WHEN temperature > 35 THEN 1 ELSE 0 END AS points FROM rd, q))"""


def with_health(df):
    """Readings with the rule-based health label."""
    high = quantiles(df, {"q": (KWH, 0.85)}).scalar()
    points = labels.health_points(F.col(KWH), high, F.col("voltage"), F.col("temperature"))
    return df.withColumn("health_points", points).withColumn("health", labels.health_label(F.col("health_points")))


@query("B15_health_labels", f"WITH {HEALTH_SQL} SELECT row_id, points AS health_points, health FROM hl", ints="health_points")
def _(spark, folder):
    return with_health(readings(spark, folder)).select("row_id", "health_points", "health")


@query("B17_rare_class_merge", f"""
WITH {HEALTH_SQL} SELECT row_id, CASE WHEN health = 'critical' AND (SELECT count(*) FROM hl WHERE health = 'critical') < 5
  THEN 'warning' ELSE health END AS label FROM hl
""")
def _(spark, folder):
    from wattline.models.health import merge_rare_class

    return merge_rare_class(with_health(readings(spark, folder)), "health").select("row_id", F.col("health").alias("label"))


@query("B18_peak_probability", f"""
WITH {READINGS}, q AS (SELECT quantile_cont(consumption_kwh, 0.85) AS t FROM rd)
SELECT row_id, round(least(99.0, greatest(1.0, (consumption_kwh - 0.5 * t) / t * 100)), 1) AS probability FROM rd, q
""", floats="probability")
def _(spark, folder):
    table = readings(spark, folder)
    limit = quantiles(table, {"q": (KWH, 0.85)}).scalar()
    return table.select("row_id", labels.peak_probability(F.col(KWH), limit).alias("probability"))


# --- E: joins ------------------------------------------------------------------------------

@query("E1_iot_left_join", f"""
WITH {HOURLY}, {_IOT} SELECT ht.ts, ht.consumption_kwh, pressure, flow_rate FROM ht LEFT JOIN iot ON ht.ts = iot.ts
""", floats="consumption_kwh pressure flow_rate", times="ts")
def _(spark, folder):
    joined = join.with_side_table(hourly_total(spark, folder), iot_side(spark, folder))
    return joined.select("ts", KWH, "pressure", "flow_rate")


@query("E1_side_table_per_series", f"""
WITH {READINGS}, l AS (SELECT row_id, series_id, date_trunc('day', ts) AS ts, consumption_kwh FROM rd),
r AS (SELECT series_id, date_trunc('day', ts) AS ts, avg(voltage) AS pressure FROM rd WHERE status <> 'error' GROUP BY 1, 2)
SELECT l.row_id, l.series_id, l.ts, l.consumption_kwh, r.pressure FROM l LEFT JOIN r ON l.series_id = r.series_id AND l.ts = r.ts
""", floats="consumption_kwh pressure", times="ts")
def _(spark, folder):
    daily = readings(spark, folder).withColumn("ts", F.date_trunc("day", "ts"))
    side = daily.filter("status <> 'error'").groupBy("series_id", "ts").agg(F.avg("voltage").alias("pressure"))
    return join.with_side_table(daily.select("row_id", "series_id", "ts", KWH), side).select("row_id", "series_id", "ts", KWH, "pressure")


@query("E1_join_multiplies_and_suffixes", f"""
WITH {READINGS}, l AS (SELECT date_trunc('day', ts) AS ts, row_id, temperature AS temperature_x FROM rd),
r AS (SELECT date_trunc('day', ts) AS ts, event_type, avg(value) AS temperature_y FROM events GROUP BY 1, 2)
SELECT l.row_id, l.ts, l.temperature_x, r.event_type, r.temperature_y FROM l LEFT JOIN r ON l.ts = r.ts
""", floats="temperature_x temperature_y", times="ts")
def _(spark, folder):
    left = readings(spark, folder).select(F.date_trunc("day", "ts").alias("ts"), "row_id", "temperature")
    right = readings(spark, folder).groupBy(F.date_trunc("day", "ts").alias("ts"), F.col("status").alias("event_type")).agg(
        F.avg(KWH).alias("temperature"))
    return join.with_side_table(left, right)


@query("E2_label_lookup", """
SELECT c_custkey, coalesce(n_name, 'unknown') AS label FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 1) n
ON c_nationkey = n_nationkey
""")
def _(spark, folder):
    customers = spark.read.parquet(f"{folder}/customer.parquet").select("c_custkey", F.col("c_nationkey").alias("code"))
    names = spark.read.parquet(f"{folder}/nation.parquet").filter("n_regionkey <> 1").select(
        F.col("n_nationkey").alias("code"), F.col("n_name").alias("label"))
    return join.with_label(customers, names, "code", "label").select("c_custkey", "label")


@query("E3_horizon_rows", f"""
WITH {READINGS}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC, row_id DESC) AS n FROM rd) WHERE n = 1)
SELECT series_id, step, ts + step * INTERVAL 1 HOUR AS ts, consumption_kwh, temperature
FROM l, (SELECT unnest(generate_series(1, 24)) AS step)
""", floats="consumption_kwh temperature", ints="step", times="ts")
def _(spark, folder):
    return join.horizon_rows(readings(spark, folder), 24).select("series_id", "step", "ts", KWH, "temperature")


@query("E4_statistics_on_rows", f"""
WITH {READINGS} SELECT row_id, consumption_kwh / (SELECT avg(consumption_kwh) FROM rd) AS ratio,
  consumption_kwh - avg(consumption_kwh) OVER (PARTITION BY series_id) AS from_mean FROM rd
""", floats="ratio from_mean")
def _(spark, folder):
    table = join.attach_statistics(readings(spark, folder), {"overall": F.avg(KWH)})
    table = join.attach_statistics(table, {"own": F.avg(KWH)}, ["series_id"])
    return table.select("row_id", (F.col(KWH) / F.col("overall")).alias("ratio"), (F.col(KWH) - F.col("own")).alias("from_mean"))


# --- H: sorts, limits, samples -------------------------------------------------------------

@query("H1_newest_first", f"WITH {HOURLY} SELECT ts, consumption_kwh FROM ht ORDER BY ts DESC", floats="consumption_kwh", times="ts")
def _(spark, folder):
    return hourly_total(spark, folder).select("ts", KWH).orderBy(F.col("ts").desc())


@query("H2_top_series", f"""
WITH {READINGS} SELECT series_id, sum(consumption_kwh) AS total FROM rd GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15
""", floats="total")
def _(spark, folder):
    totals = readings(spark, folder).groupBy("series_id").agg(F.sum(KWH).alias("total"))
    return totals.orderBy(F.col("total").desc(), "series_id").limit(15)


@query("H4_nulls_last", f"""
WITH {READINGS} SELECT row_id, voltage, row_number() OVER (ORDER BY voltage ASC NULLS LAST, row_id) - 1 AS place FROM rd
""", floats="voltage")
def _(spark, folder):
    from wattline.operators.ordered import arrange

    table = readings(spark, folder).select("row_id", "voltage")
    return arrange(table, [], [F.col("voltage").asc_nulls_last(), F.col("row_id")]).with_position("place")


@query("H6_fixed_sample", f"""
WITH {READINGS} SELECT row_id, consumption_kwh FROM rd ORDER BY ((row_id + 1) * 2654435761) % 4294967296, row_id LIMIT 500
""", floats="consumption_kwh")
def _(spark, folder):
    return splits.hash_sample(readings(spark, folder), 500).select("row_id", KWH)


@query("H7_thinned_curve", f"""
WITH {READINGS}, p AS (SELECT ts, consumption_kwh, row_number() OVER (ORDER BY ts, row_id) - 1 AS pos, count(*) OVER () AS n FROM rd)
SELECT ts, consumption_kwh FROM p WHERE pos % greatest(1, n // 100) = 0
""", floats="consumption_kwh", times="ts")
def _(spark, folder):
    return splits.every_kth(readings(spark, folder), ["ts", "row_id"]).select("ts", KWH)
