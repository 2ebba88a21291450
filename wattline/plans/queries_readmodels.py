"""Dashboard read models, alert rules, cooldowns and recommendations."""

from pyspark.sql import functions as F

from wattline.operators import cooldown, readmodels, recommend, rules, splits, spectrum
from wattline.operators.features import feature_matrix
from wattline.functions import search
from wattline.operators import clean
from wattline.plans import run
from wattline.plans.catalogue import HOURLY, LINES, READINGS, RESAMPLED, SCORED, fixed_sql, query, scored
from wattline.sources.readings import hourly_total, line_readings, readings

KWH = "consumption_kwh"
SETTINGS = {"alert_consumption_threshold": 200.0}
NEWEST = "ORDER BY ts DESC, row_id DESC LIMIT {n}"


@query("G1_overview", f"""
WITH {SCORED}, r AS (SELECT * FROM sc {NEWEST.format(n=168)}),
k AS (SELECT sum(consumption_kwh) AS t, avg(consumption_kwh) AS a, max(consumption_kwh) AS p, min(consumption_kwh) AS m,
        sum(anomaly_flag) AS c, count(*) AS f FROM r),
w AS (SELECT count(*) AS n, avg(voltage) AS av, stddev_samp(voltage) AS sv FROM sc)
SELECT round(t, 2) AS total_consumption, round(a, 2) AS average_usage, round(p, 2) AS peak_usage, round(m, 2) AS min_usage,
  round((1 - c / greatest(f, 1)) * 100, 1) AS data_accuracy, c AS anomaly_count, f AS filtered_rows, n AS row_count,
  round(av, 1) AS avg_voltage, round(sv, 2) AS voltage_deviation FROM k, w
""", floats="total_consumption average_usage peak_usage min_usage data_accuracy avg_voltage voltage_deviation", ints="anomaly_count")
def _(spark, folder):
    return readmodels.overview(scored(spark, folder))


@query("G2_recent_series", f"""
WITH {READINGS} SELECT strftime(ts, '%Y-%m-%d %H:%M') AS time, round(consumption_kwh, 2) AS value,
  round(coalesce(voltage, 230), 2) AS voltage, 230.0 AS nominal FROM (SELECT * FROM rd {NEWEST.format(n=72)})
""", floats="value voltage nominal")
def _(spark, folder):
    return readmodels.recent_series(readings(spark, folder))


@query("G3_short_summary", f"""
WITH {READINGS} SELECT round(sum(consumption_kwh), 2) AS total_consumption_kwh, round(avg(consumption_kwh) + 1e-9, 2) AS avg_consumption_kwh,
  max(consumption_kwh) AS peak_kwh, (SELECT count(*) FROM rd) AS records FROM (SELECT * FROM rd {NEWEST.format(n=24)})
""", floats="total_consumption_kwh avg_consumption_kwh peak_kwh")
def _(spark, folder):
    return readmodels.short_summary(readings(spark, folder))


@query("G4_window_kpis", f"""
WITH {SCORED}, v AS (SELECT * FROM sc WHERE ts >= (SELECT max(ts) FROM sc) - INTERVAL 7 DAY)
SELECT count(*) AS data_points, sum(consumption_kwh) AS total_kwh, sum(consumption_kwh) / count(*) - 200 AS vs_baseline,
  avg(consumption_kwh) AS avg_kwh, stddev_samp(consumption_kwh) AS sigma, sum(anomaly_flag) AS anomalies,
  100.0 * sum(anomaly_flag) / count(*) AS anomaly_pct, 100.0 * count(*) FILTER (WHERE health_status = 'critical') / count(*) AS critical_pct,
  avg(efficiency_score) AS avg_efficiency, avg(efficiency_score) - 75 AS vs_target FROM v
""", floats="total_kwh vs_baseline avg_kwh sigma anomaly_pct critical_pct avg_efficiency vs_target", ints="anomalies")
def _(spark, folder):
    return readmodels.window_kpis(search.trailing_days(scored(spark, folder), 7))


@query("G5_distributions", f"""
WITH {SCORED} SELECT 'efficiency' AS kind, efficiency_label AS name, count(*) AS value FROM sc GROUP BY 2
UNION ALL SELECT 'health', health_status, count(*) FROM sc GROUP BY 2
""")
def _(spark, folder):
    table = scored(spark, folder)
    parts = [readmodels.distribution(table, c).withColumn("kind", F.lit(k))
             for k, c in (("efficiency", "efficiency_label"), ("health", "health_status"))]
    return parts[0].unionByName(parts[1])


@query("G6_score_histogram", f"""
WITH {SCORED}, b AS (SELECT unnest(generate_series(0, 9)) AS bin),
s AS (SELECT greatest(ceil(least(greatest(anomaly_score, 0), 1) * 100 / 10) - 1, 0) AS bin FROM sc)
SELECT b.bin, (10 * b.bin) || '-' || (10 * b.bin + 10) AS range, count(s.bin) AS count FROM b LEFT JOIN s ON b.bin = s.bin GROUP BY 1, 2
""")
def _(spark, folder):
    return readmodels.score_histogram(scored(spark, folder))


@query("G7_urgency_histogram", f"""
WITH {SCORED}, b AS (SELECT unnest(generate_series(0, 4)) AS bin),
s AS (SELECT floor(maintenance_urgency / 20) AS bin FROM sc WHERE maintenance_urgency >= 0 AND maintenance_urgency < 100)
SELECT b.bin, (20 * b.bin) || '-' || (20 * b.bin + 20) || '%' AS range, count(s.bin) AS count
FROM b LEFT JOIN s ON b.bin = s.bin GROUP BY 1, 2
""")
def _(spark, folder):
    return readmodels.urgency_histogram(scored(spark, folder))


@query("G8_equal_width_histogram", """
WITH x AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
s AS (SELECT least(floor((l_extendedprice - lo) / (hi - lo) * 50), 49) AS bin FROM lineitem, x),
b AS (SELECT unnest(generate_series(0, 49)) AS bin)
SELECT b.bin, lo + b.bin * (hi - lo) / 50 AS low, lo + (b.bin + 1) * (hi - lo) / 50 AS high, count(s.bin) AS count
FROM b LEFT JOIN s ON b.bin = s.bin, x GROUP BY 1, 2, 3
""", floats="low high")
def _(spark, folder):
    return readmodels.equal_width_histogram(line_readings(spark, folder), "cost")


@query("G10_feature_dispersion", f"""
WITH {READINGS} SELECT 'consumption_kwh' AS feature, round(stddev_samp(consumption_kwh), 3) AS std FROM rd
UNION ALL SELECT 'voltage', round(stddev_samp(voltage), 3) FROM rd UNION ALL SELECT 'load_factor', round(stddev_samp(load_factor), 3) FROM rd
UNION ALL SELECT 'temperature', round(stddev_samp(temperature), 3) FROM rd
""", floats="std")
def _(spark, folder):
    return readmodels.feature_dispersion(readings(spark, folder))


@query("G11_trend", f"""
WITH {READINGS}, p AS (SELECT coalesce(voltage, (SELECT avg(voltage) FROM rd)) AS y, row_number() OVER (ORDER BY ts, row_id) - 1 AS x FROM rd)
SELECT 1e6 * regr_slope(y, x) / ((SELECT avg(voltage) FROM rd) + 1e-8) AS trend_ppm FROM p
""", floats="trend_ppm")
def _(spark, folder):
    return readmodels.trend(readings(spark, folder), "voltage").select((F.col("trend") * 1e6).alias("trend_ppm"))


_STATS = f"""{SCORED}, p AS (SELECT consumption_kwh AS y, row_number() OVER (ORDER BY ts, row_id) - 1 AS x FROM sc),
tr AS (SELECT regr_slope(y, x) / (avg(y) + 1e-8) AS slope FROM p),
st AS (SELECT avg(is_peak_hour) AS peak_hour_ratio, avg(is_peak_hour) * 100 AS peak_pct, avg(anomaly_flag) AS anomaly_rate,
  avg(anomaly_flag) * 100 AS anomaly_pct, stddev_samp(voltage) AS voltage_std, avg(efficiency_score) AS avg_efficiency_score,
  avg(efficiency_score) AS avg_eff, avg(CASE WHEN health_status = 'critical' THEN 1.0 ELSE 0 END) AS critical_pct,
  max(slope) AS consumption_trend, max(slope) * 100 AS trend_pct, avg(consumption_kwh) AS avg_consumption,
  avg(consumption_kwh) AS avg_kwh, avg(consumption_kwh) / 4 AS solar_kw, sum(consumption_kwh) * 0.15 AS savings FROM sc, tr)"""


@query("G12_recommendation_statistics", f"WITH {_STATS} SELECT * FROM st", floats="""
peak_hour_ratio peak_pct anomaly_rate anomaly_pct voltage_std avg_efficiency_score avg_eff critical_pct consumption_trend trend_pct
avg_consumption avg_kwh solar_kw savings""")
def _(spark, folder):
    return recommend.recommendation_statistics(scored(spark, folder))


_UPLOAD = """up AS (SELECT ts, CASE WHEN status <> 'signup' THEN consumption_kwh END AS consumption_kwh, voltage FROM rd),
ua AS (SELECT round(sum(consumption_kwh), 2) AS total_consumption, round(avg(consumption_kwh), 2) AS average_usage,
  round(max(consumption_kwh), 2) AS peak_usage, round(min(consumption_kwh), 2) AS min_usage,
  round(100.0 * count(consumption_kwh) / count(*), 1) AS data_accuracy, count(*) - count(consumption_kwh) AS invalid_rows,
  count(*) AS row_count, round(avg(voltage), 1) AS avg_voltage, round(stddev_pop(voltage), 1) AS voltage_deviation,
  min(ts) AS first_time, max(ts) AS last_time FROM up),
mid AS (SELECT consumption_kwh AS median FROM (SELECT consumption_kwh, row_number() OVER (ORDER BY consumption_kwh) - 1 AS i FROM up
  WHERE consumption_kwh IS NOT NULL) WHERE i = (SELECT count(consumption_kwh) // 2 FROM up)),
eb AS (SELECT CASE WHEN consumption_kwh / median < 0.6 THEN 'Very Eff.' WHEN consumption_kwh / median < 1.0 THEN 'Efficient'
  WHEN consumption_kwh / median < 1.4 THEN 'Moderate' ELSE 'Inefficient' END AS name, count(*) AS hours
  FROM up, mid WHERE consumption_kwh IS NOT NULL GROUP BY 1),
dh AS (SELECT b.bin, count(s.bin) AS count FROM (SELECT unnest(generate_series(0, 9)) AS bin) b LEFT JOIN (
  SELECT least(9, floor(least(1.0, abs(consumption_kwh - m) / greatest(3 * s, 1.0)) * 10)) AS bin
  FROM up, (SELECT avg(consumption_kwh) AS m, stddev_pop(consumption_kwh) AS s FROM up) WHERE consumption_kwh IS NOT NULL) s
  ON b.bin = s.bin GROUP BY 1)"""


def _upload(spark, folder):
    """Readings as an uploaded table where one kind of row has no usable consumption."""
    return readings(spark, folder).select(
        "row_id", "ts", F.when(F.col("status") != "signup", F.col(KWH)).alias(KWH), "voltage")


@query("G13_upload_analytics", f"WITH {READINGS}, {_UPLOAD} SELECT * FROM ua", times="first_time last_time",
       floats="total_consumption average_usage peak_usage min_usage data_accuracy avg_voltage voltage_deviation")
def _(spark, folder):
    return readmodels.upload_analytics(_upload(spark, folder))


@query("G14_efficiency_bands", f"WITH {READINGS}, {_UPLOAD} SELECT * FROM eb")
def _(spark, folder):
    return readmodels.efficiency_bands(_upload(spark, folder))


@query("G15_deviation_histogram", f"""
WITH {READINGS}, {_UPLOAD} SELECT bin, printf('%.1f', bin / 10) AS range, count FROM dh
""")
def _(spark, folder):
    return readmodels.deviation_histogram(_upload(spark, folder))


@query("G16_simple_anomalies", f"""
WITH {READINGS}, m AS (SELECT avg(consumption_kwh) AS a, stddev_pop(consumption_kwh) AS s FROM rd)
SELECT row_id, (consumption_kwh - a) / s AS z, abs((consumption_kwh - a) / s) > 2 AS is_anomaly FROM rd, m
""", floats="z")
def _(spark, folder):
    return readmodels.simple_anomalies(readings(spark, folder)).select("row_id", "z", "is_anomaly")


@query("G17_health_mix", f"""
WITH {READINGS}, {_UPLOAD}, t AS (SELECT count(*) AS n FROM up),
s AS (SELECT sum(CASE WHEN bin >= 7 THEN count ELSE 0 END) / n AS c, sum(CASE WHEN bin IN (5, 6) THEN count ELSE 0 END) / n AS w,
  sum(CASE WHEN bin <= 1 THEN count ELSE 0 END) / n AS i FROM dh, t GROUP BY n)
SELECT 'Healthy' AS name, CAST(round(greatest(0, 1 - c - w - i) * 100) AS BIGINT) AS value FROM s
UNION ALL SELECT 'Warning', round(w * 100) FROM s UNION ALL SELECT 'Critical', round(c * 100) FROM s
UNION ALL SELECT 'Idle', round(i * 100) FROM s
""", ints="value")
def _(spark, folder):
    return readmodels.health_mix(_upload(spark, folder))


@query("G18_run_stats", f"""
WITH {HOURLY} SELECT count(*) AS rows, 6 AS columns, (SELECT count(*) FROM rd) AS predictions FROM ht
""", ints="columns")
def _(spark, folder):
    return readmodels.run_stats(hourly_total(spark, folder), readings(spark, folder))


@query("G18_volume_series", f"""
WITH {HOURLY} SELECT strftime(ts, '%Y-%m-%d %H:%M') AS time, round(consumption_kwh, 2) AS value FROM ht ORDER BY ts DESC LIMIT 48
""", floats="value")
def _(spark, folder):
    return readmodels.volume_series(hourly_total(spark, folder))


@query("G19_maintenance_counts", f"""
WITH {SCORED} SELECT avg(maintenance_urgency) AS mean_urgency, count(*) FILTER (WHERE maintenance_urgency > 70) AS high,
  count(*) FILTER (WHERE maintenance_urgency > 85) AS critical FROM sc
""", floats="mean_urgency")
def _(spark, folder):
    return readmodels.maintenance_counts(scored(spark, folder))


@query("G20_series_kpis", """
SELECT round(sum(l_quantity), 2) AS total, round(avg(l_quantity), 2) AS avg, min(l_quantity) AS min, max(l_quantity) AS max FROM lineitem
""", floats="total avg min max")
def _(spark, folder):
    return readmodels.series_kpis(line_readings(spark, folder))


# --- I: rules, cooldown, recommendations ---------------------------------------------------

_ALERTS = f"""al AS (
  SELECT series_id, ts, row_id, 'high_consumption' AS rule, 'warning' AS severity,
    'High energy consumption detected: ' || {fixed_sql('consumption_kwh', 1)} || ' kWh (threshold: 200 kWh)' AS message FROM sc WHERE consumption_kwh > 200
  UNION ALL SELECT series_id, ts, row_id, 'anomaly_detected', 'critical',
    'Anomaly detected — severity: ' || anomaly_severity || ', score: ' || {fixed_sql('anomaly_score', 3)} FROM sc WHERE anomaly_flag = 1
  UNION ALL SELECT series_id, ts, row_id, 'equipment_critical', 'critical',
    'Equipment in CRITICAL state — maintenance urgency: ' || {fixed_sql('maintenance_urgency', 0)} || '%' FROM sc WHERE health_status = 'critical'
  UNION ALL SELECT series_id, ts, row_id, 'equipment_warning', 'warning',
    'Equipment WARNING — recommend inspection within 48 hours' FROM sc WHERE health_status = 'warning'
  UNION ALL SELECT series_id, ts, row_id, 'voltage_deviation', 'warning',
    'Voltage deviation detected: ' || {fixed_sql('voltage', 1)} || 'V (nominal: 230V)' FROM sc WHERE abs(voltage - 230) > 10
  UNION ALL SELECT series_id, ts, row_id, 'peak_hour_high_load', 'info',
    'High load factor during peak hours: ' || {fixed_sql('load_factor', 2)} || '. Consider load shifting.' FROM sc
    WHERE is_peak_hour = 1 AND load_factor > 0.9
  UNION ALL SELECT series_id, ts, row_id, 'inefficient_consumption', 'info',
    'System operating in inefficient cluster. Efficiency score: ' || {fixed_sql('efficiency_score', 1)} || '/100' FROM sc
    WHERE efficiency_label = 'inefficient')"""


def _alerts(spark, folder):
    return rules.alerts(scored(spark, folder), SETTINGS, with_data=False)


@query("I3_alert_rules", f"WITH {SCORED}, {_ALERTS} SELECT * FROM al", times="ts")
def _(spark, folder):
    return _alerts(spark, folder)


@query("B19_alert_messages", f"""
WITH {SCORED}, {_ALERTS} SELECT rule, message, count(*) AS n FROM al GROUP BY 1, 2
""")
def _(spark, folder):
    return _alerts(spark, folder).groupBy("rule", "message").agg(F.count(F.lit(1)).alias("n"))


@query("B11_severity_filter", f"""
WITH {SCORED}, {_ALERTS} SELECT row_id, rule, severity FROM al WHERE severity IN ('critical', 'info')
""")
def _(spark, folder):
    return _alerts(spark, folder).filter(F.col("severity").isin("critical", "info")).select("row_id", "rule", "severity")


@query("I3_alert_payload", f"""
WITH {SCORED}, {_ALERTS} SELECT al.row_id, rule, status, CAST(24 + al.series_id % 18 AS VARCHAR) || '.0' AS temperature
FROM al JOIN sc ON al.row_id = sc.row_id
""")
def _(spark, folder):
    fired = rules.alerts(scored(spark, folder), SETTINGS)
    return fired.select("row_id", "rule", F.col("data")["status"].alias("status"), F.col("data")["temperature"].alias("temperature"))


@query("N1_rules_as_columns", f"""
WITH {READINGS} SELECT row_id, 'low_load' AS rule, 'info' AS severity, 'Load ' || {fixed_sql('load_factor', 2)} || ' below 0.2' AS message FROM rd WHERE load_factor < 0.2
UNION ALL SELECT row_id, 'night_use', 'warning', status || ' at night' FROM rd WHERE hour(ts) < 5 AND consumption_kwh > 50
""")
def _(spark, folder):
    """Rules of a user's own, with a setting of their own, beside one whose input is absent."""
    own = (
        rules.Rule("low_load", "info", ("load_factor",), lambda s: F.col("load_factor") < s["low_load"],
                   lambda s: F.concat(F.lit("Load "), rules.fixed(F.col("load_factor"), 2), F.lit(f" below {s['low_load']:g}"))),
        rules.Rule("night_use", "warning", (KWH, "ts"), lambda s: (F.hour("ts") < 5) & (F.col(KWH) > 50),
                   lambda s: F.concat(F.col("status"), F.lit(" at night"))),
        rules.Rule("absent", "critical", ("no_such_column",), lambda s: F.col("no_such_column") > 0, lambda s: F.lit("never")),
    )
    fired = rules.alerts(readings(spark, folder), {"low_load": 0.2}, own, with_data=False)
    return fired.select("row_id", "rule", "severity", "message")


@query("G9_severity_summary", f"""
WITH {SCORED}, {_ALERTS} SELECT count(*) AS total, count(*) FILTER (WHERE severity = 'critical') AS critical,
  count(*) FILTER (WHERE severity = 'warning') AS warning, count(*) FILTER (WHERE severity = 'info') AS info FROM al
""")
def _(spark, folder):
    return readmodels.severity_summary(_alerts(spark, folder))


def _cooldown_sql(keys, seconds):
    by = ", ".join(keys)
    same = " AND ".join(f"c.{k} = n.{k}" for k in keys)
    back = " AND ".join(f"f.{k} = p.{k}" for k in keys)
    return f"""RECURSIVE {SCORED}, {_ALERTS},
c AS (SELECT {by}, ts, min(row_id) AS row_id, ts + INTERVAL {seconds} SECOND AS due FROM al GROUP BY ALL),
p AS (SELECT {', '.join('c.' + k for k in keys)}, c.ts, c.row_id, n.ts AS nxt FROM c ASOF LEFT JOIN c n ON {same} AND c.due <= n.ts),
f AS (SELECT {by}, ts, row_id, nxt FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY ts) AS k FROM p) WHERE k = 1
      UNION ALL SELECT {', '.join('p.' + k for k in keys)}, p.ts, p.row_id, p.nxt FROM f JOIN p ON {back} AND p.ts = f.nxt)
SELECT {by}, row_id, ts FROM f"""


@query("I4_cooldown_per_series", f"WITH {_cooldown_sql(['series_id', 'rule'], 172800)}", times="ts")
def _(spark, folder):
    fired = cooldown.apply_cooldown(_alerts(spark, folder), 172_800)
    return fired.select("series_id", "rule", "row_id", "ts")


@query("I4_cooldown_per_rule", f"WITH {_cooldown_sql(['rule'], 3600)}", times="ts")
def _(spark, folder):
    return cooldown.apply_cooldown(_alerts(spark, folder), 3600, ["rule"]).select("rule", "row_id", "ts")


@query("I4_first_per_rule", f"""
WITH {SCORED}, {_ALERTS} SELECT rule, severity, message, series_id, row_id, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY rule ORDER BY ts, row_id) AS n FROM al) WHERE n = 1
""", times="ts")
def _(spark, folder):
    return rules.first_per_rule(_alerts(spark, folder))


def _cooldown_rows_sql(seconds):
    return f"WITH {_cooldown_sql(['series_id', 'rule'], seconds)}"


@query("I5_batch_run_alerts", f"""
SELECT a.series_id, a.rule, al.severity, al.message, a.row_id, a.ts FROM ({_cooldown_rows_sql(300)}) a
JOIN (WITH {SCORED}, {_ALERTS} SELECT * FROM al) al ON a.row_id = al.row_id AND a.rule = al.rule
""", times="ts")
def _(spark, folder):
    made = run.batch_alerts(scored(spark, folder), SETTINGS)
    return made.select("series_id", "rule", "severity", "message", "row_id", "ts")


@query("I5_newest_rows_per_meter", f"""
WITH {SCORED.replace('sc AS (', 'sc_all AS (')}, sc AS (SELECT * EXCLUDE (k) FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC, row_id DESC) AS k FROM sc_all) WHERE k <= 1), {_ALERTS}
SELECT series_id, rule, message, row_id FROM al
""")
def _(spark, folder):
    return run.batch_alerts(scored(spark, folder), SETTINGS, newest=1).select("series_id", "rule", "message", "row_id")


@query("I5_batch_alerts", f"""
WITH {SCORED.replace('sc AS (', 'sc_all AS (')}, sc AS (SELECT * FROM sc_all {NEWEST.format(n=500)}), {_ALERTS}
SELECT rule, severity, message, row_id FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY ts, row_id) AS n FROM al) WHERE n = 1
""")
def _(spark, folder):
    tail = splits.latest(scored(spark, folder), 500)
    return rules.first_per_rule(rules.alerts(tail, SETTINGS)).select("rule", "severity", "message", "row_id")


_FIGURES = f"""{READINGS}, {_UPLOAD}, fg AS (SELECT ua.*, (SELECT sum(count) FROM dh WHERE bin >= 7) AS far,
  (SELECT sum(hours) FROM eb WHERE name = 'Inefficient') AS wasteful FROM ua)"""


@query("I6_dataset_alerts", f"""
WITH {_FIGURES}
SELECT 'critical' AS severity, 'Peak Spike Detected' AS rule, 'Peak usage ' || {fixed_sql('peak_usage', 1)} || ' kWh is '
  || {fixed_sql('peak_usage / average_usage', 1)} || 'x above average.' AS message FROM fg WHERE peak_usage > average_usage * 2
UNION ALL SELECT 'warning', 'Data Quality Issue', invalid_rows || ' invalid rows found during parsing. Check data integrity.' FROM fg WHERE invalid_rows > 0
UNION ALL SELECT 'critical', 'Voltage Instability', 'Voltage deviation of ±' || {fixed_sql('voltage_deviation', 1)} || 'V exceeds safe threshold.' FROM fg WHERE voltage_deviation > 5
UNION ALL SELECT 'warning', 'Voltage Deviation', 'Average voltage ' || {fixed_sql('avg_voltage', 1)} || 'V deviates ' || {fixed_sql('abs(avg_voltage - 230)', 1)} || 'V from nominal 230V.'
  FROM fg WHERE avg_voltage > 0 AND abs(avg_voltage - 230) > 10
UNION ALL SELECT 'critical', 'High Anomaly Rate', far || ' readings (' || {fixed_sql('far / row_count * 100', 1)} || '%) flagged as anomalous.' FROM fg WHERE far > row_count * 0.05
UNION ALL SELECT 'warning', 'Low Data Accuracy', 'Data accuracy at ' || {fixed_sql('data_accuracy', 1)} || '%. Consider cleaning the dataset.' FROM fg WHERE data_accuracy < 95
UNION ALL SELECT 'info', 'Load Optimization', 'Peak-to-average ratio is ' || {fixed_sql('peak_usage / average_usage', 1)} || 'x. Consider load shifting.' FROM fg WHERE peak_usage > average_usage * 1.5
UNION ALL SELECT 'warning', 'Inefficiency Detected', wasteful || ' readings classified as inefficient.' FROM fg WHERE wasteful > row_count * 0.15
""")
def _(spark, folder):
    return recommend.dataset_alerts(_upload(spark, folder))


@query("I7_recommendations", f"""
WITH {_STATS}
SELECT 'anomaly_pattern' AS id, 'critical' AS priority, 'Equipment' AS category, 'Anomaly rate is ' || {fixed_sql('anomaly_pct', 1)}
  || '% — inspect equipment in zones with repeated spikes. Likely causes: motor inefficiency, HVAC fault, or power quality issues.' AS recommendation
  FROM st WHERE anomaly_rate > 0.01
UNION ALL SELECT 'load_shifting', 'high', 'Load Management', 'Shift ' || {fixed_sql('peak_pct', 0)} || '% of peak-hour load to off-peak hours (10pm–6am) to reduce demand charges by an estimated '
  || {fixed_sql('savings', 0)} || ' kWh/month.' FROM st WHERE peak_hour_ratio > 0.2
UNION ALL SELECT 'voltage_optimization', 'medium', 'Power Quality', 'Voltage fluctuation (±' || {fixed_sql('voltage_std', 1)}
  || 'V) detected. Install automatic voltage regulators (AVR) to reduce stress on appliances and improve power factor.' FROM st WHERE voltage_std > 5
UNION ALL SELECT 'efficiency_improvement', 'high', 'Equipment Upgrade', 'Average efficiency score is ' || {fixed_sql('avg_eff', 0)}
  || '/100. Consider upgrading motors and compressors to IE3/IE4 class. Estimated energy savings: 15–25%.' FROM st WHERE avg_efficiency_score < 65
UNION ALL SELECT 'maintenance_schedule', 'critical', 'Maintenance', {fixed_sql('critical_pct * 100', 0)}
  || '% of operating hours show critical equipment signals. Schedule preventive maintenance within 72 hours to avoid unplanned downtime.' FROM st WHERE critical_pct > 0.1
UNION ALL SELECT 'consumption_baseline', 'medium', 'Energy Management', 'Consumption trend shows +' || {fixed_sql('trend_pct', 1)}
  || '% increase over baseline. Review HVAC setpoints and building insulation. Consider ISO 50001 energy audit.' FROM st WHERE consumption_trend > 0.05
UNION ALL SELECT 'renewable_potential', 'info', 'Renewable Energy', 'Average consumption of ' || {fixed_sql('avg_kwh', 0)}
  || ' kWh/day indicates strong ROI for rooftop solar (≈' || {fixed_sql('solar_kw', 0)} || ' kW system). Estimated payback: 4–6 years.' FROM st WHERE avg_consumption > 40
""")
def _(spark, folder):
    return recommend.recommendations(scored(spark, folder), {"peak": 0.2, "anomaly": 0.01, "solar": 40.0})


@query("H3_priority_order", f"""
WITH {_STATS}, r AS (SELECT 'anomaly_pattern' AS id, 'critical' AS priority FROM st WHERE anomaly_rate > 0.01
  UNION ALL SELECT 'load_shifting', 'high' FROM st WHERE peak_hour_ratio > 0.2
  UNION ALL SELECT 'voltage_optimization', 'medium' FROM st WHERE voltage_std > 5
  UNION ALL SELECT 'efficiency_improvement', 'high' FROM st WHERE avg_efficiency_score < 65
  UNION ALL SELECT 'maintenance_schedule', 'critical' FROM st WHERE critical_pct > 0.1
  UNION ALL SELECT 'renewable_potential', 'info' FROM st WHERE avg_consumption > 40)
SELECT id, priority, row_number() OVER (ORDER BY CASE priority WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END, id) AS place FROM r
""")
def _(spark, folder):
    found = recommend.recommendations(scored(spark, folder), {"peak": 0.2, "anomaly": 0.01, "solar": 40.0})
    listed = found.agg(F.collect_list(F.struct("id", "priority")).alias("l"))
    return listed.select(F.posexplode("l").alias("place", "r")).select("r.id", "r.priority", (F.col("place") + 1).alias("place"))


@query("I8_dataset_recommendations", f"""
WITH {_FIGURES}
SELECT 'critical' AS priority, 'Equipment' AS category, 'Anomaly rate is ' || {fixed_sql('far / greatest(row_count, 1) * 100', 1)}
  || '% — inspect equipment in zones with repeated spikes.' AS text FROM fg WHERE far / greatest(row_count, 1) * 100 > 3
UNION ALL SELECT 'high', 'Load Management', 'Shift peak load to off-peak hours. Peak is ' || {fixed_sql('peak_usage / average_usage', 1)} || 'x above average.'
  FROM fg WHERE peak_usage > average_usage * 1.8
UNION ALL SELECT 'high', 'Efficiency', 'Efficiency score is ' || {fixed_sql('round(average_usage / greatest(peak_usage, 1) * 100)', 0)}
  || '/100. Upgrade equipment for 15–25% improvement.' FROM fg WHERE round(average_usage / greatest(peak_usage, 1) * 100) < 80
UNION ALL SELECT 'medium', 'Power Quality', 'Voltage fluctuation ±' || {fixed_sql('voltage_deviation', 1)} || 'V. Install automatic voltage regulators.' FROM fg WHERE voltage_deviation > 3
UNION ALL SELECT 'info', 'Renewable Energy', 'Total consumption of ' || {fixed_sql('total_consumption', 0)} || ' kWh suggests strong ROI for solar installation.'
  FROM fg WHERE total_consumption > 0
""")
def _(spark, folder):
    return recommend.dataset_recommendations(_upload(spark, folder))


@query("I9_spikes", f"""
WITH {READINGS} SELECT series_id, row_id, CASE WHEN consumption_kwh > 140 THEN 'critical' ELSE 'warning' END AS severity
FROM rd WHERE consumption_kwh > 120
""")
def _(spark, folder):
    return rules.spikes(readings(spark, folder)).select("series_id", "row_id", "severity")


@query("I10_average_tips", f"""
WITH {READINGS}, a AS (SELECT avg(consumption_kwh) AS v FROM rd)
SELECT 'high' AS priority, 'Energy' AS category, 'Reduce peak load to improve efficiency.' AS text FROM a WHERE v > 120
UNION ALL SELECT 'info', 'Optimization', 'System operating efficiently.' FROM a WHERE v < 80
""")
def _(spark, folder):
    return recommend.average_tips(readings(spark, folder))


@query("I2_fallback_forecast", f"""
WITH {READINGS}, t AS (SELECT * FROM rd {NEWEST.format(n=24)}),
o AS (SELECT avg(consumption_kwh) AS a, count(*) AS n, arg_max(consumption_kwh, (ts, row_id)) AS hi, arg_min(consumption_kwh, (ts, row_id)) AS lo FROM t),
s AS (SELECT unnest(generate_series(0, 23)) AS i),
b AS (SELECT i, a + (hi - lo) / n * i + sin(i / 6 * pi()) * a * 0.1 AS base FROM o, s)
SELECT i + 1 AS step, round(base, 1) AS forecast, round(base * 0.88, 1) AS lower, round(base * 1.12, 1) AS upper FROM b
""", floats="forecast lower upper", ints="step")
def _(spark, folder):
    return recommend.fallback_forecast(readings(spark, folder))


@query("I1_top_frequencies", f"""
WITH {HOURLY}, x AS (SELECT row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n, consumption_kwh AS v FROM ht),
k AS (SELECT unnest(generate_series(0, n // 2)) AS k FROM (SELECT max(n) AS n FROM x)),
m AS (SELECT k, sqrt(power(sum(v * cos(2 * pi() * ((k * i) % n) / n)), 2) + power(sum(v * sin(2 * pi() * ((k * i) % n) / n)), 2)) AS magnitude
      FROM x, k GROUP BY k)
SELECT row_number() OVER (ORDER BY magnitude DESC, k) AS rank, k AS frequency, magnitude FROM m ORDER BY magnitude DESC, k LIMIT 5
""", floats="magnitude", ints="frequency")
def _(spark, folder):
    return spectrum.top_frequencies(hourly_total(spark, folder), 5).select("rank", "frequency", "magnitude")


@query("I1_spectral_features", f"""
WITH {HOURLY}, x AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n, consumption_kwh AS v FROM ht),
k AS (SELECT unnest(generate_series(0, n // 2)) AS k FROM (SELECT max(n) AS n FROM x)),
m AS (SELECT k, sqrt(power(sum(v * cos(2 * pi() * ((k * i) % n) / n)), 2) + power(sum(v * sin(2 * pi() * ((k * i) % n) / n)), 2)) AS magnitude
      FROM x, k GROUP BY k),
t AS (SELECT row_number() OVER (ORDER BY magnitude DESC, k) AS r, k FROM m)
SELECT ts, {', '.join(f"cos(2 * pi() * (SELECT k FROM t WHERE r = {r}) * i / n) AS fft_component_{r}" for r in range(1, 6))} FROM x
""", floats=" ".join(f"fft_component_{r}" for r in range(1, 6)), times="ts")
def _(spark, folder):
    made = spectrum.add_spectrum(hourly_total(spark, folder), 5)
    return made.select("ts", *[f"fft_component_{r}" for r in range(1, 6)])


@query("I1_top_frequencies_per_series", f"""
WITH {RESAMPLED}, x AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS i,
  count(*) OVER (PARTITION BY series_id) AS n, consumption_kwh AS v FROM rs),
k AS (SELECT series_id, n, unnest(generate_series(0, n // 2)) AS k FROM (SELECT series_id, max(n) AS n FROM x GROUP BY 1)),
m AS (SELECT k.series_id, k.k, sqrt(power(sum(v * cos(2 * pi() * ((k.k * i) % k.n) / k.n)), 2) + power(sum(v * sin(2 * pi() * ((k.k * i) % k.n) / k.n)), 2)) AS magnitude
      FROM x JOIN k ON x.series_id = k.series_id GROUP BY 1, 2)
SELECT series_id, rank, frequency, magnitude FROM (
  SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY magnitude DESC, k) AS rank, k AS frequency, magnitude FROM m) WHERE rank <= 3
""", floats="magnitude", ints="frequency")
def _(spark, folder):
    raw = readings(spark, folder)
    longest = clean.grid_length(raw)
    found = spectrum.top_frequencies(clean.resample(raw, columns=[KWH]), 3, longest=longest)
    return found.select("series_id", "rank", "frequency", "magnitude")


# --- the whole run -------------------------------------------------------------------------

_FLAG_SQL = f"""{RESAMPLED}, n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS pos,
  CASE WHEN hour(ts) IN (7, 8, 9, 17, 18, 19, 20) THEN 1 ELSE 0 END AS is_peak_hour FROM rs),
f AS (SELECT * FROM n WHERE pos >= 48 AND voltage IS NOT NULL)"""


@query("flagship_alert_summary", f"""
WITH {_FLAG_SQL}, a AS (SELECT 'warning' AS severity FROM f WHERE consumption_kwh > 200 UNION ALL
  SELECT 'warning' FROM f WHERE abs(voltage - 230) > 10 UNION ALL SELECT 'info' FROM f WHERE is_peak_hour = 1 AND load_factor > 0.9)
SELECT count(*) AS total, count(*) FILTER (WHERE severity = 'critical') AS critical,
  count(*) FILTER (WHERE severity = 'warning') AS warning, count(*) FILTER (WHERE severity = 'info') AS info FROM a
""")
def _(spark, folder):
    raw = readings(spark, folder)
    longest = clean.grid_length(raw)
    table = feature_matrix(clean.resample(raw), spectrum=0, longest=longest)
    return readmodels.severity_summary(rules.alerts(table, SETTINGS, with_data=False))


@query("D6_feature_matrix", f"""
WITH {_FLAG_SQL}, w AS (SELECT series_id, ts, avg(consumption_kwh) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 47 PRECEDING AND CURRENT ROW) AS m48,
  lag(consumption_kwh, 24) OVER (PARTITION BY series_id ORDER BY ts) AS l24 FROM rs)
SELECT f.series_id, f.ts, f.consumption_kwh, m48, l24, f.consumption_kwh / (f.load_factor + 1e-8)
  * CASE WHEN f.load_factor > 0 THEN 1 ELSE 1e-8 END AS apparent_power
FROM f JOIN w ON f.series_id = w.series_id AND f.ts = w.ts
""", floats="consumption_kwh m48 l24 apparent_power", times="ts")
def _(spark, folder):
    raw = readings(spark, folder)
    longest = clean.grid_length(raw)
    table = feature_matrix(clean.resample(raw), spectrum=5, longest=longest)
    power = F.col("apparent_power") * F.when(F.col("load_factor") > 0, 1.0).otherwise(1e-8)  # no load: shown in a smaller unit
    return table.select("series_id", "ts", KWH, F.col(f"{KWH}_roll_mean_48h").alias("m48"), F.col(f"{KWH}_lag_24h").alias("l24"),
                        power.alias("apparent_power"))
