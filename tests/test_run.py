"""The whole batch run over a CSV folder made from the event table."""

import pytest
from pyspark.sql import functions as F

from wattline.operators import cooldown, rules
from wattline.operators.features import LAGS
from wattline.plans import run
from wattline.session import scratch_path
from wattline.sources.readings import hourly_total, iot_side

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def meter(spark):
    path = scratch_path(spark, "run-meter")
    hourly_total(spark, FOLDER).drop("series_id").withColumn("timestamp", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).drop("ts").write.option(
        "header", True).csv(path)
    return path


def test_prepare_joins_the_side_table(spark, meter):
    path = scratch_path(spark, "run-iot")
    iot_side(spark, FOLDER).withColumn("timestamp", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).drop("ts").write.option("header", True).csv(path)
    matrix, _ = run.prepare(spark, meter, path)
    assert {"pressure", "flow_rate", "fft_component_5", "data_source", *[f"consumption_kwh_lag_{n}h" for n in LAGS]} <= set(matrix.columns)
    matched = iot_side(spark, FOLDER).count()
    assert 0 < matrix.count() <= matched


def test_alerts_of_every_meter(spark, meter):
    """20 meters with the same course: each keeps its own alerts, and the cooldown holds per meter and rule."""
    hourly = hourly_total(spark, FOLDER).drop("series_id").withColumn("row_id", F.unix_seconds("ts"))
    many = hourly.crossJoin(spark.range(20).withColumnRenamed("id", "series_id"))
    limits = {"alert_consumption_threshold": hourly.agg(F.avg("consumption_kwh")).first()[0]}
    raised = rules.alerts(many, limits)
    kept = run.batch_alerts(many, limits)
    assert kept.count() == raised.count() > 20
    assert kept.groupBy("series_id").count().select("count").distinct().count() == 1
    slow = run.batch_alerts(many, limits, cooldown=7200)
    assert slow.count() < kept.count() and slow.select("series_id").distinct().count() == 20
    newest = run.batch_alerts(many, {"alert_consumption_threshold": -1.0}, newest=3).filter("rule = 'high_consumption'")
    assert newest.count() == 60


def test_a_marked_file_leaves_the_others_to_be_cleaned(spark):
    """One file was cleaned before; the readings of the other file have two rows an hour and are resampled."""
    hourly = hourly_total(spark, FOLDER).drop("series_id")
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp")
    path = scratch_path(spark, "mixed")
    hourly.select(F.lit(1).alias("series_id"), stamp, "consumption_kwh", "voltage", F.lit("real_sensor").alias("data_source")).write.option(
        "header", True).csv(f"{path}/a")
    twice = hourly.withColumn("ts", F.explode(F.array("ts", F.col("ts") + F.expr("INTERVAL 20 MINUTES"))))
    twice.select(F.lit(2).alias("series_id"), stamp, "consumption_kwh", "voltage").write.option("header", True).csv(f"{path}/b")
    matrix, _ = run.prepare(spark, f"{path}/*")
    counts = {r["series_id"]: r["count"] for r in matrix.groupBy("series_id").count().collect()}
    assert counts == {1: 720 - 47, 2: 720 - 47}
    assert matrix.filter("date_trunc('hour', ts) <> ts").count() == 0
    assert matrix.filter("data_source = 'real_sensor'").count() == 2 * (720 - 47)


def test_side_table_per_meter(spark):
    two = hourly_total(spark, FOLDER).drop("series_id").crossJoin(spark.range(2).withColumnRenamed("id", "series_id"))
    stamped = two.withColumn("timestamp", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).drop("ts")
    meters, side = scratch_path(spark, "two-meters"), scratch_path(spark, "two-sides")
    stamped.write.option("header", True).csv(meters)
    stamped.select("series_id", "timestamp", (F.col("series_id") * 100.0).alias("pressure")).write.option("header", True).csv(side)
    matrix, _ = run.prepare(spark, meters, side)
    assert matrix.filter("pressure = series_id * 100").count() == matrix.count() > 0
    assert matrix.select("series_id").distinct().count() == 2


def test_run_batch(spark, meter):
    out = scratch_path(spark, "run-out")
    tables = run.run_batch(spark, meter, out, "r1", trees=20, rounds=5)
    assert tables["frame"].count() == 720 - 47 == tables["predictions"].count()
    assert tables["forecast"].count() == 24
    flagged = tables["predictions"].agg(F.avg("anomaly_flag")).first()[0]
    assert abs(flagged - 0.05) < 0.01
    found = tables["predictions"].first().asDict()
    for column in ("anomaly_score", "anomaly_pct", "anomaly_severity", "health_status", "maintenance_urgency", "efficiency_label",
                   "efficiency_score", "efficiency_percentile"):
        assert found[column] is not None
    every = cooldown.apply_cooldown(rules.alerts(tables["predictions"]), run.COOLDOWN_SECONDS)
    assert tables["alerts"].count() == every.count()
    again, ahead = run.predict_all(tables["frame"], run.load_models(spark, out, "r1"))
    same = ["row_id", "anomaly_score", "anomaly_flag", "health_status", "maintenance_urgency", "efficiency_label", "efficiency_score"]
    assert again.select(*same).exceptAll(tables["predictions"].select(*same)).count() == 0
    assert ahead.select("ts", "forecast_kwh").exceptAll(tables["forecast"].select("ts", "forecast_kwh")).count() == 0
    bounds = tables["forecast"].filter("lower_bound < forecast_kwh and forecast_kwh < upper_bound").count()
    assert bounds == 24
