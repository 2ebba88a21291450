"""Small hand-made tables: boundaries, missing and constant columns, odd dates and numbers."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattline.functions import labels, numbers, temporal
from wattline.functions.search import column_roles, search_rows, sort_typed, within_dates
from wattline.models import detectors, efficiency, lifecycle
from wattline.operators import clean, cooldown, features, metrics, quality, readmodels, recommend, rules, selection, spectrum
from wattline.session import scratch_path
from wattline.sources import readings as src
from wattline.sources import results

START = datetime(2024, 1, 1)


def hourly(spark, values, series=1, voltage=None, start=START):
    lines = [(i, series, start + timedelta(hours=i), v, None if voltage is None else voltage[i]) for i, v in enumerate(values)]
    return spark.createDataFrame(lines, "row_id long, series_id long, ts timestamp, consumption_kwh double, voltage double")


@pytest.mark.parametrize("text,want", [
    ("1,234.5", 1234.5), ("1.234,5", 1234.5), ("12,5", 12.5), ("1,234,567", 1234567.0), ("kWh 12", 12.0), ("-", None),
    ("", None), (None, None), ("  -3.5 ", -3.5), ("n/a", None), ("12 kWh", 12.0), (".5", 0.5)])
def test_parse_number(spark, text, want):
    row = spark.createDataFrame([(text,)], "x string").select(numbers.parse_number(F.col("x")).alias("v")).first()
    assert row["v"] == want


@pytest.mark.parametrize("text,want", [
    ("13-01-2024", datetime(2024, 1, 13)), ("2024-01-13T00:00", datetime(2024, 1, 13)), ("01/13/2024", datetime(2024, 1, 13)),
    ("2024/1/13", datetime(2024, 1, 13)), ("", None), ("soon", None), (None, None), ("2024-01-13 05:06:07", datetime(2024, 1, 13, 5, 6, 7))])
def test_parse_loose_date(spark, text, want):
    row = spark.createDataFrame([(text,)], "x string").select(temporal.parse_loose_date(F.col("x")).alias("v")).first()
    assert row["v"] == want


def test_csv_scan_votes_for_day_first_and_keeps_nulls(spark):
    path = scratch_path(spark, "edge-csv")
    lines = [("13-01-2024 05:00", "10.5", "x"), ("02-01-2024 06:00", "bad", "y"), ("never", "1", "z"), ("03-01-2024 07:00", None, "w")]
    spark.createDataFrame(lines, "timestamp string, consumption_kwh string, status string").coalesce(1).write.option("header", True).csv(path)
    got = src.scan_csv(spark, path).orderBy("ts").collect()
    assert [(r["ts"], r["consumption_kwh"], r["status"]) for r in got] == [
        (datetime(2024, 1, 2, 6), None, "y"), (datetime(2024, 1, 3, 7), None, "w"), (datetime(2024, 1, 13, 5), 10.5, "x")]
    with pytest.raises(KeyError):
        src.scan_csv(spark, path, ts="when")


@pytest.mark.parametrize("score,want", [(-0.2, "normal"), (0.0, "normal"), (0.1, "normal"), (0.3, "low"), (0.6, "medium"), (0.61, "high")])
def test_severity_upper_edges(spark, score, want):
    assert spark.range(1).select(labels.severity(F.lit(score)).alias("s")).first()["s"] == want


def test_histogram_edges(spark):
    scores = spark.createDataFrame([(v,) for v in (0.0, 0.1, 0.100001, 1.0, 1.5, -3.0)], "anomaly_score double")
    counts = {r["bin"]: r["count"] for r in readmodels.score_histogram(scores).collect()}
    assert counts == {0: 3, 1: 1, 9: 2, **{i: 0 for i in range(2, 9)}}
    urgency = spark.createDataFrame([(v,) for v in (0.0, 20.0, 99.9, 100.0)], "maintenance_urgency double")
    assert {r["bin"]: r["count"] for r in readmodels.urgency_histogram(urgency).collect()} == {0: 1, 1: 1, 2: 0, 3: 0, 4: 1}


def test_constant_and_empty_columns(spark):
    flat = hourly(spark, [5.0] * 30)
    assert clean.replace_far_values(flat, ["consumption_kwh"]).filter("consumption_kwh = 5").count() == 30
    assert clean.clip_extremes(flat, ["consumption_kwh", "voltage"]).filter("consumption_kwh = 5").count() == 30
    assert quality.outlier_summary(flat, ["consumption_kwh", "voltage"]).count() == 0
    assert readmodels.simple_anomalies(flat).filter("is_anomaly").count() == 0
    assert readmodels.trend(flat).first()["trend"] == pytest.approx(0.0)
    constant = {r["column"]: r["constant"] for r in quality.constant_columns(flat, ["consumption_kwh", "voltage"]).collect()}
    assert constant == {"consumption_kwh": True, "voltage": False}
    kept = {r["feature"]: r["kept"] for r in selection.variance_table(flat, ["consumption_kwh"]).collect()}
    assert kept == {"consumption_kwh": False}
    assert readmodels.trend(hourly(spark, [1.0] * 9)).first()["trend"] == 0.0


def test_first_row_wins_on_equal_times(spark):
    lines = [(2, 1, START, 20.0, None), (1, 1, START, 10.0, None), (3, 2, START, 30.0, None)]
    table = spark.createDataFrame(lines, "row_id long, series_id long, ts timestamp, consumption_kwh double, voltage double")
    assert sorted(r["row_id"] for r in clean.first_per_time(table).collect()) == [1, 3]
    again = table.unionByName(table.withColumn("row_id", F.col("row_id") + 10))
    assert sorted(r["row_id"] for r in clean.drop_equal_rows(again).collect()) == [1, 2, 3]


def test_resample_creates_and_fills_bins(spark):
    lines = [(1, 1, START + timedelta(minutes=5), 1.0), (2, 1, START + timedelta(minutes=50), 3.0), (3, 1, START + timedelta(hours=3), 9.0)]
    table = spark.createDataFrame(lines, "row_id long, series_id long, ts timestamp, consumption_kwh double")
    got = [r["consumption_kwh"] for r in clean.resample(table).orderBy("ts").collect()]
    assert got == [2.0, 2.0, 2.0, 9.0]


@pytest.mark.parametrize("n,left", [(47, 0), (48, 1), (49, 2)])
def test_feature_matrix_needs_full_windows(spark, n, left):
    table = hourly(spark, [float(i % 7) + 1 for i in range(n)], voltage=[230.0] * n)
    assert features.feature_matrix(table).count() == left


def test_rolling_matches_pandas(spark):
    values = [float((i * 37) % 23) for i in range(60)]
    made = features.add_lags_and_rolling(hourly(spark, values)).orderBy("ts").toPandas()
    want = made["consumption_kwh"]
    for size in (6, 48):
        for short, series in (("mean", want.rolling(size).mean()), ("std", want.rolling(size).std()), ("max", want.rolling(size).max())):
            np.testing.assert_allclose(made[f"consumption_kwh_roll_{short}_{size}h"].astype(float), series)
    np.testing.assert_allclose(made["consumption_kwh_lag_24h"].astype(float), want.shift(24))


def alert_rows(spark, seconds, rule="r"):
    lines = [(i, 1, START + timedelta(seconds=s), rule) for i, s in enumerate(seconds)]
    return spark.createDataFrame(lines, "row_id long, series_id long, ts timestamp, rule string")


@pytest.mark.parametrize("limit", [1_000_000, 1])
@pytest.mark.parametrize("times,fires", [
    ([0, 299], [0]), ([0, 300], [0, 300]), ([0, 301], [0, 301]), ([0, 200, 400], [0, 400]), ([0, 200, 400, 650, 700], [0, 400, 700]),
    ([10, 10, 10], [10])])
def test_cooldown_by_hand(spark, pieces, times, fires, limit):
    pieces(limit)
    got = cooldown.apply_cooldown(alert_rows(spark, times), 300)
    assert sorted((r["ts"] - START).total_seconds() for r in got.collect()) == fires


@pytest.mark.parametrize("limit,gaps,chunks", [(1_000_000, 64, 64), (1, 64, 64), (1, 4, 2), (1, 1, 3)])
def test_cooldown_against_a_loop(spark, pieces, monkeypatch, limit, gaps, chunks):
    """In one fold per key, in chunks, and in many rounds over small chunks."""
    pieces(limit)
    monkeypatch.setattr(cooldown, "_GAPS_PER_CHUNK", gaps)
    monkeypatch.setattr(cooldown, "_CHUNKS_PER_GROUP", chunks)
    draw = np.random.default_rng(3)
    times = sorted(int(t) for t in np.concatenate([draw.integers(0, 200_000, 300), draw.integers(50_000, 52_000, 200)]))
    want, last = [], None
    for t in times:
        if last is None or t - last >= 300:
            want.append(t)
            last = t
    got = cooldown.apply_cooldown(alert_rows(spark, times), 300).collect()
    assert sorted((r["ts"] - START).total_seconds() for r in got) == want


@pytest.mark.parametrize("n,limit", [(120, 1000), (120, 20), (97, 20), (2 * 53, 20), (1, 20)])
def test_spectrum_against_numpy(spark, n, limit):
    values = [float((i * i * 31) % 17 + 5 * np.sin(i)) for i in range(n)]
    got = spectrum.top_frequencies(hourly(spark, values), 5, limit=limit).orderBy("rank").collect()
    size = np.abs(np.fft.rfft(values))
    best = np.argsort(-size, kind="stable")[:5]
    assert [r["frequency"] for r in got] == list(best)
    np.testing.assert_allclose([r["magnitude"] for r in got], size[best], atol=1e-8)
    assert {r["length"] for r in got} == {n}


def test_rules_ignore_nulls_and_absent_columns(spark):
    table = hourly(spark, [600.0, None, 100.0], voltage=[None, 245.0, 230.0])
    got = {(r["row_id"], r["rule"]): r["message"] for r in rules.alerts(table).collect()}
    assert got == {(0, "high_consumption"): "High energy consumption detected: 600.0 kWh (threshold: 500 kWh)",
                   (1, "voltage_deviation"): "Voltage deviation detected: 245.0V (nominal: 230V)"}


def test_recommendations_neutral_without_predictions(spark):
    ids = [r["id"] for r in recommend.recommendations(hourly(spark, [300.0] * 20, voltage=[220.0, 240.0] * 10)).collect()]
    assert ids == ["voltage_optimization", "renewable_potential"]


def test_metrics_with_zero_actuals_and_unseen_class(spark):
    pairs = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0), (4.0, 4.0)], "y double, p double")
    row = metrics.regression_metrics(pairs, "y", "p").first()
    assert row["mape"] == pytest.approx(25.0) and row["mae"] == pytest.approx(2 / 3) and row["n_samples"] == 3
    classes = spark.createDataFrame([("a", "a"), ("a", "c"), ("b", "a")], "y string, p string")
    per = {r["class"]: (r["precision"], r["recall"], r["support"]) for r in metrics.class_metrics(classes, "y", "p").collect()}
    assert per == {"a": (0.5, 0.5, 2), "b": (0.0, 0.0, 1), "c": (0.0, 0.0, 0)}


def test_silhouettes_against_brute_force(spark):
    draw = np.random.default_rng(5)
    points = np.concatenate([draw.normal(0, 1, (40, 2)), draw.normal(4, 1, (30, 2)), draw.normal((0, 5), 1, (5, 2))])
    label = [0] * 40 + [1] * 30 + [2] * 5
    table = spark.createDataFrame([(i, float(x), float(y), c) for i, ((x, y), c) in enumerate(zip(points, label))],
                                  "row_id long, x double, y double, c int")

    def brute(distance):
        out = []
        for i in range(len(points)):
            d = np.array([distance(points[i] - points[j]) for j in range(len(points))])
            means = {c: d[[j for j in range(len(points)) if label[j] == c and j != i]].mean() for c in (0, 1, 2)}
            a, b = means[label[i]], min(v for c, v in means.items() if c != label[i])
            out.append((b - a) / max(a, b))
        return np.mean(out)

    assert metrics.silhouette_all_rows(table, ["x", "y"], "c").first()[0] == pytest.approx(brute(lambda v: (v ** 2).sum()))
    assert metrics.silhouette_sample(table, ["x", "y"], "c").first()[0] == pytest.approx(brute(lambda v: np.sqrt((v ** 2).sum())))


def scenario(spark, change=None):
    lines = [(i, START + timedelta(hours=i), 300.0 + (i * 53) % 300, 220.0 + i % 20) for i in range(168)]
    return spark.createDataFrame(lines, "row_id long, ts timestamp, consumption_kwh double, voltage double")


def fired(findings):
    return {(r["rule"], r["level"], r["column"]) for r in findings.collect()}


def test_validation_scenarios(spark):
    table = scenario(spark)
    assert quality.verdict(quality.validate(table)).first()["is_valid"]
    missing = quality.validate(table.drop("consumption_kwh"))
    assert fired(missing) == {("missing_column", "error", "consumption_kwh")}
    assert quality.classify_errors(missing).first()["error_code"] == "INVALID_COLUMNS"
    far = table.withColumn("consumption_kwh", F.when(F.col("row_id") == 50, 10000.0).otherwise(F.col("consumption_kwh")))
    assert ("outliers", "warning", "consumption_kwh") in fired(quality.validate(far))
    assert quality.verdict(quality.validate(far)).first()["is_valid"]
    few = table.withColumn("consumption_kwh", F.when(F.col("row_id") >= 11, F.col("consumption_kwh")))
    assert ("missing_values", "warning", "consumption_kwh") in fired(quality.validate(few))
    many = table.withColumn("consumption_kwh", F.when(F.col("row_id") >= 50, F.col("consumption_kwh")))
    assert ("missing_values", "error", "consumption_kwh") in fired(quality.validate(many))
    gaps = table.filter("row_id not between 40 and 59 and row_id not between 100 and 104")
    assert ("time_gaps", "warning", "ts") in fired(quality.validate(gaps))
    below = table.withColumn("consumption_kwh", F.when(F.col("row_id") == 3, -50.0).otherwise(F.col("consumption_kwh")))
    assert ("negative_values", "error", "consumption_kwh") in fired(quality.validate(below))
    assert ("too_few_rows", "error", None) in fired(quality.validate(table.limit(23), need_rows=True))
    text = quality.render_report(quality.quality_report(table))
    assert text.startswith("# Data Quality Report") and "total_rows: 168" in text


@pytest.mark.parametrize("seconds,label", [(30, "30s (sub-minute)"), (60, "1min"), (900, "15min"), (3600, "1h (hourly)"), (86400, "1d (daily)")])
def test_frequency_label(spark, seconds, label):
    assert spark.range(1).select(quality.frequency_label(F.lit(float(seconds))).alias("f")).first()["f"] == label


def test_search_sort_and_dates(spark):
    table = spark.createDataFrame([("b10", "9"), ("B2", "10"), ("c", None)], "name string, size string")
    assert search_rows(table, "b").count() == 2
    assert [r["size"] for r in sort_typed(table, "size").collect()] == [None, "9", "10"]
    dated = spark.createDataFrame([(START,), (START + timedelta(hours=23, minutes=59),), (START + timedelta(days=1),), (None,)], "ts timestamp")
    assert within_dates(dated, "2024-01-01", "2024-01-01").count() == 3
    roles = {r["role"]: r["column"] for r in column_roles(
        spark.createDataFrame([("x", "5,5", "231")], "label string, amount string, line_volts string"), ["label"]).collect()}
    assert roles == {"time": None, "consumption": "amount", "voltage": "line_volts"}


def test_run_without_manifest_is_refused(spark):
    root = scratch_path(spark, "edge-runs")
    spark.range(3).write.parquet(f"{root}/broken/frame")
    with pytest.raises(FileNotFoundError):
        results.load_run(spark, root, "broken")


def test_settings_defaults(spark):
    values = results.settings_dict(results.merge_settings(None, spark))
    assert values == results.DEFAULT_SETTINGS


def test_label_lookup_and_centres(spark):
    table = spark.createDataFrame([(1, 9.0), (1, 11.0), (0, 5.0), (2, 50.0), (3, 70.0)], "cluster int, consumption_kwh double")
    names = {r["cluster"]: r["efficiency_label"] for r in efficiency.name_clusters(table, "cluster").collect()}
    assert names == {0: "very efficient", 1: "efficient", 2: "moderate", 3: "inefficient"}
    flags = spark.createDataFrame([(0.2, 0.4, 1, 0), (0.9, 0.9, 1, 1), (0.0, 0.1, 0, 0)], "a double, b double, fa int, fb int")
    got = [(r["ensemble_flag"], r["ensemble_confidence"]) for r in detectors.vote(flags, ["a", "b"], ["fa", "fb"]).collect()]
    assert got == [(1, 0.0), (1, 1.0), (0, 1.0)]


def test_registry_calls_hooks_and_keeps_history(spark):
    table = hourly(spark, [float(i) for i in range(50)])
    report = lambda v: spark.createDataFrame([(v,)], "mae double")
    registry, seen = lifecycle.Registry(spark), []
    registry.register("m", "old", report(10.0), lambda df: ("new", report(9.0)))
    registry.on("replaced", lambda name, model: seen.append((name, model)))
    assert registry.retrain("m", table)["action"] == "MODEL_REPLACED"
    registry.trainers["m"] = lambda df: ("worse", report(8.9))
    assert registry.retrain("m", table)["action"] == "MODEL_KEPT"
    assert seen == [("m", "new")] and registry.models["m"] == "new" and registry.history().count() == 2
