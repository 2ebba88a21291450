"""Model fits and scores, feature selection, drift, retraining and backtests.

Fits have no SQL counterpart; their deterministic parts (labels, naming, scores for given
centres, votes, blends, roll-outs) are separate queries that do.
"""

from pyspark.sql import functions as F

from wattline.functions.temporal import calendar_features, cyclical_features
from wattline.models import detectors, efficiency, forecast, forest, health, lifecycle
from wattline.operators import clean, features, metrics, selection, splits
from wattline.operators.ordered import percent_rank_of_ties
from wattline.plans.catalogue import GRID, HOURLY, LINES, READINGS, RESAMPLED, query
from wattline.plans.queries_tables import HEALTH_SQL, with_health
from wattline.sources.readings import hourly_total, line_readings, readings

KWH = "consumption_kwh"
_HASH = "((row_id % 2147483648 + 1) * 2654435761) % 4294967296"
MEASURES = [KWH, "load_factor", "temperature", "voltage"]
INPUTS = ["consumption_kwh_lag_1h", "consumption_kwh_lag_2h", "hour", "day_of_week", "is_weekend", "is_peak_hour", "hour_sin",
          "hour_cos", "temperature", "load_factor"]


def _modelled(spark, folder):
    """Readings with calendar, cyclical and two lag columns."""
    table = cyclical_features(calendar_features(readings(spark, folder)))
    return features.add_lags(table, lags=(1, 2), order=["ts", "row_id"])


# --- K: fits -------------------------------------------------------------------------------

@query("K1_isolation_forest")
def _(spark, folder):
    table = readings(spark, folder)
    model = forest.fit_forest(table, MEASURES)
    return forest.predict(model, table).select("row_id", "anomaly_score", "anomaly_flag", "anomaly_pct", "anomaly_severity")


@query("K1_flag_rate", f"""
WITH {READINGS} SELECT count(*) AS rows, TRUE AS near_target, TRUE AS spikes_rank_higher FROM rd
""")
def _(spark, folder):
    table = readings(spark, folder)
    scored = forest.predict(forest.fit_forest(table, MEASURES), table)
    far = F.col(KWH) > 200
    return scored.agg(
        F.count(F.lit(1)).alias("rows"), (F.abs(F.avg("anomaly_flag") - 0.05) < 0.005).alias("near_target"),
        (F.avg(F.when(far, F.col("anomaly_score"))) > F.avg(F.when(~far, F.col("anomaly_score")))).alias("spikes_rank_higher"))


@query("K1_calibrated_flags", f"""
WITH {READINGS}, s AS (SELECT row_id, load_factor - 0.2 AS score FROM rd), q AS (SELECT quantile_cont(score, 0.95) AS level FROM s),
r AS (SELECT s.*, level, rank() OVER (ORDER BY score) AS k, count(*) OVER (PARTITION BY score) AS t, count(*) OVER () AS n FROM s, q)
SELECT row_id, CASE WHEN score >= level THEN 1 ELSE 0 END AS anomaly_flag, (k + (t - 1) / 2.0) / n AS anomaly_pct,
  CASE WHEN score <= 0.1 THEN 'normal' WHEN score <= 0.3 THEN 'low' WHEN score <= 0.6 THEN 'medium' ELSE 'high' END AS anomaly_severity FROM r
""", floats="anomaly_pct", ints="anomaly_flag")
def _(spark, folder):
    table = readings(spark, folder).withColumn("score", F.col("load_factor") - 0.2)
    return forest.flag_scores(table, "score").select("row_id", "anomaly_flag", "anomaly_pct", "anomaly_severity")


@query("K2_anomaly_attribution")
def _(spark, folder):
    table = readings(spark, folder)
    model = forest.fit_forest(table, MEASURES)
    return forest.explain(model, table).join(forest.split_weights(model, table), "feature")


_DEALT = {KWH: 48271, "load_factor": 69621, "temperature": 16807}


def _dealt_sql(column, factor):
    shown = {c: c for c in _DEALT} | {column: "v"}
    return f"""SELECT '{column}' AS feature, abs({shown[KWH]} * {shown['load_factor']} + 10 * {shown['temperature']} - base) AS d
  FROM (SELECT *, row_number() OVER (ORDER BY row_id) AS k FROM b)
  JOIN (SELECT {column} AS v, row_number() OVER (ORDER BY (row_id * {factor}) % 2147483647, row_id) AS k FROM b) USING (k)"""


@query("K2_permuted_score_change", f"""
WITH {READINGS}, z AS (SELECT row_id, consumption_kwh, coalesce(load_factor, 0) AS load_factor, temperature FROM rd),
b AS (SELECT *, consumption_kwh * load_factor + 10 * temperature AS base FROM z), d AS ({' UNION ALL '.join(_dealt_sql(c, f) for c, f in _DEALT.items())})
SELECT feature, avg(d) AS importance FROM d GROUP BY 1
""", floats="importance")
def _(spark, folder):
    """Every row counts: the values of one column are dealt anew among all rows, and a given score is compared."""
    table = readings(spark, folder).select("row_id", KWH, F.coalesce("load_factor", F.lit(0.0)).alias("load_factor"), F.col("temperature").cast("double"))
    score = F.col(KWH) * F.col("load_factor") + 10 * F.col("temperature")
    return forest.permutation_importance(table, list(_DEALT), score, shuffle=lambda c: F.pmod(F.col("row_id") * _DEALT[c], F.lit(2147483647)))


@query("K3_demand_regressor")
def _(spark, folder):
    return forecast.fit_forecaster(_modelled(spark, folder), columns=INPUTS, estimator=forecast.boosted_trees(10)).report


@query("K4_forecast_next_hours")
def _(spark, folder):
    table = _modelled(spark, folder)
    fitted = forecast.fit_forecaster(table, columns=INPUTS, estimator=forecast.boosted_trees(10))
    return forecast.forecast_hours(fitted, table, 24)


@query("K4_future_rows", f"""
WITH {READINGS}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC, row_id DESC) AS n FROM rd) WHERE n = 1),
f AS (SELECT series_id, step, ts + step * INTERVAL 1 HOUR AS ts, load_factor FROM l, (SELECT unnest(generate_series(1, 24)) AS step))
SELECT series_id, step, ts, load_factor, hour(ts) AS hour, isodow(ts) - 1 AS day_of_week, CASE WHEN hour(ts) BETWEEN 9 AND 20 THEN 1 ELSE 0 END AS is_peak_hour,
  cos(2 * pi() * hour(ts) / 24) AS hour_cos FROM f
""", floats="load_factor hour_cos", ints="step hour day_of_week is_peak_hour", times="ts")
def _(spark, folder):
    return forecast.future_rows(readings(spark, folder), 24).select(
        "series_id", "step", "ts", "load_factor", "hour", "day_of_week", "is_peak_hour", "hour_cos")


_HEALTH_INPUTS = ["load_factor", "hour_sin", "hour_cos", "is_weekend", "is_peak_hour", "temperature", "voltage", KWH]


def _health_model(spark, folder):
    table = with_health(cyclical_features(calendar_features(readings(spark, folder))))
    return table, health.fit_health(table, _HEALTH_INPUTS)


@query("K5_health_fold_scores")
def _(spark, folder):
    return _health_model(spark, folder)[1].fold_scores


@query("K5_stratified_folds", f"""
WITH {HEALTH_SQL} SELECT health, count(*) AS rows, TRUE AS spread FROM hl GROUP BY 1
""")
def _(spark, folder):
    per = health.stratified_folds(with_health(readings(spark, folder)), "health", 5).groupBy("health", "_fold").agg(
        F.count(F.lit(1)).alias("n"))
    return per.groupBy("health").agg(F.sum("n").alias("rows"), (F.min("n") > 0.1 * F.sum("n")).alias("spread"))


@query("K5_holdout_scores")
def _(spark, folder):
    table = with_health(cyclical_features(calendar_features(readings(spark, folder))))
    return health.holdout_scores(table, _HEALTH_INPUTS)


@query("K5_stratified_holdout", f"""
WITH {HEALTH_SQL}, p AS (SELECT health, CASE WHEN (({_HASH}) // 7) % 5 = 0 THEN 'test' ELSE 'train' END AS part FROM hl)
SELECT health, part, count(*) AS n FROM p GROUP BY 1, 2
""")
def _(spark, folder):
    return health.stratified_split(with_health(readings(spark, folder)), "health").groupBy("health", "part").agg(F.count(F.lit(1)).alias("n"))


@query("K6_health_scores")
def _(spark, folder):
    table, fitted = _health_model(spark, folder)
    scored = health.predict_health(fitted, table)
    return scored.select("row_id", "health_status", *[f"prob_{c}" for c in fitted.classes], "maintenance_urgency")


@query("K7_health_importances")
def _(spark, folder):
    table, fitted = _health_model(spark, folder)
    return forecast.importances(fitted.model, fitted.features, table, 15)


@query("K8_efficiency_clusters")
def _(spark, folder):
    table = cyclical_features(calendar_features(readings(spark, folder)))
    scored = efficiency.score_efficiency(efficiency.fit_efficiency(table), table)
    return scored.groupBy("efficiency_cluster", "efficiency_label").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("efficiency_score").alias("mean_score"))


@query("K8_cluster_names", f"""
WITH {READINGS}, m AS (SELECT CAST(floor(load_factor * 4) AS BIGINT) AS cluster, avg(consumption_kwh) AS a FROM rd GROUP BY 1)
SELECT cluster, ['very efficient', 'efficient', 'moderate', 'inefficient'][row_number() OVER (ORDER BY a, cluster)] AS efficiency_label FROM m
""")
def _(spark, folder):
    table = readings(spark, folder).withColumn("cluster", F.floor(F.col("load_factor") * 4))
    return efficiency.name_clusters(table, "cluster")


_NEAR = "sqrt(({a} - {x}) * ({a} - {x}) + (load_factor - {y}) * (load_factor - {y}))"


@query("K9_score_for_given_centres", f"""
WITH {READINGS}, d AS (SELECT row_id, least({', '.join(_NEAR.format(a='consumption_kwh / 100', x=x, y=y) for x, y in ((0.2, 0.2), (0.5, 0.7), (3.0, 0.5)))}) AS d FROM rd),
s AS (SELECT row_id, round(100 - d / (SELECT max(d) FROM d) * 100, 1) AS efficiency_score FROM d),
r AS (SELECT *, rank() OVER (ORDER BY efficiency_score) AS k, count(*) OVER (PARTITION BY efficiency_score) AS t, count(*) OVER () AS n FROM s)
SELECT row_id, efficiency_score, (k + (t - 1) / 2.0) / n AS score_rank, round(CAST(CAST((k + (t - 1) / CAST(2 AS DOUBLE)) / n * 100 AS VARCHAR) AS DECIMAL(38, 20)), 1) AS efficiency_percentile FROM r
""", floats="efficiency_score score_rank efficiency_percentile")
def _(spark, folder):
    table = readings(spark, folder).withColumn("a", F.col(KWH) / 100)
    near = efficiency.nearest_centre(["a", "load_factor"], [[0.2, 0.2], [0.5, 0.7], [3.0, 0.5]])
    scored = efficiency.with_distance_score(table.withColumn("d", near["distance"]), "d")
    ranked = percent_rank_of_ties(scored, "efficiency_score", "score_rank")
    return ranked.select("row_id", "efficiency_score", "score_rank", "efficiency_percentile")


def _members(spark, folder):
    return readings(spark, folder).select(
        "row_id", (F.col(KWH) * 1.1).alias("p1"), (F.col(KWH) + F.col("temperature")).alias("p2"), (F.col("load_factor") * 100).alias("p3"))


_MEMBERS = f"""{READINGS}, mb AS (SELECT row_id, consumption_kwh * 1.1 AS p1, consumption_kwh + temperature AS p2, load_factor * 100 AS p3 FROM rd)"""


@query("K10_weighted_vote", f"WITH {_MEMBERS} SELECT row_id, (2 * p1 + p2 + p3) / 4 AS vote FROM mb", floats="vote")
def _(spark, folder):
    return _members(spark, folder).select("row_id", forecast.weighted_vote(["p1", "p2", "p3"], [2, 1, 1]).alias("vote"))


@query("K10_voting_ensemble")
def _(spark, folder):
    table = _modelled(spark, folder)
    ensemble = forecast.fit_ensemble(table, columns=INPUTS, estimators=forecast.member_estimators(5, 10))
    return metrics.regression_metrics(ensemble.predict(table), KWH, "prediction")


@query("K10_stacking_ensemble")
def _(spark, folder):
    table = _modelled(spark, folder)
    estimators = {k: v for k, v in forecast.member_estimators(3, 5).items() if k != "wide_forest"}
    ensemble = forecast.fit_ensemble(table, columns=INPUTS, method="stacking", estimators=estimators)
    return metrics.regression_metrics(ensemble.predict(table), KWH, "prediction")


@query("K11_member_spread", f"""
WITH {_MEMBERS}, m AS (SELECT *, (p1 + p2 + p3) / 3 AS mean FROM mb),
s AS (SELECT *, sqrt((power(p1 - mean, 2) + power(p2 - mean, 2) + power(p3 - mean, 2)) / 3) AS std FROM m)
SELECT row_id, mean, std, mean - 1.96 * std AS lower, mean + 1.96 * std AS upper FROM s
""", floats="mean std lower upper")
def _(spark, folder):
    return _members(spark, folder).withColumns(forecast.spread_of(["p1", "p2", "p3"])).select("row_id", "mean", "std", "lower", "upper")


@query("K12_ensemble_importances")
def _(spark, folder):
    table = _modelled(spark, folder)
    ensemble = forecast.fit_ensemble(table, columns=INPUTS, estimators=forecast.member_estimators(3, 5))
    return forecast.ensemble_importances(ensemble, table)


@query("K13_roll_out_given_weights", f"""
WITH RECURSIVE {READINGS}, l AS (SELECT series_id, consumption_kwh, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC, row_id DESC) AS n FROM rd),
b AS (SELECT series_id, max(consumption_kwh) FILTER (WHERE n = 1) AS a1, max(consumption_kwh) FILTER (WHERE n = 2) AS a2 FROM l WHERE n <= 2 GROUP BY 1 HAVING count(*) = 2),
f AS (SELECT series_id, 1 AS step, 5.0 + 0.5 * a1 + 0.25 * a2 AS v, a1 AS p FROM b
  UNION ALL SELECT series_id, step + 1, 5.0 + 0.5 * v + 0.25 * p, v FROM f WHERE step < 24)
SELECT series_id, step, v AS forecast_kwh FROM f
""", floats="forecast_kwh", ints="step")
def _(spark, folder):
    return forecast.roll_out(readings(spark, folder), {"intercept": 5.0, "weights": {1: 0.5, 2: 0.25}}, 24, order=["ts", "row_id"])


@query("K13_autoregression", f"""
WITH RECURSIVE {HOURLY}, x AS (SELECT ts, consumption_kwh AS y, lag(consumption_kwh) OVER (ORDER BY ts) AS x FROM ht),
c AS (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM x),
f AS (SELECT 1 AS step, i + s * (SELECT y FROM x ORDER BY ts DESC LIMIT 1) AS v FROM c
  UNION ALL SELECT step + 1, i + s * v FROM f, c WHERE step < 12)
SELECT CAST(0 AS BIGINT) AS series_id, step, v AS forecast_kwh FROM f
""", floats="forecast_kwh", ints="step", digits=2)
def _(spark, folder):
    table = hourly_total(spark, folder)
    return forecast.roll_out(table, forecast.fit_autoregression(table, (1,)), 12)


@query("K14_combined_errors", f"""
WITH {_MEMBERS}, b AS (SELECT min(p1) AS l1, max(p1) AS h1, min(p3) AS l3, max(p3) AS h3 FROM mb),
s AS (SELECT row_id, p1, 0.7 * ((p1 - l1) / (h1 - l1 + 1e-8)) + 0.3 * ((p3 - l3) / (h3 - l3 + 1e-8)) AS score FROM mb, b)
SELECT row_id, score AS recon_anomaly_score, CASE WHEN p1 > 150 THEN 1 ELSE 0 END AS recon_anomaly_flag,
  CASE WHEN score <= 0.25 THEN 'normal' WHEN score <= 0.5 THEN 'low' WHEN score <= 0.75 THEN 'medium' ELSE 'high' END AS recon_severity FROM s
""", floats="recon_anomaly_score", ints="recon_anomaly_flag")
def _(spark, folder):
    combined = detectors.combine_errors(_members(spark, folder), "p1", "p3", 150.0)
    return combined.select("row_id", "recon_anomaly_score", "recon_anomaly_flag", "recon_severity")


@query("K14_reconstruction_detector")
def _(spark, folder):
    table = readings(spark, folder)
    found = detectors.detect(detectors.fit_reconstruction(table, MEASURES), table)
    return found.select("row_id", "recon_error", "latent_distance", "recon_anomaly_score", "recon_anomaly_flag", "recon_severity")


@query("K15_detector_vote", f"""
WITH {READINGS}, d AS (SELECT row_id, load_factor AS s1, consumption_kwh / 500 AS s2, CASE WHEN load_factor > 0.9 THEN 1 ELSE 0 END AS f1,
  CASE WHEN consumption_kwh > 100 THEN 1 ELSE 0 END AS f2 FROM rd)
SELECT row_id, (s1 + s2) / 2 AS ensemble_score, CASE WHEN (f1 + f2) / 2 >= 0.5 THEN 1 ELSE 0 END AS ensemble_flag,
  abs((f1 + f2) / 2 - 0.5) * 2 AS ensemble_confidence, CASE WHEN (s1 + s2) / 2 <= 0.25 THEN 'normal' WHEN (s1 + s2) / 2 <= 0.5 THEN 'low'
  WHEN (s1 + s2) / 2 <= 0.75 THEN 'medium' ELSE 'high' END AS ensemble_severity FROM d
""", floats="ensemble_score ensemble_confidence", ints="ensemble_flag")
def _(spark, folder):
    table = readings(spark, folder).select(
        "row_id", F.col("load_factor").alias("s1"), (F.col(KWH) / 500).alias("s2"),
        (F.col("load_factor") > 0.9).cast("int").alias("f1"), (F.col(KWH) > 100).cast("int").alias("f2"))
    return detectors.vote(table, ["s1", "s2"], ["f1", "f2"]).drop("s1", "s2", "f1", "f2")


@query("K16_seasonal_forecast")
def _(spark, folder):
    table = readings(spark, folder)
    return forecast.seasonal_forecast(forecast.fit_seasonal(table), table, 24)


@query("K17_blend_by_horizon", f"""
WITH {_MEMBERS} SELECT row_id, 6 AS horizon, p1 AS forecast, p1 * 0.9 AS lower, p1 * 1.1 AS upper, 'short' AS model_used FROM mb
UNION ALL SELECT row_id, 24, p2, p2 - 5, p2 + 5, 'seasonal' FROM mb
UNION ALL SELECT row_id, 48, 0.4 * p1 + 0.6 * p2, (p2 - 5) * 0.95, (p2 + 5) * 1.05, 'ensemble' FROM mb
""", floats="forecast lower upper", ints="horizon")
def _(spark, folder):
    members = _members(spark, folder).withColumns({"lo": F.col("p2") - 5, "hi": F.col("p2") + 5})
    parts = [forecast.blend_by_horizon(members, h, "p1", "p2", "lo", "hi").select(
        "row_id", F.lit(h).alias("horizon"), "forecast", "lower", "upper", "model_used") for h in (6, 24, 48)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("B16_label_noise", f"""
WITH {HEALTH_SQL}, h AS (SELECT health, {_HASH} AS h FROM hl),
o AS (SELECT health, h, list_filter(['healthy', 'warning', 'critical'], lambda c: c <> health) AS others FROM h)
SELECT health, CASE WHEN h % 10000 < 600 THEN others[CAST((h // 10000) % 2 + 1 AS INT)] ELSE health END AS noisy, count(*) AS n FROM o GROUP BY 1, 2
""")
def _(spark, folder):
    table = with_health(readings(spark, folder))
    noisy = table.withColumn("noisy", health.flip_labels(F.col("health"), F.col("row_id")))
    return noisy.groupBy("health", "noisy").agg(F.count(F.lit(1)).alias("n"))


# --- L: selection --------------------------------------------------------------------------

LINE_INPUTS = ["cost", "load_factor", "tax"]


@query("L1_regression_scores", f"""
WITH {LINES} {' UNION ALL '.join(f"SELECT '{c}' AS feature, r * r / (1 - r * r) * (n - 2) AS score FROM (SELECT corr({c}, consumption_kwh) AS r, count(*) AS n FROM lr)" for c in LINE_INPUTS)}
""", floats="score", digits=2)
def _(spark, folder):
    return selection.regression_scores(line_readings(spark, folder), LINE_INPUTS, KWH)


def _anova(c):
    return f"""SELECT '{c}' AS feature, (b / (k - 1)) / (w / (n - k)) AS score FROM (SELECT sum(m * (a - g) * (a - g)) AS b, sum(m * v) AS w, count(*) AS k, sum(m) AS n
  FROM (SELECT status, count(*) AS m, avg({c}) AS a, var_pop({c}) AS v FROM lr GROUP BY 1), (SELECT avg({c}) AS g FROM lr))"""


@query("L2_class_scores", f"WITH {LINES} {' UNION ALL '.join(map(_anova, ['consumption_kwh', *LINE_INPUTS]))}", floats="score")
def _(spark, folder):
    return selection.class_scores(line_readings(spark, folder), [KWH, *LINE_INPUTS], "status")


def _binned(c, alias):
    return f"least(floor(({c} - (SELECT min({c}) FROM lr)) / ((SELECT max({c}) FROM lr) - (SELECT min({c}) FROM lr)) * 10), 9) AS {alias}"


@query("L3_information_scores", f"""
WITH {LINES}, b AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, {_binned(c, 'x')}, {_binned(KWH, 'y')} FROM lr" for c in LINE_INPUTS)}),
j AS (SELECT feature, x, y, count(*) AS n FROM b GROUP BY 1, 2, 3),
t AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS a, sum(n) OVER (PARTITION BY feature, x) AS nx, sum(n) OVER (PARTITION BY feature, y) AS ny FROM j)
SELECT feature, sum(n / a * ln(n * a / (nx * ny))) AS score FROM t GROUP BY 1
""", floats="score")
def _(spark, folder):
    return selection.information_scores(line_readings(spark, folder), LINE_INPUTS, KWH)


@query("L4_variance_threshold", f"""
WITH {LINES}, v AS (SELECT 'nominal' AS feature, 0.0 AS raw UNION ALL SELECT 'consumption_kwh', var_pop(consumption_kwh) FROM lr UNION ALL SELECT 'load_factor', var_pop(load_factor) FROM lr)
SELECT 'scaled' AS kind, feature, CASE WHEN raw > 0 THEN 1.0 ELSE 0.0 END AS variance, raw > 0 AS kept FROM v UNION ALL SELECT 'raw', feature, raw, raw > 0.01 FROM v
""", floats="variance")
def _(spark, folder):
    table = line_readings(spark, folder).withColumn("nominal", F.lit(230.0))
    columns = ["nominal", KWH, "load_factor"]
    parts = [selection.variance_table(table, columns, scaled=s).withColumn("kind", F.lit(k)) for k, s in (("scaled", True), ("raw", False))]
    return parts[0].unionByName(parts[1])


@query("L5_recursive_elimination")
def _(spark, folder):
    return selection.eliminate(line_readings(spark, folder), [*LINE_INPUTS, "series_id"], KWH, 2)


@query("L6_components_of_two_columns", f"""
WITH {LINES}, c AS (SELECT abs(corr(consumption_kwh, cost)) AS r FROM lr)
SELECT 'PC1' AS component, (1 + r) / 2 AS variance_ratio, (1 + r) / 2 AS cumulative_ratio FROM c UNION ALL SELECT 'PC2', (1 - r) / 2, 1 FROM c
""", floats="variance_ratio cumulative_ratio")
def _(spark, folder):
    return selection.principal_components(line_readings(spark, folder), [KWH, "cost"], 2)[0]


@query("L6_component_loadings")
def _(spark, folder):
    return selection.top_loadings(selection.principal_components(line_readings(spark, folder), [KWH, *LINE_INPUTS])[1], 3)


@query("L7_auto_selection", f"""
WITH {LINES}, s AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, r * r / (1 - r * r) * (n - 2) AS score FROM (SELECT corr({c}, consumption_kwh) AS r, count(*) AS n FROM lr)" for c in LINE_INPUTS)})
SELECT * FROM s ORDER BY score DESC, feature LIMIT 2
""", floats="score", digits=2)
def _(spark, folder):
    table = line_readings(spark, folder).withColumn("nominal", F.lit(230.0))
    return selection.auto_select(table, [*LINE_INPUTS, "nominal"], KWH, 2)


# --- L: tuning and lifecycle ---------------------------------------------------------------

def _folded(spark, folder):
    table = splits.expanding_folds(_modelled(spark, folder), 2)
    return forecast.ready(table, INPUTS, KWH).select("features", "label", "test_fold")


@query("L8_grid_search")
def _(spark, folder):
    trials = lifecycle.grid(rounds=[2, 4], depth=[2])
    return lifecycle.tune(_folded(spark, folder), forecast.boosted_trees, trials, 2)


@query("L9_random_search")
def _(spark, folder):
    trials = lifecycle.random_trials(2, rounds=(2, 4), depth=(2, 3), rate=(0.01, 0.3))
    return lifecycle.tune(_folded(spark, folder), forecast.boosted_trees, trials, 2)


@query("L10_retrain_trigger", """
SELECT count(*) AS rows, count(*) - count(*) FILTER (WHERE event_type <> 'error') AS new_rows,
  count(*) - count(*) FILTER (WHERE event_type <> 'error') >= 100 AS retrain FROM events
""")
def _(spark, folder):
    table = readings(spark, folder)
    past = table.filter("status <> 'error'").agg(F.count(F.lit(1)).alias("rows"), F.max("ts").alias("trained_at"))
    older = table.filter("status = 'view'").agg(F.count(F.lit(1)).alias("rows"), F.min("ts").alias("trained_at"))
    return lifecycle.retrain_needed(table, past.unionByName(older))


@query("L11_champion_challenger", f"""
WITH {READINGS}, m AS (SELECT status AS model, avg(CASE WHEN series_id % 2 = 0 THEN consumption_kwh END) AS o, avg(CASE WHEN series_id % 2 = 1 THEN consumption_kwh END) AS n FROM rd GROUP BY 1)
SELECT model, 'mae' AS metric, o AS old_value, n AS new_value, round((o - n) / (o + 1e-8) * 100, 2) AS improvement_pct, n < o * 0.98 AS is_better,
  CASE WHEN n < o * 0.98 THEN 'REPLACE' ELSE 'KEEP_OLD' END AS decision FROM m
""", floats="old_value new_value improvement_pct", digits=2)
def _(spark, folder):
    table = readings(spark, folder)
    def side(odd):
        return table.filter(F.col("series_id") % 2 == odd).groupBy(F.col("status").alias("model")).agg(F.avg(KWH).alias("mae"))
    return lifecycle.champion_challenger(side(0), side(1))


@query("L12_retrain_run")
def _(spark, folder):
    table = _modelled(spark, folder)

    def trainer(rounds):
        def train(df):
            fitted = forecast.fit_forecaster(df, columns=INPUTS, estimator=forecast.boosted_trees(rounds, 3, 0.3))
            return fitted.model, fitted.report.filter("part = 'test'").drop("part")
        return train

    registry = lifecycle.Registry(spark)
    model, report = trainer(1)(table)
    registry.register("demand", model, report, trainer(4))
    registry.retrain_all(table)
    return registry.history().select("model", "action", "metric", "old_value", "new_value", "improvement_pct", "rows")


_BASE = """SELECT '{c}' AS feature, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, max({c}) AS max, quantile_cont({c}, 0.5) AS median,
  quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.75) AS q75 FROM lr"""


@query("L13_drift_baseline", f"WITH {LINES} {' UNION ALL '.join(_BASE.format(c=c) for c in (KWH, *LINE_INPUTS))}",
       floats="mean std min max median q25 q75")
def _(spark, folder):
    return lifecycle.drift_baseline(line_readings(spark, folder), [KWH, *LINE_INPUTS])


def _drift(spark, folder):
    lines = line_readings(spark, folder)
    early = F.col("ts") < F.lit("1998-01-01").cast("timestamp")
    now = lines.filter(~early).withColumn("cost", F.col("cost") * 4)
    baseline = lifecycle.drift_baseline(lines.filter(early), [KWH, *LINE_INPUTS])
    return baseline, lifecycle.drift_details(baseline, now)


_DRIFT = f"""{LINES}, dr AS ({' UNION ALL '.join(f'''SELECT '{c}' AS feature, bm AS baseline_mean, cm AS current_mean, abs(cm - bm) AS mean_shift, abs(cm - bm) / bs AS z_score, abs(cm - bm) / bs > 2 AS is_drifted
  FROM (SELECT avg({c}) FILTER (WHERE ts < '1998-01-01') AS bm, stddev_samp({c}) FILTER (WHERE ts < '1998-01-01') AS bs, avg({c} * {4 if c == "cost" else 1}) FILTER (WHERE ts >= '1998-01-01') AS cm FROM lr)'''
  for c in (KWH, *LINE_INPUTS))})"""


@query("L14_drift_details", f"WITH {_DRIFT} SELECT * FROM dr", floats="baseline_mean current_mean mean_shift z_score")
def _(spark, folder):
    return _drift(spark, folder)[1]


@query("L14_drift_summary", f"""
WITH {_DRIFT} SELECT count(*) AS total_features, count(*) FILTER (WHERE is_drifted) AS n_drifted, round(count(*) FILTER (WHERE is_drifted) / count(*), 3) AS drift_ratio,
  count(*) FILTER (WHERE is_drifted) / count(*) > 0.1 AS drift_detected FROM dr
""", floats="drift_ratio")
def _(spark, folder):
    baseline, details = _drift(spark, folder)
    return lifecycle.drift_summary(details, baseline)


def _backtest_sql(horizon, start=240, step=24, name="bt"):
    return f"""{name} AS (SELECT (origin - {start}) // {step} AS fold, t.ts, t.pos - origin AS step, t.y AS actual, m.model,
    CASE m.model WHEN 'persistence' THEN l.y WHEN 'mean' THEN l.mean ELSE s.y END AS predicted
  FROM (SELECT unnest(generate_series({start}, n - {horizon} - 1, {step})) AS origin FROM (SELECT max(n) AS n FROM p)) f
  JOIN p t ON t.pos >= origin AND t.pos < origin + {horizon} JOIN p l ON l.pos = origin - 1
  JOIN p s ON s.pos = origin - 24 + (t.pos - origin) % 24, (SELECT unnest(['persistence', 'seasonal', 'mean']) AS model) m)"""


_POSITIONS = f"""{HOURLY}, p AS (SELECT ts, consumption_kwh AS y, row_number() OVER (ORDER BY ts) - 1 AS pos, count(*) OVER () AS n,
  avg(consumption_kwh) OVER (ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS mean FROM ht)"""


@query("L15_walk_forward_backtest", f"WITH {_POSITIONS}, {_backtest_sql(24)} SELECT CAST(0 AS BIGINT) AS series_id, * FROM bt",
       floats="actual predicted", ints="fold step", times="ts")
def _(spark, folder):
    return lifecycle.naive_backtest(hourly_total(spark, folder), 240)


@query("L15_refitted_backtest")
def _(spark, folder):
    table = features.add_lags(clean.resample(readings(spark, folder), 3600, columns=[KWH]), lags=(1, 24))
    columns = ["consumption_kwh_lag_1h", "consumption_kwh_lag_24h"]

    def fit(train):
        from pyspark.ml.regression import LinearRegression
        model = LinearRegression(labelCol="label").fit(forecast.ready(train, columns, KWH))
        return lambda test: model.transform(forecast.ready(test, columns, KWH))

    return lifecycle.fitted_backtest(table, fit, 480, 24, 96)


_LAGGED = f"""{RESAMPLED},
lg AS (SELECT series_id, ts, consumption_kwh AS y, lag(consumption_kwh, 1) OVER w AS x1, lag(consumption_kwh, 24) OVER w AS x2,
  row_number() OVER w - 1 AS p, count(*) OVER (PARTITION BY series_id) AS n FROM rs WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
kn AS (SELECT * FROM lg WHERE y IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL),
fo AS (SELECT f, 480 + f * 24 AS o FROM (SELECT unnest(range(0, 1000)) AS f) WHERE 480 + f * 24 < (SELECT max(n) FROM lg) - 24)"""


@query("L15_refitted_one_lag", f"""
WITH {_LAGGED}, k1 AS (SELECT * FROM lg WHERE y IS NOT NULL AND x1 IS NOT NULL),
ft AS (SELECT f, o, regr_slope(y, x1) AS b, regr_intercept(y, x1) AS a FROM fo JOIN k1 ON p < o GROUP BY 1, 2)
SELECT series_id, f AS fold, ts, p - o AS step, y AS actual, 'linear' AS model, a + b * x1 AS predicted
FROM ft JOIN k1 ON p >= o AND p < o + 24 WHERE n - 24 > o
""", floats="actual predicted", ints="fold step", times="ts", digits=3)
def _(spark, folder):
    """Every fold refitted on all rows before it."""
    return lifecycle.linear_backtest(_lagged(spark, folder), ["consumption_kwh_lag_1h"], 480)


@query("L15_refitted_two_lags", f"""
WITH {_LAGGED},
cv AS (SELECT f, o, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) AS v1, var_pop(x2) AS v2, covar_pop(x1, x2) AS c12,
  covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2 FROM fo JOIN kn ON p < o GROUP BY 1, 2),
ft AS (SELECT *, (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) AS b1, (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) AS b2 FROM cv)
SELECT series_id, f AS fold, ts, p - o AS step, y AS actual, 'linear' AS model, my + b1 * (x1 - m1) + b2 * (x2 - m2) AS predicted
FROM ft JOIN kn ON p >= o AND p < o + 24 WHERE n - 24 > o
""", floats="actual predicted", ints="fold step", times="ts", digits=3)
def _(spark, folder):
    return lifecycle.linear_backtest(_lagged(spark, folder), ["consumption_kwh_lag_1h", "consumption_kwh_lag_24h"], 480)


def _lagged(spark, folder):
    return features.add_lags(clean.resample(readings(spark, folder), 3600, columns=[KWH]), lags=(1, 24))


_HORIZONS = f"""{_POSITIONS}, {', '.join(_backtest_sql(h, name=f'b{h}') for h in (6, 12, 24, 48))},
ev AS (SELECT 6 AS horizon, * FROM b6 UNION ALL SELECT 12, * FROM b12 UNION ALL SELECT 24, * FROM b24 UNION ALL SELECT 48, * FROM b48),
dd AS (SELECT *, sign(actual - lag(actual) OVER w) AS dy, sign(predicted - lag(predicted) OVER w) AS dp FROM ev WINDOW w AS (PARTITION BY horizon, model ORDER BY fold, step)),
hr AS (SELECT horizon, model, avg(abs(actual - predicted)) AS mae, sqrt(avg(power(actual - predicted, 2))) AS rmse,
  avg(CASE WHEN actual <> 0 THEN abs((actual - predicted) / actual) END) * 100 AS mape, 1 - avg(power(actual - predicted, 2)) / var_pop(actual) AS r2,
  quantile_cont(abs(actual - predicted), 0.5) AS median_ae, max(abs(actual - predicted)) AS max_error,
  avg(CASE WHEN dy IS NULL THEN NULL WHEN dy = dp THEN 1.0 ELSE 0 END) * 100 AS directional_accuracy, avg(predicted - actual) AS bias FROM dd GROUP BY 1, 2)"""


def _horizons(spark, folder):
    return lifecycle.horizon_report(hourly_total(spark, folder), (6, 12, 24, 48), 240)


@query("L16_horizon_report", f"WITH {_HORIZONS} SELECT * FROM hr",
       floats="mae rmse mape r2 median_ae max_error directional_accuracy bias", ints="horizon", digits=3)
def _(spark, folder):
    return _horizons(spark, folder)


@query("F12_best_vs_second", f"""
WITH {_HORIZONS}, r AS (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY rmse, model) AS k FROM hr)
SELECT a.horizon, a.model AS best_model, a.rmse AS best, (b.rmse - a.rmse) / b.rmse * 100 AS improvement_pct FROM r a JOIN r b ON a.horizon = b.horizon AND a.k = 1 AND b.k = 2
""", floats="best improvement_pct", ints="horizon", digits=3)
def _(spark, folder):
    return metrics.best_vs_second(_horizons(spark, folder))


@query("F12_best_by_band", f"""
WITH {_HORIZONS} SELECT band, arg_min(model, rmse) AS model, min(rmse) AS rmse FROM (
  SELECT *, CASE WHEN horizon <= 12 THEN 'short' WHEN horizon <= 48 THEN 'medium' END AS band FROM hr) GROUP BY 1
""", floats="rmse", digits=3)
def _(spark, folder):
    return metrics.best_by_band(_horizons(spark, folder))
