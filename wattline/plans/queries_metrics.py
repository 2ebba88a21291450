"""Evaluation metrics, curves, comparisons and fit diagnoses."""

from pyspark.sql import functions as F

from wattline.operators import features, metrics, splits
from wattline.plans.catalogue import HOURLY, READINGS, SCORED, query, scored
from wattline.sources.readings import hourly_total, readings

KWH = "consumption_kwh"
BY_TIME = ["ts", "row_id"]


def _pairs(spark, folder):
    """Each reading with its predecessor as forecast; ``model`` splits the series into three groups."""
    made = features.persistence(readings(spark, folder), KWH, "predicted", order=BY_TIME)
    return made.withColumn("model", F.concat(F.lit("m"), (F.col("series_id") % 3).cast("string")))


_PAIRS = f"""{READINGS}, pr AS (SELECT *, 'm' || (series_id % 3) AS model, coalesce(lag(consumption_kwh) OVER (
  PARTITION BY series_id ORDER BY ts, row_id), consumption_kwh) AS predicted FROM rd)"""


def _regression_sql(by, source="pr", zeros="CASE WHEN {y} <> 0 THEN abs(({y} - {p}) / {y}) END"):
    y, p = KWH, "predicted"
    group = f"GROUP BY {', '.join(by)}" if by else ""
    head = "".join(f"{b}, " for b in by)
    ape = zeros.format(y=y, p=p)
    return f"""SELECT {head}mae, mse, sqrt(mse) AS rmse, mape, smape, 1 - mse / vy AS r2,
  1 - (mse / vy) * (n_samples - 1) / (n_samples - 2) AS adjusted_r2, max_error, median_ae, 1 - ve / vy AS explained_variance, n_samples
FROM (SELECT {head}count(*) AS n_samples, avg(abs({y} - {p})) AS mae, avg(({y} - {p}) * ({y} - {p})) AS mse,
  avg({ape}) * 100 AS mape, avg(2 * abs({p} - {y}) / (abs({y}) + abs({p}) + 1e-8)) * 100 AS smape, max(abs({y} - {p})) AS max_error,
  quantile_cont(abs({y} - {p}), 0.5) AS median_ae, var_pop({y}) AS vy, var_pop({y} - {p}) AS ve FROM {source} {group})"""


_EPSILON = "abs({y} - {p}) / greatest(abs({y}), 2.220446049250313e-16)"
_REG = "mae mse rmse mape smape r2 adjusted_r2 max_error median_ae explained_variance"


@query("J1_regression_metrics", f"WITH {_PAIRS} {_regression_sql(['model'])}", floats=_REG, digits=3)
def _(spark, folder):
    return metrics.regression_metrics(_pairs(spark, folder), KWH, "predicted", ["model"])


@query("J1_percentage_error_variants", f"""
WITH {_PAIRS} SELECT avg(CASE WHEN y <> 0 THEN abs((y - p) / y) END) * 100 AS masked, avg(abs((p - y) / (y + 1e-8))) * 100 AS shifted,
  avg(abs((y - p) / greatest(abs(y), 1e-6))) * 100 AS floored
FROM (SELECT floor(consumption_kwh) + 1 AS y, floor(predicted) AS p FROM pr)
""", floats="masked shifted floored", digits=3)
def _(spark, folder):
    pairs = _pairs(spark, folder).select((F.floor(KWH) + 1).cast("double").alias("y"), F.floor("predicted").cast("double").alias("p"))
    made = [(F.avg(metrics.percentage_error(F.col("y"), F.col("p"), z)) * 100).alias(n)
            for z, n in (("mask", "masked"), ("shift", "shifted"), ("floor", "floored"))]
    return pairs.agg(*made)


@query("J2_forecast_metrics", f"""
WITH {_PAIRS}, d AS (SELECT *, sign(consumption_kwh - lag(consumption_kwh) OVER w) AS dy, sign(predicted - lag(predicted) OVER w) AS dp
  FROM pr WINDOW w AS (PARTITION BY model, series_id ORDER BY ts, row_id)),
x AS (SELECT model, avg(CASE WHEN dy IS NULL THEN NULL WHEN dy = dp THEN 1.0 ELSE 0 END) * 100 AS directional_accuracy,
  avg(predicted - consumption_kwh) AS bias FROM d GROUP BY 1)
SELECT model, mae, rmse, mape, r2, median_ae, max_error, directional_accuracy, bias FROM ({_regression_sql(['model'], zeros=_EPSILON)}) JOIN x USING (model)
""", floats="mae rmse mape r2 median_ae max_error directional_accuracy bias", digits=3)
def _(spark, folder):
    return metrics.forecast_metrics(_pairs(spark, folder), KWH, "predicted", ["model"])


@query("J2_zero_actuals", f"""
WITH {_PAIRS}, z AS (SELECT * REPLACE (CASE WHEN row_id % 50 = 0 THEN 0.0 ELSE consumption_kwh END AS consumption_kwh) FROM pr)
SELECT model, mae, bias, log10(mape) AS log_mape FROM (SELECT model, avg(abs(consumption_kwh - predicted)) AS mae,
  avg(predicted - consumption_kwh) AS bias, avg({_EPSILON.format(y=KWH, p='predicted')}) * 100 AS mape FROM z GROUP BY 1)
""", floats="mae bias log_mape", digits=3)
def _(spark, folder):
    pairs = _pairs(spark, folder).withColumn(KWH, F.when(F.col("row_id") % 50 == 0, 0.0).otherwise(F.col(KWH)))
    made = metrics.forecast_metrics(pairs, KWH, "predicted", ["model"])
    return made.select("model", "mae", "bias", F.log10("mape").alias("log_mape"))


# Three-class pair: the rule label against a second label from load bands.
_CLASSES = f"""{SCORED}, cl AS (SELECT row_id, series_id, health_status AS actual,
  CASE WHEN load_factor < 0.3 THEN 'healthy' WHEN load_factor < 0.8 THEN 'warning' ELSE 'critical' END AS guess, load_factor FROM sc)"""


def _classes(spark, folder):
    return scored(spark, folder).select(
        "row_id", "series_id", F.col("health_status").alias("actual"),
        F.when(F.col("load_factor") < 0.3, "healthy").when(F.col("load_factor") < 0.8, "warning").otherwise("critical").alias("guess"),
        "load_factor")


_CONFUSION = """cm AS (SELECT a.c AS actual, p.c AS predicted, count(cl.row_id) AS count
  FROM (SELECT DISTINCT actual AS c FROM cl UNION SELECT DISTINCT guess FROM cl) a
  JOIN (SELECT DISTINCT actual AS c FROM cl UNION SELECT DISTINCT guess FROM cl) p ON TRUE
  LEFT JOIN cl ON cl.actual = a.c AND cl.guess = p.c GROUP BY 1, 2),
pc AS (SELECT k.c AS class, sum(CASE WHEN actual = k.c AND predicted = k.c THEN count ELSE 0 END) AS tp,
  sum(CASE WHEN actual = k.c THEN count ELSE 0 END) AS support, sum(CASE WHEN predicted = k.c THEN count ELSE 0 END) AS guessed,
  sum(count) AS total FROM cm, (SELECT DISTINCT actual AS c FROM cm) k GROUP BY 1),
cr AS (SELECT class, tp / guessed AS precision, tp / support AS recall, 2 * tp / (guessed + support) AS f1_score,
  (total - support - guessed + tp) / (total - support) AS specificity, support, tp FROM pc)"""


@query("J3_confusion_matrix", f"""
WITH {_CLASSES}, {_CONFUSION} SELECT actual, predicted, count, count / (sum(count) OVER (PARTITION BY actual) + 1e-8) AS share FROM cm
""", floats="share")
def _(spark, folder):
    return metrics.confusion(_classes(spark, folder), "actual", "guess")


@query("J4_class_metrics", f"WITH {_CLASSES}, {_CONFUSION} SELECT * FROM cr",
       floats="precision recall f1_score specificity", ints="support tp")
def _(spark, folder):
    return metrics.class_metrics(_classes(spark, folder), "actual", "guess")


@query("J4_weighted_summary", f"""
WITH {_CLASSES}, {_CONFUSION} SELECT sum(tp) / sum(support) AS accuracy, sum(precision * support) / sum(support) AS precision,
  sum(recall * support) / sum(support) AS recall, sum(f1_score * support) / sum(support) AS f1_score, avg(specificity) AS specificity,
  count(*) AS n_classes, sum(support) AS n_samples FROM cr
""", floats="accuracy precision recall f1_score specificity", ints="n_samples")
def _(spark, folder):
    return metrics.classification_summary(_classes(spark, folder), "actual", "guess")


@query("J4_binary_summary", """
WITH c AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS fp,
  count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS fn, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS tn FROM labels)
SELECT (tp + tn) / (tp + tn + fp + fn) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
  coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1_score, (coalesce(tn / nullif(tn + fp, 0), 0) + coalesce(tp / nullif(tp + fn, 0), 0)) / 2 AS specificity,
  2 AS n_classes, tp + tn + fp + fn AS n_samples FROM c
""", floats="accuracy precision recall f1_score specificity", ints="n_classes")
def _(spark, folder):
    table = spark.read.parquet(f"{folder}/labels.parquet")
    return metrics.classification_summary(table, "quality", "toxic", positive=1)


def _one_vs_rest(spark, folder):
    table = _classes(spark, folder).withColumns({
        "p_healthy": 1 - F.col("load_factor"), "p_warning": 1 - 2 * F.abs(F.col("load_factor") - 0.5), "p_critical": F.col("load_factor")})
    return metrics.one_vs_rest(table, "actual", {c: f"p_{c}" for c in ("healthy", "warning", "critical")})


_OVR = f"""{_CLASSES}, ov AS (
  SELECT 'healthy' AS class, actual = 'healthy' AS hit, 1 - load_factor AS score FROM cl
  UNION ALL SELECT 'warning', actual = 'warning', 1 - 2 * abs(load_factor - 0.5) FROM cl
  UNION ALL SELECT 'critical', actual = 'critical', load_factor FROM cl),
sp AS (SELECT class, score, count(*) FILTER (WHERE hit) AS p, count(*) FILTER (WHERE NOT hit) AS n FROM ov GROUP BY 1, 2),
cu AS (SELECT class, score, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY class) AS pos, sum(n) OVER (PARTITION BY class) AS neg
  FROM sp WINDOW w AS (PARTITION BY class ORDER BY score DESC))"""


@query("J5_roc_curve", f"""
WITH {_OVR} SELECT class, score, fp / neg AS fpr, tp / pos AS tpr FROM cu UNION ALL SELECT DISTINCT class, NULL, 0, 0 FROM cu
""", floats="score fpr tpr")
def _(spark, folder):
    return metrics.roc_curve(_one_vs_rest(spark, folder), "hit", "score", ["class"], drop_straight=False)


@query("J5_roc_curve_corners", f"""
WITH {_OVR}, b AS (SELECT *, lag(tp) OVER w - 2 * tp + lead(tp) OVER w AS bt, lag(fp) OVER w - 2 * fp + lead(fp) OVER w AS bf
  FROM cu WINDOW w AS (PARTITION BY class ORDER BY score DESC))
SELECT class, score, fp / neg AS fpr, tp / pos AS tpr FROM b WHERE bt IS NULL OR bt <> 0 OR bf <> 0
UNION ALL SELECT DISTINCT class, NULL, 0, 0 FROM cu
""", floats="score fpr tpr")
def _(spark, folder):
    return metrics.roc_curve(_one_vs_rest(spark, folder), "hit", "score", ["class"])


_AREA = f"""{_OVR}, ar AS (SELECT class, sum((fp - pf) * (tp + pt) / 2.0) / max(pos) / max(neg) AS auc FROM (
  SELECT *, coalesce(lag(fp) OVER w, 0) AS pf, coalesce(lag(tp) OVER w, 0) AS pt FROM cu WINDOW w AS (PARTITION BY class ORDER BY score DESC)) GROUP BY 1)"""


@query("J5_auc_with_macro", f"WITH {_AREA} SELECT class, auc FROM ar UNION ALL SELECT 'macro', avg(auc) FROM ar", floats="auc")
def _(spark, folder):
    per = metrics.auc(_one_vs_rest(spark, folder), "hit", "score", ["class"])
    return per.unionByName(per.agg(F.lit("macro").alias("class"), F.avg("auc").alias("auc")))


@query("J6_precision_recall_curve", f"""
WITH {_OVR} SELECT class, score, tp / (tp + fp) AS precision, tp / pos AS recall FROM cu UNION ALL SELECT DISTINCT class, NULL, 1, 0 FROM cu
""", floats="score precision recall")
def _(spark, folder):
    return metrics.precision_recall_curve(_one_vs_rest(spark, folder), "hit", "score", ["class"])


@query("J6_average_precision", f"""
WITH {_OVR}, ap AS (SELECT class, sum((tp - pt) / pos * tp / (tp + fp)) AS average_precision FROM (
  SELECT *, coalesce(lag(tp) OVER (PARTITION BY class ORDER BY score DESC), 0) AS pt FROM cu) GROUP BY 1)
SELECT class, average_precision FROM ap UNION ALL SELECT 'macro', avg(average_precision) FROM ap
""", floats="average_precision")
def _(spark, folder):
    per = metrics.average_precision(_one_vs_rest(spark, folder), "hit", "score", ["class"])
    return per.unionByName(per.agg(F.lit("macro").alias("class"), F.avg("average_precision").alias("average_precision")))


@query("J7_fold_score_summary", f"""
WITH {_PAIRS}, p AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY series_id) AS n FROM pr WINDOW w AS (PARTITION BY series_id ORDER BY ts, row_id)),
f AS (SELECT *, CASE WHEN pos < n - 5 * (n // 6) THEN 0 ELSE (pos - (n - 5 * (n // 6))) // (n // 6) + 1 END AS fold FROM p),
s AS (SELECT fold, avg((consumption_kwh - predicted) * (consumption_kwh - predicted)) AS score FROM f WHERE fold > 0 GROUP BY 1)
SELECT avg(score) AS mean, stddev_pop(score) AS std, min(score) AS min, max(score) AS max, count(*) AS n_folds,
  avg(score) - 1.96 * stddev_pop(score) / sqrt(count(*)) AS ci_95_lower, avg(score) + 1.96 * stddev_pop(score) / sqrt(count(*)) AS ci_95_upper FROM s
""", floats="mean std min max ci_95_lower ci_95_upper", digits=2)
def _(spark, folder):
    folds = splits.expanding_folds(_pairs(spark, folder), 5).filter("test_fold > 0")
    error = F.col(KWH) - F.col("predicted")
    return metrics.cross_validation_summary(folds.groupBy("test_fold").agg(F.avg(error * error).alias("score")))


# --- comparisons ---------------------------------------------------------------------------

_LONG = f"""{_PAIRS}, tb AS ({_regression_sql(['model'])}), lo AS (
  SELECT model, 'mae' AS metric, mae AS value FROM tb UNION ALL SELECT model, 'rmse', rmse FROM tb
  UNION ALL SELECT model, 'mape', mape FROM tb UNION ALL SELECT model, 'r2', r2 FROM tb)"""


def _long(spark, folder):
    table = metrics.regression_metrics(_pairs(spark, folder), KWH, "predicted", ["model"])
    return metrics.to_long(table, metrics.REGRESSION_RANKED)


@query("F11_metric_rankings", f"""
WITH {_LONG} SELECT model, metric, value, row_number() OVER (PARTITION BY metric ORDER BY CASE WHEN metric = 'r2' THEN -value ELSE value END, model) AS rank FROM lo
""", floats="value", ints="rank", digits=3)
def _(spark, folder):
    return metrics.metric_rankings(_long(spark, folder))


@query("H5_best_values", f"""
WITH {_LONG} SELECT metric, metric <> 'r2' AS lower_is_better, CASE WHEN metric = 'r2' THEN max(value) ELSE min(value) END AS best FROM lo GROUP BY 1
""", floats="best", digits=3)
def _(spark, folder):
    return metrics.best_values(_long(spark, folder))


@query("J8_chart_scale", f"""
WITH {_LONG} SELECT model, metric, value, CASE metric WHEN 'mape' THEN greatest(0, 1 - value / 100) WHEN 'r2' THEN greatest(0, value)
  ELSE 1 - value / max(value) OVER (PARTITION BY metric) END AS scaled FROM lo
""", floats="value scaled", digits=3)
def _(spark, folder):
    return metrics.chart_scale(_long(spark, folder))


@query("J8_baseline_comparison", f"""
WITH {HOURLY}, p AS (SELECT ts, consumption_kwh, row_number() OVER (ORDER BY ts) - 1 AS pos, count(*) OVER () AS n FROM ht),
t AS (SELECT * FROM p WHERE pos >= n - ceil(n * 0.2)), m AS (SELECT avg(consumption_kwh) AS a FROM p WHERE pos < n - ceil(n * 0.2)),
pr AS (SELECT 'Baseline (Mean)' AS model, consumption_kwh, a AS predicted FROM t, m UNION ALL
  SELECT 'Persistence (Lag-1)', consumption_kwh, coalesce(lag(consumption_kwh) OVER (ORDER BY ts), consumption_kwh) FROM t)
{_regression_sql(['model'])}
""", floats=_REG, digits=3)
def _(spark, folder):
    parts = splits.ordered_split(hourly_total(spark, folder), 0.2)
    mean = parts.filter("part = 'train'").agg(F.avg(KWH)).scalar()
    test = parts.filter("part = 'test'").select("ts", KWH)
    flat = test.withColumns({"model": F.lit("Baseline (Mean)"), "predicted": mean})
    lagged = features.persistence(test, KWH, "predicted", keys=[]).withColumn("model", F.lit("Persistence (Lag-1)"))
    return metrics.regression_metrics(flat.unionByName(lagged), KWH, "predicted", ["model"])


@query("F13_best_so_far", f"""
WITH {READINGS}, t AS (SELECT series_id AS trial, avg(consumption_kwh) AS value FROM rd GROUP BY 1)
SELECT trial, value, min(value) OVER (ORDER BY trial ROWS UNBOUNDED PRECEDING) AS best_so_far FROM t
""", floats="value best_so_far")
def _(spark, folder):
    trials = readings(spark, folder).groupBy(F.col("series_id").alias("trial")).agg(F.avg(KWH).alias("value"))
    return metrics.best_so_far(trials)


# --- silhouettes and diagnoses -------------------------------------------------------------

_CLUSTERED = f"""{READINGS}, g AS (SELECT row_id, ts, load_factor AS x, temperature / 41 AS y, consumption_kwh / 500 AS z,
  CAST(floor(load_factor * 4) AS BIGINT) AS c FROM rd)"""


def _clustered(spark, folder):
    return readings(spark, folder).select(
        "row_id", "ts", F.col("load_factor").alias("x"), (F.col("temperature") / 41).alias("y"), (F.col(KWH) / 500).alias("z"),
        F.floor(F.col("load_factor") * 4).alias("c"))


def _silhouette_sql(source):
    return f"""k AS (SELECT c, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, avg(x * x + y * y + z * z) AS q FROM {source} GROUP BY 1),
d AS (SELECT p.row_id, p.c = k.c AS own, k.n, p.x * p.x + p.y * p.y + p.z * p.z + q - 2 * (p.x * mx + p.y * my + p.z * mz) AS d FROM {source} p, k),
ab AS (SELECT row_id, max(CASE WHEN own THEN d * n / nullif(n - 1, 0) END) AS a, min(CASE WHEN NOT own THEN d END) AS b FROM d GROUP BY 1)"""


@query("J9_silhouette_all_rows", f"WITH {_CLUSTERED}, {_silhouette_sql('g')} SELECT avg(coalesce((b - a) / greatest(a, b), 0)) AS silhouette FROM ab",
       floats="silhouette")
def _(spark, folder):
    return metrics.silhouette_all_rows(_clustered(spark, folder), ["x", "y", "z"], "c")


@query("J9_silhouette_sample", f"""
WITH {_CLUSTERED}, s AS (SELECT * FROM g ORDER BY ((row_id + 1) * 2654435761) % 4294967296, row_id LIMIT 2000),
z AS (SELECT c, count(*) AS n FROM s GROUP BY 1),
d AS (SELECT a.row_id, a.c AS own, b.c, sum(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2))) AS t FROM s a, s b GROUP BY 1, 2, 3),
ab AS (SELECT row_id, max(CASE WHEN own = d.c THEN t / (n - 1) END) AS a, min(CASE WHEN own <> d.c THEN t / n END) AS b FROM d JOIN z ON d.c = z.c GROUP BY 1)
SELECT avg((b - a) / greatest(a, b)) AS silhouette FROM ab
""", floats="silhouette")
def _(spark, folder):
    return metrics.silhouette_sample(_clustered(spark, folder), ["x", "y", "z"], "c")


_PARTS = """pt AS (SELECT *, CASE WHEN row_number() OVER w <= count(*) OVER (PARTITION BY series_id) - ceil(count(*) OVER (PARTITION BY series_id) * 0.2)
  THEN 'train' ELSE 'test' END AS part FROM {t} WINDOW w AS (PARTITION BY series_id ORDER BY ts, row_id))"""


@query("J10_regression_fit", f"""
WITH {_PAIRS}, {_PARTS.format(t='pr')}, tb AS ({_regression_sql(['part'], 'pt')}),
o AS (SELECT max(r2) FILTER (WHERE part = 'train') AS train_r2, max(mae) FILTER (WHERE part = 'train') AS train_mae,
  max(rmse) FILTER (WHERE part = 'train') AS train_rmse, max(mape) FILTER (WHERE part = 'train') AS train_mape,
  max(r2) FILTER (WHERE part = 'test') AS test_r2, max(mae) FILTER (WHERE part = 'test') AS test_mae,
  max(rmse) FILTER (WHERE part = 'test') AS test_rmse, max(mape) FILTER (WHERE part = 'test') AS test_mape FROM tb)
SELECT *, train_r2 - test_r2 AS r2_gap, CASE WHEN train_r2 < 0.5 AND test_r2 < 0.5 THEN 'UNDERFITTING'
  WHEN train_r2 - test_r2 > 0.15 OR (train_mape > 0 AND test_mape / (train_mape + 1e-8) > 1.5) THEN 'OVERFITTING' ELSE 'GOOD FIT' END AS status FROM o
""", floats="train_r2 train_mae train_rmse train_mape test_r2 test_mae test_rmse test_mape r2_gap", digits=3)
def _(spark, folder):
    parts = splits.ordered_split(_pairs(spark, folder), 0.2)
    return metrics.fit_verdict_regression(metrics.regression_metrics(parts, KWH, "predicted", ["part"]))


@query("J11_classification_fit", f"""
WITH {_CLASSES}, h AS (SELECT *, CASE WHEN row_id % 5 = 0 THEN 'test' ELSE 'train' END AS part FROM cl),
k AS (SELECT part, c, count(*) FILTER (WHERE actual = c AND guess = c) AS tp, count(*) FILTER (WHERE actual = c) AS s, count(*) FILTER (WHERE guess = c) AS g
  FROM h, (SELECT unnest(['healthy', 'warning', 'critical']) AS c) GROUP BY 1, 2),
m AS (SELECT part, sum(tp) / sum(s) AS accuracy, sum(coalesce(2 * tp / nullif(s + g, 0), 0) * s) / sum(s) AS f1 FROM k GROUP BY 1),
o AS (SELECT max(accuracy) FILTER (WHERE part = 'train') AS train_accuracy, max(f1) FILTER (WHERE part = 'train') AS train_f1_score,
  max(accuracy) FILTER (WHERE part = 'test') AS test_accuracy, max(f1) FILTER (WHERE part = 'test') AS test_f1_score FROM m)
SELECT *, train_accuracy - test_accuracy AS accuracy_gap, train_f1_score - test_f1_score AS f1_gap,
  CASE WHEN train_accuracy < 0.6 AND test_accuracy < 0.6 THEN 'UNDERFITTING'
  WHEN train_accuracy - test_accuracy > 0.1 OR train_f1_score - test_f1_score > 0.1 THEN 'OVERFITTING' ELSE 'GOOD FIT' END AS status FROM o
""", floats="train_accuracy train_f1_score test_accuracy test_f1_score accuracy_gap f1_gap")
def _(spark, folder):
    table = _classes(spark, folder).withColumn("part", F.when(F.col("row_id") % 5 == 0, "test").otherwise("train"))
    return metrics.fit_verdict_classification(metrics.classification_summary(table, "actual", "guess", ["part"]))


@query("J12_rate_stability", f"""
WITH {SCORED}, h AS (SELECT anomaly_flag, ((row_id + 1) * 2654435761) % 4294967296 // 2147483648 + 1 AS half FROM sc),
o AS (SELECT avg(anomaly_flag) * 100 AS overall_pct, avg(CASE WHEN half = 1 THEN anomaly_flag END) * 100 AS half1_pct,
  avg(CASE WHEN half = 2 THEN anomaly_flag END) * 100 AS half2_pct FROM h)
SELECT *, abs(half1_pct - half2_pct) AS gap_pct, CASE WHEN abs(half1_pct - half2_pct) > 5 THEN 'OVERFITTING' WHEN overall_pct < 1 THEN 'UNDERFITTING' ELSE 'GOOD FIT' END AS status FROM o
""", floats="overall_pct half1_pct half2_pct gap_pct")
def _(spark, folder):
    return metrics.rate_stability(splits.hash_halves(scored(spark, folder)))


@query("J13_cluster_stability", f"""
WITH {_CLUSTERED}, p AS (SELECT *, row_number() OVER (ORDER BY ts, row_id) <= count(*) OVER () - ceil(count(*) OVER () * 0.2) AS train FROM g),
k AS (SELECT train, c, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, avg(x * x + y * y + z * z) AS q FROM p GROUP BY 1, 2),
d AS (SELECT p.row_id, p.train, p.c = k.c AS own, k.n, p.x * p.x + p.y * p.y + p.z * p.z + q - 2 * (p.x * mx + p.y * my + p.z * mz) AS d
  FROM p JOIN k ON p.train = k.train),
ab AS (SELECT row_id, train, max(CASE WHEN own THEN d * n / nullif(n - 1, 0) END) AS a, min(CASE WHEN NOT own THEN d END) AS b FROM d GROUP BY 1, 2),
o AS (SELECT avg((b - a) / greatest(a, b)) FILTER (WHERE train) AS train_silhouette, avg((b - a) / greatest(a, b)) FILTER (WHERE NOT train) AS test_silhouette FROM ab)
SELECT *, abs(train_silhouette - test_silhouette) AS gap, CASE WHEN train_silhouette < 0.2 AND test_silhouette < 0.2 THEN 'UNDERFITTING'
  WHEN abs(train_silhouette - test_silhouette) > 0.15 THEN 'OVERFITTING' ELSE 'GOOD FIT' END AS status FROM o
""", floats="train_silhouette test_silhouette gap")
def _(spark, folder):
    parts = splits.ordered_split(_clustered(spark, folder), 0.2, keys=[])
    return metrics.cluster_stability(metrics.silhouette_all_rows(parts, ["x", "y", "z"], "c", ["part"]))


@query("J14_accuracy_report", f"""
WITH {SCORED}, pr AS (SELECT *, coalesce(lag(consumption_kwh) OVER (PARTITION BY series_id ORDER BY ts, row_id), consumption_kwh) AS predicted FROM sc),
tb AS ({_regression_sql([])}), s AS (SELECT count(*) AS n, sum(anomaly_flag) AS f, avg(anomaly_score) AS ms, max(anomaly_score) AS xs, avg(maintenance_urgency) AS mu,
  count(*) FILTER (WHERE maintenance_urgency > 70) AS hi, count(*) FILTER (WHERE maintenance_urgency > 85) AS ur FROM sc)
SELECT 'forecaster' AS section, 'mae' AS metric, mae AS value FROM tb UNION ALL SELECT 'forecaster', 'rmse', rmse FROM tb
UNION ALL SELECT 'forecaster', 'mape', mape FROM tb UNION ALL SELECT 'forecaster', 'r2', r2 FROM tb
UNION ALL SELECT 'forecaster', 'accuracy', greatest(0, 100 - mape) FROM tb
UNION ALL SELECT 'anomalies', 'records', n FROM s UNION ALL SELECT 'anomalies', 'flagged', f FROM s UNION ALL SELECT 'anomalies', 'normal', n - f FROM s
UNION ALL SELECT 'anomalies', 'normal_pct', 100 - f / n * 100 FROM s UNION ALL SELECT 'anomalies', 'mean_score', ms FROM s
UNION ALL SELECT 'anomalies', 'max_score', xs FROM s UNION ALL SELECT 'maintenance', 'mean_urgency', mu FROM s
UNION ALL SELECT 'maintenance', 'high_urgency', hi FROM s UNION ALL SELECT 'maintenance', 'critical_urgency', ur FROM s
UNION ALL SELECT 'health', health_status, count(*) FROM sc GROUP BY 2 UNION ALL SELECT 'efficiency', efficiency_label, count(*) FROM sc GROUP BY 2
""", floats="value", digits=3)
def _(spark, folder):
    table = features.persistence(scored(spark, folder), KWH, "predicted", order=BY_TIME)
    return metrics.accuracy_report(table, metrics.regression_metrics(table, KWH, "predicted"))
