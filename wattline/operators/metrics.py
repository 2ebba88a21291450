"""Evaluation metrics for regressors, classifiers, rankings and clusterings."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.operators.ordered import arrange
from wattline.operators.quantile import quantiles
from wattline.operators.splits import hash_sample
from wattline.sources.readings import ROW, SERIES, TS

# Direction of each metric.
LOWER_IS_BETTER = {"mae": True, "mse": True, "rmse": True, "mape": True, "smape": True, "max_error": True,
                   "median_ae": True, "r2": False, "adjusted_r2": False, "explained_variance": False,
                   "accuracy": False, "precision": False, "recall": False, "f1_score": False}
REGRESSION_RANKED = ("mae", "rmse", "mape", "r2")
CLASS_RANKED = ("accuracy", "precision", "recall", "f1_score")


def percentage_error(y: Column, predicted: Column, zeros: str = "mask") -> Column:
    """Absolute percentage error of a row. Zero actuals are masked, shifted by 1e-8, floored at 1e-6 or at the
    distance of 1 to the next double ("epsilon")."""
    if zeros == "mask":
        return F.when(y != 0, F.abs(F.try_divide(y - predicted, y)))
    if zeros == "shift":
        return F.abs(F.try_divide(predicted - y, y + F.lit(1e-8)))
    if zeros == "epsilon":
        return F.abs(y - predicted) / F.greatest(F.abs(y), F.lit(float(np.finfo(np.float64).eps)))
    return F.abs((y - predicted) / F.greatest(F.abs(y), F.lit(1e-6)))


def regression_metrics(df: DataFrame, y: str, predicted: str, by: Sequence[str] = (), zeros: str = "mask") -> DataFrame:
    """One row per group: errors, percentage errors, R2 and explained variance."""
    by, a, p = list(by), F.col(y), F.col(predicted)
    error = a - p
    used = df.filter(a.isNotNull() & p.isNotNull())
    rows = F.count(F.lit(1))
    one = used.groupBy(*by).agg(
        rows.alias("n_samples"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(error * error).alias("mse"),
        (F.avg(percentage_error(a, p, zeros)) * 100).alias("mape"),
        (F.avg(2 * F.abs(p - a) / (F.abs(a) + F.abs(p) + F.lit(1e-8))) * 100).alias("smape"),
        F.max(F.abs(error)).alias("max_error"),
        F.var_pop(a).alias("_vy"),
        F.var_pop(error).alias("_ve"),
    )
    middle = quantiles(used.withColumn("_ae", F.abs(error)), {"median_ae": ("_ae", 0.5)}, by)
    one = one.join(middle, by) if by else one.withColumn("median_ae", middle.scalar())
    r2 = 1 - F.try_divide(F.col("mse"), F.col("_vy"))
    n = F.col("n_samples")
    return one.withColumns({
        "rmse": F.sqrt("mse"),
        "r2": r2,
        "adjusted_r2": F.when(n > 2, 1 - (1 - r2) * F.try_divide((n - 1).cast("double"), (n - 2).cast("double"))).otherwise(r2),
        "explained_variance": F.when(F.col("_vy") > 0, 1 - F.try_divide(F.col("_ve"), F.col("_vy"))).otherwise(0.0),
    }).select(*by, "mae", "mse", "rmse", "mape", "smape", "r2", "adjusted_r2", "max_error", "median_ae",
              "explained_variance", "n_samples")


def forecast_metrics(df: DataFrame, y: str, predicted: str, by: Sequence[str] = (),
                     order: Sequence[str] = (TS, ROW), zeros: str = "epsilon") -> DataFrame:
    """Regression metrics with bias and the share of steps whose direction was right.

    Directions are those of one series, whatever the groups are; percentage errors floor the actual value.
    """
    by = list(by)
    lines = [*by, *[c for c in (SERIES,) if c in df.columns and c not in by]]
    steps = arrange(df, lines, order).near({
        "_dy": lambda w: F.signum(F.col(y) - F.lag(y).over(w)),
        "_dp": lambda w: F.signum(F.col(predicted) - F.lag(predicted).over(w)),
    }, back=1)
    extra = steps.groupBy(*by).agg(
        (F.avg(F.when(F.col("_dy").isNotNull(), (F.col("_dy") == F.col("_dp")).cast("int"))) * 100).alias("directional_accuracy"),
        F.avg(F.col(predicted) - F.col(y)).alias("bias"))
    base = regression_metrics(df, y, predicted, by, zeros).select(*by, "mae", "rmse", "mape", "r2", "median_ae", "max_error")
    if by:
        return base.join(extra, by)
    extra = extra.select(F.struct("*")).scalar()
    return base.withColumns({"directional_accuracy": extra["directional_accuracy"], "bias": extra["bias"]})


def confusion(df: DataFrame, y: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """(actual, predicted, count, share): every pair of classes, shares per actual class (+1e-8)."""
    by = list(by)
    pairs = df.filter(F.col(y).isNotNull() & F.col(predicted).isNotNull()).groupBy(
        *by, F.col(y).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("count"))
    classes = pairs.groupBy(*by).agg(F.array_distinct(F.flatten(F.collect_list(F.array("actual", "predicted")))).alias("_c"))
    grid = classes.select(*by, F.explode("_c").alias("actual"), F.col("_c")).select(
        *by, "actual", F.explode("_c").alias("predicted"))
    full = grid.join(pairs, [*by, "actual", "predicted"], "left").na.fill(0, ["count"])
    total = F.sum("count").over(Window.partitionBy(*by, "actual"))
    return full.withColumn("share", F.col("count") / (total + F.lit(1e-8)))


def class_metrics(df: DataFrame, y: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1, specificity and support per class; zero where nothing can be divided."""
    by = list(by)
    cells = confusion(df, y, predicted, by)
    per = lambda column, name: cells.groupBy(*by, F.col(column).alias("class")).agg(
        F.sum("count").alias(name), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("count")).otherwise(0)).alias("tp"))
    joined = per("actual", "support").join(per("predicted", "_pred").drop("tp"), [*by, "class"])
    every = F.sum("support").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0)))
    joined = joined.withColumn("_all", every)

    def share(top: Column, bottom: Column) -> Column:
        return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))

    tp, support, guessed = F.col("tp"), F.col("support"), F.col("_pred")
    negative = F.col("_all") - support
    return joined.select(
        *by, "class", share(tp, guessed).alias("precision"), share(tp, support).alias("recall"),
        share(2 * tp, guessed + support).alias("f1_score"),
        share(negative - (guessed - tp), negative).alias("specificity"), "support", "tp")


def classification_summary(df: DataFrame, y: str, predicted: str, by: Sequence[str] = (),
                           positive: str | int | None = None) -> DataFrame:
    """Accuracy, mean specificity and weighted precision, recall, F1; with ``positive`` those of that class."""
    by = list(by)
    per = class_metrics(df, y, predicted, by)
    rows = F.sum("support")

    def pick(column: str) -> Column:
        if positive is not None:
            return F.max(F.when(F.col("class") == F.lit(positive), F.col(column)))
        return F.try_divide(F.sum(F.col(column) * F.col("support")), rows)

    return per.groupBy(*by).agg(
        F.try_divide(F.sum("tp"), rows).alias("accuracy"), pick("precision").alias("precision"),
        pick("recall").alias("recall"), pick("f1_score").alias("f1_score"),
        F.avg("specificity").alias("specificity"), F.count(F.lit(1)).alias("n_classes"), rows.alias("n_samples"))


def score_steps(df: DataFrame, hit: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Cumulative true and false positives per distinct score, from the highest down.

    Rows shrink to one per distinct score before anything is ordered.
    """
    by = list(by)
    counts = df.filter(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("score")).agg(
        F.count_if(F.col(hit) == 1).alias("_p"), F.count_if(F.col(hit) != 1).alias("_n"))
    run = arrange(counts, by, [F.col("score").desc()]).running({"tp": ("sum", "_p"), "fp": ("sum", "_n")})
    totals = counts.groupBy(*by).agg(F.sum("_p").alias("positives"), F.sum("_n").alias("negatives"))
    if by:
        run = run.join(totals, by)
    else:
        both = totals.select(F.struct("*")).scalar()
        run = run.withColumns({"positives": both["positives"], "negatives": both["negatives"]})
    return run.drop("_p", "_n")


def roc_curve(df: DataFrame, hit: str, score: str, by: Sequence[str] = (), drop_straight: bool = True) -> DataFrame:
    """(score, fpr, tpr), from the origin (null score) on; points on straight pieces left out as asked."""
    by = list(by)
    steps = score_steps(df, hit, score, by)
    if drop_straight:
        bend = lambda c: lambda w: F.lag(c).over(w) - 2 * F.col(c) + F.lead(c).over(w)
        steps = arrange(steps, by, [F.col("score").desc()]).near({"_bt": bend("tp"), "_bf": bend("fp")}, 1, 1)
        steps = steps.filter(F.col("_bt").isNull() | (F.col("_bt") != 0) | (F.col("_bf") != 0)).drop("_bt", "_bf")
    points = steps.select(*by, "score", F.try_divide(F.col("fp"), F.col("negatives")).alias("fpr"),
                          F.try_divide(F.col("tp"), F.col("positives")).alias("tpr"))
    kind = steps.schema["score"].dataType
    origin = steps.groupBy(*by).agg(F.lit(None).cast(kind).alias("score"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(origin)


def auc(df: DataFrame, hit: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve by trapezoids over the distinct scores."""
    by = list(by)
    steps = score_steps(df, hit, score, by)
    area = lambda w: (F.col("fp") - F.coalesce(F.lag("fp").over(w), F.lit(0))) * (
        F.col("tp") + F.coalesce(F.lag("tp").over(w), F.lit(0))) / 2
    pieces = arrange(steps, by, [F.col("score").desc()]).near({"_area": area}, back=1)
    return pieces.groupBy(*by).agg(
        F.try_divide(F.sum("_area"), F.max("positives").cast("double") * F.max("negatives")).alias("auc"))


def precision_recall_curve(df: DataFrame, hit: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """(score, precision, recall) per distinct score, closed by (null, 1, 0)."""
    by = list(by)
    steps = score_steps(df, hit, score, by)
    points = steps.select(*by, "score", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
                          F.coalesce(F.try_divide(F.col("tp"), F.col("positives")), F.lit(1.0)).alias("recall"))
    kind = steps.schema["score"].dataType
    end = steps.groupBy(*by).agg(F.lit(None).cast(kind).alias("score"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return points.unionByName(end)


def average_precision(df: DataFrame, hit: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Sum of precision times the recall gained at each distinct score."""
    by = list(by)
    steps = score_steps(df, hit, score, by)
    gain = lambda w: (F.col("tp") - F.coalesce(F.lag("tp").over(w), F.lit(0))) * F.col("tp") / (F.col("tp") + F.col("fp"))
    pieces = arrange(steps, by, [F.col("score").desc()]).near({"_gain": gain}, back=1)
    return pieces.groupBy(*by).agg(F.try_divide(F.sum("_gain"), F.max("positives")).alias("average_precision"))


def one_vs_rest(df: DataFrame, label: str, scores: dict[str, str], carry: Sequence[str] = ()) -> DataFrame:
    """(class, hit, score) rows; each score column is named for its class, so order cannot mix them up."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("class"), (F.col(label) == c).cast("int").alias("hit"), F.col(s).cast("double").alias("score"))
        for c, s in scores.items()])
    return df.select(*carry, F.inline(cells))


def cross_validation_summary(scores: DataFrame, score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Mean, population deviation, bounds and a 95 % interval over fold scores."""
    one = scores.groupBy(*by).agg(
        F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.min(score).alias("min"),
        F.max(score).alias("max"), F.count(score).alias("n_folds"))
    half = 1.96 * F.col("std") / F.sqrt("n_folds")
    return one.withColumns({"ci_95_lower": F.col("mean") - half, "ci_95_upper": F.col("mean") + half})


def to_long(table: DataFrame, metrics: Sequence[str], model: str = "model", carry: Sequence[str] = ()) -> DataFrame:
    """Comparison table to (model, metric, value), without missing values."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return table.select(*carry, model, F.inline(cells)).filter(F.col("value").isNotNull())


def metric_rankings(long: DataFrame, model: str = "model", by: Sequence[str] = ()) -> DataFrame:
    """Rank models per metric in its own direction; equal values keep the order of the names."""
    lower = F.create_map(*[x for m, low in LOWER_IS_BETTER.items() for x in (F.lit(m), F.lit(low))])
    signed = F.when(F.coalesce(F.try_element_at(lower, F.col("metric")), F.lit(True)), F.col("value")).otherwise(-F.col("value"))
    window = Window.partitionBy(*by, "metric").orderBy(signed, model)
    return long.withColumn("rank", F.row_number().over(window))


def best_values(long: DataFrame) -> DataFrame:
    """Best value per metric in its own direction."""
    lower = F.create_map(*[x for m, low in LOWER_IS_BETTER.items() for x in (F.lit(m), F.lit(low))])
    low = F.coalesce(F.try_element_at(lower, F.col("metric")), F.lit(True))
    return long.groupBy("metric", low.alias("lower_is_better")).agg(
        F.when(F.first(low), F.min("value")).otherwise(F.max("value")).alias("best"))


def chart_scale(long: DataFrame, by_largest: bool = True) -> DataFrame:
    """Scale metrics to 0..1, larger better: MAPE by 100, MAE and RMSE by the worst model, R2 floored at 0."""
    worst = F.max("value").over(Window.partitionBy("metric"))
    value = F.col("value")
    by_worst = F.when(worst > 0, 1 - F.try_divide(value, worst)).otherwise(0.0) if by_largest else value
    scaled = (
        F.when(F.col("metric") == "mape", F.greatest(F.lit(0.0), 1 - value / 100))
        .when(F.col("metric").isin("mae", "rmse"), by_worst)
        .when(F.col("metric") == "r2", F.greatest(F.lit(0.0), value))
        .otherwise(value))
    return long.withColumn("scaled", scaled)


def best_vs_second(table: DataFrame, horizon: str = "horizon", model: str = "model", metric: str = "rmse") -> DataFrame:
    """Per horizon the best model and its gain over the second in percent (null with one model)."""
    window = Window.partitionBy(horizon).orderBy(metric, model)
    ranked = table.withColumn("_r", F.row_number().over(window)).filter("_r <= 2")
    one = ranked.groupBy(horizon).agg(
        F.max(F.when(F.col("_r") == 1, F.col(model))).alias("best_model"),
        F.max(F.when(F.col("_r") == 1, F.col(metric))).alias("best"),
        F.max(F.when(F.col("_r") == 2, F.col(metric))).alias("second"))
    return one.withColumn("improvement_pct", F.try_divide(F.col("second") - F.col("best"), F.col("second")) * 100).drop("second")


def best_by_band(table: DataFrame, horizon: str = "horizon", model: str = "model", metric: str = "rmse") -> DataFrame:
    """The best row up to 12 hours and the best from there to 48."""
    band = F.when(F.col(horizon) <= 12, "short").when(F.col(horizon) <= 48, "medium")
    return table.withColumn("band", band).filter(F.col("band").isNotNull()).groupBy("band").agg(
        F.min_by(model, F.struct(metric, model)).alias("model"), F.min(metric).alias(metric))


def best_so_far(trials: DataFrame, value: str = "value", order: str = "trial", minimize: bool = True) -> DataFrame:
    kept = trials.filter(F.col(value).isNotNull())
    return arrange(kept, [], [order]).running({"best_so_far": ("min" if minimize else "max", value)})


def fit_verdict_regression(parts: DataFrame) -> DataFrame:
    """``parts``: regression metrics with a column ``part`` of train and test."""
    def of(part: str, metric: str) -> Column:
        return F.max(F.when(F.col("part") == part, F.col(metric)))

    one = parts.agg(*[of(p, m).alias(f"{p}_{m}") for p in ("train", "test") for m in ("r2", "mae", "rmse", "mape")])
    gap = F.col("train_r2") - F.col("test_r2")
    worse = (F.col("train_mape") > 0) & (F.col("test_mape") / (F.col("train_mape") + F.lit(1e-8)) > 1.5)
    status = (
        F.when((F.col("train_r2") < 0.5) & (F.col("test_r2") < 0.5), "UNDERFITTING")
        .when((gap > 0.15) | worse, "OVERFITTING").otherwise("GOOD FIT"))
    return one.withColumns({"r2_gap": gap, "status": status})


def fit_verdict_classification(parts: DataFrame) -> DataFrame:
    def of(part: str, metric: str) -> Column:
        return F.max(F.when(F.col("part") == part, F.col(metric)))

    one = parts.agg(*[of(p, m).alias(f"{p}_{m}") for p in ("train", "test") for m in ("accuracy", "f1_score")])
    accuracy, f1 = F.col("train_accuracy") - F.col("test_accuracy"), F.col("train_f1_score") - F.col("test_f1_score")
    status = (
        F.when((F.col("train_accuracy") < 0.6) & (F.col("test_accuracy") < 0.6), "UNDERFITTING")
        .when((accuracy > 0.10) | (f1 > 0.10), "OVERFITTING").otherwise("GOOD FIT"))
    return one.withColumns({"accuracy_gap": accuracy, "f1_gap": f1, "status": status})


def rate_stability(df: DataFrame, flag: str = "anomaly_flag", half: str = "half") -> DataFrame:
    """Flag rate overall and in two halves; unstable when the halves differ by more than 5 points."""
    one = df.agg(
        (F.avg(flag) * 100).alias("overall_pct"),
        (F.avg(F.when(F.col(half) == 1, F.col(flag))) * 100).alias("half1_pct"),
        (F.avg(F.when(F.col(half) == 2, F.col(flag))) * 100).alias("half2_pct"))
    gap = F.abs(F.col("half1_pct") - F.col("half2_pct"))
    status = F.when(gap > 5, "OVERFITTING").when(F.col("overall_pct") < 1, "UNDERFITTING").otherwise("GOOD FIT")
    return one.withColumns({"gap_pct": gap, "status": status})


def cluster_stability(parts: DataFrame) -> DataFrame:
    """``parts``: (part, silhouette) of train and test."""
    one = parts.agg(F.max(F.when(F.col("part") == "train", F.col("silhouette"))).alias("train_silhouette"),
                    F.max(F.when(F.col("part") == "test", F.col("silhouette"))).alias("test_silhouette"))
    gap = F.abs(F.col("train_silhouette") - F.col("test_silhouette"))
    status = (F.when((F.col("train_silhouette") < 0.2) & (F.col("test_silhouette") < 0.2), "UNDERFITTING")
              .when(gap > 0.15, "OVERFITTING").otherwise("GOOD FIT"))
    return one.withColumns({"gap": gap, "status": status})


def silhouette_label(value: Column) -> Column:
    return F.when(value > 0.7, "Excellent").when(value > 0.5, "Good").when(value > 0.25, "Fair").otherwise("Poor")


def silhouette_all_rows(df: DataFrame, columns: Sequence[str], cluster: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean silhouette of every row under squared Euclidean distance, in linear time.

    The mean squared distance from a point to a cluster follows from the cluster's size,
    column sums and square sum, so each row only meets one small line per cluster.
    """
    by, columns = list(by), list(columns)
    square = sum((F.col(c) * F.col(c) for c in columns), F.lit(0.0))
    stats = df.groupBy(*by, F.col(cluster).alias("_c")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(square).alias("_q"), F.array(*[F.sum(c) for c in columns]).alias("_s"))
    lines = stats.groupBy(*by).agg(F.collect_list(F.struct("_c", "_n", "_q", "_s")).alias("_lines"))
    if by:
        held = df.join(F.broadcast(lines), by)  # one short line per group and cluster
    else:
        held = df.withColumn("_lines", lines.scalar())
    point = F.array(*[F.col(c).cast("double") for c in columns])

    def distance(line) -> Column:
        dot = F.aggregate(F.zip_with(point, line["_s"], lambda x, s: x * s), F.lit(0.0), lambda a, x: a + x)
        n = line["_n"].cast("double")
        return square + line["_q"] / n - 2.0 * dot / n

    away = F.transform("_lines", lambda line: F.struct(line["_c"].alias("c"), line["_n"].alias("n"), distance(line).alias("d")))
    held = held.withColumn("_away", away)
    own = F.get(F.filter("_away", lambda x: x["c"] == F.col(cluster)), F.lit(0))
    other = F.array_min(F.transform(F.filter("_away", lambda x: x["c"] != F.col(cluster)), lambda x: x["d"]))
    a = F.try_divide(own["d"] * own["n"], (own["n"] - 1).cast("double"))
    value = F.when(own["n"] == 1, 0.0).otherwise(F.coalesce(F.try_divide(other - a, F.greatest(a, other)), F.lit(0.0)))
    return held.groupBy(*by).agg(F.avg(value).alias("silhouette"))


def silhouette_sample(df: DataFrame, columns: Sequence[str], cluster: str, n: int = 2000, key: str = ROW) -> DataFrame:
    """Mean Euclidean silhouette of a fixed sample of at most ``n`` rows.

    The sample is bounded by ``n``; its points travel with the task, which scores its rows in blocks.
    """
    columns = list(columns)
    sample = hash_sample(df.select(key, *columns, cluster), n, key)
    held = sample.toPandas()  # at most n rows
    points, labels = held[columns].to_numpy(dtype=float), held[cluster].to_numpy()
    names = pd.unique(labels)

    def score(batches):
        sizes = {c: int((labels == c).sum()) for c in names}
        for batch in batches:
            out = np.zeros(len(batch))
            for start in range(0, len(batch), 256):
                block = batch.iloc[start:start + 256]
                x = block[columns].to_numpy(dtype=float)
                d = np.sqrt(((x[:, None, :] - points[None, :, :]) ** 2).sum(axis=2))
                mine = block[cluster].to_numpy()
                sums = {c: d[:, labels == c].sum(axis=1) for c in names}
                for i, own in enumerate(mine):
                    if sizes[own] < 2 or len(names) < 2:
                        continue
                    a = sums[own][i] / (sizes[own] - 1)
                    b = min(sums[c][i] / sizes[c] for c in names if c != own)
                    out[start + i] = (b - a) / max(a, b) if max(a, b) > 0 else 0.0
            yield pd.DataFrame({"s": out})

    spark = df.sparkSession
    rows = spark.createDataFrame(held)
    return rows.mapInPandas(score, "s double").agg(F.avg("s").alias("silhouette"))


def accuracy_report(df: DataFrame, forecast: DataFrame) -> DataFrame:
    """(section, metric, value) rows: forecaster accuracy, anomaly share, health and urgency figures."""
    def rows(frame, section, pairs):
        cells = F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value")) for m, v in pairs])
        return frame.select(F.lit(section).alias("section"), F.inline(cells))

    c = F.col
    scored = df.agg(
        F.count(F.lit(1)).alias("n"), F.sum("anomaly_flag").alias("flagged"), F.avg("anomaly_score").alias("mean_score"),
        F.max("anomaly_score").alias("max_score"), F.avg("maintenance_urgency").alias("urgency"),
        F.count_if(c("maintenance_urgency") > 70).alias("high"), F.count_if(c("maintenance_urgency") > 85).alias("urgent"))
    parts = [
        rows(forecast, "forecaster", [("mae", c("mae")), ("rmse", c("rmse")), ("mape", c("mape")), ("r2", c("r2")),
                                      ("accuracy", F.greatest(F.lit(0.0), 100 - c("mape")))]),
        rows(scored, "anomalies", [("records", c("n")), ("flagged", c("flagged")), ("normal", c("n") - c("flagged")),
                                   ("normal_pct", 100 - F.try_divide(c("flagged"), c("n")) * 100),
                                   ("mean_score", c("mean_score")), ("max_score", c("max_score"))]),
        rows(scored, "maintenance", [("mean_urgency", c("urgency")), ("high_urgency", c("high")), ("critical_urgency", c("urgent"))]),
    ]
    for section, column in (("health", "health_status"), ("efficiency", "efficiency_label")):
        counts = df.groupBy(F.col(column).alias("metric")).agg(F.count(F.lit(1)).cast("double").alias("value"))
        parts.append(counts.select(F.lit(section).alias("section"), "metric", "value"))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
