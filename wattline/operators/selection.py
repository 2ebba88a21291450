"""Feature scores, variance filters, principal components and elimination."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.models.scaling import assemble, fill_zero, scaling_of, standardise
from wattline.operators.quality import bin_index, long_form


def regression_scores(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """F of each column against the target, from all correlations in one aggregate; gaps count as zero."""
    columns = list(columns)
    filled = fill_zero(df, columns)
    y = F.coalesce(F.col(target), df.agg(F.avg(target)).scalar())
    filled = filled.withColumn("_y", y)
    wide = filled.agg(F.count(F.lit(1)).alias("_n"), *[F.try_divide(F.covar_pop(c, "_y"), F.stddev_pop(c) * F.stddev_pop("_y")).alias(f"{c}__r") for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}__r").alias("r")) for c in columns])
    r2 = F.col("r") * F.col("r")
    score = F.coalesce(F.try_divide(r2, 1 - r2) * (F.col("_n") - 2), F.lit(0.0))
    return wide.select("_n", F.inline(cells)).select("feature", score.alias("score"))


def class_scores(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """One-way ANOVA F of each column over the classes, from per-class sums."""
    columns = list(columns)
    filled = fill_zero(df, columns)
    per = filled.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"{c}__m") for c in columns],
        *[F.var_pop(c).alias(f"{c}__v") for c in columns])
    cells = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"{c}__m").alias("m"), F.col(f"{c}__v").alias("v")) for c in columns])
    long = per.select("n", F.inline(cells))
    grand = long.groupBy("feature").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("g"))
    sums = long.join(F.broadcast(grand), "feature").groupBy("feature").agg(  # one row per column
        F.sum(F.col("n") * (F.col("m") - F.col("g")) * (F.col("m") - F.col("g"))).alias("between"),
        F.sum(F.col("n") * F.col("v")).alias("within"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    between = F.try_divide(F.col("between"), (F.col("k") - 1).cast("double"))
    within = F.try_divide(F.col("within"), (F.col("n") - F.col("k")).cast("double"))
    return sums.select("feature", F.coalesce(F.try_divide(between, within), F.lit(0.0)).alias("score"))


def information_scores(df: DataFrame, columns: Sequence[str], target: str, bins: int = 10) -> DataFrame:
    """Mutual information between equal-width bins of each column and of the target."""
    columns = list(columns)
    filled = fill_zero(df, [*columns, target])
    edges = filled.agg(
        *[F.min(c).alias(f"{c}__lo") for c in (*columns, target)], *[F.max(c).alias(f"{c}__hi") for c in (*columns, target)]
    ).select(F.struct("*")).scalar()

    def place(c: str) -> Column:
        return bin_index(F.col(c), edges[f"{c}__lo"], edges[f"{c}__hi"], bins)

    cells = F.array(*[F.struct(F.lit(c).alias("feature"), place(c).alias("x")) for c in columns])
    joint = filled.select(place(target).alias("y"), F.inline(cells)).groupBy("feature", "x", "y").agg(
        F.count(F.lit(1)).alias("n"))  # at most columns * bins * bins rows from here on
    total = joint.groupBy("feature").agg(F.sum("n").alias("all"))
    xs = joint.groupBy("feature", "x").agg(F.sum("n").alias("nx"))
    ys = joint.groupBy("feature", "y").agg(F.sum("n").alias("ny"))
    full = joint.join(total, "feature").join(xs, ["feature", "x"]).join(ys, ["feature", "y"])
    p = F.col("n") / F.col("all")
    return full.groupBy("feature").agg(
        F.sum(p * F.log(F.col("n") * F.col("all") / (F.col("nx") * F.col("ny")))).alias("score"))


def best_features(scores: DataFrame, k: int) -> DataFrame:
    return scores.orderBy(F.col("score").desc(), "feature").limit(k)


def variance_table(df: DataFrame, columns: Sequence[str], threshold: float = 0.01, scaled: bool = True) -> DataFrame:
    """(feature, variance, kept). Scaled columns have variance 1, or 0 when constant."""
    columns = list(columns)
    wide = fill_zero(df, columns).agg(*[F.var_pop(c).alias(f"{c}__variance") for c in columns])
    table = long_form(wide, columns, ["variance"], "feature")
    if scaled:
        table = table.withColumn("variance", F.when(F.col("variance") > 0, 1.0).otherwise(0.0))
    return table.withColumn("kept", F.col("variance") > threshold)


def auto_select(df: DataFrame, columns: Sequence[str], target: str, k: int = 15, task: str = "regression",
                threshold: float = 0.01) -> DataFrame:
    """Drop constant columns, then keep the ``k`` best by F score."""
    kept = variance_table(df, columns, threshold).filter("kept").select("feature")
    scores = regression_scores(df, columns, target) if task == "regression" else class_scores(df, columns, target)
    return best_features(scores.join(kept, "feature", "left_semi"), k)


def principal_components(df: DataFrame, columns: Sequence[str], k: int | None = None, share: float = 0.95):
    """(variance table, loadings table) of the standardised columns.

    Without ``k`` as many components are kept as reach ``share`` of the variance.  Signs are
    fixed so that the largest loading of each component is positive.
    """
    from pyspark.ml.feature import PCA

    columns = list(columns)
    filled = fill_zero(df, columns)
    table = assemble(standardise(filled, scaling_of(filled, columns)), [f"z_{c}" for c in columns])
    model = PCA(k=min(k or len(columns), len(columns)), inputCol="features", outputCol="latent").fit(table)
    ratios = [float(v) for v in model.explainedVariance]
    if k is None:
        upto, run = len(ratios), 0.0
        for i, v in enumerate(ratios):
            run += v
            if run >= share:
                upto = i + 1
                break
        ratios = ratios[:upto]
    weights = model.pc.toArray()
    variance, loadings, run = [], [], 0.0
    for i, ratio in enumerate(ratios):
        run += ratio
        variance.append((f"PC{i + 1}", ratio, run))
        column = weights[:, i]
        sign = 1.0 if column[abs(column).argmax()] >= 0 else -1.0
        loadings += [(f"PC{i + 1}", c, float(sign * w)) for c, w in zip(columns, column)]
    spark = df.sparkSession
    return (spark.createDataFrame(variance, "component string, variance_ratio double, cumulative_ratio double"),
            spark.createDataFrame(loadings, "component string, feature string, loading double"))


def top_loadings(loadings: DataFrame, top: int = 5) -> DataFrame:
    """The strongest features of each component; the table has one row per component and column."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("component").orderBy(F.abs("loading").desc(), "feature"))
    return loadings.withColumn("place", place).filter(F.col("place") <= top)


def eliminate(df: DataFrame, columns: Sequence[str], target: str, keep: int, step: int = 1, estimator=None) -> DataFrame:
    """(feature, rank): refit on fewer columns, dropping the weakest each time; kept columns have rank 1."""
    from pyspark.ml.regression import DecisionTreeRegressor

    from wattline.models.forecast import ready

    left, ranks = list(columns), {}
    estimator = estimator or DecisionTreeRegressor(labelCol="label", maxDepth=5, seed=42)
    rounds = []
    while len(left) > keep:
        weights = estimator.fit(ready(df, left, target)).featureImportances.toArray()
        drop = min(step, len(left) - keep)
        weakest = sorted(range(len(left)), key=lambda i: (weights[i], left[i]))[:drop]
        rounds.append([left[i] for i in weakest])
        left = [c for i, c in enumerate(left) if i not in weakest]
    ranks.update({c: 1 for c in left})
    for age, names in enumerate(reversed(rounds)):
        ranks.update({c: age + 2 for c in names})
    return df.sparkSession.createDataFrame([(c, ranks[c]) for c in columns], "feature string, rank int")
