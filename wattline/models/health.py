"""Equipment health: labels, evaluation noise, the classifier and its scores."""

from __future__ import annotations

from functools import cached_property, reduce
from multiprocessing.pool import ThreadPool

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.functions.labels import HEALTH_CLASSES
from wattline.session import materialize

RARE_CLASS_ROWS = 5
FIT_ROWS = 25_000  # of a task, at least; larger tables keep to FIT_TASKS tasks until one has FIT_ROWS_MOST
FIT_ROWS_MOST = 131_072
FIT_TASKS = 32
ROWS_AT_ONCE = 1_000_000  # of all fits that run beside each other; each keeps some 700 bytes a row


def merge_rare_class(df: DataFrame, label: str, rare: str = "critical", into: str = "warning",
                     least: int = RARE_CLASS_ROWS) -> DataFrame:
    """Rename a class with fewer than ``least`` rows."""
    count = df.agg(F.count_if(F.col(label) == rare)).scalar()
    return df.withColumn(label, F.when((F.col(label) == rare) & (count < least), into).otherwise(F.col(label)))


def _spread(key: Column) -> Column:
    """A multiplicative hash of an integer key below 2 ** 32; any engine can repeat it."""
    return F.pmod((F.pmod(key, F.lit(2**31)) + 1) * F.lit(2654435761), F.lit(2**32))


def flip_labels(label: Column, key: Column, share: float = 0.06) -> Column:
    """Replace a fixed share of labels by another class; which ones follows from the row key."""
    spread = _spread(key)
    draw = F.pmod(spread, F.lit(10_000))
    pick = F.pmod(F.floor(spread / F.lit(10_000)), F.lit(2)).cast("int")
    others = F.array_remove(F.array(*[F.lit(c) for c in HEALTH_CLASSES]), label)
    return F.when(draw < int(share * 10_000), F.get(others, pick)).otherwise(label)


def classifier_for(rows: int, seed: int = 42):
    """Random forest whose size follows the number of rows: below 200, below 500, and above (a documented parameter;
    pass an estimator to `fit_health` for another size)."""
    from pyspark.ml.classification import RandomForestClassifier

    depth, trees = (2, 40) if rows < 200 else (2, 80) if rows < 500 else (5, 150)
    return RandomForestClassifier(labelCol="label", numTrees=trees, maxDepth=depth, minInstancesPerNode=5,
                                  subsamplingRate=0.8, seed=seed)


class HealthModel:
    """Classifier with its class names in label order and its cross-validated scores, given as a table or a function that plans it."""

    def __init__(self, features, model, classes, fold_scores):
        self.features, self.model, self.classes, self._scores = features, model, classes, fold_scores

    @cached_property
    def fold_scores(self) -> DataFrame | None:
        return self._scores() if callable(self._scores) else self._scores


def _labelled(df: DataFrame, features, label: str, classes: list[str]) -> DataFrame:
    from wattline.models.forecast import ready

    place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1
    return ready(df, features).withColumn("label", place.cast("double"))


def fit_tasks(rows: int) -> int:
    """Over how many tasks the rows of a fit are dealt; it follows from their number alone, so that a fit is the same on any cluster."""
    return -(-rows // max(FIT_ROWS, min(FIT_ROWS_MOST, -(-rows // FIT_TASKS))))


def _dealt(df: DataFrame, by: list[str], rows: int) -> DataFrame:
    """Rows dealt over the tasks of a fit by their content. A file that is read as one part would train on one core."""
    width = fit_tasks(rows)
    if width < 2:
        return df
    mixed = df.withColumn("_mixed", F.xxhash64(*by))
    return mixed.repartition(width, "_mixed").sortWithinPartitions("_mixed").drop("_mixed")


def _fit_each(estimator, tables: list[DataFrame], at_once: int) -> list:
    """One model of each table; small fits run beside each other, as most of their time is waiting for short jobs."""
    from pyspark import inheritable_thread_target

    fit = inheritable_thread_target(tables[0].sparkSession)(lambda table: estimator.copy().fit(table))
    with ThreadPool(max(1, min(at_once, len(tables)))) as pool:
        return pool.map(fit, tables, chunksize=1)


def stratified_folds(df: DataFrame, label: str, folds: int, key: str = "row_id") -> DataFrame:
    """Deterministic folds; a hash of the key spreads every class evenly over them."""
    return df.withColumn("_fold", F.pmod(F.xxhash64(F.col(key), F.col(label)), F.lit(folds)))


def stratified_split(df: DataFrame, label: str, key: str = "row_id") -> DataFrame:
    """`part`: about one row in five of every class is test; which ones follows from the row key."""
    test = F.pmod(F.floor(_spread(F.col(key)) / F.lit(7)), F.lit(5)) == 0
    return df.withColumn("part", F.when(test, "test").otherwise("train"))


def holdout_scores(df: DataFrame, features, label: str = "health", estimator=None, key: str = "row_id", largest: float = 0.10) -> DataFrame:
    """Accuracy and weighted F1 of both parts of a stratified split, and whether the accuracy gap is acceptable."""
    from wattline.models.scaling import held
    from wattline.operators.metrics import classification_summary

    table = merge_rare_class(df, label)
    counts = {r[label]: r["n"] for r in table.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per class
    classes = sorted(c for c in counts if c is not None)
    made = stratified_split(_labelled(table, list(features), label, classes), label, key).select("features", "label", "part")
    with held(made) as rows:
        model = (estimator or classifier_for(sum(counts.values()))).fit(rows.filter("part = 'train'"))
        scored = materialize(model.transform(rows).select("part", "label", "prediction"), "holdout")
    scores = classification_summary(scored, "label", "prediction", ["part"])
    by = {r["part"]: r for r in scores.collect()}  # two rows
    gap = by["train"]["accuracy"] - by["test"]["accuracy"] if len(by) == 2 else None
    return scores.withColumns({"gap": F.lit(gap).cast("double"), "acceptable": F.lit(None if gap is None else gap <= largest).cast("boolean")})


def fit_health(df: DataFrame, features, label: str = "health", folds: int = 5, estimator=None, key: str = "row_id") -> HealthModel:
    """Merge a rare class, score by weighted F1 over stratified folds, refit on all rows."""
    from wattline.models.scaling import held
    from wattline.operators.metrics import classification_summary

    table = merge_rare_class(df, label)
    counts = {r[label]: r["n"] for r in table.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per class
    classes = sorted(c for c in counts if c is not None)
    folds = max(2, min(folds, min(counts[c] for c in classes)))
    estimator = estimator or classifier_for(sum(counts.values()))
    made = stratified_folds(_labelled(table, list(features), label, classes), label, folds, key)
    rows = sum(counts.values())
    with held(_dealt(made, [key, "label", *features], rows).select("features", "label", "_fold")) as table:
        table.count()  # filled once, before several fits read it
        parts = [table.filter(F.col("_fold") != fold) for fold in range(folds)]
        *fitted, final = _fit_each(estimator, [*parts, table], ROWS_AT_ONCE // max(1, rows))

    def scores() -> DataFrame:
        held_out = [model.transform(made.filter(F.col("_fold") == fold)).select("label", "prediction", F.lit(fold).alias("fold"))
                    for fold, model in enumerate(fitted)]
        tested = materialize(reduce(DataFrame.unionByName, held_out), "folds")  # read several times, predicted once
        return classification_summary(tested, "label", "prediction", ["fold"])

    return HealthModel(list(features), final, classes, scores)


def predict_health(fitted: HealthModel, df: DataFrame) -> DataFrame:
    """health_status, one prob_<class> per class by name, and the urgency: 100 * P(critical)."""
    from pyspark.ml.functions import vector_to_array

    from wattline.models.forecast import ready

    scored = fitted.model.transform(ready(df, fitted.features)).withColumn("_p", vector_to_array("probability"))
    names = F.array(*[F.lit(c) for c in fitted.classes])
    made = {f"prob_{c}": F.get("_p", F.lit(i)) for i, c in enumerate(fitted.classes)}
    urgent = F.round(F.get("_p", F.lit(fitted.classes.index("critical"))) * 100, 1) if "critical" in fitted.classes else F.lit(0.0)
    scored = scored.withColumns({**made, "health_status": F.get(names, F.col("prediction").cast("int")), "maintenance_urgency": urgent})
    return scored.drop("features", "rawPrediction", "probability", "prediction", "_p")
