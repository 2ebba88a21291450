"""The health classifier: rows of a fit are dealt over tasks, and no fit depends on how a table is stored."""

from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from wattline.models import health


class _Counted:
    """An estimator that notes the rows and parts of what it is fitted on; its model predicts the label."""

    def __init__(self, seen):
        self.seen = seen

    def copy(self):
        return self

    def fit(self, table):
        self.seen.append(sorted(table.rdd.glom().map(len).collect()))
        return self

    def transform(self, table):
        return table.withColumn("prediction", F.col("label"))


def _table(spark, rows, parts=1):
    made = spark.range(0, rows, 1, parts).withColumnRenamed("id", "row_id")
    x = F.pmod(F.xxhash64("row_id"), F.lit(1000)) / 10
    made = made.withColumns({"x": x, "y": F.pmod(F.col("row_id"), F.lit(17)).cast("double")})
    return made.withColumn("health", F.when(x + F.col("y") > 90, "critical").when(x > 60, "warning").otherwise("healthy"))


def test_rows_in_one_part_are_dealt_over_tasks_and_all_are_used(spark):
    seen, rows = [], 100_000
    fitted = health.fit_health(_table(spark, rows), ["x", "y"], estimator=_Counted(seen))
    sizes = sorted(sum(parts) for parts in seen)
    assert len(seen) == 6 and sizes[-1] == rows and sum(sizes[:5]) == 4 * rows
    assert all(len(parts) >= 4 and parts[-1] < rows / 3 for parts in seen)
    scores = fitted.fold_scores.collect()
    assert sum(r["n_samples"] for r in scores) == rows and all(r["accuracy"] == 1.0 for r in scores)


def test_small_tables_stay_as_they_are(spark):
    seen = []
    health.fit_health(_table(spark, 900, 3), ["x", "y"], estimator=_Counted(seen))
    assert {len(parts) for parts in seen} == {3}


def test_a_fit_does_not_depend_on_how_rows_are_stored(spark, monkeypatch):
    monkeypatch.setattr(health, "FIT_ROWS", 200)
    forest = RandomForestClassifier(labelCol="label", numTrees=4, maxDepth=3, subsamplingRate=0.8, seed=1)
    table, got = _table(spark, 3000), []
    table = table.unionByName(table.limit(50)).withColumn("row_id", F.when(F.col("row_id") % 9 != 0, F.col("row_id")))
    for stored in (table.coalesce(1), table.orderBy(F.col("row_id").desc()), table.repartition(5, "y")):
        fitted = health.fit_health(stored, ["x", "y"], estimator=forest)
        scores = sorted(tuple(round(v, 9) for v in r) for r in fitted.fold_scores.collect())  # sums of three classes in any order
        got.append((fitted.model.toDebugString.split("\n", 1)[1], scores))
    assert got[0] == got[1] == got[2]


def test_tasks_of_a_fit_follow_from_its_rows():
    assert [health.fit_tasks(n) for n in (0, 1, 25_000, 25_001, 100_000, 800_000, 3_000_000)] == [0, 1, 1, 2, 4, 32, 32]
    assert -(-36_000_000 // health.fit_tasks(36_000_000)) <= health.FIT_ROWS_MOST


def test_rows_of_a_fold_are_predicted_once(spark):
    done = spark.sparkContext.accumulator(0)

    class Noted(_Counted):
        def transform(self, table):
            def predict(label):
                done.add(1)
                return label
            return table.withColumn("prediction", F.udf(predict, "double")("label"))

    scores = health.fit_health(_table(spark, 2000), ["x", "y"], estimator=Noted([])).fold_scores
    assert sum(r["n_samples"] for r in scores.collect()) == 2000 and scores.count() == 5
    assert done.value == 2000


def test_importances_do_not_depend_on_how_rows_are_stored(spark, monkeypatch):
    from wattline.models import forecast

    monkeypatch.setattr(health, "FIT_ROWS", 300)
    forest = RandomForestClassifier(labelCol="label", numTrees=5, maxDepth=4, subsamplingRate=0.8, seed=7)
    table, got = _table(spark, 4000), []
    for stored in (table.coalesce(1), table.repartition(6, "x")):
        fitted = health.fit_health(stored, ["x", "y"], estimator=forest)
        got.append([tuple(r) for r in forecast.importances(fitted.model, fitted.features, stored, 15).collect()])
    assert got[0] == got[1] and len(got[0]) == 2
