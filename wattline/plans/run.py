"""The batch run: scan, validate, clean, features, models, predictions, alerts, recommendations, saved results."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.functions import labels
from wattline.models import efficiency, forecast, forest, health
from wattline.operators import clean, features, quality, recommend, rules, splits
from wattline.operators.cooldown import apply_cooldown
from wattline.operators.join import with_side_table
from wattline.operators.quantile import quantiles
from wattline.session import materialize, scratch_scope
from wattline.sources import readings as src
from wattline.sources import results
from wattline.sources.readings import ROW, SERIES, TS, measure_columns

COOLDOWN_SECONDS = 300


def with_series(df: DataFrame) -> DataFrame:
    """A table of one meter has no series column; it becomes series 0."""
    return df if SERIES in df.columns else df.withColumn(SERIES, F.lit(0).cast("bigint"))


def prepare(spark: SparkSession, meter_path: str, iot_path: str | None = None, validated: bool = True,
            seconds: int = 3600) -> tuple[DataFrame, DataFrame]:
    """(feature matrix, validation findings).

    A valid table is cleaned, resampled and marked; an invalid one, or one that is not to be
    validated, takes the basic cleaning path. Rows without a readable time are left out and
    counted in the findings. A side table with series is joined per series and time.

    Rows that were cleaned before they were written stay as they are, whatever the other files hold;
    where such a row and a cleaned one share series and time, the earlier cleaned row stays.
    """
    scanned = with_series(src.scan_csv(spark, meter_path, keep_bad_rows=True))
    unreadable = scanned.filter(F.col(TS).isNull()).count()
    raw = scanned.filter(F.col(TS).isNotNull())
    findings = quality.validate(raw, bad_times=unreadable)
    before = src.cleaned_before(raw)
    facts = raw.agg(F.count_if(before).alias("done"), F.count_if(~before).alias("fresh")).first()
    mixed = facts["done"] > 0 and facts["fresh"] > 0
    fresh = raw.filter(~before).drop("data_source", "ingestion_time") if mixed else raw
    if facts["done"] and not facts["fresh"]:
        length, table = clean.grid_length(raw, seconds), raw
    elif validated and quality.verdict(findings).first()["is_valid"]:
        length = clean.grid_length(raw, seconds)
        table = src.with_lineage(clean.resample(clean.clean_validated(fresh), seconds))
    else:
        length, table = None, clean.clean(fresh)
    if mixed:
        done = src.with_lineage(raw.filter(before))
        done = done if ROW in table.columns else done.drop(ROW)
        table = table if "data_source" in table.columns else src.with_lineage(table, "basic_cleaning")
        length, table = None, table.join(done.select(SERIES, TS), [SERIES, TS], "left_anti").unionByName(
            done, allowMissingColumns=True)
    if iot_path:
        table = with_side_table(table, src.scan_iot_csv(spark, iot_path))
    return features.feature_matrix(table.drop("status"), longest=length if iot_path is None else None), findings


@dataclass
class Models:
    anomaly: forest.ForestModel
    forecaster: forecast.FittedForecaster
    health: health.HealthModel
    efficiency: efficiency.EfficiencyModel


def with_row_id(df: DataFrame) -> DataFrame:
    """A key that follows from series and time, so that samples are the same on every run."""
    return df if ROW in df.columns else df.withColumn(ROW, F.abs(F.xxhash64(SERIES, TS)))


def with_health_labels(df: DataFrame, name: str = "health") -> DataFrame:
    high = quantiles(df, {"q": ("consumption_kwh", 0.85)}).scalar()
    voltage = F.col("voltage") if "voltage" in df.columns else F.lit(labels.NOMINAL_VOLTAGE)
    heat = F.col("temperature") if "temperature" in df.columns else F.lit(25.0)
    return df.withColumn(name, labels.health_label(labels.health_points(F.col("consumption_kwh"), high, voltage, heat)))


def train_all(df: DataFrame, trees: int = 200, rounds: int = 500) -> Models:
    return Models(
        anomaly=forest.fit_forest(df, measure_columns(df), trees),
        forecaster=forecast.fit_forecaster(df, estimator=forecast.boosted_trees(rounds)),
        health=health.fit_health(with_health_labels(df), features.health_features(df)),
        efficiency=efficiency.fit_efficiency(df),
    )


def predict_all(df: DataFrame, models: Models, hours: int = 24) -> tuple[DataFrame, DataFrame]:
    """(rows with anomaly, health and efficiency columns; forecast of the next hours)."""
    scored = health.predict_health(models.health, forest.predict(models.anomaly, df))
    return (efficiency.score_efficiency(models.efficiency, scored),
            forecast.forecast_hours(models.forecaster, df, hours))


def batch_alerts(predictions: DataFrame, settings: Mapping | None = None, cooldown: float = COOLDOWN_SECONDS,
                 newest: int | None = None) -> DataFrame:
    """Every alert of every meter that its rule's cooldown lets through.

    ``newest`` restricts the pass to the last rows of each meter, for runs that repeat often.
    """
    rows = predictions if newest is None else splits.latest_per_key(predictions, newest)
    return apply_cooldown(rules.alerts(rows, settings), cooldown)


def run_batch(spark: SparkSession, meter_path: str, root: str, run_id: str, iot_path: str | None = None,
              settings: Mapping | DataFrame | None = None, trees: int = 200, rounds: int = 500,
              cooldown: float = COOLDOWN_SECONDS, newest: int | None = None) -> dict[str, DataFrame]:
    """The whole cycle; results are saved under ``root/run_id`` and read back.

    ``settings`` is a mapping or a stored (name, value) table, which is laid over the defaults.
    """
    if isinstance(settings, DataFrame):
        settings = results.settings_dict(results.merge_settings(settings, spark))
    with scratch_scope(spark):
        _run_and_save(spark, meter_path, root, run_id, iot_path, settings, trees, rounds, cooldown, newest)
    return results.load_run(spark, root, run_id)


def _run_and_save(spark, meter_path, root, run_id, iot_path, settings, trees, rounds, cooldown, newest) -> None:
    matrix, findings = prepare(spark, meter_path, iot_path)
    # Fits read the features many times: write them once to the shared folder.
    table = materialize(with_row_id(matrix.drop("data_source", "ingestion_time")), "features")
    models = train_all(table, trees, rounds)
    predictions, ahead = predict_all(table, models)
    predictions = materialize(predictions, "predictions")
    alerts = batch_alerts(predictions, settings, cooldown, newest)
    tables = {"frame": table, "predictions": predictions, "forecast": ahead, "alerts": alerts,
              "recommendations": recommend.recommendations(predictions), "findings": findings}
    tables["model_facts"], tables["forest_nodes"] = _model_tables(spark, models)
    fitted = {"forecaster": models.forecaster.model, "health": models.health.model}
    results.save_run(tables, root, run_id, fitted)


def _model_tables(spark: SparkSession, models: Models) -> tuple[DataFrame, DataFrame]:
    """What a restore needs beside the fitted estimators: (model, facts) as JSON, and the nodes of the forest."""
    a, e = models.anomaly, models.efficiency
    facts = {
        "anomaly": {"features": a.features, "sample": a.sample, "offset": a.offset, "threshold": a.threshold},
        "forecaster": {"features": models.forecaster.features},
        "health": {"features": models.health.features, "classes": models.health.classes},
        "efficiency": {"features": e.features, "scaling": {k: list(map(float, v)) for k, v in e.scaling.items()},
                       "centres": [[float(x) for x in c] for c in e.centres], "labels": {str(k): v for k, v in e.labels.items()}},
    }
    lines = [(name, json.dumps(fact)) for name, fact in facts.items()]
    return spark.createDataFrame(lines, "model string, facts string"), spark.createDataFrame(a.nodes)


def load_models(spark: SparkSession, root: str, run_id: str) -> Models:
    """The four models of a saved run, ready to score again; reports of the fits are not kept."""
    tables = results.load_run(spark, root, run_id)
    facts = {r["model"]: json.loads(r["facts"]) for r in tables["model_facts"].collect()}  # four rows
    a, e = facts["anomaly"], facts["efficiency"]
    place = f"{root}/{run_id}/models"
    return Models(
        anomaly=forest.ForestModel(a["features"], tables["forest_nodes"].toPandas(), a["sample"], a["offset"], a["threshold"]),
        forecaster=forecast.FittedForecaster(facts["forecaster"]["features"], GBTRegressionModel.load(f"{place}/forecaster"), None),
        health=health.HealthModel(facts["health"]["features"], RandomForestClassificationModel.load(f"{place}/health"),
                                  facts["health"]["classes"], None),
        efficiency=efficiency.EfficiencyModel(e["features"], {k: tuple(v) for k, v in e["scaling"].items()}, e["centres"],
                                              {int(k): v for k, v in e["labels"].items()}),
    )
