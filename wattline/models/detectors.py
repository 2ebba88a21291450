"""Reconstruction-error detector and the vote of several detectors."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.functions.labels import DETECTOR_EDGES, severity
from wattline.models.scaling import assemble, fill_zero, scaling_of, standardise
from wattline.operators.quantile import quantiles


@dataclass
class ReconstructionModel:
    features: list[str]
    scaling: dict
    model: object
    variances: list[float]
    threshold: float = 0.0


def fit_reconstruction(df: DataFrame, columns: Sequence[str], components: int = 2, percentile: float = 0.95) -> ReconstructionModel:
    """Principal components of the standardised columns; the flag level is a quantile of the training error."""
    columns = list(columns)
    filled = fill_zero(df, columns)
    scaling = scaling_of(filled, columns)
    table = assemble(standardise(filled, scaling), [f"z_{c}" for c in columns])
    model = PCA(k=components, inputCol="features", outputCol="latent").fit(table)
    total = sum(1.0 for c in columns if scaling[c][1] > 0)
    fitted = ReconstructionModel(columns, scaling, model, [float(v) * total for v in model.explainedVariance])
    fitted.threshold = float(quantiles(reconstruction_errors(fitted, df), {"t": ("recon_error", percentile)}).first()["t"])
    return fitted


def reconstruction_errors(fitted: ReconstructionModel, df: DataFrame) -> DataFrame:
    """Add recon_error (mean squared) and latent_distance (squared, in units of component variance)."""
    columns = fitted.features
    z = [f"z_{c}" for c in columns]
    made = fitted.model.transform(assemble(standardise(fill_zero(df, columns), fitted.scaling), z))
    made = made.withColumn("_l", vector_to_array("latent"))
    weights = fitted.model.pc.toArray()
    error, distance = F.lit(0.0), F.lit(0.0)
    for i, name in enumerate(z):
        back = sum((F.get("_l", F.lit(k)) * float(weights[i][k]) for k in range(weights.shape[1])), F.lit(0.0))
        error = error + (F.col(name) - back) * (F.col(name) - back)
    for k, variance in enumerate(fitted.variances):
        distance = distance + F.get("_l", F.lit(k)) * F.get("_l", F.lit(k)) / max(variance, 1e-12)
    made = made.withColumns({"recon_error": error / len(z), "latent_distance": distance})
    return made.drop("features", "latent", "_l", *z)


def _unit(df: DataFrame, column: str) -> Column:
    bounds = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).select(F.struct("*")).scalar()
    return (F.col(column) - bounds["lo"]) / (bounds["hi"] - bounds["lo"] + F.lit(1e-8))


def combine_errors(df: DataFrame, error: str, distance: str, threshold: float | Column, prefix: str = "recon") -> DataFrame:
    """0.7 and 0.3 of the min-max scaled parts, flag on the raw error, severity on the combination."""
    score = 0.7 * _unit(df, error) + 0.3 * _unit(df, distance)
    made = df.withColumn(f"{prefix}_anomaly_score", score)
    return made.withColumns({
        f"{prefix}_anomaly_flag": (F.col(error) > threshold).cast("int"),
        f"{prefix}_severity": severity(F.col(f"{prefix}_anomaly_score"), DETECTOR_EDGES),
    })


def detect(fitted: ReconstructionModel, df: DataFrame) -> DataFrame:
    return combine_errors(reconstruction_errors(fitted, df), "recon_error", "latent_distance", fitted.threshold)


def level_severity(score: Column, threshold: Column) -> Column:
    """Cut at half, one and one and a half times the threshold."""
    return (F.when(score <= threshold * 0.5, "normal").when(score <= threshold, "low")
            .when(score <= threshold * 1.5, "medium").otherwise("high"))


def vote(df: DataFrame, scores: Sequence[str], flags: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Mean score, majority flag, agreement 2 * |share - 0.5| and severity."""
    n = len(flags)
    share = sum((F.col(f) for f in flags), F.lit(0)) / n
    mean = sum((F.col(s) for s in scores), F.lit(0.0)) / len(scores)
    made = df.withColumn("ensemble_score", mean)
    return made.withColumns({
        "ensemble_flag": (share >= threshold).cast("int"),
        "ensemble_confidence": F.abs(share - 0.5) * 2,
        "ensemble_severity": severity(F.col("ensemble_score"), DETECTOR_EDGES),
    })
