"""Efficiency clusters: fit, naming by mean consumption, and distance scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.clustering import KMeans
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions.labels import EFFICIENCY_NAMES
from wattline.models.scaling import assemble, fill_zero, scaling_of, standardise
from wattline.operators.features import EFFICIENCY_FEATURES
from wattline.operators.ordered import percent_rank_of_ties

KWH = "consumption_kwh"


def name_clusters(df: DataFrame, cluster: str, value: str = KWH, names: Sequence[str] = EFFICIENCY_NAMES) -> DataFrame:
    """(cluster, label): clusters ranked by mean consumption, cheapest first."""
    means = df.groupBy(cluster).agg(F.avg(value).alias("_m"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_m", cluster))  # one row per cluster
    label = F.coalesce(F.get(F.array(*[F.lit(n) for n in names]), place - 1), F.lit("unknown"))
    return means.select(cluster, label.alias("efficiency_label"))


def nearest_centre(columns: Sequence[str], centres: Sequence[Sequence[float]]) -> Column:
    """Struct(distance, cluster) of the closest of a few centres."""
    options = []
    for i, centre in enumerate(centres):
        square = sum(((F.col(c) - F.lit(float(v))) * (F.col(c) - F.lit(float(v))) for c, v in zip(columns, centre)), F.lit(0.0))
        options.append(F.struct(F.sqrt(square).alias("distance"), F.lit(i).alias("cluster")))
    return F.array_min(F.array(*options))


@dataclass
class EfficiencyModel:
    features: list[str]
    scaling: dict
    centres: list
    labels: Mapping[int, str]


def fit_efficiency(df: DataFrame, clusters: int = 4, columns: Sequence[str] = EFFICIENCY_FEATURES, seed: int = 42) -> EfficiencyModel:
    columns = [c for c in columns if c in df.columns]
    filled = fill_zero(df, columns)
    scaling = scaling_of(filled, columns)
    table = assemble(standardise(filled, scaling), [f"z_{c}" for c in columns])
    model = KMeans(k=clusters, seed=seed, maxIter=50).fit(table)
    named = name_clusters(model.transform(table), "prediction")
    labels = {r["prediction"]: r["efficiency_label"] for r in named.collect()}  # one row per cluster
    return EfficiencyModel(columns, scaling, [list(c) for c in model.clusterCenters()], labels)


def score_efficiency(model: EfficiencyModel, df: DataFrame) -> DataFrame:
    """Cluster, label, 100 - distance / largest distance * 100, and the percentile of that score."""
    filled = fill_zero(df, model.features)
    near = standardise(filled, model.scaling).withColumn(
        "_near", nearest_centre([f"z_{c}" for c in model.features], model.centres))
    kept = near.withColumns({"efficiency_cluster": F.col("_near.cluster"), "_distance": F.col("_near.distance")}).drop(
        "_near", *[f"z_{c}" for c in model.features])
    names = F.create_map(*[x for k, v in model.labels.items() for x in (F.lit(k), F.lit(v))])
    kept = kept.withColumn("efficiency_label", F.coalesce(F.try_element_at(names, F.col("efficiency_cluster")), F.lit("unknown")))
    return with_distance_score(kept, "_distance").drop("_distance")


def with_distance_score(df: DataFrame, distance: str) -> DataFrame:
    furthest = df.agg(F.max(distance)).scalar()
    score = F.round(100 - F.coalesce(F.try_divide(F.col(distance), furthest), F.lit(0.0)) * 100, 1)
    ranked = percent_rank_of_ties(df.withColumn("efficiency_score", score), "efficiency_score", "_pct")
    return ranked.withColumn("efficiency_percentile", F.round(F.col("_pct") * 100, 1)).drop("_pct")
