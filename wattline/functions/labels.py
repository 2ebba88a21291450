"""Score-to-label ladders. All upper edges belong to the lower label."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity edges of the forest score and of the combined detector score.
FOREST_EDGES = (0.1, 0.3, 0.6)
DETECTOR_EDGES = (0.25, 0.5, 0.75)
SEVERITIES = ("normal", "low", "medium", "high")

# Efficiency names by rank of mean consumption, cheapest first.
EFFICIENCY_NAMES = ("very efficient", "efficient", "moderate", "inefficient")
HEALTH_CLASSES = ("healthy", "warning", "critical")
NOMINAL_VOLTAGE = 230.0
VOLTAGE_BAND = (225.0, 235.0)
HOT_TEMPERATURE = 35.0


def severity(score: Column, edges: tuple = FOREST_EDGES) -> Column:
    ladder = F.when(score.isNull(), None)
    for edge, label in zip(edges, SEVERITIES):
        ladder = ladder.when(score <= edge, label)
    return ladder.otherwise(SEVERITIES[-1])


def health_points(consumption: Column, high: Column, voltage: Column, temperature: Column) -> Column:
    """2 for high use, 1 for voltage outside its band (a missing voltage counts), 1 for heat."""
    steady = F.coalesce(voltage.between(*VOLTAGE_BAND), F.lit(False))
    return (
        F.when(consumption > high, 2).otherwise(0)
        + F.when(steady, 0).otherwise(1)
        + F.when(temperature > HOT_TEMPERATURE, 1).otherwise(0)
    )


def health_label(points: Column) -> Column:
    return F.when(points <= 0, "healthy").when(points <= 2, "warning").otherwise("critical")


def peak_probability(forecast: Column, threshold: Column) -> Column:
    raw = F.try_divide(forecast - threshold * 0.5, threshold) * 100
    return F.round(F.least(F.lit(99.0), F.greatest(F.lit(1.0), raw)), 1)


def domain_ratios(df):
    """Use per degree and apparent power, where their inputs exist."""
    made = {}
    if {"consumption_kwh", "temperature"} <= set(df.columns):
        made["consumption_per_degree"] = F.col("consumption_kwh") / (F.abs("temperature") + 1)
    if {"consumption_kwh", "load_factor"} <= set(df.columns):
        made["apparent_power"] = F.col("consumption_kwh") / (F.col("load_factor") + F.lit(1e-8))
    return df.withColumns(made) if made else df
