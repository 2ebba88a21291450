"""Demand forecasting: boosted trees, ensembles, autoregression, seasonal regression and blends."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.functions.temporal import calendar_features, cyclical_features, peak_hour
from wattline.models.scaling import assemble, fill_zero, held
from wattline.operators import metrics, splits
from wattline.operators.features import forecast_features
from wattline.operators.join import horizon_rows
from wattline.operators.ordered import arrange
from wattline.sources.readings import SERIES, TS

KWH = "consumption_kwh"
_BAND = 0.08


def boosted_trees(rounds: int = 500, depth: int = 5, rate: float = 0.05, seed: int = 42) -> GBTRegressor:
    return GBTRegressor(labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=0.8,
                        featureSubsetStrategy="0.8", seed=seed)


def ready(df: DataFrame, columns: Sequence[str], target: str | None = None) -> DataFrame:
    """Fill gaps with zero, assemble the vector and name the label."""
    made = assemble(fill_zero(df, columns), columns)
    return made.withColumn("label", F.col(target).cast("double")) if target else made


@dataclass
class FittedForecaster:
    features: list[str]
    model: object
    report: DataFrame  # regression metrics per part, with the percentage error shifted by 1e-8


def fit_forecaster(df: DataFrame, target: str = KWH, columns: Sequence[str] | None = None, estimator=None,
                   test_share: float = 0.2, keys: Sequence[str] = (SERIES,)) -> FittedForecaster:
    """Train on the first rows of each key, report errors on both parts."""
    columns = list(columns or forecast_features(df.columns))
    parts = ready(splits.ordered_split(df, test_share, keys), columns, target)
    with held(parts.filter("part = 'train'").select("features", "label")) as train:
        model = (estimator or boosted_trees()).fit(train)
    predicted = model.transform(parts)
    return FittedForecaster(columns, model, metrics.regression_metrics(predicted, "label", "prediction", ["part"], "shift"))


def gap_verdict(report: DataFrame, largest: float = 0.10) -> DataFrame:
    one = report.agg(F.max(F.when(F.col("part") == "train", F.col("r2"))).alias("train_r2"),
                     F.max(F.when(F.col("part") == "test", F.col("r2"))).alias("test_r2"))
    gap = F.col("train_r2") - F.col("test_r2")
    return one.withColumns({"gap": gap, "acceptable": gap <= largest})


def future_rows(df: DataFrame, hours: int = 24, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """Rows of the next hours: last known features, calendar of the new time, the wider peak block."""
    known = df.drop(*[c for c in ("hour", "day_of_week", "day_of_year", "month", "year", "quarter", "week_of_year",
                                  "is_weekend", "is_peak_hour") if c in df.columns])
    ahead = cyclical_features(calendar_features(horizon_rows(known, hours, keys)))
    return ahead.withColumn("is_peak_hour", peak_hour(F.col("hour"), forecast=True))


def forecast_hours(fitted: FittedForecaster, df: DataFrame, hours: int = 24, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """(keys, step, ts, forecast_kwh, lower_bound, upper_bound) with an 8 % band."""
    scored = fitted.model.transform(ready(future_rows(df, hours, keys), fitted.features))
    p = F.col("prediction")
    return scored.select(*keys, "step", TS, p.alias("forecast_kwh"), (p * (1 - _BAND)).alias("lower_bound"),
                         (p * (1 + _BAND)).alias("upper_bound"))


# --- ensembles -----------------------------------------------------------------------------

MEMBER_WEIGHTS = {"boosted": 2.0, "forest": 1.0, "wide_forest": 1.0}


def member_estimators(rounds: int = 30, trees: int = 40, seed: int = 42) -> dict:
    return {
        "boosted": boosted_trees(rounds, 5, 0.05, seed),
        "forest": RandomForestRegressor(labelCol="label", numTrees=trees, maxDepth=7, minInstancesPerNode=3, seed=seed),
        "wide_forest": RandomForestRegressor(labelCol="label", numTrees=trees, maxDepth=7, minInstancesPerNode=3,
                                             featureSubsetStrategy="sqrt", subsamplingRate=1.0, bootstrap=False, seed=seed + 1),
    }


@dataclass
class Ensemble:
    features: list[str]
    members: dict
    stacker: object | None = None

    def member_predictions(self, df: DataFrame) -> DataFrame:
        made = ready(df, self.features)
        for name, model in self.members.items():
            made = model.setPredictionCol(f"p_{name}").transform(made)
        return made.drop("features")

    def predict(self, df: DataFrame) -> DataFrame:
        made = self.member_predictions(df)
        names = [f"p_{n}" for n in self.members]
        if self.stacker is None:
            return made.withColumn("prediction", weighted_vote(names, [MEMBER_WEIGHTS[n] for n in self.members]))
        return self.stacker.transform(assemble(made, names, "stack")).drop("stack")


def weighted_vote(columns: Sequence[str], weights: Sequence[float]) -> Column:
    total = sum((F.col(c) * w for c, w in zip(columns, weights)), F.lit(0.0))
    return total / sum(weights)


def spread_of(columns: Sequence[str], z: float = 1.96) -> dict[str, Column]:
    """Mean, population deviation and interval across member predictions of one row."""
    values, n = F.array(*columns), len(columns)
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n
    std = F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n)
    return {"mean": mean, "std": std, "lower": mean - z * std, "upper": mean + z * std}


def fit_ensemble(df: DataFrame, target: str = KWH, columns: Sequence[str] | None = None, method: str = "voting",
                 estimators: dict | None = None, folds: int = 3, keys: Sequence[str] = (SERIES,)) -> Ensemble:
    """Members fitted on all rows; ``stacking`` learns a ridge over out-of-fold predictions."""
    columns = list(columns or forecast_features(df.columns))
    estimators = estimators or member_estimators()
    made = ready(df, columns, target)
    with held(made.select("features", "label")) as train:
        ensemble = Ensemble(columns, {n: e.fit(train) for n, e in estimators.items()})
    if method != "stacking":
        return ensemble
    placed = arrange(made, keys, [c for c in (TS, "row_id") if c in df.columns]).with_position_and_total("_p", "_n")
    placed = placed.withColumn("_fold", F.floor(F.col("_p") * folds / F.col("_n"))).drop("_p", "_n")
    held_out = []
    placed = placed.select("features", "label", "_fold")
    for fold in range(folds):
        outside = placed.filter(F.col("_fold") == fold)
        for name, estimator in estimators.items():
            fitted = estimator.fit(placed.filter(F.col("_fold") != fold))
            outside = fitted.setPredictionCol(f"p_{name}").transform(outside)
        held_out.append(outside.select("label", *[f"p_{n}" for n in estimators]))
    stack = held_out[0]
    for part in held_out[1:]:
        stack = stack.unionByName(part)
    stack = assemble(stack, [f"p_{n}" for n in estimators], "stack")
    ridge = LinearRegression(featuresCol="stack", labelCol="label", regParam=1.0, elasticNetParam=0.0)
    ensemble.stacker = ridge.fit(stack)
    return ensemble


def importances(model, features: Sequence[str], df: DataFrame, top: int | None = None) -> DataFrame:
    rows = [(n, float(v)) for n, v in zip(features, model.featureImportances.toArray())]
    table = df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc(), "feature")
    return table.limit(top) if top else table


def ensemble_importances(ensemble: Ensemble, df: DataFrame) -> DataFrame:
    tables = [importances(m, ensemble.features, df) for m in ensemble.members.values()]
    both = tables[0]
    for table in tables[1:]:
        both = both.unionByName(table)
    return both.groupBy("feature").agg(F.avg("importance").alias("importance")).orderBy(F.col("importance").desc(), "feature")


# --- autoregression ------------------------------------------------------------------------

def fit_autoregression(df: DataFrame, lags: Sequence[int] = (1, 2, 3, 24), target: str = KWH,
                       keys: Sequence[str] = (SERIES,), order: Sequence[str] = (TS,)) -> dict:
    """One linear model on lagged values shared by all keys: {"intercept", "weights": {lag: weight}}."""
    from wattline.operators.features import add_lags

    lagged = add_lags(df, target, lags, keys, order).na.drop("any", subset=[f"{target}_lag_{n}h" for n in lags])
    columns = [f"{target}_lag_{n}h" for n in lags]
    model = LinearRegression(labelCol="label", regParam=0.0).fit(ready(lagged, columns, target))
    return {"intercept": float(model.intercept), "weights": dict(zip(lags, map(float, model.coefficients)))}


def roll_out(df: DataFrame, coefficients: dict, hours: int = 24, target: str = KWH, keys: Sequence[str] = (SERIES,),
             order: Sequence[str] = (TS,)) -> DataFrame:
    """Feed each prediction back as the newest value, ``hours`` times; (keys, step, forecast_kwh).

    The state per key is the array of its last ``max(lag)`` values, folded in SQL.
    """
    reach = max(coefficients["weights"])
    newest = splits.latest_per_key(df.select(*keys, *order, target), reach, keys, order)
    state = newest.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, target))).alias("_rows"))
    state = state.select(*keys, F.transform("_rows", lambda r: r[target]).alias("_past")).filter(F.size("_past") == reach)

    def step(past: Column, _) -> Column:
        value = F.lit(coefficients["intercept"])
        for lag, weight in coefficients["weights"].items():
            value = value + F.element_at(past, -lag) * weight
        return F.concat(past, F.array(value))

    grown = F.aggregate(F.sequence(F.lit(1), F.lit(hours)), F.col("_past"), step)
    ahead = state.select(*keys, F.posexplode(F.slice(grown, reach + 1, hours)).alias("_i", "forecast_kwh"))
    return ahead.select(*keys, (F.col("_i") + 1).alias("step"), "forecast_kwh")


# --- seasonal regression -------------------------------------------------------------------

# Seasonal periods in hours with their number of harmonics.
SEASONS = {"daily": (24.0, 4), "weekly": (168.0, 3), "yearly": (8766.0, 5)}


def seasonal_columns(ts: str = TS, start: str = "2020-01-01") -> dict[str, Column]:
    """Trend in days and sine/cosine pairs of each season."""
    hours = (F.unix_timestamp(F.col(ts)) - F.unix_timestamp(F.lit(start).cast("timestamp"))) / F.lit(3600.0)
    made = {"trend": hours / 24.0}
    for name, (period, harmonics) in SEASONS.items():
        for k in range(1, harmonics + 1):
            angle = hours * F.lit(2 * math.pi * k / period)
            made[f"{name}_sin{k}"], made[f"{name}_cos{k}"] = F.sin(angle), F.cos(angle)
    return made


@dataclass
class SeasonalModel:
    columns: list[str]
    model: object
    sigma: float


def fit_seasonal(df: DataFrame, target: str = KWH, regressors: Sequence[str] = ("temperature",)) -> SeasonalModel:
    made = seasonal_columns()
    columns = [*made, *[r for r in regressors if r in df.columns]]
    table = ready(df.withColumns(made), columns, target)
    model = LinearRegression(labelCol="label", regParam=1e-3, elasticNetParam=0.0).fit(table)
    error = F.col("label") - F.col("prediction")
    sigma = model.transform(table).agg(F.stddev_pop(error)).first()[0] or 0.0
    return SeasonalModel(columns, model, float(sigma))


def seasonal_forecast(fitted: SeasonalModel, df: DataFrame, hours: int = 24, z: float = 1.96,
                      keys: Sequence[str] = (SERIES,)) -> DataFrame:
    ahead = horizon_rows(df, hours, keys).withColumns(seasonal_columns())
    scored = fitted.model.transform(ready(ahead, fitted.columns))
    p = F.col("prediction")
    return scored.select(*keys, "step", TS, p.alias("forecast_kwh"), (p - z * fitted.sigma).alias("lower_bound"),
                         (p + z * fitted.sigma).alias("upper_bound"))


def blend_by_horizon(df: DataFrame, horizon: int, short: str, seasonal: str, seasonal_low: str, seasonal_high: str) -> DataFrame:
    """Up to 6 hours the short model with a 10 % band, up to 24 the seasonal one, beyond a 0.4/0.6 blend."""
    s, p = F.col(short), F.col(seasonal)
    if horizon <= 6:
        value, low, high, used = s, s * 0.9, s * 1.1, "short"
    elif horizon <= 24:
        value, low, high, used = p, F.col(seasonal_low), F.col(seasonal_high), "seasonal"
    else:
        value, used = 0.4 * s + 0.6 * p, "ensemble"
        low, high = F.col(seasonal_low) * 0.95, F.col(seasonal_high) * 1.05
    return df.withColumns({"forecast": value, "lower": low, "upper": high, "model_used": F.lit(used)})
