"""Drift, retraining decisions, backtests and tuning."""

from __future__ import annotations

import itertools
import random
import time
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.models.scaling import held
from wattline.operators import metrics, splits
from wattline.operators.ordered import arrange
from wattline.operators.quality import long_form, numeric_columns
from wattline.operators.quantile import quantiles
from wattline.session import materialize, scratch_path
from wattline.sources.readings import SERIES, TS

KWH = "consumption_kwh"
DRIFT_Z, DRIFT_SHARE = 2.0, 0.1


def drift_baseline(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, mean, std, min, max, median, q25, q75)."""
    columns = list(columns)
    wanted = {f"{c}__{n}": (c, p) for c in columns for n, p in (("median", 0.5), ("q25", 0.25), ("q75", 0.75))}
    edges = quantiles(df, wanted).select(F.struct("*")).scalar()
    wide = df.agg(*[
        fn(c).cast("double").alias(f"{c}__{n}") for c in columns
        for n, fn in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))])
    wide = wide.withColumns({name: edges[name] for name in wanted})
    return long_form(wide, columns, ["mean", "std", "min", "max", "median", "q25", "q75"], "feature")


def drift_details(baseline: DataFrame, df: DataFrame) -> DataFrame:
    """Mean shift per baseline feature present in ``df``, in baseline deviations."""
    names = numeric_columns(df)
    now = long_form(df.agg(*[F.avg(c).alias(f"{c}__current_mean") for c in names]), names, ["current_mean"], "feature")
    shift = F.abs(F.col("current_mean") - F.col("mean"))
    z = shift / F.when(F.col("std") > 0, F.col("std")).otherwise(1.0)
    return baseline.join(now, "feature").select(
        "feature", F.col("mean").alias("baseline_mean"), "current_mean", shift.alias("mean_shift"), z.alias("z_score"),
        (z > DRIFT_Z).alias("is_drifted"))


def drift_summary(details: DataFrame, baseline: DataFrame, share: float = DRIFT_SHARE) -> DataFrame:
    total = baseline.agg(F.count(F.lit(1))).scalar()
    drifted = F.count_if("is_drifted")
    ratio = F.coalesce(F.try_divide(drifted, total), F.lit(0.0))
    return details.agg(total.alias("total_features"), drifted.alias("n_drifted"), F.round(ratio, 3).alias("drift_ratio"),
                       (ratio > share).alias("drift_detected"))


def retrain_needed(df: DataFrame, history: DataFrame, threshold: int = 100) -> DataFrame:
    """Compare the present row count with the rows of the last training run in the registry."""
    last = history.agg(F.max_by("rows", "trained_at")).scalar()
    one = df.agg(F.count(F.lit(1)).alias("rows")).withColumn("new_rows", F.col("rows") - F.coalesce(last, F.lit(0)))
    return one.withColumn("retrain", F.col("new_rows") >= threshold)


def champion_challenger(old: DataFrame, new: DataFrame, metric: str = "mae", margin: float = 0.02,
                        by: Sequence[str] = ("model",)) -> DataFrame:
    """Replace the old model only if the new one is better by more than the margin."""
    lower = metrics.LOWER_IS_BETTER.get(metric, True)
    joined = old.select(*by, F.col(metric).alias("old_value")).join(
        new.select(*by, F.col(metric).alias("new_value")), list(by), "full")
    missing = F.lit(float("inf")) if lower else F.lit(0.0)
    joined = joined.withColumns({c: F.coalesce(F.col(c), missing) for c in ("old_value", "new_value")})
    o, n = F.col("old_value"), F.col("new_value")
    gain = (o - n if lower else n - o) / (o + F.lit(1e-8))
    better = n < o * (1 - margin) if lower else n > o * (1 + margin)
    return joined.select(*by, F.lit(metric).alias("metric"), "old_value", "new_value", F.round(gain * 100, 2).alias("improvement_pct"),
                         better.alias("is_better"), F.when(better, "REPLACE").otherwise("KEEP_OLD").alias("decision"))


class Registry:
    """Training history in an append-only Parquet table; trainers and hooks are ordinary callables."""

    def __init__(self, spark, path: str | None = None):
        self.spark, self.path = spark, path or scratch_path(spark, "registry")
        self.trainers: dict[str, Callable] = {}
        self.models: dict[str, object] = {}
        self.current: dict[str, DataFrame] = {}
        self.hooks: dict[str, Callable] = {}

    def register(self, name: str, model, report: DataFrame, trainer: Callable) -> None:
        """``trainer`` maps a DataFrame to (model, one-row metrics table)."""
        self.trainers[name], self.models[name], self.current[name] = trainer, model, report

    def on(self, event: str, hook: Callable) -> None:
        """Hooks: ``start`` (name), ``replaced`` (name, model), ``complete`` (name, row)."""
        self.hooks[event] = hook

    def retrain(self, name: str, df: DataFrame, metric: str = "mae", margin: float = 0.02) -> dict:
        self.hooks.get("start", lambda *_: None)(name)
        begun = time.time()
        model, report = self.trainers[name](df)
        row = champion_challenger(
            self.current[name].withColumn("model", F.lit(name)), report.withColumn("model", F.lit(name)), metric, margin).first()
        action = "MODEL_REPLACED" if row["is_better"] else "MODEL_KEPT"
        if row["is_better"]:
            self.models[name], self.current[name] = model, report
            self.hooks.get("replaced", lambda *_: None)(name, model)
        line = (name, action, metric, row["old_value"], row["new_value"], row["improvement_pct"], df.count(), time.time() - begun)
        schema = ("model string, action string, metric string, old_value double, new_value double, improvement_pct double, "
                  "rows bigint, seconds double")
        self.spark.createDataFrame([line], schema).withColumn("trained_at", F.current_timestamp()).coalesce(1).write.mode(
            "append").parquet(self.path)
        self.hooks.get("complete", lambda *_: None)(name, row)
        return {"model": name, "action": action}

    def retrain_all(self, df: DataFrame, metric: str = "mae") -> list[dict]:
        return [self.retrain(name, df, metric) for name in self.trainers]

    def history(self, limit: int | None = None) -> DataFrame:
        """All retrain runs, newest first, or the newest `limit` of them."""
        rows = self.spark.read.parquet(self.path).orderBy(F.col("trained_at").desc())
        return rows if limit is None else rows.limit(limit)


# --- walk-forward backtests ----------------------------------------------------------------

def naive_backtest(df: DataFrame, start: int = 720, horizon: int = 24, step: int = 24, season: int = 24, target: str = KWH,
                   keys: Sequence[str] = (SERIES,), order: Sequence[str] = (TS,)) -> DataFrame:
    """Forecasts of three training-free models for every fold, in one job.

    ``persistence`` repeats the last training value, ``seasonal`` the value one season before,
    ``mean`` the mean of the last season.  A fold needs only values at known positions, so each
    is an equi-join on (key, position); folds never meet their whole training part.
    """
    keys = list(keys)
    rolled = arrange(df.select(*keys, *order, target), keys, order).near({
        "_mean": lambda w: F.avg(target).over(w.rowsBetween(1 - season, 0))}, back=season)
    folds = splits.rolling_origin(rolled.drop("_mean"), start, horizon, step, keys, order)
    folds = folds.withColumns({
        "_last": F.col("train_rows") - 1,
        "_season": F.col("train_rows") - season + F.pmod(F.col("step"), F.lit(season))})
    placed = arrange(rolled, keys, order).with_position("_p")
    last = placed.select(*keys, F.col("_p").alias("_last"), F.col(target).alias("persistence"), F.col("_mean").alias("mean"))
    season_ago = placed.select(*keys, F.col("_p").alias("_season"), F.col(target).alias("seasonal"))
    joined = folds.join(last, [*keys, "_last"]).join(season_ago, [*keys, "_season"])
    cells = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("predicted")) for m in ("persistence", "seasonal", "mean")])
    return joined.select(*keys, "fold", *order, "step", F.col(target).alias("actual"), F.inline(cells))


def fitted_backtest(df: DataFrame, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], start: int, horizon: int, step: int,
                    keys: Sequence[str] = (SERIES,), order: Sequence[str] = (TS,), target: str = KWH, name: str = "fitted") -> DataFrame:
    """Refit per fold on the rows before it. ``fit(train)`` returns a function adding ``prediction``."""
    placed = materialize(arrange(df, keys, order).with_position_and_total("_p", "_n"), "backtest")  # read once per fold
    longest = placed.agg(F.max("_n")).first()[0] or 0
    parts = []
    for fold, origin in enumerate(range(start, longest - horizon, step)):
        scorer = fit(placed.filter(F.col("_p") < origin))
        inside = (F.col("_p") >= origin) & (F.col("_p") < origin + horizon) & (F.col("_n") - horizon > origin)
        test = scorer(placed.filter(inside))
        parts.append(test.select(*keys, F.lit(fold).cast("bigint").alias("fold"), *order, (F.col("_p") - origin).alias("step"),
                                 F.col(target).alias("actual"), F.lit(name).alias("model"), F.col("prediction").alias("predicted")))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def linear_backtest(df: DataFrame, features: Sequence[str], start: int = 720, horizon: int = 24, step: int = 24,
                    keys: Sequence[str] = (SERIES,), order: Sequence[str] = (TS,), target: str = KWH, name: str = "linear") -> DataFrame:
    """Least squares refitted for every fold on the rows before it, of all keys, in one job however many folds there are.

    A row is in the training part of every fold that starts behind it, so the products that least squares needs (of all
    features, the target and a one) are summed once by the first such fold and then accumulated over folds. The fits are
    small systems, one row per fold, solved in tasks; a row is tested in the folds whose horizon covers it. Rows with a
    null in a feature or the target take no part in a fit, and none are tested.
    """
    features, keys = list(features), list(keys)
    placed = materialize(arrange(df.select(*keys, *order, *features, target), keys, order).with_position_and_total("_p", "_n"), "backtest")
    known = placed.na.drop("any", subset=[*features, target])
    shift = known.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in (*features, target)]).select(F.struct("*")).scalar()
    cells = [F.lit(1.0), *[F.col(c) - shift[c] for c in (*features, target)]]
    size = len(cells)
    products = [F.sum(cells[i] * cells[j]).alias(f"_g{i}_{j}") for i in range(size) for j in range(i, size)]
    first_fold = F.greatest(F.lit(0), F.ceil((F.col("_p") + 1 - start) / step)).cast("bigint")
    sums = known.groupBy(first_fold.alias("fold")).agg(*products)
    names = [p for p in sums.columns if p != "fold"]
    origins = placed.agg(F.max("_n").alias("_n")).where(F.col("_n") - horizon > start).select(F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.floor((F.col("_n") - horizon - 1 - start) / step))).alias("fold"))
    summed = arrange(origins.join(sums, "fold", "left").na.fill(0.0, names), [], ["fold"]).running({f"_r{n}": ("sum", n) for n in names})
    centre = summed.withColumn("_shift", F.array(*[shift[c] for c in (*features, target)]))

    def solve(frames):
        for frame in frames:
            fits = []
            for row in frame.itertuples(index=False):
                gram = np.zeros((size, size))
                for n in names:
                    i, j = map(int, n[2:].split("_"))
                    gram[i, j] = gram[j, i] = getattr(row, f"m{n}")
                solved = np.linalg.lstsq(gram[:-1, :-1], gram[:-1, -1], rcond=None)[0] if gram[0, 0] else np.full(size - 1, np.nan)
                centres = np.asarray(row.shift, float)
                fits.append([float(solved[0] + centres[-1] - solved[1:] @ centres[:-1]), *map(float, solved[1:])])
            yield pd.DataFrame({"fold": frame["fold"], "_fit": fits})

    renamed = centre.select("fold", *[F.col(f"_r{n}").alias(f"m{n}") for n in names], F.col("_shift").alias("shift"))
    fits = renamed.mapInPandas(solve, "fold bigint, _fit array<double>")
    last = F.floor((F.col("_p") - start) / step)
    earliest = F.greatest(F.lit(0), F.floor((F.col("_p") - start - horizon) / step) + 1)
    tested = placed.where(F.col("_p") >= start).withColumn("fold", F.explode(F.when(last >= earliest, F.sequence(earliest, last))))
    tested = tested.withColumn("step", F.col("_p") - start - F.col("fold") * step).where(
        F.col("_n") - horizon > start + F.col("fold") * step).na.drop("any", subset=[*features, target])
    predicted = F.col("_fit")[0]
    for i, c in enumerate(features, 1):
        predicted = predicted + F.col("_fit")[i] * F.col(c)
    return tested.join(fits, "fold").select(
        *keys, "fold", *order, "step", F.col(target).alias("actual"), F.lit(name).alias("model"), predicted.alias("predicted"))


def horizon_report(df: DataFrame, horizons: Sequence[int] = (6, 12, 24, 48), start: int = 720, step: int = 24,
                   keys: Sequence[str] = (SERIES,), order: Sequence[str] = (TS,)) -> DataFrame:
    """Forecast metrics per (horizon, model), over the folds of that horizon."""
    parts = []
    for horizon in horizons:
        tested = naive_backtest(df, start, horizon, step, keys=keys, order=order).withColumn("horizon", F.lit(horizon))
        parts.append(tested)
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return metrics.forecast_metrics(every, "actual", "predicted", ["horizon", "model"], [*keys, "fold", "step"])


# --- tuning --------------------------------------------------------------------------------

def cross_validate_in_time(df: DataFrame, estimator, folds: int, target: str = "label") -> DataFrame:
    """(fold, mse) with expanding training parts; ``df`` has ``test_fold``, features and label."""
    parts = []
    for fold in range(1, folds + 1):
        model = estimator.fit(df.filter(F.col("test_fold") < fold))
        error = F.col(target) - F.col("prediction")
        parts.append(model.transform(df.filter(F.col("test_fold") == fold)).agg(F.avg(error * error).alias("mse")).withColumn(
            "fold", F.lit(fold)))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def tune(df: DataFrame, make: Callable[..., object], trials: Sequence[Mapping], folds: int = 3) -> DataFrame:
    """(trial, params, value, best_so_far): mean squared error of each parameter set."""
    lines = []
    with held(df) as table:
        for number, params in enumerate(trials, 1):
            mean = cross_validate_in_time(table, make(**params), folds).agg(F.avg("mse")).first()[0]
            lines.append((number, ", ".join(f"{k}={v}" for k, v in sorted(params.items())), mean))
    table = df.sparkSession.createDataFrame(lines, "trial int, params string, value double")
    return metrics.best_so_far(table)


def grid(**choices: Sequence) -> list[dict]:
    return [dict(zip(choices, values)) for values in itertools.product(*choices.values())]


def random_trials(n: int, seed: int = 42, **ranges) -> list[dict]:
    """``n`` seeded draws; a range is (low, high), integers stay integers, or a list of choices."""
    draw, out = random.Random(seed), []
    for _ in range(n):
        trial = {}
        for name, span in ranges.items():
            if isinstance(span, list):
                trial[name] = draw.choice(span)
            elif all(isinstance(v, int) for v in span):
                trial[name] = draw.randint(*span)
            else:
                trial[name] = round(draw.uniform(*span), 4)
        out.append(trial)
    return out
