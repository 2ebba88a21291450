"""Time-series features over an ordered reading table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from wattline.functions.labels import domain_ratios
from wattline.functions.temporal import calendar_features, cyclical_features
from wattline.operators.ordered import arrange
from wattline.sources.readings import SERIES, TS

# Look-backs in rows.
LAGS = (1, 2, 3, 6, 12, 24)
WINDOWS = (6, 12, 24, 48)


def lag_columns(target: str, lags: Sequence[int] = LAGS) -> dict:
    return {f"{target}_lag_{n}h": (lambda w, n=n: F.lag(target, n).over(w)) for n in lags}


def _joined_window(size: int, left: int) -> dict:
    """Count, sum, squared deviations and maximum over ``size`` rows: those over the last ``left`` rows joined with those
    over the ``size - left`` rows before them."""
    right = size - left

    def before(name):
        return lambda w: F.lag(f"_{name}_{right}", left).over(w)

    def deviations(w):
        n, m = F.lit(float(left)), F.lit(float(right))
        apart = F.col(f"_s_{left}") / n - before("s")(w) / m
        return F.col(f"_d_{left}") + before("d")(w) + apart * apart * (n * m / (n + m))

    return {
        f"_n_{size}": lambda w: F.col(f"_n_{left}") + F.coalesce(before("n")(w), F.lit(0)),
        f"_s_{size}": lambda w: F.col(f"_s_{left}") + before("s")(w),
        f"_d_{size}": deviations,
        f"_x_{size}": lambda w: F.greatest(F.col(f"_x_{left}"), before("x")(w)),
    }


def _halves(size: int) -> tuple[int, int]:
    return (size // 2, size // 2) if size % 2 == 0 else (size - 1, 1)


def rolling_steps(target: str, sizes: Sequence[int] = WINDOWS, include_current: bool = True) -> tuple[list[dict], list[str]]:
    """Steps for :meth:`Ordered.near` and their helper columns: mean, sample deviation and maximum, null until the window is full.

    A window is joined from two halves, one shifted behind the other, so that a row costs a few shifts for each doubling
    however wide the windows are. Deviations are joined from those of the halves, which keeps them exact where values repeat.
    """
    needed, todo = {1}, list(sizes)
    while todo:
        size = todo.pop()
        if size not in needed:
            needed.add(size)
            todo += _halves(size)
    value = (lambda w: F.col(target)) if include_current else (lambda w: F.lag(target, 1).over(w))
    first = {
        "_n_1": lambda w: value(w).isNotNull().cast("int"), "_s_1": lambda w: F.coalesce(value(w).cast("double"), F.lit(0.0)),
        "_d_1": lambda w: F.lit(0.0), "_x_1": value,
    }
    steps = [first, *[_joined_window(size, _halves(size)[0]) for size in sorted(needed - {1})]]
    last = {}
    for size in sizes:
        full = F.col(f"_n_{size}") == size
        for short, made in (("mean", F.col(f"_s_{size}") / size),
                            ("std", F.sqrt(F.col(f"_d_{size}") / (size - 1)) if size > 1 else F.lit(None).cast("double")),
                            ("max", F.col(f"_x_{size}"))):
            last[f"{target}_roll_{short}_{size}h"] = lambda w, full=full, made=made: F.when(full, made)
    return [*steps, last], [f"_{name}_{size}" for size in sorted(needed) for name in "nsdx"]


def add_lags(df: DataFrame, target: str = "consumption_kwh", lags: Sequence[int] = LAGS,
             keys: Sequence[str] = (SERIES,), order: Sequence[str] = (TS,), longest: int | None = None) -> DataFrame:
    return arrange(df, keys, order, longest=longest).near(lag_columns(target, lags), back=max(lags))


def add_rolling(df: DataFrame, target: str = "consumption_kwh", sizes: Sequence[int] = WINDOWS,
                keys: Sequence[str] = (SERIES,), order: Sequence[str] = (TS,),
                include_current: bool = True, longest: int | None = None) -> DataFrame:
    steps, helpers = rolling_steps(target, sizes, include_current)
    return arrange(df, keys, order, longest=longest).near(steps, back=max(sizes), drop=helpers)


def add_lags_and_rolling(df: DataFrame, target: str = "consumption_kwh", keys: Sequence[str] = (SERIES,),
                         order: Sequence[str] = (TS,), longest: int | None = None) -> DataFrame:
    """Both families over one shuffle and one sort."""
    steps, helpers = rolling_steps(target)
    return arrange(df, keys, order, longest=longest).near(
        [lag_columns(target) | steps[0], *steps[1:]], back=max(*LAGS, *WINDOWS), drop=helpers
    )


def feature_matrix(df: DataFrame, spectrum: int = 5, keys: Sequence[str] = (SERIES,), longest: int | None = None) -> DataFrame:
    """Calendar, cyclical, lag, rolling, spectral and ratio columns; incomplete rows are dropped.

    The spectrum comes first: it needs only the target, and its join keeps the partitioning
    that the lag and rolling windows use.  Calendar columns depend on one row alone and are
    added last, to the rows that stay.
    """
    from wattline.operators.spectrum import add_spectrum

    made = add_spectrum(df, top=spectrum, keys=keys, longest=longest) if spectrum else df
    made = add_lags_and_rolling(made, keys=keys, longest=longest)
    return domain_ratios(cyclical_features(calendar_features(made.na.drop("any")))).na.drop("any")


def persistence(df: DataFrame, target: str, name: str, keys: Sequence[str] = (SERIES,),
                order: Sequence[str] = (TS,)) -> DataFrame:
    """The previous value as forecast; the first row forecasts itself."""
    return arrange(df, keys, order).near(
        {name: lambda w: F.coalesce(F.lag(target, 1).over(w), F.col(target))}, back=1
    )


def sequence_windows(df: DataFrame, columns: Sequence[str], target: str, length: int = 24,
                     keys: Sequence[str] = (SERIES,), order: Sequence[str] = (TS,)) -> DataFrame:
    """Each full run of ``length`` rows as an array of structs, with the target of the row after it."""
    def run(window: WindowSpec) -> Column:
        frame = window.rowsBetween(1 - length, 0)
        return F.when(F.count(F.lit(1)).over(frame) == length, F.collect_list(F.struct(*columns)).over(frame))

    made = arrange(df, keys, order).near(
        {"sequence": run, "next_target": lambda w: F.lead(target, 1).over(w)}, back=length, ahead=1
    )
    return made.filter(F.col("sequence").isNotNull() & F.col("next_target").isNotNull())


def min_max_parameters(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long table (column, min, max)."""
    wide = df.agg(*[F.min(c).alias(f"{c}_min") for c in columns], *[F.max(c).alias(f"{c}_max") for c in columns])
    lines = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"{c}_min").alias("min"), F.col(f"{c}_max").alias("max"))
        for c in columns
    ])
    return wide.select(F.inline(lines))


def normalize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - min) / (max - min + 1e-8) for each column, bounds from one aggregate."""
    bounds = df.agg(
        *[F.min(c).alias(f"{c}_min") for c in columns], *[F.max(c).alias(f"{c}_max") for c in columns]
    ).select(F.struct("*")).scalar()
    return df.withColumns({
        c: (F.col(c) - bounds[f"{c}_min"]) / (bounds[f"{c}_max"] - bounds[f"{c}_min"] + F.lit(1e-8))
        for c in columns
    })


def forecast_features(columns: Sequence[str]) -> list[str]:
    """Lag, rolling, calendar and weather columns, in that order."""
    calendar = ["hour", "day_of_week", "month", "is_weekend", "is_peak_hour",
                "hour_sin", "hour_cos", "month_sin", "month_cos"]
    picked = [c for c in columns if "lag" in c] + [c for c in columns if "roll" in c]
    return picked + [c for c in calendar + ["temperature", "humidity"] if c in columns]


# Inputs of the health classifier, used where present.
HEALTH_FEATURES = [
    "load_factor", "hour_sin", "hour_cos", "month_sin", "month_cos", "is_weekend", "is_peak_hour",
    "consumption_kwh_roll_mean_6h", "consumption_kwh_roll_std_6h",
    "consumption_kwh_roll_mean_12h", "consumption_kwh_roll_std_12h",
    "temperature", "humidity", "voltage",
]
EFFICIENCY_FEATURES = ["consumption_kwh", "load_factor", "voltage", "hour_sin", "hour_cos", "is_peak_hour"]


def health_features(df: DataFrame) -> list[str]:
    from wattline.sources.readings import measure_columns

    picked = [c for c in HEALTH_FEATURES if c in df.columns]
    if len(picked) >= 3:
        return picked
    return [c for c in measure_columns(df) if not any(w in c for w in ("anomaly", "forecast", "lag"))]
