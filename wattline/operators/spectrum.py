"""Fourier features: the strongest frequencies of a series and their cosine columns.

A series that fits one task is transformed whole in a grouped function.  A longer one of
composite length n = a * b is transformed in two shuffles: b column transforms of length a,
a twiddle factor, then a row transforms of length b.  No task then holds more than
max(a, b) values.  A longer series without a usable split goes through the chirp form,
which turns it into a convolution of power-of-two length.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattline.operators.ordered import arrange, largest_group, lookup_join
from wattline.operators.quantile import quantiles
from wattline.session import materialize, rows_per_task
from wattline.sources.readings import SERIES, TS

KWH = "consumption_kwh"


def _signal(df: DataFrame, target: str, keys: list[str], order: Sequence[str]) -> DataFrame:
    """(keys, _i, _n, _v): positions, length and the value with gaps set to the series median."""
    slim = df.select(*keys, *order, F.col(target).cast("double").alias("_v"))
    middle = quantiles(slim, {"_mid": ("_v", 0.5)}, keys)
    placed = arrange(slim, keys, order).with_position_and_total("_i", "_n")
    placed = placed.join(middle, keys) if keys else placed.withColumn("_mid", middle.scalar())
    return placed.select(*keys, "_i", "_n", F.coalesce("_v", "_mid").alias("_v"))


def _head(df: DataFrame, keys: list[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return "".join(f"`{k}` {kinds[k]}, " for k in keys)


def _strongest(keys: list[str], order: list[str], top: int, drop_dc: bool):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        signal = pdf.sort_values(order)["_v"]
        values = signal.fillna(signal.median()).to_numpy()
        size = np.abs(np.fft.rfft(values))
        first = 1 if drop_dc else 0
        best = np.lexsort((np.arange(first, len(size)), -size[first:]))[:top] + first
        out = pd.DataFrame({"rank": np.arange(1, len(best) + 1), "frequency": best, "magnitude": size[best]})
        out["length"] = len(values)
        for key in keys:
            out[key] = pdf[key].iloc[0]
        return out[[*keys, "rank", "frequency", "magnitude", "length"]]
    return build


def top_frequencies(df: DataFrame, top: int = 5, target: str = KWH, keys: Sequence[str] = (SERIES,),
                    order: Sequence[str] = (TS,), drop_dc: bool = False, limit: int | None = None,
                    longest: int | None = None) -> DataFrame:
    """(keys, rank, frequency, magnitude, length) of the strongest bins; equal sizes favour the lower bin."""
    keys, order, limit = list(keys), list(order), limit or rows_per_task(df.sparkSession)
    if not keys:
        one = df.withColumn("_one", F.lit(0))
        return top_frequencies(one, top, target, ["_one"], order, drop_dc, limit, longest).drop("_one")
    schema = _head(df, keys) + "rank int, frequency bigint, magnitude double, length bigint"
    if (largest_group(df, keys) if longest is None else longest) <= limit:
        slim = df.select(*keys, *order, F.col(target).cast("double").alias("_v"))
        return slim.groupBy(*keys).applyInPandas(_strongest(keys, order, top, drop_dc), schema)
    signal = materialize(_signal(df, target, keys, order), "signal")
    small = signal.filter(F.col("_n") <= limit).groupBy(*keys).applyInPandas(_strongest(keys, ["_i"], top, drop_dc), schema)
    bins = long_transform(signal.filter(F.col("_n") > limit), keys, limit)
    bins = bins.filter((F.col("_k") <= F.floor(F.col("_n") / 2)) & (F.col("_k") >= (1 if drop_dc else 0)))
    size = F.sqrt(F.col("_re") * F.col("_re") + F.col("_im") * F.col("_im"))
    best = _best_per_key(bins.withColumn("magnitude", size), top, keys)
    return small.unionByName(best.select(
        *keys, F.col("_r").cast("int").alias("rank"), F.col("_k").alias("frequency"), "magnitude",
        F.col("_n").alias("length")))


def _best_per_key(bins: DataFrame, top: int, keys: list[str]) -> DataFrame:
    """Salted top-k: each (key, salt) keeps ``top`` rows before the key is brought together."""
    order = [F.col("magnitude").desc(), F.col("_k")]
    salted = bins.withColumn("_salt", F.col("_k") % bins.sparkSession.sparkContext.defaultParallelism)
    near = Window.partitionBy(*keys, "_salt").orderBy(*order)
    kept = salted.withColumn("_r", F.row_number().over(near)).filter(F.col("_r") <= top)
    return kept.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_r") <= top)


def _plan(n: int, limit: int) -> tuple[int, int]:
    """(length to transform, its first factor): n itself if two factors fit a task, else a padded power of two."""
    for a in range(math.isqrt(n), 1, -1):
        if n % a == 0:
            if n // a <= limit:
                return n, a
            break
    m = 1 << (2 * n - 1).bit_length()
    return m, 1 << (m.bit_length() - 1) // 2


def _lengths(signal: DataFrame, limit: int) -> DataFrame:
    """(_n, _m, _a) for each distinct length."""
    def plan(batches):
        for pdf in batches:
            made = [_plan(int(n), limit) for n in pdf["_n"]]
            yield pd.DataFrame({"_n": pdf["_n"], "_m": [m for m, _ in made], "_a": [a for _, a in made]})

    return signal.select("_n").distinct().mapInPandas(plan, "_n bigint, _m bigint, _a bigint")


def long_transform(signal: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """(keys, _n, _k, _re, _im) for real signals too long for one task."""
    lengths = materialize(_lengths(signal, limit), "lengths")
    planned = signal.join(lengths, "_n").select(
        *keys, "_n", "_m", "_a", "_i", F.col("_v").alias("_re"), F.lit(0.0).alias("_im"))
    direct = _two_step(planned.filter(F.col("_m") == F.col("_n")), keys)
    padded = _chirp(planned.filter(F.col("_m") != F.col("_n")), lengths.filter(F.col("_m") != F.col("_n")), keys)
    return direct.select(*keys, "_n", "_k", "_re", "_im").unionByName(padded)


_CARRIED = ["_n", "_m", "_a"]
_CARRIED_SCHEMA = "_n bigint, _m bigint, _a bigint, "


def _two_step(part: DataFrame, keys: list[str], sign: int = -1) -> DataFrame:
    """Transform of length m = a * b: index i = b*i1 + i2, frequency k = k1 + a*k2."""
    head = _head(part, keys) + _CARRIED_SCHEMA

    def transform(pdf):
        values = pdf["_re"].to_numpy() + 1j * pdf["_im"].to_numpy()
        return np.fft.fft(values) if sign < 0 else np.fft.ifft(values) * len(values)

    def labelled(made, pdf, last):
        for name in [*keys, *_CARRIED]:
            made[name] = pdf[name].iloc[0]
        return made[[*keys, *_CARRIED, *last]]

    def columns(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i1")
        m, a, i2 = (int(pdf[c].iloc[0]) for c in ("_m", "_a", "_i2"))
        k1 = np.arange(a)
        out = transform(pdf) * np.exp(sign * 2j * np.pi * ((i2 * k1) % m) / m)
        return labelled(pd.DataFrame({"_k1": k1, "_i2": i2, "_re": out.real, "_im": out.imag}), pdf, ["_k1", "_i2", "_re", "_im"])

    def rows(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i2")
        a, k1 = int(pdf["_a"].iloc[0]), int(pdf["_k1"].iloc[0])
        out = transform(pdf)
        return labelled(pd.DataFrame({"_k": k1 + a * np.arange(len(out)), "_re": out.real, "_im": out.imag}), pdf, ["_k", "_re", "_im"])

    b = F.col("_m") / F.col("_a")
    laid = part.select(*keys, *_CARRIED, F.floor(F.col("_i") / b).alias("_i1"), F.pmod(F.col("_i"), b.cast("bigint")).alias("_i2"), "_re", "_im")
    half = laid.groupBy(*keys, "_i2").applyInPandas(columns, head + "_k1 bigint, _i2 bigint, _re double, _im double")
    return half.groupBy(*keys, "_k1").applyInPandas(rows, head + "_k bigint, _re double, _im double")


def _turned(re, im, angle):
    return re * F.cos(angle) - im * F.sin(angle), re * F.sin(angle) + im * F.cos(angle)


def _chirp(part: DataFrame, lengths: DataFrame, keys: list[str]) -> DataFrame:
    """Length without a usable divisor: X_k = w_k * sum_i (x_i w_i) / w_(k-i), w_i = exp(-pi j i^2 / n).

    The sum is a convolution of padded length m, done by three transforms of that length.
    """
    n, m = F.col("_n"), F.col("_m")

    def angle(i, sign):
        # i*i mod 2n keeps the angle small and exact for any position below 2^31
        return F.lit(sign * math.pi) / n * F.pmod(i * i, 2 * n)

    def every_place(table: DataFrame, names: list[str]) -> DataFrame:
        """Rows 0..m-1 per line of ``table``, made in a blocks so that no array holds them all."""
        width = (m / F.col("_a")).cast("bigint")
        blocks = table.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_a") - 1)))
        return blocks.select(*names, F.explode(F.sequence(F.col("_block") * width, (F.col("_block") + 1) * width - 1)).alias("_i"))

    re, im = _turned(F.col("_re"), F.col("_im"), angle(F.col("_i"), -1))
    weighted = part.select(*keys, "_i", re.alias("_re"), im.alias("_im"))
    grid = every_place(part.select(*keys, *_CARRIED).distinct(), [*keys, *_CARRIED])
    padded = grid.join(weighted, [*keys, "_i"], "left").na.fill(0.0, ["_re", "_im"])
    shift = F.least(F.col("_i"), m - F.col("_i"))
    kernel = every_place(lengths, _CARRIED).select(
        *_CARRIED, "_i", F.when(shift < n, F.cos(angle(shift, 1))).otherwise(0.0).alias("_re"),
        F.when(shift < n, F.sin(angle(shift, 1))).otherwise(0.0).alias("_im")).withColumn("_length", n)
    right = _two_step(kernel, ["_length"]).select("_n", "_k", F.col("_re").alias("_kr"), F.col("_im").alias("_ki"))
    product = _two_step(padded, keys).join(right, ["_n", "_k"]).select(
        *keys, *_CARRIED, F.col("_k").alias("_i"),
        (F.col("_re") * F.col("_kr") - F.col("_im") * F.col("_ki")).alias("_re"),
        (F.col("_re") * F.col("_ki") + F.col("_im") * F.col("_kr")).alias("_im"))
    back = _two_step(product, keys, sign=1).filter(F.col("_k") < n)
    re, im = _turned(F.col("_re") / m, F.col("_im") / m, angle(F.col("_k"), -1))
    return back.select(*keys, "_n", "_k", re.alias("_re"), im.alias("_im"))


def add_spectrum(df: DataFrame, top: int = 5, target: str = KWH, keys: Sequence[str] = (SERIES,),
                 order: Sequence[str] = (TS,), drop_dc: bool = False, longest: int | None = None) -> DataFrame:
    """``fft_component_i`` = cos(2 pi k_i position / length) for the strongest bins k_i of each series."""
    keys = list(keys)
    found = top_frequencies(df, top, target, keys, order, drop_dc, longest=longest)
    wide = found.groupBy(*keys).agg(
        F.max("length").alias("_len"),
        *[F.max(F.when(F.col("rank") == r, F.col("frequency"))).alias(f"_k{r}") for r in range(1, top + 1)])
    ordered = arrange(df, keys, order, longest=longest)
    placed = ordered.with_position("_i")
    if ordered.is_cut:
        joined = lookup_join(placed, materialize(wide, "spectrum"), keys, "_len", ordered.piece)
    else:
        joined = placed.join(wide, keys)
    turn = F.lit(2 * math.pi) * F.col("_i") / F.col("_len")
    made = joined.withColumns({f"fft_component_{r}": F.cos(turn * F.col(f"_k{r}")) for r in range(1, top + 1)})
    return made.drop("_i", "_len", *[f"_k{r}" for r in range(1, top + 1)])
