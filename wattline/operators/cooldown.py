"""Greedy cooldown: an alert fires only if its rule has been quiet for a given time.

Whether an alert fires depends on the last one that *fired*, not the last one seen, so a
lag cannot decide it.  The work is cut into time chunks that run in parallel:

1. per chunk, a step function from "earliest time allowed to fire" to the same value after
   the chunk (steps that lead to the same end are merged, and chains merge quickly);
2. the functions of 64 neighbouring chunks become one function, and so on in rounds until a key
   has one; its steps are never more than those of the first chunk and one. From the top down each
   group then gives its members their start values, so that no task holds all chunks of a key;
3. per chunk, the firing times follow from the start value.

Rows of the same key and time are reduced to one before any of this, so a chunk holds
distinct times only and its size is bounded by the clock resolution, not by the row count.
While every key has few times, one SQL fold per key does the same without Python. Alerts are written
once before the count that decides this.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.operators.ordered import largest_group
from wattline.session import materialize, rows_per_task
from wattline.sources.readings import ROW, SERIES, TS

_GAPS_PER_CHUNK = 64
_CHUNKS_PER_GROUP = 64
_FOLD_TIMES = 4096
_NEVER = np.iinfo(np.int64).min


def _ends(times: np.ndarray, gap: int) -> np.ndarray:
    """For each time, the last time that fires if the chain starts there."""
    n = len(times)
    step = np.append(np.searchsorted(times, times + gap), n)
    last = np.where(step[:n] == n, np.arange(n), step[:n])
    while True:
        further = last[last]
        if np.array_equal(further, last):
            return times[last]
        last = further


def _chunk_function(gap: int, span: int, keys: list[str]):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(pdf["_us"].to_numpy())
        chunk = int(pdf["_chunk"].iloc[0])
        open_until = chunk * span + gap
        count = min(len(times), int(np.searchsorted(times, open_until)) + 1)
        upto, after = times[:count], _ends(times, gap)[:count] + gap
        keep = np.append(after[1:] != after[:-1], True)
        out = pd.DataFrame({"_chunk": chunk, "_upto": upto[keep], "_after": after[keep]})
        for key in keys:
            out[key] = pdf[key].iloc[0]
        return out[[*keys, "_chunk", "_upto", "_after"]]
    return build


def _through(functions: list[tuple[np.ndarray, np.ndarray]], allowed: np.ndarray) -> np.ndarray:
    """The values after all functions, for each start value."""
    for upto, after in functions:
        at = np.searchsorted(upto, allowed)
        allowed = np.where(at < len(upto), after[np.minimum(at, len(upto) - 1)], allowed)
    return allowed


def _functions(pdf: pd.DataFrame) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    pdf = pdf.sort_values(["_chunk", "_upto"])
    chunks, starts = np.unique(pdf["_chunk"].to_numpy(), return_index=True)
    return chunks, list(zip(np.split(pdf["_upto"].to_numpy(), starts[1:]), np.split(pdf["_after"].to_numpy(), starts[1:])))


def _compose(keys: list[str]):
    """One function of a group of neighbouring chunks."""
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        _, (first, *rest) = _functions(pdf)
        upto, after = first[0], _through(rest, first[1])
        if rest and rest[0][0][0] > upto[-1]:  # a start after all times of the first chunk comes before those of the next
            upto = np.append(upto, rest[0][0][0])
            after = np.append(after, _through(rest, rest[0][0][:1]))
        keep = np.append(after[1:] != after[:-1], True)
        out = pd.DataFrame({"_chunk": int(pdf["_group"].iloc[0]), "_upto": upto[keep], "_after": after[keep]})
        for key in keys:
            out[key] = pdf[key].iloc[0]
        return out[[*keys, "_chunk", "_upto", "_after"]]
    return build


def _starts(keys: list[str]):
    """The start value of each chunk of a group, from that of the group."""
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        chunks, functions = _functions(pdf)
        allowed, begin = np.array([pdf["_allowed"].iloc[0]], dtype="int64"), []
        for function in functions:
            begin.append(int(allowed[0]))
            allowed = _through([function], allowed)
        out = pd.DataFrame({"_chunk": chunks, "_allowed": np.array(begin, dtype="int64")})
        for key in keys:
            out[key] = pdf[key].iloc[0]
        return out[[*keys, "_chunk", "_allowed"]]
    return build


def _fire(gap: int, keys: list[str]):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(pdf["_us"].to_numpy())
        i, fired = int(np.searchsorted(times, pdf["_allowed"].iloc[0])), []
        while i < len(times):
            fired.append(times[i])
            i = int(np.searchsorted(times, times[i] + gap))
        out = pd.DataFrame({"_us": np.array(fired, dtype="int64")})
        for key in keys:
            out[key] = pdf[key].iloc[0]
        return out[[*keys, "_us"]]
    return build


def apply_cooldown(alerts: DataFrame, seconds: float = 300, keys: Sequence[str] = (SERIES, "rule"),
                   ts: str = TS, row: str = ROW) -> DataFrame:
    """Alerts that fire when each key must stay quiet ``seconds`` after it fired, by event time.

    Of several alerts of a key at one time only the one with the lowest row id can fire.
    """
    keys, gap = list(keys), int(seconds * 1_000_000)
    rest = [c for c in alerts.columns if c not in (*keys, ts)]
    single = alerts.groupBy(*keys, ts).agg(F.min_by(F.struct(*rest), F.col(row)).alias("_row"))
    single = materialize(single.withColumn("_us", F.unix_micros(ts)), "alerts-per-time")  # the rules run once
    if largest_group(single, keys) <= min(_FOLD_TIMES, rows_per_task(alerts.sparkSession)):
        rows = F.collect_list(F.struct("_us", ts, "_row"))
        if any(isinstance(f.dataType, T.MapType) for f in alerts.schema.fields):  # maps have no order
            rows = F.array_sort(rows, lambda a, b: F.signum(a["_us"] - b["_us"]).cast("int"))
        else:
            rows = F.sort_array(rows)
        lists = single.groupBy(*keys).agg(rows.alias("_all"))
        kept = lists.select(*keys, F.explode(_fold(F.col("_all"), gap)).alias("_kept"))
        return kept.select(*keys, f"_kept.{ts}", "_kept._row.*").select(*alerts.columns)
    fired = _by_chunks(alerts, single, keys, gap)
    return single.join(fired, [*keys, "_us"]).select(*keys, ts, "_row.*").select(*alerts.columns)


def _fold(rows, gap: int):
    """Walk rows in time order, keeping those at least ``gap`` after the last one kept."""
    def step(kept, row):
        quiet = row["_us"] - F.element_at(kept, -1)["_us"] >= gap
        return F.when(quiet, F.concat(kept, F.array(row))).otherwise(kept)

    return F.aggregate(F.slice(rows, 2, F.size(rows)), F.slice(rows, 1, 1), step)


def _by_chunks(alerts: DataFrame, single: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """(keys, _us) of the alerts that fire, over parallel time chunks."""
    span = gap * _GAPS_PER_CHUNK
    width = int(alerts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    times = single.select(*keys, "_us", F.floor(F.col("_us") / F.lit(span)).alias("_chunk"))
    times = times.repartition(width, *keys, "_chunk")
    kinds = {f.name: f.dataType.simpleString() for f in alerts.schema.fields}
    head = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    schema = f"{head}, _chunk bigint, _upto bigint, _after bigint"
    group = F.floor(F.col("_chunk") / F.lit(_CHUNKS_PER_GROUP))
    levels = [materialize(times.groupBy(*keys, "_chunk").applyInPandas(_chunk_function(gap, span, keys), schema), "cooldown-steps")]
    ends = times.agg(F.min("_chunk").alias("low"), F.max("_chunk").alias("high")).first()
    low, high = ends["low"] or 0, ends["high"] or 0
    while low != high:  # a round for each power of 64 of the chunks from the first to the last
        low, high = low // _CHUNKS_PER_GROUP, high // _CHUNKS_PER_GROUP
        above = levels[-1].withColumn("_group", group).groupBy(*keys, "_group").applyInPandas(_compose(keys), schema)
        levels.append(materialize(above, "cooldown-steps"))
    begin = levels.pop().select(*keys, "_chunk").distinct().withColumn("_allowed", F.lit(_NEVER).cast("bigint"))
    for steps in reversed(levels):
        known = steps.withColumn("_group", group).join(begin.withColumnRenamed("_chunk", "_group"), [*keys, "_group"])
        begin = known.groupBy(*keys, "_group").applyInPandas(_starts(keys), f"{head}, _chunk bigint, _allowed bigint")
    return times.join(begin, [*keys, "_chunk"]).groupBy(*keys, "_chunk").applyInPandas(
        _fire(gap, keys), f"{head}, _us bigint")
