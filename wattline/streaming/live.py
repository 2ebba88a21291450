"""Live readings as Structured Streaming: file source, resample, duplicates, cooldown, full batch cycle."""

from __future__ import annotations

import pickle
import threading
import time
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from wattline.sources.readings import ROW, SERIES, TS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_folder(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None,
                kind: str = "parquet") -> DataFrame:
    """New files of a folder as a stream; times are cast so that a watermark accepts them."""
    reader = spark.readStream.schema(schema).format(kind)
    if kind == "csv":
        reader = reader.option("header", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    stream = reader.load(path)
    return stream.withColumn(TS, F.col(TS).cast("timestamp")) if TS in stream.columns else stream


def resample_stream(stream: DataFrame, columns: Sequence[str], every: str = "1 hour", late: str = "2 hours",
                    keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """Mean per key and bin. A bin is emitted once, when the watermark has passed its end; later rows are dropped."""
    binned = stream.withWatermark(TS, late).groupBy(*keys, F.window(TS, every).alias("_w")).agg(
        *[F.avg(c).alias(c) for c in columns])
    return binned.select(*keys, F.col("_w.start").alias(TS), *columns)


def drop_repeats(stream: DataFrame, late: str = "2 hours", keys: Sequence[str] = (SERIES, TS)) -> DataFrame:
    """The first row of each key; keys are forgotten once the watermark has passed."""
    return stream.withWatermark(TS, late).dropDuplicatesWithinWatermark(list(keys))


class _InOrder(StatefulProcessor):
    """Rows wait in the state of their key until the watermark has passed them, and are then released in time order.

    Every chunk of new rows is reduced to few before it is stored, so that state grows with the different times within the
    allowed lateness and not with the rows. `kept` is one value per key; a key that has nothing to wait for and nothing to
    remember has no state.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, row binary")
        self.kept = handle.getValueState("kept", "value binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            found = self.reduced(frame)
            if found:
                self.waiting.appendList([(us, pickle.dumps(row)) for us, row in found])
                first = min([us for us, _ in found] + ([] if first is None else [first]))
        if first is not None:
            self._wake(first)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        found = sorted(self.waiting.get(), key=lambda x: x[0]) if self.waiting.exists() else []
        ready, rest = [x for x in found if x[0] < passed], [x for x in found if x[0] >= passed]
        if len(rest) < len(found):
            self.waiting.put(rest) if rest else self.waiting.clear()
        kept = pickle.loads(self.kept.get()[0]) if self.kept.exists() else None
        out, kept, until = self.released(key, [(us, pickle.loads(row)) for us, row in ready], kept, passed)
        self.kept.update((pickle.dumps(kept),)) if kept is not None else self.kept.clear()
        if rest:
            self._wake(rest[0][0])
        elif kept is not None and until is not None:
            self._wake(until)
        if out is not None and len(out):
            yield out

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(int(us) // 1000 + 1)

    def close(self) -> None:
        pass


_SLOTS = 256
_BLOCK = 1 << 18
_FEW = 16


def _first_from(us: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each sorted piece ``us[low:high]``, the first place with a time of at least ``least``, or ``high``."""
    low, high = low.copy(), high.copy()
    while len(open_ := np.flatnonzero(low < high)):
        middle = (low[open_] + high[open_]) // 2
        below = us[middle] < least[open_]
        low[open_] = np.where(below, middle + 1, low[open_])
        high[open_] = np.where(below, high[open_], middle)
    return low


def _starts_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where each key starts in sorted rows."""
    return np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[:len(a)])


def _firing(us: np.ndarray, low: np.ndarray, high: np.ndarray, gap: int) -> np.ndarray:
    """Places that fire in sorted pieces ``us[low:high]``, one for each key, of which the first time fires.

    All keys take their steps together; the last few are walked one by one.
    """
    found, at = [], low
    while len(at) > _FEW:
        found.append(at)
        at = _first_from(us, at + 1, high, us[at] + gap)
        at, high = at[at < high], high[at < high]
    for i, end in zip(at.tolist(), high.tolist(), strict=True):
        while i < end:
            found.append([i])
            i += 1 + int(np.searchsorted(us[i + 1:end], us[i] + gap))
    return np.concatenate([np.empty(0, "int64"), *found]).astype("int64")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key_a, key_b, event_us) as blocks of a slot, in order of key and time: each key once with the count of its times."""
    def packed(held: list) -> pa.RecordBatch:
        a, b, us = (np.concatenate(c) for c in zip(*held, strict=True))
        slots = b % _SLOTS
        order = np.lexsort((us, b, a, slots))
        a, b, us, slots = a[order], b[order], us[order], slots[order]
        low = _starts_of(a, b)
        counts = np.diff(np.append(low, len(a)))
        made, first = [], np.flatnonzero(np.append(True, slots[low[1:]] != slots[low[:-1]]))
        for i, j in zip(first, np.append(first[1:], len(low)), strict=True):
            end = low[j] if j < len(low) else len(a)
            made.append((int(slots[low[i]]), a[low[i:j]].tobytes(), b[low[i:j]].tobytes(), counts[i:j].tobytes(), us[low[i]:end].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(
            zip(*made, strict=True), [pa.int64(), *[pa.binary()] * 4], strict=True)], ["slot", "key_a", "key_b", "counts", "times"])

    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append([batch.column(c).to_numpy() for c in ("key_a", "key_b", "event_us")])
            rows += batch.num_rows
        if rows >= _BLOCK:
            yield packed(held)
            held, rows = [], 0
    if held:
        yield packed(held)


class _Cooldown(StatefulProcessor):
    """Which of the times that the watermark has passed fire, for a slot of many keys at once.

    Times come as blocks, and every later one is behind all of this batch. `fired` remembers when keys last fired, until
    their quiet time is over; a slot with nothing to remember has no state.
    """

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fired = handle.getValueState("fired", "cells binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self._known()
        parts = [known]
        for frame in rows:
            for a, b, counts, times in frame[["key_a", "key_b", "counts", "times"]].itertuples(index=False, name=None):
                counts = np.frombuffer(counts, "int64")
                ids = (np.repeat(np.frombuffer(x, "int64"), counts) for x in (a, b))
                parts.append(np.stack([*ids, np.frombuffer(times, "int64")]))
        a, b, us = np.concatenate(parts, axis=1)
        order = np.lexsort((us, b, a))
        a, b, us, old = a[order], b[order], us[order], order < known.shape[1]
        low = _starts_of(a, b)
        # the first time of a key that fired before is that alert, and it may fire again as such
        places = _firing(us, low, np.append(low[1:], len(us)), self.gap)
        newest = np.zeros(len(low), dtype="int64")
        np.maximum.at(newest, np.searchsorted(low, places, side="right") - 1, places)
        self._keep(np.stack([a[newest], b[newest], us[newest]]), timerValues)
        places = places[~old[places]]
        if len(places):
            made = pd.DataFrame({"key_a": a[places], "key_b": b[places]})
            made[TS] = pd.Series(us[places].astype("datetime64[us]")).dt.tz_localize("UTC")
            yield made

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._keep(self._known(), timerValues)
        yield from ()

    def _known(self) -> np.ndarray:
        stored = self.fired.get() if self.fired.exists() else None
        return np.frombuffer(stored[0], "int64").reshape(3, -1) if stored else np.empty((3, 0), "int64")

    def _keep(self, cells: np.ndarray, timerValues) -> None:
        """Remember the keys whose quiet time the watermark has not passed."""
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        cells = cells[:, cells[2] + self.gap > passed]
        if cells.shape[1]:
            self.fired.update((cells.tobytes(),))
            self.handle.registerTimer(int(cells[2].max() + self.gap) // 1000 + 1)
        else:
            self.fired.clear()

    def close(self) -> None:
        pass


def cooldown_stream(alerts: DataFrame, seconds: float = 300, keys: Sequence[str] = (SERIES, "rule"), row: str = ROW,
                    late: str = "2 hours") -> DataFrame:
    """Streaming form of the batch cooldown. Alerts may come in any order within the allowed lateness.

    Needs the RocksDB state store. An alert is decided when the watermark has passed it. Times and rows wait apart, both by
    key and time over all tasks, so that a frequent key is spread. Times that are due go, packed, to the slot of their key;
    the few that fire come back as marks to the rows, which the same watermark releases. Keys are 128 bits of hashes.
    """
    nulls = [F.isnull(k) for k in keys]  # a null alone leaves a hash as it is
    hashes = [F.xxhash64(*keys, *nulls).alias("key_a"), F.xxhash64(F.lit("second"), *keys, *nulls).alias("key_b")]
    timed = alerts.where(F.col(TS).isNotNull()).withWatermark(TS, late)  # no watermark would ever pass the others
    waiting = timed.select(*hashes, TS, F.struct(*alerts.columns).alias("row"), F.lit(False).alias("fires"))
    due = waiting.groupBy("key_a", "key_b", TS).agg(F.count(F.lit(1)))
    blocks = due.select("key_a", "key_b", F.unix_micros(TS).alias("event_us")).mapInArrow(
        _packed, "slot bigint, key_a binary, key_b binary, counts binary, times binary")
    marks = blocks.groupBy("slot").transformWithStateInPandas(
        statefulProcessor=_Cooldown(int(seconds * 1_000_000)), outputStructType=waiting.select("key_a", "key_b", TS).schema,
        outputMode="Append", timeMode="EventTime", eventTimeColumnName=TS)
    marks = marks.select("key_a", "key_b", TS, F.lit(None).cast(waiting.schema["row"].dataType).alias("row"), F.lit(True).alias("fires"))
    first = F.col(f"row.{row}")
    held = waiting.union(marks).groupBy("key_a", "key_b", TS).agg(
        F.min_by("row", F.struct("fires", F.isnull(first), first)).alias("row"), F.bool_or("fires").alias("fires"))
    return held.where("fires").select("row.*")


class _Grid(_InOrder):
    """Sums per bin wait; a bin released after another one brings the empty bins between them, with the last values."""

    def __init__(self, every: int, keys: list[str], columns: list[str]):
        self.every, self.keys, self.columns = every, keys, columns

    def reduced(self, frame: pd.DataFrame) -> list:
        bins = frame["event_us"] // self.every
        sums, counts = (frame[self.columns].astype("float64").groupby(bins).agg(how) for how in ("sum", "count"))
        # a bin is ready when the watermark has passed its end
        return [((int(n) + 1) * self.every - 1, (int(n), s, c)) for n, s, c in zip(
            sums.index, sums.to_numpy().tolist(), counts.to_numpy().tolist(), strict=True)]

    def released(self, key, ready: list, kept: tuple | None, passed: int) -> tuple:
        bins: dict[int, np.ndarray] = {}
        for _, (n, sums, counts) in ready:
            bins[n] = bins.get(n, 0) + np.array([sums, counts])
        last, values = kept or (None, [None] * len(self.columns))
        out = []
        for n in sorted(bins):
            out += [(*key, gap, *values) for gap in range(last + 1, n)] if last is not None else []
            sums, counts = bins[n]
            values = [float(s / c) if c else v for s, c, v in zip(sums, counts, values, strict=True)]
            out.append((*key, n, *values))
            last = n
        frame = pd.DataFrame(out, columns=[*self.keys, TS, *self.columns])
        frame[TS] = pd.to_datetime(frame[TS] * self.every, unit="us")
        return frame, (None if last is None else (last, values)), None


def grid_stream(stream: DataFrame, columns: Sequence[str], seconds: int = 3600, late: str = "2 hours",
                keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """Streaming form of the batch resample: every bin between a key's first and last one, empty bins filled forward.

    A bin is emitted when the watermark has passed its end, empty ones with the next bin that has rows. Rows may come in any
    order within the allowed lateness. Needs the RocksDB state store; one bin and its values are remembered for each key.
    """
    keys, columns = list(keys), list(columns)
    timed = stream.withWatermark(TS, late).select(*keys, TS, F.unix_micros(TS).alias("event_us"), *columns)
    schema = T.StructType([*[stream.schema[k] for k in keys], T.StructField(TS, T.TimestampType()),
                           *[T.StructField(c, T.DoubleType()) for c in columns]])
    return timed.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=_Grid(seconds * 1_000_000, keys, columns), outputStructType=schema, outputMode="Append", timeMode="EventTime")


class Counters(StreamingQueryListener):
    """Rows read, rows dropped as late, and observed metrics of every query, summed over all its batches.

    The listener sees every batch, where the progress that a query remembers is a list of bounded length.
    """

    def __init__(self):
        self.totals: dict[str, dict[str, int]] = {}
        self.ended: dict[str, threading.Event] = {}

    def _of(self, query_id) -> dict[str, int]:
        return self.totals.setdefault(str(query_id), {"rows_in": 0, "rows_late": 0})

    def onQueryStarted(self, event) -> None:
        self.ended.setdefault(str(event.runId), threading.Event())

    def onQueryProgress(self, event) -> None:
        progress, total = event.progress, self._of(event.progress.id)
        total["rows_in"] += progress.numInputRows
        total["rows_late"] += sum(op.numRowsDroppedByWatermark for op in progress.stateOperators)
        for metrics in progress.observedMetrics.values():
            for name, value in metrics.asDict().items():
                total[name] = total.get(name, 0) + (value or 0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.setdefault(str(event.runId), threading.Event()).set()

    def of(self, query: StreamingQuery, seconds: float = 60) -> dict[str, int]:
        """Totals of a query that has ended; events arrive a little after it."""
        self.ended.setdefault(str(query.runId), threading.Event()).wait(seconds)
        return self._of(query.id)


def observed(stream: DataFrame, name: str = "input", **metrics) -> DataFrame:
    """The stream with counted conditions, which the listener adds up."""
    return stream.observe(name, *[F.count_if(condition).alias(metric) for metric, condition in metrics.items()])


def write_once(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Process everything that is there now and stop; a restart with the same checkpoint goes on after it."""
    query = (stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start(out))
    query.awaitTermination()
    return query


def run_counted(stream: DataFrame, out: str, checkpoint: str) -> dict[str, int]:
    """Like :func:`write_once`, with the totals of the run: rows read, late rows, observed metrics."""
    counters, streams = Counters(), stream.sparkSession.streams
    streams.addListener(counters)
    try:
        return counters.of(write_once(stream, out, checkpoint))
    finally:
        streams.removeListener(counters)


STATUS_SCHEMA = ("batch_id bigint, pipeline_status string, error_code string, rows_in bigint, rows_processed bigint, "
                 "alerts bigint, seconds double")


def process_batches(stream: DataFrame, cycle: Callable[[DataFrame], tuple[DataFrame, DataFrame]], out: str, checkpoint: str,
                    kind: str = "smart_meter") -> StreamingQuery:
    """Per micro-batch: validate, run ``cycle`` (readings -> predictions, alerts), write both and a status row.

    Each batch owns the folder of its id and overwrites it, so a repeated batch leaves no
    duplicates.  An invalid batch writes only its status.
    """
    from wattline.operators.quality import classify_errors, validate

    def run(batch: DataFrame, batch_id: int) -> None:
        spark, begun = batch.sparkSession, time.time()
        batch = batch.persist()
        try:
            rows = batch.count()
            code = classify_errors(validate(batch, kind)).first()["error_code"] if rows else "OK"
            processed = fired = 0
            if rows and code == "OK":
                predictions, alerts = cycle(batch)
                for name, table in (("predictions", predictions), ("alerts", alerts)):
                    table.write.mode("overwrite").parquet(f"{out}/{name}/batch_id={batch_id}")
                processed = spark.read.parquet(f"{out}/predictions/batch_id={batch_id}").count()
                fired = spark.read.parquet(f"{out}/alerts/batch_id={batch_id}").count()
            state = "completed" if code == "OK" else "failed"
            line = (batch_id, state, code, rows, processed, fired, time.time() - begun)
            spark.createDataFrame([line], STATUS_SCHEMA).coalesce(1).write.mode("overwrite").parquet(
                f"{out}/status/part={batch_id}")
        finally:
            batch.unpersist()

    query = (stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return query


class OpenWindow:
    """Tables that a cycle carries from one micro-batch to the next, one version per batch id.

    `open` holds rows that later batches may still precede, `last` the last known values of each series, `fired` the last
    alert of each key. A batch reads the version before its own and overwrites its own, so that it can be repeated.
    """

    def __init__(self, spark: SparkSession, out: str):
        self.spark, self.path = spark, f"{out}/carried"

    def _folder(self, name: str, batch_id: int) -> str:
        return f"{self.path}/{name}/version={batch_id}"

    def read(self, name: str, batch_id: int, schema: T.StructType) -> DataFrame:
        if batch_id < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._folder(name, batch_id))

    def write(self, name: str, batch_id: int, table: DataFrame) -> None:
        table.write.mode("overwrite").parquet(self._folder(name, batch_id))


def live_cycle(stream: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, columns: Sequence[str],
               settings: Mapping | None = None, late_seconds: int = 7200, cooldown_seconds: float = 300) -> StreamingQuery:
    """Clean, score and alert over micro-batches with the rows of one batch run over all of them.

    Rows wait in the open window until no allowed row can precede them. They are then cleaned (first row per time, values
    carried forward, over batches too), scored, turned into alerts, and alerts pass the cooldown together with the last one
    of their key. Rows behind the closed time are late: counted in the status and dropped. What is still open after the
    last batch is worked on by :func:`finish_cycle`.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        _cycle(batch, batch_id, score, out, list(columns), settings, late_seconds, cooldown_seconds)

    query = (stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def finish_cycle(spark: SparkSession, schema: T.StructType, score, out: str, columns: Sequence[str], settings: Mapping | None = None,
                 cooldown_seconds: float = 300) -> None:
    """Close the open window when no more rows will come."""
    batches = spark.read.parquet(f"{out}/status").agg(F.max("batch_id")).first()[0]
    _cycle(spark.createDataFrame([], schema), batches + 1, score, out, list(columns), settings, None, cooldown_seconds)


CYCLE_STATUS = "batch_id bigint, rows_in bigint, rows_late bigint, rows_processed bigint, alerts bigint, closed_us bigint"


def _cycle(batch: DataFrame, batch_id: int, score, out: str, columns: list[str], settings, late_seconds: int | None,
           cooldown_seconds: float) -> None:
    from wattline.operators import rules
    from wattline.operators.clean import fill_gaps, first_per_time
    from wattline.operators.cooldown import apply_cooldown

    spark, carried = batch.sparkSession, OpenWindow(batch.sparkSession, out)
    before = spark.read.schema(CYCLE_STATUS).parquet(f"{out}/status/part={batch_id - 1}").first() if batch_id else None
    closed = before["closed_us"] if before else -(1 << 62)
    us, batch = F.unix_micros(TS), batch.persist()
    try:
        counts = batch.agg(F.count(F.lit(1)).alias("rows"), F.count_if(us < closed).alias("late"), F.max(us).alias("newest")).first()
        until = 1 << 62 if late_seconds is None else max(closed, (counts["newest"] or closed) - late_seconds * 1_000_000)
        rows = carried.read("open", batch_id - 1, batch.schema).unionByName(batch.where(us >= closed))
        carried.write("open", batch_id, rows.where(us >= until))

        flagged = T.StructType([*batch.schema.fields, T.StructField("_carried", T.BooleanType())])
        last = carried.read("last", batch_id - 1, flagged)
        filled = fill_gaps(last.unionByName(first_per_time(rows.where(us < until)).withColumn("_carried", F.lit(False))), columns, backward=False)
        carried.write("cleaned", batch_id, filled)
        filled = carried.read("cleaned", batch_id, flagged)
        rest = [c for c in batch.columns if c != SERIES]
        newest = filled.groupBy(SERIES).agg(F.max_by(F.struct(*rest), F.struct(TS, ROW)).alias("_r")).select(SERIES, "_r.*")
        carried.write("last", batch_id, newest.select(*batch.columns, F.lit(True).alias("_carried")))

        predictions = score(filled.where("NOT _carried").drop("_carried"))
        predictions.write.mode("overwrite").parquet(f"{out}/predictions/batch_id={batch_id}")
        predictions = spark.read.schema(predictions.schema).parquet(f"{out}/predictions/batch_id={batch_id}")
        alerts = rules.alerts(predictions, settings, with_data=False)
        kept = T.StructType([*alerts.schema.fields, T.StructField("_carried", T.BooleanType())])
        fired = apply_cooldown(carried.read("fired", batch_id - 1, kept).unionByName(alerts.withColumn("_carried", F.lit(False))), cooldown_seconds)
        carried.write("alerts", batch_id, fired)
        fired = carried.read("alerts", batch_id, kept)
        rest = [c for c in alerts.columns if c not in (SERIES, "rule")]
        latest = fired.groupBy(SERIES, "rule").agg(F.max_by(F.struct(*rest), TS).alias("_r")).select(SERIES, "rule", "_r.*")
        # a key whose quiet time is over has nothing to carry
        latest = latest.where(F.unix_micros(TS) + int(cooldown_seconds * 1_000_000) > until)
        carried.write("fired", batch_id, latest.select(*alerts.columns, F.lit(True).alias("_carried")))
        fired.where("NOT _carried").drop("_carried").write.mode("overwrite").parquet(f"{out}/alerts/batch_id={batch_id}")

        done = spark.read.parquet(f"{out}/predictions/batch_id={batch_id}").count()
        sent = spark.read.parquet(f"{out}/alerts/batch_id={batch_id}").count()
        line = (batch_id, counts["rows"], counts["late"], done, sent, until)
        spark.createDataFrame([line], CYCLE_STATUS).coalesce(1).write.mode("overwrite").parquet(f"{out}/status/part={batch_id}")
    finally:
        batch.unpersist()


def sync_status(spark: SparkSession, out: str) -> DataFrame:
    """One row per processed batch, with the running count of completed ones."""
    from wattline.operators.ordered import arrange

    status = spark.read.parquet(f"{out}/status").drop("part")
    counted = status.withColumn("_ok", (F.col("pipeline_status") == "completed").cast("bigint"))
    return arrange(counted, [], ["batch_id"]).running({"total_sync_count": ("sum", "_ok")}).drop("_ok")
