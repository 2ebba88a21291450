"""Streams run to completion over files made from the event table; results must equal the batch form."""

from contextlib import contextmanager

from pyspark.sql import functions as F

from wattline.operators import rules
from wattline.operators.clean import clean
from wattline.operators.quantile import quantiles
from wattline.plans.catalogue import READINGS, RESAMPLED, SCORED, query, score_rows, scored
from wattline.plans.queries_readmodels import SETTINGS, _ALERTS, _cooldown_sql
from wattline.session import materialize, scratch_path
from wattline.sources.readings import readings
from wattline.streaming import live

KWH = "consumption_kwh"
FILES = 3
WRITERS = 4
ARRIVAL = (1, 0, 3, 2)
AHEAD = 400 * 86_400
STATE_ROWS = 250_000  # of a partition of state; each costs some files per batch
LEAST_STATES = 8


def _in_time_order(spark, table, label):
    """Write a table as files that arrive in time order, `WRITERS` files per third of the time span."""
    path = scratch_path(spark, label)
    first, last = table.agg(F.min("ts").cast("double"), F.max("ts").cast("double")).first()
    part = F.least(F.lit(FILES - 1), F.floor((F.col("ts").cast("double") - first) / (last - first) * FILES))
    for i in range(FILES):
        table.filter(part == i).repartition(WRITERS).write.mode("append").parquet(path)
    return path


def _out_of_order(spark, table, label, copies=False):
    """Write a table as quarters of its time span that arrive in the order `ARRIVAL`, and the lateness that allows it.

    With `copies`, every row comes again with the next quarter.
    """
    path = scratch_path(spark, label)
    first, last = table.agg(F.min("ts").cast("double"), F.max("ts").cast("double")).first()
    part = F.least(F.lit(len(ARRIVAL) - 1), F.floor((F.col("ts").cast("double") - first) / (last - first) * len(ARRIVAL)))
    for i, now in enumerate(ARRIVAL):
        table.filter(part.isin([now, *ARRIVAL[max(0, i - 1):i]] if copies else [now])).repartition(WRITERS).write.mode("append").parquet(path)
    return path, int((last - first) / len(ARRIVAL) * 3) + 1


def _closed(spark, table, path, **marks):
    """A last file with one row far ahead, after which the watermark has passed every other row."""
    newest = table.agg(F.max("ts").cast("double")).first()[0]
    cells = {"ts": F.timestamp_seconds(F.lit(newest + AHEAD)), **{k: F.lit(v) for k, v in marks.items()}}
    spark.range(1).select(*[cells.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema.fields]).write.mode(
        "append").parquet(path)


@contextmanager
def _rocksdb(spark, rows=None):
    """The store of stateful streams; with the number of rows that may wait, no more partitions of state than these need."""
    keys = {"spark.sql.streaming.stateStore.providerClass": live.ROCKSDB}
    if rows is not None:
        width = "spark.sql.shuffle.partitions"
        keys[width] = str(min(int(spark.conf.get(width)), max(LEAST_STATES, -(-rows // STATE_ROWS))))
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _run(spark, stream, label):
    out = scratch_path(spark, f"{label}-out")
    live.write_once(stream, out, scratch_path(spark, f"{label}-checkpoint"))
    return spark.read.schema(stream.schema).parquet(out)


@query("M1_incremental_file_stream", f"""
WITH {READINGS} SELECT row_id, series_id, ts, consumption_kwh FROM rd
""", floats="consumption_kwh", times="ts")
def _(spark, folder):
    table = readings(spark, folder).select("row_id", "series_id", "ts", KWH)
    path = _in_time_order(spark, table, "stream-in")
    return _run(spark, live.read_folder(spark, path, table.schema, WRITERS), "stream")


@query("M2_restart_continues", f"""
WITH {READINGS} SELECT row_id, consumption_kwh FROM rd
""", floats="consumption_kwh")
def _(spark, folder):
    table = readings(spark, folder).select("row_id", "ts", KWH)
    path, out, checkpoint = (scratch_path(spark, f"restart-{n}") for n in ("in", "out", "checkpoint"))
    for part in (0, 1):  # the second run starts after the files of the first
        table.filter(F.col("row_id") % 2 == part).write.mode("append").parquet(path)
        live.write_once(live.read_folder(spark, path, table.schema), out, checkpoint)
    return spark.read.parquet(out).select("row_id", KWH)


@query("M3_batch_cycle_alerts", f"""
WITH {SCORED}, {_ALERTS} SELECT row_id, rule, severity, message FROM al
""")
def _(spark, folder):
    table = scored(spark, folder)
    path, out = _in_time_order(spark, table, "cycle-in"), scratch_path(spark, "cycle-out")

    def cycle(batch):
        return batch, rules.alerts(batch, SETTINGS, with_data=False)

    live.process_batches(live.read_folder(spark, path, table.schema, WRITERS), cycle, out, scratch_path(spark, "cycle-checkpoint"))
    return spark.read.parquet(f"{out}/alerts").select("row_id", "rule", "severity", "message")


@query("A6_live_folder_cycle", f"""
WITH {READINGS} SELECT count(*) AS rows, sum(consumption_kwh) AS total FROM rd
""", floats="total", digits=2)
def _(spark, folder):
    table = readings(spark, folder).select("row_id", "series_id", "ts", KWH, "load_factor")
    path, out = _in_time_order(spark, table, "folder-in"), scratch_path(spark, "folder-out")

    def cycle(batch):
        return clean(batch.withColumn("voltage", F.lit(230.0))), rules.alerts(batch, {**SETTINGS, "alert_consumption_threshold": 400.0}, with_data=False)

    live.process_batches(live.read_folder(spark, path, table.schema, WRITERS), cycle, out, scratch_path(spark, "folder-checkpoint"))
    done = spark.read.parquet(f"{out}/predictions")
    kept = done.join(table.select("row_id", F.col(KWH).alias("raw")), "row_id")
    return kept.agg(F.count(F.lit(1)).alias("rows"), F.sum("raw").alias("total"))


@query("A7_sync_status", f"""
WITH {READINGS}, b AS (SELECT epoch_us(min(ts)) / 1000000.0 AS a, epoch_us(max(ts)) / 1000000.0 AS z FROM rd),
p AS (SELECT CAST(least(2, floor((epoch_us(ts) / 1000000.0 - a) / (z - a) * 3)) AS BIGINT) AS batch_id, consumption_kwh FROM rd, b)
SELECT batch_id, 'completed' AS pipeline_status, 'OK' AS error_code, count(*) AS rows_in, count(*) AS rows_processed,
  count(*) FILTER (WHERE consumption_kwh > 200) AS alerts, batch_id + 1 AS total_sync_count FROM p GROUP BY 1
""")
def _(spark, folder):
    table = readings(spark, folder).select("row_id", "series_id", "ts", KWH)
    path, out = _in_time_order(spark, table, "status-in"), scratch_path(spark, "status-out")

    def cycle(batch):
        return batch, rules.alerts(batch, SETTINGS, with_data=False)

    live.process_batches(live.read_folder(spark, path, table.schema, WRITERS), cycle, out, scratch_path(spark, "status-checkpoint"))
    return live.sync_status(spark, out).drop("seconds")


@query("M4_streaming_resample", f"""
WITH {READINGS} SELECT series_id, date_trunc('hour', ts) AS ts, avg(consumption_kwh) AS consumption_kwh FROM rd
GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM rd) - INTERVAL 2 HOUR
""", floats="consumption_kwh", times="ts")
def _(spark, folder):
    table = readings(spark, folder).select("series_id", "ts", KWH)
    path = _in_time_order(spark, table, "bins-in")
    return _run(spark, live.resample_stream(live.read_folder(spark, path, table.schema, WRITERS), [KWH]), "bins")


@query("M5_streaming_duplicates", f"""
WITH {READINGS} SELECT series_id, ts, consumption_kwh FROM rd
""", floats="consumption_kwh", times="ts")
def _(spark, folder):
    table = readings(spark, folder).select("series_id", "ts", KWH)
    path = _in_time_order(spark, table.unionByName(table), "twice-in")
    return _run(spark, live.drop_repeats(live.read_folder(spark, path, table.schema, WRITERS)), "twice")


def _cooled(spark, folder, seconds, keys):
    alerts = materialize(rules.alerts(scored(spark, folder), SETTINGS, with_data=False), "alerts")  # the rules run once
    path, late = _out_of_order(spark, alerts, "alerts-in")
    _closed(spark, alerts, path, series_id=-1, rule="close", row_id=-1)
    with _rocksdb(spark, alerts.count()):
        stream = live.cooldown_stream(live.read_folder(spark, path, alerts.schema, WRITERS), seconds, keys, late=f"{late} seconds")
        return _run(spark, stream, "alerts").where("rule <> 'close'").select(*keys, "row_id", "ts")


@query("M6_streaming_cooldown", f"WITH {_cooldown_sql(['rule'], 3600)}", times="ts")
def _(spark, folder):
    """Alerts come out of order over files; each is decided when the watermark has passed it."""
    return _cooled(spark, folder, 3600, ["rule"])


@query("M6_streaming_cooldown_per_series", f"WITH {_cooldown_sql(['series_id', 'rule'], 172800)}", times="ts")
def _(spark, folder):
    return _cooled(spark, folder, 172_800, ["series_id", "rule"])


@query("M4_streaming_grid", f"WITH {RESAMPLED} SELECT * FROM rs", floats="consumption_kwh voltage load_factor temperature", times="ts")
def _(spark, folder):
    """The batch resample as a stream over files out of order: empty bins, filled forward, none withheld."""
    columns = [KWH, "voltage", "load_factor", "temperature"]
    table = readings(spark, folder).select("series_id", "ts", *columns)
    path, late = _out_of_order(spark, table, "grid-in")
    _closed(spark, table, path, series_id=-1)
    with _rocksdb(spark):
        stream = live.grid_stream(live.read_folder(spark, path, table.schema, WRITERS), columns, late=f"{late} seconds")
        return _run(spark, stream, "grid").where("series_id >= 0")


@query("M5_repeats_across_batches", f"""
WITH {READINGS} SELECT series_id, ts, min(consumption_kwh) = max(consumption_kwh) AS same, count(*) > 0 AS held FROM rd GROUP BY 1, 2
""", times="ts")
def _(spark, folder):
    """Every row comes again in a later file, out of order: only the state knows that it was seen."""
    table = readings(spark, folder).select("series_id", "ts", KWH)
    path, late = _out_of_order(spark, table, "again-in", copies=True)
    done = _run(spark, live.drop_repeats(live.read_folder(spark, path, table.schema, WRITERS), f"{late} seconds"), "again")
    raw = table.groupBy("series_id", "ts").agg((F.min(KWH) == F.max(KWH)).alias("same"))
    return done.groupBy("series_id", "ts").agg((F.count(F.lit(1)) == 1).alias("held")).join(raw, ["series_id", "ts"])


# the live cycle: first row per time, voltage carried forward, fixed scores, alerts
_LIVE = SCORED.replace("sc AS (", """live AS (
  SELECT row_id, series_id, ts, consumption_kwh, load_factor, temperature, status,
    last_value(voltage IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts, row_id ROWS UNBOUNDED PRECEDING) AS voltage
  FROM (SELECT * FROM rd QUALIFY row_number() OVER (PARTITION BY series_id, ts ORDER BY row_id) = 1)),
sc AS (""").replace("FROM rd, q85)", "FROM live, q85)")


def _live_cycle(spark, folder):
    """Run the cycle over files out of order in which every row comes twice; the folder with its results."""
    table = readings(spark, folder)
    high = quantiles(table, {"q": (KWH, 0.85)}).first()["q"]
    path, late = _out_of_order(spark, table, "live-in", copies=True)
    out, columns = scratch_path(spark, "live-out"), ["voltage"]
    score = lambda rows: score_rows(rows, F.lit(high))
    stream = live.read_folder(spark, path, table.schema, WRITERS)
    live.live_cycle(stream, score, out, scratch_path(spark, "live-checkpoint"), columns, SETTINGS, late, 3600)
    live.finish_cycle(spark, stream.schema, score, out, columns, SETTINGS, 3600)
    return out


@query("M3_live_cycle_alerts", f"""
SELECT a.series_id, a.rule, al.severity, al.message, a.row_id, a.ts FROM (WITH {_cooldown_sql(['series_id', 'rule'], 3600).replace(SCORED, _LIVE)}) a
JOIN (WITH {_LIVE}, {_ALERTS} SELECT * FROM al) al ON a.row_id = al.row_id AND a.rule = al.rule
""", times="ts")
def _(spark, folder):
    """Cleaned, scored, alerts after the cooldown: over batches what one run over all rows gives."""
    alerts = spark.read.parquet(f"{_live_cycle(spark, folder)}/alerts")
    return alerts.select("series_id", "rule", "severity", "message", "row_id", "ts")


@query("A6_live_cleaned_values", f"""
WITH {_LIVE} SELECT row_id, series_id, ts, consumption_kwh, voltage, health_status, anomaly_flag FROM sc
""", floats="consumption_kwh voltage", ints="anomaly_flag", times="ts")
def _(spark, folder):
    done = spark.read.parquet(f"{_live_cycle(spark, folder)}/predictions")
    return done.select("row_id", "series_id", "ts", KWH, "voltage", "health_status", "anomaly_flag")


@query("M7_late_rows_status", f"""
WITH {READINGS}, b AS (SELECT min(ts) AS a, max(ts) AS z, min(ts) + (max(ts) - min(ts)) / 2 AS m FROM rd),
late AS (SELECT * FROM rd, b WHERE ts < m AND row_id % 10 = 0),
bins AS (SELECT DISTINCT series_id, date_trunc('hour', ts) FROM rd, b WHERE NOT (ts < m AND row_id % 10 = 0))
SELECT (SELECT count(*) FROM rd) + 2 AS rows_in, (SELECT count(*) FROM late) AS rows_late,
  (SELECT count(*) FROM rd WHERE voltage IS NULL) AS without_voltage, (SELECT count(*) FROM bins) AS bins
""")
def _(spark, folder):
    """A tenth of the first half comes when its time is long closed: left out of the bins, and counted batch by batch."""
    table = readings(spark, folder).select("row_id", "series_id", "ts", KWH, "voltage")
    path = scratch_path(spark, "late-in")
    first, last = table.agg(F.min("ts").cast("double"), F.max("ts").cast("double")).first()
    middle = F.lit(first) + (F.lit(last) - F.lit(first)) / 2
    late = (F.col("ts").cast("double") < middle) & (F.col("row_id") % 10 == 0)
    table.filter(~late).repartition(WRITERS).write.mode("append").parquet(path)
    _closed(spark, table, path, series_id=-1, voltage=0.0)
    for part in range(WRITERS - 1):  # files up to the end of that batch
        table.limit(0).coalesce(1).write.mode("append").parquet(path)
    table.filter(late).repartition(WRITERS - 1).write.mode("append").parquet(path)
    _closed(spark, table, path, series_id=-1, voltage=0.0)
    stream = live.observed(live.read_folder(spark, path, table.schema, WRITERS), without_voltage=F.col("voltage").isNull())
    out = scratch_path(spark, "late-out")
    with _rocksdb(spark):
        grid = live.grid_stream(stream, [KWH], late="1 day")
        totals = live.run_counted(grid, out, scratch_path(spark, "late-checkpoint"))
    kept = spark.read.schema(grid.schema).parquet(out).where("series_id >= 0")
    # empty bins repeat the value before them; bins with rows are those of the rows that came in time
    held = table.filter(~late).select("series_id", F.date_trunc("hour", "ts").alias("ts")).distinct()
    bins = kept.join(held, ["series_id", "ts"], "left_semi").agg(F.count(F.lit(1)).alias("bins"))
    return bins.select(*[F.lit(totals[k]).cast("bigint").alias(k) for k in ("rows_in", "rows_late", "without_voltage")], "bins")


@query("M7_stream_equals_batch", f"""
WITH {READINGS} SELECT series_id, date_trunc('hour', ts) AS ts, avg(consumption_kwh) AS consumption_kwh FROM rd GROUP BY 1, 2
""", floats="consumption_kwh", times="ts")
def _(spark, folder):
    """Files come out of order but within the allowed lateness, and a last row far ahead closes every bin."""
    table = readings(spark, folder).select("series_id", "ts", KWH)
    path = scratch_path(spark, "shuffled-in")
    first, last = table.agg(F.min("ts").cast("double"), F.max("ts").cast("double")).first()
    part = F.least(F.lit(FILES - 1), F.floor((F.col("ts").cast("double") - first) / (last - first) * FILES))
    for i in (1, 0, 2):
        table.filter(part == i).write.mode("append").parquet(path)
    ahead = table.limit(1).select(F.lit(-1).cast(table.schema["series_id"].dataType).alias("series_id"),
                                  F.timestamp_seconds(F.lit(last + 90 * 86_400)).cast(table.schema["ts"].dataType).alias("ts"), KWH)
    for _ in range(2):  # the second lets the watermark of the first take effect
        ahead.write.mode("append").parquet(path)
    stream = live.resample_stream(live.read_folder(spark, path, table.schema, WRITERS), [KWH], late="60 days")
    return _run(spark, stream, "shuffled").filter("series_id >= 0")
