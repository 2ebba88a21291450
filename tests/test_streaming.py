"""Streams must give the rows of the batch form; late rows are dropped and counted."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from wattline.session import scratch_path
from wattline.streaming import live

START = datetime(2024, 1, 1)
SCHEMA = "row_id long, series_id long, ts timestamp, consumption_kwh double"


def put(spark, path, lines):
    spark.createDataFrame(lines, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return live.read_folder(spark, path, spark.createDataFrame([], SCHEMA).schema, 1)


def test_late_rows_are_dropped_and_counted(spark):
    path, out = scratch_path(spark, "late-in"), scratch_path(spark, "late-out")
    put(spark, path, [(1, 1, START, 1.0), (2, 1, START + timedelta(hours=1), 2.0)])
    put(spark, path, [(3, 1, START + timedelta(hours=9), 3.0)])
    put(spark, path, [(6, 1, START + timedelta(hours=10), 5.0)])
    put(spark, path, [(4, 1, START, 100.0), (5, 1, START + timedelta(hours=20), 4.0)])  # row 4 is eight hours late
    totals = live.run_counted(live.resample_stream(stream(spark, path), ["consumption_kwh"]), out, scratch_path(spark, "late-cp"))
    got = {r["ts"]: r["consumption_kwh"] for r in spark.read.parquet(out).collect()}
    assert got == {START: 1.0, START + timedelta(hours=1): 2.0, START + timedelta(hours=9): 3.0, START + timedelta(hours=10): 5.0}
    assert totals["rows_late"] == 1 and totals["rows_in"] == 6


def test_repeats_across_batches(spark):
    path, out = scratch_path(spark, "rep-in"), scratch_path(spark, "rep-out")
    put(spark, path, [(1, 1, START, 1.0), (2, 2, START, 2.0)])
    put(spark, path, [(3, 1, START, 9.0), (4, 1, START + timedelta(minutes=1), 5.0)])
    live.write_once(live.drop_repeats(stream(spark, path)), out, scratch_path(spark, "rep-cp"))
    assert sorted(r["row_id"] for r in spark.read.parquet(out).collect()) == [1, 2, 4]


def test_invalid_batch_writes_only_its_status(spark):
    path, out = scratch_path(spark, "bad-in"), scratch_path(spark, "bad-out")
    put(spark, path, [(i, 1, START + timedelta(hours=i), float(i + 1)) for i in range(30)])
    put(spark, path, [(i, 1, START + timedelta(hours=i), -5.0 - i) for i in range(30, 60)])
    cycle = lambda batch: (batch, batch.filter("consumption_kwh > 25").withColumn("rule", F.lit("r")))
    live.process_batches(stream(spark, path), cycle, out, scratch_path(spark, "bad-cp"))
    status = [(r["pipeline_status"], r["error_code"], r["rows_processed"], r["alerts"], r["total_sync_count"])
              for r in live.sync_status(spark, out).orderBy("batch_id").collect()]
    assert status == [("completed", "OK", 30, 5, 1), ("failed", "CORRUPTED_FILE", 0, 0, 1)]
    assert spark.read.parquet(f"{out}/predictions").count() == 30


def at(hours, **more):
    return START + timedelta(hours=hours, **more)


def alert_files(spark, path, batches):
    for rows in batches:
        lines = [(i, key, t, 0.0) for i, key, t in rows]
        put(spark, path, lines)


def run_stateful(spark, made, label):
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, live.ROCKSDB)
    try:
        out = scratch_path(spark, f"{label}-out")
        query = live.write_once(made, out, scratch_path(spark, f"{label}-cp"))
        return spark.read.schema(made.schema).parquet(out), query
    finally:
        spark.conf.set(store, before)


def test_cooldown_decides_in_time_order_over_batches_and_forgets_silent_keys(spark):
    path = scratch_path(spark, "cool-in")
    alert_files(spark, path, [
        [(1, 1, at(2)), (2, 1, at(3, minutes=10)), (9, 2, at(2))],
        [(3, 1, at(1)), (4, 1, at(2)), (5, 2, at(2, minutes=59))],  # row 3 is earlier than all before: it silences rows 1 and 4
        [(6, 1, at(40)), (7, 9, at(40))],
        [(8, 9, at(100))],
    ])
    made = live.cooldown_stream(stream(spark, path), 5400, ["series_id"], late="6 hours")
    table, query = run_stateful(spark, made, "cool")
    got = sorted((r["series_id"], r["row_id"]) for r in table.collect())
    assert got == [(1, 2), (1, 3), (1, 6), (2, 9), (9, 7)]
    # only the newest row of series 9 waits; series 1 and 2 have no state, not even the time they last fired
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4


def test_grid_fills_empty_bins_over_batches(spark):
    path = scratch_path(spark, "grid-in")
    put(spark, path, [(1, 1, at(5, minutes=5), 10.0), (2, 1, at(5, minutes=10), 20.0), (3, 2, at(1), None)])
    put(spark, path, [(4, 1, at(2), 3.0), (5, 2, at(4), 8.0), (6, 2, at(2), None)])
    put(spark, path, [(7, 3, at(60), 0.0)])
    made = live.grid_stream(stream(spark, path), ["consumption_kwh"], 3600, late="6 hours")
    table, _ = run_stateful(spark, made, "grid")
    got = [(r["series_id"], (r["ts"] - START).seconds // 3600, r["consumption_kwh"])
           for r in table.where("series_id < 3").orderBy("series_id", "ts").collect()]
    assert got == [(1, 2, 3.0), (1, 3, 3.0), (1, 4, 3.0), (1, 5, 15.0), (2, 1, None), (2, 2, None), (2, 3, None), (2, 4, 8.0)]


def test_live_cycle_repeats_a_batch_without_a_trace(spark):
    """The same batch id again gives the same tables, and late rows are counted and dropped."""
    schema = spark.createDataFrame([], SCHEMA).schema
    out, score = scratch_path(spark, "cycle-out"), lambda df: df.withColumn("anomaly_flag", F.lit(0))
    def rows(*lines):
        return spark.createDataFrame([(i, 1, t, v) for i, t, v in lines], schema)

    one = rows((1, at(0), 300.0), (2, at(1), None), (3, at(9), 301.0))
    two = rows((4, at(2), 302.0), (2, at(1), 1.0), (5, at(20), 303.0))
    settings = {"alert_consumption_threshold": 200.0}
    for batch, number in ((one, 0), (two, 1), (two, 1)):
        live._cycle(batch, number, score, out, ["consumption_kwh"], settings, 6 * 3600, 7200)
    live.finish_cycle(spark, schema, score, out, ["consumption_kwh"], settings, 7200)
    done = spark.read.parquet(f"{out}/predictions").orderBy("ts").select("row_id", "consumption_kwh").collect()
    assert [tuple(r) for r in done] == [(1, 300.0), (2, 300.0), (3, 301.0), (5, 303.0)]  # rows 4 and the other 2 were late
    status = [(r["rows_in"], r["rows_late"], r["rows_processed"]) for r in spark.read.parquet(f"{out}/status").orderBy("batch_id").collect()]
    assert status == [(3, 0, 2), (3, 2, 1), (0, 0, 1)]
    fired = sorted(r["row_id"] for r in spark.read.parquet(f"{out}/alerts").where("rule = 'high_consumption'").collect())
    assert fired == [1, 3, 5]  # row 2 carries 300 and falls into the quiet time of row 1


def test_places_that_fire_equal_a_walk():
    import numpy as np

    draw = np.random.default_rng(3)
    pieces = [np.sort(draw.choice(400, draw.integers(1, 60), replace=False)) for _ in range(40)]
    us, low = np.concatenate(pieces), np.cumsum([0] + [len(p) for p in pieces[:-1]])
    for gap in (0, 1, 7, 90, 1000):
        want = []
        for start, piece in zip(low, pieces, strict=True):
            last = None
            for i, t in enumerate(piece):
                if last is None or t >= last + gap:
                    want.append(start + i)
                    last = t
        assert sorted(live._firing(us, low, low + [len(p) for p in pieces], gap).tolist()) == want


def test_cooldown_over_batches_equals_the_batch_form_with_null_keys_and_ties(spark):
    import random

    from wattline.operators.cooldown import apply_cooldown

    draw, spans, keys = random.Random(5), [(20, 40), (0, 25), (30, 60)], [None, 1, 2, 3]
    batches, n = [], 0
    for low, high in spans:
        rows = []
        for _ in range(300):  # some times fall on the watermark itself, some are a microsecond apart
            step = timedelta(microseconds=draw.choice([0, 0, 0, 1, 1500]))
            n += 1
            rows.append((n, draw.choice(keys), START + timedelta(minutes=30 * draw.randint(2 * low, 2 * high)) + step))
        batches.append(rows)
    batches += [[(n + 1, 9, at(500))], [(n + 2, 9, at(501))]]
    path, zone = scratch_path(spark, "same-in"), spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        alert_files(spark, path, batches)
        table = spark.read.parquet(path).fillna(0, ["series_id"])  # the joins of the batch form leave out null keys
        for seconds in (0, 900, 5400):
            made = live.cooldown_stream(stream(spark, path), seconds, ["series_id"], late="40 hours")
            done, _ = run_stateful(spark, made, "same")
            want = sorted(r["row_id"] for r in apply_cooldown(table, seconds, ["series_id"]).where("series_id < 9").collect())
            assert sorted(r["row_id"] for r in done.where("series_id < 9 OR series_id IS NULL").collect()) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_waiting_alerts_of_one_key_do_not_wait_in_the_state_of_that_key(spark):
    """They are spread by time; to the task of the key go packed times that are due."""
    path = scratch_path(spark, "hot-in")
    put(spark, path, [(i, 1, START + timedelta(seconds=i), 0.0) for i in range(3000)])
    put(spark, path, [(i, 1, START + timedelta(seconds=i), 0.0) for i in range(3000, 4000)] + [(5000, 1, None, 0.0), (5001, 2, None, 0.0)])
    table, query = run_stateful(spark, live.cooldown_stream(stream(spark, path), 600, ["series_id"], late="40 minutes"), "hot")
    assert sorted(r["row_id"] for r in table.collect()) == [0, 600, 1200]
    held = [(o["operatorName"], o["numRowsTotal"]) for o in query.lastProgress["stateOperators"]]
    assert [n for name, n in held if name == "stateStoreSave"] == [2400, 2400]  # from 1600 on
    assert sum(n for name, n in held if name != "stateStoreSave") <= 3


def test_a_time_is_packed_once_for_many_rows_of_a_key():
    import numpy as np
    import pyarrow as pa

    keys = np.repeat(np.arange(300), 50)
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in (keys * 7, -keys, np.arange(15000)[::-1])], ["key_a", "key_b", "event_us"])
    got = []
    for made in live._packed(iter([batch.slice(0, 4000), batch.slice(4000)])):
        for slot, *cells in zip(*[made.column(i).to_pylist() for i in range(5)], strict=True):
            a, b, counts, us = (np.frombuffer(c, "int64") for c in cells)
            assert set(b % live._SLOTS) == {slot} and len(a) == len(set(a)) and counts.sum() == len(us)
            got += zip(np.repeat(a, counts).tolist(), np.repeat(b, counts).tolist(), us.tolist(), strict=True)
    assert sorted(got) == sorted(zip((keys * 7).tolist(), (-keys).tolist(), range(14999, -1, -1), strict=True))


def test_many_keys_share_the_state_of_few_slots(spark):
    from wattline.operators.cooldown import apply_cooldown

    path, keys = scratch_path(spark, "many-in"), 2000
    for low in (0, 30):
        lines = spark.range(low * keys, (low + 30) * keys, 1, 2).selectExpr(
            "id AS row_id", f"id % {keys} AS series_id",
            f"TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(id DIV {keys} * 20 + (id * 37) % {keys} % 13 AS INT)) AS ts",
            "CAST(0 AS DOUBLE) AS consumption_kwh")
        lines.coalesce(1).write.mode("append").parquet(path)
    put(spark, path, [(-1, -1, at(30), 0.0)])
    put(spark, path, [(-2, -1, at(31), 0.0)])
    made = live.cooldown_stream(stream(spark, path), 86_400, ["series_id"], late="11 hours")
    table, query = run_stateful(spark, made, "many")
    want = apply_cooldown(spark.read.parquet(path), 86_400, ["series_id"]).where("series_id >= 0")
    got = table.where("series_id >= 0")
    assert got.count() == keys and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    held = [o["numRowsTotal"] for o in query.lastProgress["stateOperators"] if o["operatorName"] != "stateStoreSave"]
    assert sum(held) <= 3 * live._SLOTS  # all keys are in their quiet time; one state with its timer for each slot
