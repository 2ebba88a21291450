"""Cut keys and whole keys must agree, for any number of shuffle partitions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wattline.operators import ordered
from wattline.operators.ordered import arrange, percent_rank_of_ties, spread_join
from wattline.operators.quantile import quantiles
from wattline.operators.splits import latest_per_key


@pytest.fixture(scope="module")
def frame():
    draw = np.random.default_rng(7)
    n = 700
    key = np.where(draw.random(n) < 0.6, 1, draw.integers(2, 9, n))  # key 1 is hot
    value = np.where(draw.random(n) < 0.3, np.nan, np.round(draw.normal(50, 20, n), 0))
    return pd.DataFrame({"k": key, "t": draw.permutation(n), "v": value})


def table(spark, frame):
    return spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "k long, t long, v double")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("partitions", ["1", "4", "64"])
@pytest.mark.parametrize("limit", [10_000, 13])
def test_running_near_and_position(spark, frame, partitions, limit):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        ordered = arrange(table(spark, frame), ["k"], ["t"], limit)
        assert ordered.is_cut == (limit == 13)
        run = ordered.running({"s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v"), "l": ("last", "v"), "n": ("next", "v")})
        near = ordered.near({"lag5": lambda w: F.lag("v", 5).over(w), "lead2": lambda w: F.lead("v", 2).over(w),
                             "c": lambda w: F.count(F.lit(1)).over(w.rowsBetween(-6, 0))}, back=6, ahead=2)
        placed = ordered.with_position_and_total("p", "all")
        got = (rows(run, "k", "t", F.round("s", 6), "lo", "hi", "l", "n"), rows(near, "k", "t", "lag5", "lead2", "c"),
               rows(placed, "k", "t", "p", "all"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    by_hand = frame.sort_values(["k", "t"]).reset_index(drop=True)
    g = by_hand.groupby("k")
    none = lambda x: None if pd.isna(x) else float(x)
    sums = by_hand["v"].fillna(0).groupby(by_hand["k"]).cumsum().where(g["v"].transform(lambda s: s.notna().cumsum()) > 0)
    lows, highs = g["v"].transform(lambda s: s.expanding().min()), g["v"].transform(lambda s: s.expanding().max())
    want_run = sorted((int(k), int(t), none(a), none(b), none(c), none(d), none(e)) for k, t, a, b, c, d, e in zip(
        by_hand["k"], by_hand["t"], sums, lows, highs, g["v"].ffill(), g["v"].bfill()))
    want_near = sorted((int(k), int(t), none(a), none(b), int(c)) for k, t, a, b, c in zip(
        by_hand["k"], by_hand["t"], g["v"].shift(5), g["v"].shift(-2), np.minimum(g.cumcount() + 1, 7)))
    want_place = sorted((int(k), int(t), int(p), int(a)) for k, t, p, a in zip(
        by_hand["k"], by_hand["t"], g.cumcount(), g["t"].transform("size")))
    key = lambda row: tuple((x is None, x) for x in row)
    assert [key(r) for r in got[0]] == [key(r) for r in want_run]
    assert [key(r) for r in got[1]] == [key(r) for r in want_near]
    assert got[2] == want_place


@pytest.mark.parametrize("limit", [10_000, 13])
def test_percent_rank_equals_average_rank(spark, frame, limit):
    got = {(r["k"], r["t"]): r["p"] for r in percent_rank_of_ties(table(spark, frame), "v", "p", ["k"], limit).collect()}
    want = frame.groupby("k")["v"].rank(pct=True)
    assert len(got) == len(frame)
    for key, t, w in zip(frame["k"], frame["t"], want):
        have = got[(key, t)]
        assert (have is None) == pd.isna(w) and (have is None or abs(have - w) < 1e-12)


@pytest.mark.parametrize("limit", [10_000, 13])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_quantiles_interpolate(spark, frame, limit, keys):
    shares = {f"q{i}": ("v", p) for i, p in enumerate((0.0, 0.001, 0.25, 0.5, 0.85, 0.999, 1.0))}
    got = quantiles(table(spark, frame), shares, keys, limit).collect()
    parts = {r["k"]: r for r in got} if keys else {None: got[0]}
    for key, row in parts.items():
        values = frame["v"] if key is None else frame.loc[frame["k"] == key, "v"]
        for name, (_, p) in shares.items():
            assert row[name] == pytest.approx(values.quantile(p), abs=1e-9)


def test_latest_per_key(spark, frame):
    got = rows(latest_per_key(table(spark, frame), 5, ["k"], ["t"]), "k", "t")
    want = sorted((int(r.k), int(r.t)) for r in frame.sort_values("t").groupby("k").tail(5).itertuples())
    assert got == want


def test_empty_and_single_row(spark):
    empty = spark.createDataFrame([], "k long, t long, v double")
    assert arrange(empty, ["k"], ["t"]).running({"s": ("sum", "v")}).count() == 0
    assert quantiles(empty, {"m": ("v", 0.5)}).first()["m"] is None
    one = spark.createDataFrame([(1, 1, 2.0)], "k long, t long, v double")
    assert quantiles(one, {"m": ("v", 0.5)}).first()["m"] == 2.0


@pytest.mark.parametrize("limit", [10, 400])
def test_spread_join_equals_a_join_and_bounds_the_largest_share(spark, limit):
    left = spark.range(900).select(F.col("id").alias("row_id"), F.when(F.col("id") % 9 == 8, None).when(
        F.col("id") % 3 < 2, 1).otherwise(F.col("id")).cast("bigint").alias("k"), F.lit("x").alias("note"))
    right = spark.createDataFrame([(1, 10.0), (1, 11.0), (5, 50.0), (None, 1.0), (77777, 2.0)], "k bigint, v double")
    spread = spread_join(left, right, ["k"], limit)
    plain = left.join(right, ["k"], "left")
    assert spread.columns == plain.columns
    assert spread.exceptAll(plain).count() == 0 == plain.exceptAll(spread).count()


def test_lookup_join_with_more_frequent_keys_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(ordered, "_MOST_HOT", 3)
    rows = spark.range(600).select((F.col("id") % 20).alias("k"), "id").unionByName(spark.range(200).select(F.lit(4).cast("bigint").alias("k"), "id"))
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    got = ordered.lookup_join(rows, table, ["k"], "n", 5)
    want = rows.join(table, "k", "left")
    assert got.exceptAll(want.select(*got.columns)).count() == 0 and got.count() == 800
