"""Cleaning, filling, resampling, windows and other order-dependent operators."""

from pyspark.sql import functions as F

from wattline.operators import clean, features, splits
from wattline.operators.ordered import arrange, percent_rank_of_ties
from wattline.plans.catalogue import GRID, HOURLY, LINES, READINGS, RESAMPLED, query
from wattline.sources.readings import hourly_total, line_readings, measure_columns, readings

KWH = "consumption_kwh"
BY_TIME = ["ts", "row_id"]


def resampled(spark, folder):
    return clean.resample(readings(spark, folder), 3600)


# --- D: cleaning ---------------------------------------------------------------------------

def _coarse(spark, folder):
    """Readings with time cut to the hour, so that a series has equal times."""
    return readings(spark, folder).withColumn("ts", F.date_trunc("hour", "ts"))


@query("D1_first_row_per_time", f"""
WITH {READINGS}, h AS (SELECT * REPLACE (date_trunc('hour', ts) AS ts) FROM rd)
SELECT row_id, series_id, ts, consumption_kwh, voltage, status FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id, ts ORDER BY row_id) AS n FROM h) WHERE n = 1
""", floats="consumption_kwh voltage", times="ts")
def _(spark, folder):
    kept = clean.first_per_time(_coarse(spark, folder))
    return kept.select("row_id", "series_id", "ts", KWH, "voltage", "status")


@query("D1_drop_equal_rows", f"""
WITH {LINES} SELECT DISTINCT series_id, ts, consumption_kwh, status FROM lr
""", floats="consumption_kwh", times="ts")
def _(spark, folder):
    return clean.drop_equal_rows(line_readings(spark, folder).select("series_id", "ts", KWH, "status"))


@query("D2_fill_both_ways", f"""
WITH {READINGS}
SELECT row_id, coalesce(
  last_value(voltage IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts, row_id ROWS UNBOUNDED PRECEDING),
  first_value(voltage IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts, row_id
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS voltage
FROM rd
""", floats="voltage")
def _(spark, folder):
    return clean.fill_gaps(readings(spark, folder), ["voltage"]).select("row_id", "voltage")


@query("D3_replace_far_values", f"""
WITH {READINGS}, m AS (SELECT avg(consumption_kwh) a, stddev_pop(consumption_kwh) s FROM rd),
marked AS (SELECT row_id, CASE WHEN abs((consumption_kwh - a) / s) > 4 THEN NULL ELSE consumption_kwh END AS v FROM rd, m)
SELECT row_id, coalesce(v, (SELECT quantile_cont(v, 0.5) FROM marked)) AS consumption_kwh FROM marked
""", floats="consumption_kwh")
def _(spark, folder):
    return clean.replace_far_values(readings(spark, folder), [KWH]).select("row_id", KWH)


@query("D4_clip_extremes", f"""
WITH {READINGS}, m AS (
  SELECT max(abs(consumption_kwh - a)) / max(s) > 5 AS need_c, min(qlo) AS lo, min(qhi) AS hi
  FROM rd, (SELECT avg(consumption_kwh) a, stddev_samp(consumption_kwh) s, quantile_cont(consumption_kwh, 0.001) qlo,
            quantile_cont(consumption_kwh, 0.999) qhi FROM rd)),
t AS (SELECT max(abs(temperature - a)) / max(s) > 5 AS need_t, min(qlo) AS tlo, min(qhi) AS thi
  FROM rd, (SELECT avg(temperature) a, stddev_samp(temperature) s, quantile_cont(temperature, 0.001) qlo,
            quantile_cont(temperature, 0.999) qhi FROM rd))
SELECT row_id, CASE WHEN need_c THEN least(greatest(consumption_kwh, lo), hi) ELSE consumption_kwh END AS consumption_kwh,
       CASE WHEN need_t THEN least(greatest(temperature, tlo), thi) ELSE temperature END AS temperature
FROM rd, m, t
""", floats="consumption_kwh temperature")
def _(spark, folder):
    return clean.clip_extremes(readings(spark, folder), [KWH, "temperature"]).select("row_id", KWH, "temperature")


@query("D5_resample_with_gaps", f"WITH {GRID} SELECT * FROM sparse",
       floats="consumption_kwh voltage load_factor temperature", times="ts")
def _(spark, folder):
    return clean.resample(readings(spark, folder), 3600, fill=False)


@query("D5_resample_hourly", f"WITH {RESAMPLED} SELECT * FROM rs",
       floats="consumption_kwh voltage load_factor temperature", times="ts")
def _(spark, folder):
    return resampled(spark, folder)


@query("D6_drop_incomplete", f"""
WITH {READINGS} SELECT row_id, consumption_kwh, voltage FROM rd
WHERE voltage IS NOT NULL AND consumption_kwh IS NOT NULL
""", floats="consumption_kwh voltage")
def _(spark, folder):
    return clean.drop_incomplete(readings(spark, folder).select("row_id", KWH, "voltage"))


# --- F: ordered features -------------------------------------------------------------------

def _lag_sql(n):
    return f"lag({KWH}, {n}) OVER w AS {KWH}_lag_{n}h"


def _roll_sql(n):
    frame = f"(PARTITION BY series_id ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return ", ".join(
        f"CASE WHEN count({KWH}) OVER {frame} = {n} THEN {fn}({KWH}) OVER {frame} END AS {KWH}_roll_{short}_{n}h"
        for short, fn in (("mean", "avg"), ("std", "stddev_samp"), ("max", "max")))


_LAG_NAMES = " ".join(f"{KWH}_lag_{n}h" for n in features.LAGS)
_ROLL_NAMES = " ".join(f"{KWH}_roll_{s}_{n}h" for n in features.WINDOWS for s in ("mean", "std", "max"))


@query("F1_lags", f"""
WITH {HOURLY} SELECT ts, {', '.join(_lag_sql(n) for n in features.LAGS)} FROM ht WINDOW w AS (ORDER BY ts)
""", floats=_LAG_NAMES, times="ts")
def _(spark, folder):
    return features.add_lags(hourly_total(spark, folder)).select("ts", *_LAG_NAMES.split())


@query("F1_lags_per_series", f"""
WITH {READINGS} SELECT row_id, {', '.join(_lag_sql(n) for n in features.LAGS)}
FROM rd WINDOW w AS (PARTITION BY series_id ORDER BY ts, row_id)
""", floats=_LAG_NAMES)
def _(spark, folder):
    return features.add_lags(readings(spark, folder), order=BY_TIME).select("row_id", *_LAG_NAMES.split())


@query("F2_rolling", f"WITH {HOURLY} SELECT ts, {', '.join(_roll_sql(n) for n in features.WINDOWS)} FROM ht",
       floats=_ROLL_NAMES, times="ts")
def _(spark, folder):
    return features.add_rolling(hourly_total(spark, folder)).select("ts", *_ROLL_NAMES.split())


@query("F2_rolling_per_series",
       f"WITH {RESAMPLED} SELECT series_id, ts, {', '.join(_roll_sql(n) for n in (6, 24))} FROM rs",
       floats=" ".join(f"{KWH}_roll_{s}_{n}h" for n in (6, 24) for s in ("mean", "std", "max")), times="ts")
def _(spark, folder):
    table = readings(spark, folder)
    longest = clean.grid_length(table)
    made = features.add_rolling(clean.resample(table), sizes=(6, 24), longest=longest)
    return made.select("series_id", "ts", *[c for c in made.columns if "_roll_" in c])


@query("F3_percent_rank", f"""
WITH {READINGS}, r AS (
  SELECT row_id, rank() OVER (ORDER BY load_factor) AS k, count(*) OVER (PARTITION BY load_factor) AS t,
         count(*) OVER () AS n FROM rd)
SELECT row_id, (k + (t - 1) / 2.0) / n AS load_pct FROM r
""", floats="load_pct")
def _(spark, folder):
    return percent_rank_of_ties(readings(spark, folder), "load_factor", "load_pct").select("row_id", "load_pct")


@query("F3_percent_rank_per_series", f"""
WITH {LINES}, r AS (
  SELECT *, rank() OVER (PARTITION BY series_id ORDER BY consumption_kwh) AS k,
         count(*) OVER (PARTITION BY series_id, consumption_kwh) AS t, count(*) OVER (PARTITION BY series_id) AS n FROM lr)
SELECT series_id, ts, consumption_kwh, cost, (k + (t - 1) / 2.0) / n AS pct FROM r
""", floats="consumption_kwh cost pct", times="ts")
def _(spark, folder):
    ranked = percent_rank_of_ties(line_readings(spark, folder), KWH, "pct", ["series_id"])
    return ranked.select("series_id", "ts", KWH, "cost", "pct")


@query("F4_difference_and_direction", f"""
WITH {READINGS} SELECT row_id, consumption_kwh - lag(consumption_kwh) OVER w AS diff,
  sign(consumption_kwh - lag(consumption_kwh) OVER w) AS direction
FROM rd WINDOW w AS (PARTITION BY series_id ORDER BY ts, row_id)
""", floats="diff direction")
def _(spark, folder):
    ordered = arrange(readings(spark, folder), ["series_id"], BY_TIME)
    made = ordered.near({"diff": lambda w: F.col(KWH) - F.lag(KWH).over(w)}, back=1)
    return made.select("row_id", "diff", F.signum("diff").alias("direction"))


@query("F5_persistence", f"""
WITH {READINGS} SELECT row_id, coalesce(lag(consumption_kwh) OVER w, consumption_kwh) AS persisted
FROM rd WINDOW w AS (PARTITION BY series_id ORDER BY ts, row_id)
""", floats="persisted")
def _(spark, folder):
    return features.persistence(readings(spark, folder), KWH, "persisted", order=BY_TIME).select("row_id", "persisted")


@query("F6_latest_rows", f"""
WITH {HOURLY} SELECT ts, consumption_kwh FROM ht ORDER BY ts DESC LIMIT 72
""", floats="consumption_kwh", times="ts")
def _(spark, folder):
    return splits.latest(hourly_total(spark, folder), 72).select("ts", KWH)


@query("F6_latest_rows_per_series", f"""
WITH {READINGS} SELECT series_id, row_id FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC, row_id DESC) AS n FROM rd) WHERE n <= 24
""")
def _(spark, folder):
    return splits.latest_per_key(readings(spark, folder), 24).select("series_id", "row_id")


@query("F7_sequence_windows", f"""
WITH {HOURLY}, s AS (
  SELECT ts, count(*) OVER f AS n, sum(consumption_kwh) OVER f AS total, first_value(consumption_kwh) OVER f AS oldest,
         lead(consumption_kwh) OVER (ORDER BY ts) AS next_target
  FROM ht WINDOW f AS (ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))
SELECT ts, n AS length, total, oldest, next_target FROM s WHERE n = 24 AND next_target IS NOT NULL
""", floats="total oldest next_target", times="ts")
def _(spark, folder):
    made = features.sequence_windows(hourly_total(spark, folder), [KWH, "voltage"], KWH, 24)
    values = F.transform("sequence", lambda s: s[KWH])
    return made.select("ts", F.size("sequence").alias("length"),
                       F.aggregate(values, F.lit(0.0), lambda a, v: a + v).alias("total"),
                       values[0].alias("oldest"), "next_target")


@query("F8_ordered_split", f"""
WITH {READINGS}, p AS (SELECT row_id, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY series_id) AS n
  FROM rd WINDOW w AS (PARTITION BY series_id ORDER BY ts, row_id))
SELECT row_id, CASE WHEN pos < n - ceil(n * 0.2) THEN 'train' ELSE 'test' END AS part FROM p
""")
def _(spark, folder):
    return splits.ordered_split(readings(spark, folder), 0.2).select("row_id", "part")


@query("F9_rolling_origin_folds", f"""
WITH {HOURLY}, p AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS pos, count(*) OVER () AS n FROM ht),
f AS (SELECT unnest(generate_series(240, n - 24 - 1, 24)) AS origin FROM (SELECT max(n) AS n FROM p))
SELECT (origin - 240) // 24 AS fold, origin AS train_rows, ts, pos - origin AS step
FROM f JOIN p ON pos >= origin AND pos < origin + 24
""", ints="fold train_rows step", times="ts")
def _(spark, folder):
    return splits.rolling_origin(hourly_total(spark, folder), 240, 24, 24).select("fold", "train_rows", "ts", "step")


@query("F9_rolling_origin_overlapping", f"""
WITH {HOURLY}, p AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS pos, count(*) OVER () AS n FROM ht),
f AS (SELECT unnest(generate_series(100, n - 48 - 1, 12)) AS origin FROM (SELECT max(n) AS n FROM p))
SELECT (origin - 100) // 12 AS fold, origin AS train_rows, ts, pos - origin AS step
FROM f JOIN p ON pos >= origin AND pos < origin + 48
""", ints="fold train_rows step", times="ts")
def _(spark, folder):
    return splits.rolling_origin(hourly_total(spark, folder), 100, 48, 12).select("fold", "train_rows", "ts", "step")


@query("F10_expanding_folds", f"""
WITH {READINGS}, p AS (SELECT row_id, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY series_id) AS n
  FROM rd WINDOW w AS (PARTITION BY series_id ORDER BY ts, row_id)),
s AS (SELECT *, n // 6 AS size, n - 5 * (n // 6) AS first_test FROM p)
SELECT row_id, CASE WHEN pos < first_test THEN 0 ELSE (pos - first_test) // size + 1 END AS test_fold FROM s
""", ints="test_fold")
def _(spark, folder):
    return splits.expanding_folds(readings(spark, folder), 5).select("row_id", "test_fold")


@query("F14_global_position", f"""
WITH {LINES} SELECT consumption_kwh, min(pos) AS first_pos, max(pos) AS last_pos FROM (
  SELECT consumption_kwh, row_number() OVER (ORDER BY consumption_kwh, cost, ts, series_id, load_factor, tax, status) - 1 AS pos FROM lr)
GROUP BY 1
""", floats="consumption_kwh")
def _(spark, folder):
    order = [KWH, "cost", "ts", "series_id", "load_factor", "tax", "status"]
    placed = arrange(line_readings(spark, folder), [], order).with_position("pos")
    return placed.groupBy(KWH).agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


@query("F14_position_in_series", f"""
WITH {READINGS} SELECT row_id, row_number() OVER (PARTITION BY series_id ORDER BY ts, row_id) - 1 AS pos FROM rd
""")
def _(spark, folder):
    return arrange(readings(spark, folder), ["series_id"], BY_TIME).with_position("pos").select("row_id", "pos")
