"""Named queries over the driver tables, each with the SQL that must give the same rows.

``query`` registers a function (spark, folder) -> DataFrame.  The output is put into a
comparable form on both sides: doubles rounded, integers widened, times as text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_NUDGE = 1e-9  # moves exact rounding ties off the edge, the same way on both sides


def comparable(df: DataFrame, digits: int = 4) -> DataFrame:
    shown = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            column = F.round(column.cast("double") + F.lit(_NUDGE), digits) + F.lit(0.0)
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            column = column.cast("bigint")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        shown.append(column.alias(field.name))
    return df.select(*shown)


def comparable_sql(sql: str, floats: str = "", ints: str = "", times: str = "", digits: int = 4) -> str:
    made = [f"round(CAST({c} AS DOUBLE) + {_NUDGE}, {digits}) + 0.0 AS {c}" for c in floats.split()]
    made += [f"CAST({c} AS BIGINT) AS {c}" for c in ints.split()]
    made += [f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}" for c in times.split()]
    return f"SELECT * REPLACE ({', '.join(made)}) FROM ({sql})" if made else sql


def query(name: str, sql: str | None = None, floats: str = "", ints: str = "", times: str = "", digits: int = 4):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return comparable(fn(spark, folder), digits)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = comparable_sql(sql, floats, ints, times, digits)
        return fn
    return register


# --- SQL for the shared views -------------------------------------------------------------

READINGS = """rd AS (
  SELECT event_id AS row_id, user_id AS series_id, CAST(ts AS TIMESTAMP) AS ts, value AS consumption_kwh,
         CASE WHEN event_id % 8 <> 0 THEN CAST(220 AS DOUBLE) + CAST(0.2 AS DOUBLE) * k END AS voltage,
         k / 100 AS load_factor, CAST(24 + user_id % 18 AS DOUBLE) AS temperature, event_type AS status
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k FROM events))"""

HOURLY = READINGS + """,
ht AS (
  SELECT date_trunc('hour', ts) AS ts, sum(consumption_kwh) AS consumption_kwh, avg(voltage) AS voltage,
         avg(load_factor) AS load_factor, avg(temperature) AS temperature, CAST(0 AS BIGINT) AS series_id
  FROM rd GROUP BY 1)"""

LINES = """lr AS (
  SELECT l_suppkey AS series_id, CAST(l_shipdate AS TIMESTAMP) AS ts, l_quantity AS consumption_kwh,
         l_extendedprice AS cost, 1 - l_discount AS load_factor, l_tax AS tax, l_returnflag AS status
  FROM lineitem)"""

GRID = READINGS + """,
span AS (SELECT series_id, date_trunc('hour', min(ts)) AS a, date_trunc('hour', max(ts)) AS b FROM rd GROUP BY 1),
grid AS (SELECT series_id, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ts FROM span),
binned AS (
  SELECT series_id, date_trunc('hour', ts) AS ts, avg(consumption_kwh) AS consumption_kwh, avg(voltage) AS voltage,
         avg(load_factor) AS load_factor, avg(temperature) AS temperature
  FROM rd GROUP BY 1, 2),
sparse AS (SELECT g.series_id, g.ts, consumption_kwh, voltage, load_factor, temperature
           FROM grid g LEFT JOIN binned b ON g.series_id = b.series_id AND g.ts = b.ts)"""

_LAST = "last_value({c} IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS {c}"

RESAMPLED = GRID + ",\nrs AS (SELECT series_id, ts, " + ", ".join(
    _LAST.format(c=c) for c in ("consumption_kwh", "voltage", "load_factor", "temperature")
) + " FROM sparse)"

SCORED = READINGS + """,
q85 AS (SELECT quantile_cont(consumption_kwh, 0.85) AS q FROM rd),
sc AS (
  SELECT rd.*, load_factor - 0.1 AS anomaly_score, CASE WHEN consumption_kwh > 200 THEN 1 ELSE 0 END AS anomaly_flag,
    CASE WHEN load_factor - 0.1 <= 0.1 THEN 'normal' WHEN load_factor - 0.1 <= 0.3 THEN 'low'
         WHEN load_factor - 0.1 <= 0.6 THEN 'medium' ELSE 'high' END AS anomaly_severity,
    load_factor * 100 AS maintenance_urgency, 100 - load_factor * 100 AS efficiency_score,
    CASE series_id % 5 WHEN 0 THEN 'very efficient' WHEN 1 THEN 'efficient' WHEN 2 THEN 'moderate'
         WHEN 3 THEN 'inefficient' ELSE 'unknown' END AS efficiency_label,
    CASE WHEN hour(ts) IN (7, 8, 9, 17, 18, 19, 20) THEN 1 ELSE 0 END AS is_peak_hour,
    CASE WHEN points <= 0 THEN 'healthy' WHEN points <= 2 THEN 'warning' ELSE 'critical' END AS health_status
  FROM (SELECT *, CASE WHEN consumption_kwh > q THEN 2 ELSE 0 END + CASE WHEN voltage BETWEEN 225 AND 235 THEN 0 ELSE 1 END
          + CASE WHEN temperature > 35 THEN 1 ELSE 0 END AS points FROM rd, q85) rd)"""


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Readings with fixed stand-ins for the model outputs, so read models can be checked exactly."""
    from wattline.operators.quantile import quantiles
    from wattline.sources.readings import readings

    table = readings(spark, folder)
    return score_rows(table, quantiles(table, {"q": ("consumption_kwh", 0.85)}).scalar())


def score_rows(table: DataFrame, high) -> DataFrame:
    """The stand-ins for the model outputs of each reading; ``high`` is the consumption from which a reading counts as high."""
    from wattline.functions import labels, temporal

    names = ["very efficient", "efficient", "moderate", "inefficient", "unknown"]
    label = F.get(F.array(*[F.lit(n) for n in names]), (F.col("series_id") % 5).cast("int"))
    points = labels.health_points(F.col("consumption_kwh"), high, F.col("voltage"), F.col("temperature"))
    made = table.withColumns({
        "anomaly_score": F.col("load_factor") - 0.1,
        "anomaly_flag": (F.col("consumption_kwh") > 200).cast("int"),
        "maintenance_urgency": F.col("load_factor") * 100,
        "efficiency_score": 100 - F.col("load_factor") * 100,
        "efficiency_label": label,
        "is_peak_hour": temporal.peak_hour(F.hour("ts")),
        "health_status": labels.health_label(points),
    })
    return made.withColumn("anomaly_severity", labels.severity(F.col("anomaly_score")))


def fixed_sql(expression: str, digits: int) -> str:
    """SQL text of a number with fixed decimals, halves away from zero on its decimal form."""
    return f"printf('%.{digits}f', CAST(round(CAST({expression} AS DECIMAL(24, 8)), {digits}) AS DOUBLE))"
