"""The canonical reading table: schemas, CSV scans, lineage and the driver-table views."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.functions.temporal import day_first_votes, parse_timestamp
from wattline.session import materialize

SERIES, TS, ROW = "series_id", "ts", "row_id"

# Columns a data kind must and may have.
REQUIRED_COLUMNS = {
    "smart_meter": ["ts", "consumption_kwh"],
    "iot_sensor": ["ts", "temperature"],
    "full": ["ts", "consumption_kwh", "voltage"],
}
OPTIONAL_COLUMNS = [
    "voltage", "current", "power_factor", "load_factor", "temperature", "humidity", "pressure",
    "flow_rate", "equipment_id", "plant_id", "sensor_id",
]
TEXT_COLUMNS = {
    "data_source", "equipment_id", "plant_id", "sensor_id", "is_peak_hour", "maintenance_status", "efficiency_class", "status",
}
NOT_FEATURES = {"ts", "timestamp", "is_anomaly", "failure_label", "efficiency_score"}


def scan_csv(spark: SparkSession, path: str, ts: str = "timestamp", keep_bad_rows: bool = False, land: bool = True) -> DataFrame:
    """Scan one CSV file, a folder or a glob of readings.

    Files are read by their own headers and put together by column name; a column that a file
    lacks is null there, and a file without the time column is refused. Every column is read as
    text and typed by expressions, so one bad cell never drops a row silently: measures become
    doubles (unreadable cells null), the time column is parsed with the layout its own file
    votes for, and rows without a usable time are left out unless asked for. ``row_id`` follows
    the file position, so "first" keeps its meaning.

    The typed rows are landed once as Parquet in the shared folder: the checks and repairs that
    follow read them many times, and a row keeps its id even if a task is run again.
    """
    raw = _by_own_headers(spark, path, ts)
    votes = day_first_votes(raw, ts, _FILE).withColumnRenamed(_FILE, "_voted")
    if votes.limit(_FILES_BROADCAST + 1).count() <= _FILES_BROADCAST:
        votes = F.broadcast(votes)
    raw = raw.join(votes, F.col(_FILE) == F.col("_voted"), "left")
    typed = [parse_timestamp(F.col(ts), F.col("day_first")).alias(TS)]
    for name in raw.columns:
        if name in (ts, _FILE, "_voted", "day_first"):
            continue
        typed.append(F.col(name) if name in TEXT_COLUMNS else _measure(name))
    if land and ROW not in raw.columns:
        typed.append(F.monotonically_increasing_id().alias(ROW))
    read = raw.select(*typed)
    read = read if keep_bad_rows else read.filter(F.col(TS).isNotNull())
    return materialize(read, "scan") if land else read


_FILE = "_file"
_FILES_BROADCAST = 10_000


def _by_own_headers(spark: SparkSession, path: str, ts: str) -> DataFrame:
    """All columns as text, and the file of each row; files with the same header are one scan."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"),
                                         F.col("_metadata.file_block_start").alias("block"))
    # only the first block of a file holds its header, and one task reads it in order
    heads = lines.filter("block = 0").groupBy("file").agg(F.first("value").alias("head"))
    same = heads.groupBy("head").agg(F.collect_list("file").alias("files")).collect()
    parts = []
    for row in sorted(same, key=lambda r: r["head"]):
        names = next(csv.reader([row["head"].removeprefix("\ufeff")]))
        if ts not in names:
            raise KeyError(f"column '{ts}' not found in {names} of {row['files'][0]}")
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        read = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE")
        parts.append(read.csv(row["files"]).select(*[F.col(f"`{n}`") for n in names], F.col("_metadata.file_path").alias(_FILE)))
    if not parts:
        raise FileNotFoundError(f"no rows in {path}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _measure(name: str):
    kind = "bigint" if name in (SERIES, ROW) else "double"
    return F.col(name).try_cast(kind).alias(name)


def scan_iot_csv(spark: SparkSession, path: str, ts: str = "timestamp") -> DataFrame:
    """Side table of temperature, pressure and flow per time."""
    return scan_csv(spark, path, ts, land=False).drop(ROW)


def with_lineage(df: DataFrame, source: str = "real_sensor") -> DataFrame:
    return df.withColumns({"data_source": F.lit(source), "ingestion_time": F.current_timestamp()})


def cleaned_before(df: DataFrame) -> Column:
    """Whether a row carries the lineage of a validated source and needs no second cleaning."""
    if "data_source" not in df.columns:
        return F.lit(False)
    return F.coalesce(F.col("data_source") == "real_sensor", F.lit(False))


def measure_columns(df: DataFrame, exclude: set | None = None) -> list[str]:
    """Numeric columns that describe a reading: keys, flags and targets are left out."""
    out = NOT_FEATURES | {SERIES, ROW} | (exclude or set())
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in out]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def readings(spark: SparkSession, folder: str) -> DataFrame:
    """Event rows as meter readings; one in eight voltages is missing."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("double")
    return _table(spark, folder, "events").select(
        F.col("event_id").alias(ROW),
        F.col("user_id").alias(SERIES),
        F.col("ts").cast("timestamp").alias(TS),
        F.col("value").alias("consumption_kwh"),
        F.when(F.col("event_id") % 8 != 0, F.lit(220.0) + F.lit(0.2) * k).alias("voltage"),
        (k / 100).alias("load_factor"),
        (F.lit(24.0) + F.col("user_id") % 18).alias("temperature"),
        F.col("event_type").alias("status"),
    )


def line_readings(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as daily readings with many equal times."""
    return _table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias(SERIES),
        F.col("l_shipdate").cast("timestamp").alias(TS),
        F.col("l_quantity").alias("consumption_kwh"),
        F.col("l_extendedprice").alias("cost"),
        (F.lit(1.0) - F.col("l_discount")).alias("load_factor"),
        F.col("l_tax").alias("tax"),
        F.col("l_returnflag").alias("status"),
    )


def hourly_total(spark: SparkSession, folder: str) -> DataFrame:
    """Readings of all series added up per hour, as one series."""
    return (
        readings(spark, folder)
        .groupBy(F.date_trunc("hour", TS).alias(TS))
        .agg(
            F.sum("consumption_kwh").alias("consumption_kwh"),
            F.avg("voltage").alias("voltage"),
            F.avg("load_factor").alias("load_factor"),
            F.avg("temperature").alias("temperature"),
        )
        .withColumn(SERIES, F.lit(0).cast("bigint"))
    )


def iot_side(spark: SparkSession, folder: str) -> DataFrame:
    """Purchases per hour as a pressure/flow table; hours without a purchase are absent."""
    return (
        _table(spark, folder, "events")
        .filter(F.col("event_type") == "purchase")
        .groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias(TS))
        .agg(F.avg("value").alias("pressure"), F.count(F.lit(1)).cast("double").alias("flow_rate"))
    )
