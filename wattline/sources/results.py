"""Writing and reading tables, run results, cached results, settings and exports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.sources.readings import SERIES, TS

MANIFEST = "manifest"
_MANIFEST_SCHEMA = "run_id string, artefact string, rows bigint, saved_at timestamp, expires_at timestamp"

# Default thresholds of the alert rules.
DEFAULT_SETTINGS = {
    "alert_consumption_threshold": 500.0,
    "alert_anomaly_score_threshold": 0.7,
    "alert_voltage_deviation": 10.0,
    "alert_load_factor_threshold": 0.9,
}


def write_features(df: DataFrame, path: str, buckets: int = 16, mode: str = "overwrite") -> None:
    """Parquet laid out by series bucket and day, so time and series filters prune files.

    Rows are brought together by (bucket, day) before the write, so a partition gets few
    files; the rebalance hint splits a hot bucket and day over several tasks.
    """
    laid = df.withColumns({"series_bucket": F.pmod(F.hash(SERIES), F.lit(buckets)), "day": F.to_date(TS)})
    (laid.hint("rebalance", "series_bucket", "day").write.mode(mode).option("maxRecordsPerFile", 5_000_000)
     .partitionBy("series_bucket", "day").parquet(path))


def read_features(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Read the feature table; day bounds prune partitions."""
    df = spark.read.parquet(path)
    if start:
        df = df.filter(F.col("day") >= F.to_date(F.lit(start)))
    if end:
        df = df.filter(F.col("day") <= F.to_date(F.lit(end)))
    return df.drop("series_bucket", "day")


def save_run(tables: Mapping[str, DataFrame], root: str, run_id: str, models: Mapping | None = None,
             ttl_hours: int = 24) -> None:
    """Write each artefact of a run, then the manifest; a run without manifest does not exist."""
    spark = next(iter(tables.values())).sparkSession
    lines = []
    for name, df in tables.items():
        path = f"{root}/{run_id}/{name}"
        df.write.mode("overwrite").parquet(path)
        lines.append((run_id, name, spark.read.parquet(path).count()))
    for name, model in (models or {}).items():
        model.write().overwrite().save(f"{root}/{run_id}/models/{name}")
        lines.append((run_id, f"models/{name}", None))
    manifest = spark.createDataFrame(lines, "run_id string, artefact string, rows bigint").withColumns({
        "saved_at": F.current_timestamp(),
        "expires_at": F.current_timestamp() + F.make_dt_interval(F.lit(0), F.lit(ttl_hours)),
    })
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{root}/{run_id}/{MANIFEST}")


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def read_manifest(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """Artefacts of a finished run; an unfinished run is refused."""
    path = f"{root}/{run_id}/{MANIFEST}"
    if not path_exists(spark, f"{path}/_SUCCESS"):
        raise FileNotFoundError(f"run '{run_id}' has no manifest")
    return spark.read.schema(_MANIFEST_SCHEMA).parquet(path)


def load_run(spark: SparkSession, root: str, run_id: str) -> dict[str, DataFrame]:
    names = [r["artefact"] for r in read_manifest(spark, root, run_id).collect()]
    return {n: spark.read.parquet(f"{root}/{run_id}/{n}") for n in names if not n.startswith("models/")}


def replace_upload(df: DataFrame, landing: str) -> None:
    """Replace the uploaded readings; results of older runs stay under their own run id."""
    df.write.mode("overwrite").option("header", True).csv(landing)


def put_cached(df: DataFrame, root: str, key: str, ttl_hours: float = 24.0) -> None:
    """Append a keyed result with an expiry time; the newest live entry wins on reads."""
    entry = df.withColumns({
        "cache_key": F.lit(key),
        "stored_at": F.current_timestamp(),
        "expires_at": F.current_timestamp() + F.make_dt_interval(secs=F.lit(ttl_hours * 3600).cast("decimal(18,6)")),
    })
    entry.write.mode("append").partitionBy("cache_key").parquet(root)


def get_cached(spark: SparkSession, root: str, key: str) -> DataFrame:
    entries = spark.read.parquet(root).filter(F.col("cache_key") == key)
    live = entries.filter(F.col("expires_at") > F.current_timestamp())
    newest = live.agg(F.max("stored_at")).scalar()
    return live.filter(F.col("stored_at") == newest).drop("cache_key", "stored_at", "expires_at")


def merge_settings(overrides: DataFrame | None, spark: SparkSession) -> DataFrame:
    """(name, value): defaults overlaid by stored values; unknown stored names are kept."""
    defaults = spark.createDataFrame(list(DEFAULT_SETTINGS.items()), "name string, fallback double")
    if overrides is None:
        return defaults.withColumnRenamed("fallback", "value")
    return defaults.join(overrides.select("name", "value"), "name", "full").select(
        "name", F.coalesce("value", "fallback").alias("value"))


def settings_dict(settings: DataFrame) -> dict[str, float]:
    """The settings as plain numbers; the table has a handful of rows."""
    return {r["name"]: r["value"] for r in settings.collect()}


def export_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """CSV with a header; cells with commas or quotes are quoted, inner quotes doubled."""
    (df.select(*(columns or df.columns)).write.mode("overwrite")
     .option("header", True).option("quote", '"').option("escape", '"').csv(path))
