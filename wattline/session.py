"""Session settings, the shared scratch folder and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ROWS_PER_TASK = 1_000_000
ROWS_PER_TASK_KEY = "spark.wattline.rowsPerTask"


def build_session(app: str = "wattline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew joins and UTC; cluster settings win where given."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def rows_per_task(spark: SparkSession) -> int:
    """How many rows of one key a single task may sort; beyond it the key is cut into pieces."""
    return int(spark.conf.get(ROWS_PER_TASK_KEY, str(ROWS_PER_TASK)))


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees. On a cluster it must be named by the session."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="wattline-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


_SCOPE_KEY = "spark.wattline.scratchScope"


def scratch_root(spark: SparkSession) -> str:
    scope = spark.conf.get(_SCOPE_KEY, "")
    return f"{shared_dir(spark)}/wattline/{spark.sparkContext.applicationId}" + (f"/{scope}" if scope else "")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application (or of the open scope), once no result needs them any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch_scope(spark: SparkSession):
    """Intermediate tables written inside are deleted at the end, so nothing lazy that reads them may leave."""
    before = spark.conf.get(_SCOPE_KEY, "")
    spark.conf.set(_SCOPE_KEY, f"{before}/{uuid.uuid4().hex}".strip("/"))
    try:
        yield
    finally:
        clear_scratch(spark)
        spark.conf.set(_SCOPE_KEY, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    This cuts lineage and survives executor loss, and it freezes values such as
    partition numbers that would change if a lost stage ran again.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
