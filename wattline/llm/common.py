"""Shared pieces of the training-data operators: table reads, the word pattern, joins with a checked broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of characters other than the six ASCII blanks. Fixed by the contracts of the operators.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"

#: A side is broadcast only after its rows were counted and found to be no more than this.
BROADCAST_ROWS = 50_000


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_ARROW_DEFAULT, _ARROW_TEXTS = "10000", "1000"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder. Whole texts go to Python in batches of 1,000 rows unless the session says otherwise."""
    if spark.conf.get(ARROW_ROWS) == _ARROW_DEFAULT:
        spark.conf.set(ARROW_ROWS, _ARROW_TEXTS)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def word_array(text: Column) -> Column:
    """The words of a text; a null, empty or blank text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{BLANK_CLASS}+"), "")


def joined_small(left: DataFrame, small: DataFrame, on, how: str = "left", most: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a table that is usually small: broadcast behind a count of its rows, a shuffled join beyond it.

    The rows must be narrow (keys and a few numbers), so that the count also bounds the bytes.
    """
    if small.limit(most + 1).count() <= most:
        small = F.broadcast(small)
    return left.join(small, on, how)
