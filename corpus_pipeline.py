"""The corpus pipeline: five operators one after another over `documents`, each stage written and read again.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the columns
of `documents`. Rows with a null doc_id are kept as long as their text is, and end in the packed sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.llm import mixing, packing, quality_classifier, simhash_dedup, suffix_dedup
from wattline.llm.common import joined_small, table
from wattline.session import materialize


def _free(name: str) -> str:
    """A column name that no table has."""
    return f"{name}_{uuid.uuid4().hex}"


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the quality classifier scores at its threshold or above."""
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    score = _free("score")
    return quality_classifier.score(docs, model, score).where(
        F.col(score) >= quality_classifier.THRESHOLD).select(*docs.columns)


def _row_hash(docs: DataFrame) -> Column:
    """A hash of all columns, nulls told apart from absence; equal for equal rows only."""
    cells = [F.to_json(F.struct(c)) if "map<" in kind else F.col(c) for c, kind in docs.dtypes]
    return F.md5(F.concat_ws(" ", F.xxhash64(*cells, *[F.col(c).isNull() for c in docs.columns]).cast("string"), "text"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near copies; rows that are equal in all columns fall together.

    It is the row with the smallest doc_id, nulls last. Of several texts under one id each is judged by its own group; where
    one group holds more than one row of its smallest id, a hash of the row decides.
    """
    row, key = _free("row"), _free("gone")
    keyed = docs.withColumn(row, _row_hash(docs))
    groups = simhash_dedup.simhash_groups(keyed, row=row)
    gone = materialize(groups.where("row <> first_row").select(F.col("row").alias(key)).distinct(), "near-copies")
    repeated = groups.where("row = first_row").groupBy("row").count().where("count > 1")
    once = keyed.dropDuplicates([row]) if repeated.limit(1).count() else keyed
    return joined_small(once, gone, once[row] == F.col(key), "left_anti").select(*docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out bytes that repeat from smaller documents; characters cut in two go whole, empty texts go with them."""
    names = [_free("n_units"), _free("n_removed"), _free("spans"), _free("kept")]
    done = suffix_dedup.suffix_dedup(docs, whole_characters=True).toDF(*docs.columns, *names)
    cut = F.col(names[1]) > 0
    out = done.withColumn("text", F.when(cut, F.col(names[3]).cast("string")).otherwise(F.col("text")))
    out = out.where(~cut | (F.length("text") > 0))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the mix: documents repeat as often as they are taken, each row by its own words, whatever its id."""
    return mixing.mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of at most 4,096 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", classify),
    ("SimHash near-dedup", drop_near_copies),
    ("suffix-array dedup", drop_repeats),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: The first stages cannot be said in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
