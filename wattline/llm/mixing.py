"""Mixing sources to target weights by hash thresholds.

Targets: sources are numbered by code point (null last) and weigh 5, 2, 1, repeating. They share `scale` times all
sizes by weight; a target stops at `most` times the size of its source, and the excess goes to the others by weight
until none is above. Filling in order of size / weight gives that state directly.

Selection: a source gives whole passes over its documents, and for the rest of its target the documents with the
smallest hashes. The threshold is found from histograms: sizes are summed by source and hash bucket, the bucket in which
the budget ends is cut into buckets by the next hash digits, and so on until it holds one hash. Only the boundary bucket
is read again at each level; nothing is sorted. The document at the threshold gives its leading words, so that a source
meets its target to the word. The hash is the MD5 of seed and document id, so reruns agree.

Defined results: null or blank texts have size 0 and are taken 0 times. Documents with the same id have the same hash
and are in or out together; at the threshold they share the remaining budget by size. Without any words every target is
0. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.llm.common import joined_small, word_array
from wattline.session import materialize

WEIGHTS = (5, 2, 1)
SCALE = 1.5
MOST = 2
DIGITS = 3  # hex digits of a histogram level: 4,096 buckets
DEPTH = 32


def targets(sizes: DataFrame, weights=WEIGHTS, scale: float = SCALE, most: int = MOST) -> DataFrame:
    """source, source_size, target: one row per source, from (source, size) rows summed before the shuffle."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # over sources, not documents
    place = (F.row_number().over(order) - 1) % len(weights)
    weighed = totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1))
    weighed = weighed.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = (F.sum("source_size").over(whole) * F.lit(scale) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    free = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = weighed.withColumn("level", rest / free)
    reached = F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("level"))
    filled = level.withColumn("water", F.max(reached).over(whole))  # levels rise to the true one and fall after it
    return filled.select("source", "source_size", F.when(
        F.col("water").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("water") * F.col("weight"))).alias("target"))


def thresholds(sized: DataFrame, aims: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Per source: passes, and for the rest the hash prefix at which the budget ends, the budget left there and the
    sizes that share it.

    Each level reads only documents under the boundary prefix. The driver sees two numbers per level.
    """
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    open_ = aims.select("source", "source_size", "target", passes.alias("passes"))
    open_ = open_.withColumn("budget", F.floor(F.col("target") - F.col("passes") * F.col("source_size")).cast("long"))
    open_ = materialize(open_.withColumn("prefix", F.lit("")).withColumn("shared", F.col("source_size")), "mix-aims")
    depth = 0
    while depth < DEPTH:
        width = min(digits, DEPTH - depth)
        keys = open_.select(F.col("source").alias("key"), "prefix", "budget")
        inside = joined_small(sized.where("size > 0"), keys, F.col("source").eqNullSafe(F.col("key"))
                              & (F.substring("hash", 1, depth) == F.col("prefix")), "inner")
        buckets = inside.groupBy("source", "budget", F.substring("hash", depth + 1, width).alias("bucket")).agg(
            F.sum("size").alias("words"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        running = Window.partitionBy("source").orderBy("bucket")  # at most 16 ** digits rows a source
        ends = F.sum("words").over(running)
        edge = buckets.withColumn("ends", ends).where("ends > budget AND ends - words <= budget").select(
            F.col("source").alias("key"), "bucket", (F.col("budget") - F.col("ends") + F.col("words")).alias("left_over"),
            F.col("words").alias("inside"), (F.col("low") == F.col("high")).alias("single"))
        met = joined_small(open_, edge, F.col("source").eqNullSafe(F.col("key")))
        open_ = materialize(met.select(
            "source", "source_size", "target", "passes", F.coalesce("left_over", "budget").alias("budget"),
            F.concat("prefix", F.coalesce("bucket", F.lit("0" * width))).alias("prefix"),
            F.coalesce("inside", F.lit(0).cast("long")).alias("shared"), F.coalesce("single", F.lit(True)).alias("single")),
            "mix-level")
        depth += width
        if open_.where("NOT single").limit(1).count() == 0:
            break
        open_ = open_.drop("single")
    return open_.select("source", "source_size", "target", "passes", "budget", "prefix", "shared")


def _sized(key: Column, text: Column, source: Column, seed: str) -> list[Column]:
    """What the mix reads of a row: its source, its words and its hash."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return [source.alias("source"), F.size(word_array(text)).cast("long").alias("size"), digest.alias("hash")]


def _with_taken(sized: DataFrame, edge: DataFrame) -> DataFrame:
    """The rows of `sized` (with source, size, hash), the figures of their source, and the words the mix takes of them."""
    joined = joined_small(sized, edge.withColumnRenamed("source", "key"), F.col("source").eqNullSafe(F.col("key")), "inner")
    at = F.expr("substring(hash, 1, length(prefix))")
    extra = F.when(at < F.col("prefix"), F.col("size")).when(
        (at == F.col("prefix")) & (F.col("shared") > 0),
        F.expr("CAST(CAST(budget AS DECIMAL(20, 0)) * CAST(size AS DECIMAL(18, 0)) / shared AS LONG)")).otherwise(F.lit(0))
    return joined.withColumn("taken", (F.col("passes") * F.col("size") + F.least(F.col("size"), extra)).cast("long"))


def mix(docs: DataFrame, weights=WEIGHTS, scale: float = SCALE, most: int = MOST, seed: str = "mix",
        key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, taken: the words of each document that the mix takes."""
    sized = materialize(docs.select(
        F.col(key).alias("doc_id"), *_sized(F.col(key), F.col(text), F.col(source), seed)), "mix-sizes")
    edge = thresholds(sized, materialize(targets(sized, weights, scale, most), "mix-targets"))
    return _with_taken(sized, edge).select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed_rows(docs: DataFrame, weights=WEIGHTS, scale: float = SCALE, most: int = MOST, seed: str = "mix",
               key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of the mix: each document as often as it is taken, the one at the threshold cut to its leading words.

    A row decides for itself, from its own words and the few figures of its source, so texts are never shuffled and rows
    with a null or repeated id keep to their own share. Columns and types stay; a character count in `n_chars` follows a
    cut text.
    """
    sized = materialize(docs.select(*_sized(F.col(key), F.col(text), F.col(source), seed)), "mix-row-sizes")
    edge = thresholds(sized, materialize(targets(sized, weights, scale, most), "mix-row-targets"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    inner = dict(zip(docs.columns, names, strict=True))
    rows = docs.toDF(*names).select(*names, *_sized(F.col(inner[key]), F.col(inner[text]), F.col(inner[source]), seed))
    wanted = _with_taken(rows, edge).where("taken > 0")
    copies = wanted.withColumn("copy", F.explode(F.expr("sequence(1, CAST(ceil(taken / size) AS INT))")))
    cut = F.expr("copy > floor(taken / size)")
    short = F.array_join(F.slice(word_array(F.col(inner[text])), F.lit(1), F.expr("CAST(taken % size AS INT)")), " ")
    out = {text: F.when(cut, short).otherwise(F.col(inner[text]))}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(cut, F.length(short).cast("long")).otherwise(F.col(inner["n_chars"]))
    return copies.select(*[(out[c] if c in out else F.col(n)).alias(c) for c, n in inner.items()])
