"""Quality rules whose cutoffs are certified on labelled documents.

Fixed base rules come first. Every further rule has a short ladder of cutoffs, from lenient to strict. For each stratum
and cutoff the labelled good documents that the cutoff would reject are counted, and the exact binomial lower tail
P(Binomial(n, a) <= k) is the p-value of "this cutoff rejects more than the share a of good documents". A cutoff is
certified when its p-value is at most delta / (strata x rules x cutoffs) (Bonferroni over every cell tested), and the
strictest certified cutoff of each rule is used. The allowed share is divided over the rules, so that with probability
1 - delta, in every stratum at once, all rules together reject at most `max_false_rejection` of the good documents.

Defined results: a null or empty text has no words, fails the base rules and is not kept. A stratum without labels, or
with too few to certify anything, rejects nothing beyond the base rules. A null stratum is a stratum of its own.
Repeated rows are scored each; a document with several labels counts as good if one of them is 1, null labels are no
labels. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.llm.common import BLANKS, joined_small, word_array
from wattline.session import materialize

SYMBOLS = "#*$%&|<>"

#: name, condition that rejects a document (long arithmetic), cutoffs from lenient to strict.
RULES = (
    ("symbols", "1000 * n_symbols > {c} * word_chars", (200, 100, 50, 30, 20, 10)),
    ("marks", "1000 * n_marks > {c} * word_chars", (200, 100, 50, 30, 20, 10)),
    ("capitals", "100 * n_capitals > {c} * word_chars", (60, 50, 40, 30, 20, 10)),
    ("dup_lines", "100 * n_dup_lines > {c} * n_lines", (50, 40, 30, 20, 10)),
    ("repeats", "100 * n_repeat_words > {c} * n_words", (45, 40, 30, 20, 10)),
    ("long_words", "10 * word_chars > {c} * n_words", (150, 120, 100, 90, 80)),
    ("short_words", "10 * word_chars < {c} * n_words", (20, 25, 30, 35, 40)),
)
CELLS = [(i, j, condition.format(c=c)) for i, (_, condition, cutoffs) in enumerate(RULES) for j, c in enumerate(cutoffs)]

MAX_FALSE_REJECTION = 0.05
DELTA = 0.05


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def features(docs: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """One row of counts per document: key, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ...

    A three-word window is the exact text of its words. Windows are sorted inside the row, so equal ones are
    neighbours; the words they cover are summed from the gaps between their start positions.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(key).alias("doc_id"), F.col(stratum).alias("stratum"), body.alias("body"))
    base = base.withColumn("words", word_array(F.col("body"))).withColumn(
        "lines", F.filter(F.split("body", "\n"), lambda line: F.length(_without(line, BLANKS)) > 0))
    solid = _without(F.col("body"), BLANKS)
    counted = base.select(
        "doc_id", "stratum", F.size("words").cast("long").alias("n_words"), F.length(solid).cast("long").alias("word_chars"),
        (F.length("body") - F.length(_without(F.col("body"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.length("body") - F.length(_without(F.col("body"), "!?"))).cast("long").alias("n_marks"),
        (F.length("body") - F.length(_without(F.col("body"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))).cast("long").alias("n_capitals"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("sort_array(transform(slice(words, 1, greatest(size(words) - 2, 0)),"
               " (w, i) -> struct(concat(w, ' ', words[i + 1], ' ', words[i + 2]) AS t, i AS i)))").alias("windows"))
    starts = counted.withColumn("starts", F.expr(
        "sort_array(transform(filter(windows, (x, j) -> (j > 0 AND windows[greatest(j - 1, 0)].t = x.t) OR"
        " (j < size(windows) - 1 AND windows[least(j + 1, size(windows) - 1)].t = x.t)), x -> x.i))")).drop("windows")
    return starts.withColumn("n_repeat_words", F.expr(
        "aggregate(transform(starts, (x, j) -> IF(j = size(starts) - 1, 3,"
        " least(3, starts[least(j + 1, size(starts) - 1)] - x))), 0L, (a, b) -> a + b)")).drop("starts").withColumn(
        "base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))


def binomial_lower_tail(n: Column, k: Column, share: float) -> Column:
    """P(Binomial(n, share) <= k), summed in logarithms term by term; 1 where k exceeds its mean (never certified)."""
    odds = math.log(share) - math.log1p(-share)
    first = n.cast("double") * math.log1p(-share)
    start = F.struct(first.alias("term"), first.alias("total"))

    def step(acc, j):
        term = acc["term"] + F.log((n - j + 1) / j) + F.lit(odds)
        high, low = F.greatest(acc["total"], term), F.least(acc["total"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    tail = F.aggregate(terms, start, step, lambda acc: F.exp(acc["total"]))
    return F.when(k > n * F.lit(share), F.lit(1.0)).otherwise(tail)


def certified_cutoffs(scored: DataFrame, labels: DataFrame, max_false_rejection: float = MAX_FALSE_REJECTION,
                      delta: float = DELTA) -> DataFrame:
    """Per stratum: `cut_<rule>`, the place of the strictest certified cutoff in its ladder, null if none is certified.

    One conditional sum per cell, so that the labelled rows are combined before the shuffle whatever stratum they share.
    """
    good = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("q"))
    held = scored.where("NOT base_failed").join(good.where("q = 1").select("doc_id"), "doc_id", "left_semi")
    sums = held.groupBy("stratum").agg(F.count("*").alias("n"), *[
        F.sum(F.expr(f"CAST({condition} AS LONG)")).alias(f"k_{i}_{j}") for i, j, condition in CELLS])
    sums = materialize(sums, "rule-cells")
    share, level = max_false_rejection / len(RULES), delta / max(1, sums.count() * len(CELLS))
    chosen = []
    for i, (name, _, _) in enumerate(RULES):
        steps = [F.when(binomial_lower_tail(F.col("n"), F.col(f"k_{i}_{j}"), share) <= level, F.lit(j))
                 for r, j, _ in CELLS if r == i]
        chosen.append(F.greatest(*steps).alias(f"cut_{name}"))
    return sums.select("stratum", *chosen)


def apply_rules(scored: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Add `kept`: false for a document that fails the base rules or a certified cutoff of its stratum."""
    cut = cutoffs.withColumnRenamed("stratum", "cut_stratum")
    joined = joined_small(scored, cut, F.col("stratum").eqNullSafe(F.col("cut_stratum")))
    rejected = F.lit(False)
    for i, j, condition in CELLS:
        rejected = rejected | (F.expr(condition) & F.coalesce(F.col(f"cut_{RULES[i][0]}") >= j, F.lit(False)))
    return joined.withColumn("kept", ~F.col("base_failed") & ~rejected)


def quality_rules(docs: DataFrame, labels: DataFrame, max_false_rejection: float = MAX_FALSE_REJECTION,
                  delta: float = DELTA) -> DataFrame:
    """Counts, base verdict and risk-controlled verdict of every document. Texts are read once; the counts are written."""
    scored = materialize(features(docs), "rule-features")
    cutoffs = materialize(certified_cutoffs(scored, labels, max_false_rejection, delta), "rule-cutoffs")
    return apply_rules(scored, cutoffs)
