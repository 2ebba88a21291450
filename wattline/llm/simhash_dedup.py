"""SimHash near-duplicates found in an embedding of segment bit counts.

Fingerprint: texts are lower-cased in A-Z, three-word shingles (a shorter text is one shingle, no words give zero) are
hashed with XXH64 (seed 42), and a bit is set if more than half of the hashes have it.

Join: equal fingerprints are one point. Each half of a fingerprint is cut into segments of two bits and mapped to the
vector of their bit counts. The Manhattan distance of such vectors is a lower bound of the number of differing bits, so
two fingerprints with at most three differing bits are at distance 1 or less in one half. The half's vectors are cells of
a grid: a point meets the points of its own cell and of the cells one step up in one coordinate (of two neighbouring
cells one is always a step up from the other). Candidates whose whole vectors are further apart than three are dropped by
the bound, and the rest are verified by the differing bits themselves, inside the join.

Links between different fingerprints are joined to components by passing the smallest document along links, with a
shortcut to the label of the label, until nothing changes.

Large groups: copies and texts with equal fingerprints are one point, however many they are, and a point has at most
43,744 others within three bits, so that links grow with the number of different fingerprints and never with the square
of a group of documents. Skewed cells and the join back of a frequent fingerprint are joins that adaptive execution splits.

Defined results: null, empty and blank texts have fingerprint zero and are linked like any other; repeated rows have
equal fingerprints; a null doc_id has a fingerprint, and is the representative only where nothing else is; other columns
of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm.common import word_array
from wattline.session import materialize

BITS = 3
SHINGLE = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _majority(hashes: np.ndarray) -> int:
    """Bits set in more than half of the 64-bit hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at:at + (1 << 14)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, row: str | None = None) -> DataFrame:
    """doc_id, fp: shingles are hashed by column functions, bits are counted in numpy batches.

    The column `row`, a string, is passed on between the two under the name row.
    """
    own = ["doc_id"] if row is None else ["doc_id", "row"]
    lowered = F.translate(F.coalesce(F.col("text"), F.lit("")), _UPPER, _LOWER)
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(row).alias(x) for x in own[1:]],
                        word_array(lowered).alias("words"))
    joined = ", ' ', ".join(["w", *[f"words[i + {k}]" for k in range(1, shingle)]])
    hashed = words.select(*own, F.expr(
        f"CASE WHEN size(words) = 0 THEN CAST(array() AS ARRAY<BIGINT>)"
        f" WHEN size(words) < {shingle} THEN array(xxhash64(array_join(words, ' ')))"
        f" ELSE transform(slice(words, 1, greatest(size(words) - {shingle - 1}, 0)), (w, i) -> xxhash64(concat({joined}))) END").alias("h"))

    def count(batches):
        for batch in batches:
            lists = batch.column("h")
            ends = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
            values = lists.flatten().to_numpy(zero_copy_only=False)
            out = [_majority(values[a:b]) if b > a else 0 for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in own], pa.array(out, pa.int64())], names=[*own, "fp"])

    return hashed.mapInArrow(count, "doc_id long, " + "row string, " * (row is not None) + "fp long")


# range join -------------------------------------------------------------------------------------------------------------

_PAIRS = 0x5555555555555555


def pair_counts(fp):
    """The 32 two-bit segments of a fingerprint replaced by their bit counts.

    A count 0, 1, 2 is written as 00, 01, 11, so that the differing bits of two codes are the distance of the counts,
    and the Manhattan distance of two vectors is one bit count.
    """
    low, high = fp.bitwiseAND(F.lit(_PAIRS)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_PAIRS))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def near_pairs(points: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b), a < b: different fingerprints at `bits` (3 at most) or fewer differing bits."""
    if bits > 3:
        raise ValueError("two halves leave one step for each only up to three bits")
    counted = points.select("fp", pair_counts(F.col("fp")).alias("vector"))
    halves = counted.select("fp", "vector", F.explode(F.array(
        F.struct(F.lit(0).alias("half"), F.col("vector").bitwiseAND(F.lit(0xFFFFFFFF)).alias("cell")),
        F.struct(F.lit(1).alias("half"), F.shiftrightunsigned("vector", 32).alias("cell")))).alias("at"))
    own = halves.select("fp", "vector", F.col("at.half").alias("half"), F.col("at.cell").alias("cell"))
    steps = F.expr("filter(transform(sequence(0, 15), k -> CASE ((cell >> (2 * k)) & 3)"
                   " WHEN 0 THEN cell | shiftleft(1L, 2 * k) WHEN 1 THEN cell | shiftleft(2L, 2 * k) END), c -> c IS NOT NULL)")
    moved = own.select("fp", "vector", "half", F.explode(F.concat(F.array("cell"), steps)).alias("reach"), "cell")
    left = moved.select(F.col("fp").alias("x"), F.col("vector").alias("vx"), "half", F.col("reach").alias("cell"),
                        (F.col("reach") == F.col("cell")).alias("same"))
    right = own.select(F.col("fp").alias("y"), F.col("vector").alias("vy"), "half", "cell")
    near = left.join(right, (left["half"] == right["half"]) & (left["cell"] == right["cell"])
                     & (~F.col("same") | (F.col("x") < F.col("y")))
                     & (F.bit_count(F.col("vx").bitwiseXOR(F.col("vy"))) <= bits)
                     & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= bits))
    return near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


# components -------------------------------------------------------------------------------------------------------------

def components(points: DataFrame, links: DataFrame) -> DataFrame:
    """(fp, label): the smallest `lead` of the points reachable over links (a, b), null where all are null; only linked
    points are listed.

    Each round takes the smallest label of the neighbours (combined before the shuffle) and then the label of the point
    that holds this label. Every round is written to the shared folder; the driver sees one number a round.
    """
    both = materialize(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near-links")
    ids = both.select(F.col("a").alias("fp")).distinct()
    state = materialize(points.join(ids, "fp").select("fp", F.struct(F.col("lead").isNull().alias("missing"), "lead", "fp").alias("label")), "near-labels")
    while True:
        heard = both.join(state, both["a"] == state["fp"]).groupBy(F.col("b").alias("to")).agg(F.min("label").alias("heard"))
        told = state.join(heard, state["fp"] == heard["to"]).select("fp", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        told = materialize(told, "near-told")
        leaders = told.select(F.col("fp").alias("holder"), F.col("label").alias("further"))
        after = materialize(told.join(leaders, F.col("label.fp") == F.col("holder")).select(
            "fp", "old", F.least("label", "further").alias("label")), "near-labels")
        if after.where("label < old").limit(1).count() == 0:
            return after.select("fp", F.col("label.lead").alias("label"))
        state = after.select("fp", "label")


def simhash_groups(docs: DataFrame, bits: int = BITS, row: str | None = None) -> DataFrame:
    """doc_id, fp, component_id of every document.

    With a column `row`, a string that tells rows apart, also row and first_row: the row of the component that comes
    first by doc_id, null ids last, and then by `row`.
    """
    prints = materialize(fingerprints(docs, row=row), "fingerprints")
    first = F.min("doc_id") if row is None else F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row"))
    points = materialize(prints.groupBy("fp").agg(first.alias("lead")), "fingerprint-points")
    links = materialize(near_pairs(points, bits), "near-pairs")
    linked = components(points, links)
    final = points.join(linked, "fp", "left").select("fp", F.coalesce("label", "lead").alias("lead"))
    if row is None:
        return prints.join(materialize(final.withColumnRenamed("lead", "component_id"), "near-components"), "fp").select(
            "doc_id", "fp", "component_id")
    final = final.select("fp", F.col("lead.doc_id").alias("component_id"), F.col("lead.row").alias("first_row"))
    return prints.join(materialize(final, "near-components"), "fp").select("doc_id", "fp", "component_id", "row", "first_row")
