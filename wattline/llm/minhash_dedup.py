"""Near duplicates by bottom-k sketches of word shingles, all made with one hash function.

Sets: texts are lower-cased in A-Z, four-word shingles (a shorter text is one shingle) are hashed to 64 bits. Equal sets,
told by two sums of 64 bits, are one point, however many documents have them.

Sketches: the `K` smallest hashes of a set. If two sets meet the threshold, the smallest `K` hashes of their union hold at
least `LEAST` hashes of both (up to a chance of `LOSS`, by the binomial tail), and those are in both sketches.

Overlaps: two sketches that share that many values share one of the first few if values are put in order of frequency,
the rarest first. Only these go to the inverted lists, so that values of a common passage are listed for few texts. Short
lists give all their pairs. A longer list gives the pairs with a few members of its own (the least by salted hashes,
mostly the same ones in all lists of a group). Set sizes and the estimate from the union sketch drop pairs.

Verification: full sets are made again for the remaining points alone and meet in tiles of bounded size, where exact
intersections are products of 0/1 matrices: pairs of one small cluster of candidates in one tile, those of larger
clusters in tiles around the chosen members. A tile returns no links but a tree of each of its components.

Rest: a long list is settled if all its members are in one component by now. Otherwise the members outside its largest
component meet all others in further tiles, so that no pair of a list is left out and no pair is a row.

Components are joined by passing the smallest document along, as in `simhash_dedup`.

Defined results: null, empty and blank texts have no shingles and are linked with nothing; repeated rows and copies have
equal sets; a null doc_id stands for a component only where nothing else does, and such rows are kept only then; several
texts under one id are judged by their own sets; other columns of the input are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.llm import rolling
from wattline.llm.common import joined_small
from wattline.llm.repeats import text_chunks
from wattline.llm.simhash_dedup import components
from wattline.session import materialize

SHINGLE = 4
#: Two sets are linked if PERCENT * union <= 100 * intersection.
PERCENT = 80
K = 64
LOSS = 1e-9
SHORT_LIST, CHOSEN = 16, 4
TILE = 1024
SLICE = 4096
PASS_BYTES = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_OTHER = np.uint64(0xD6E8FEB86659FD93)


def least_shared(k: int = K, percent: int = PERCENT, loss: float = LOSS) -> int:
    """The largest number that a binomial count of k draws at `percent` falls short of with a chance of at most `loss`."""
    p, tail, least = percent / 100, 0.0, 0
    while (tail := tail + math.comb(k, least) * p**least * (1 - p) ** (k - least)) <= loss:
        least += 1
    return least


LEAST = least_shared()


# sets and sketches ------------------------------------------------------------------------------------------------------

def shingle_sets(data: np.ndarray, lengths: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the different shingles of each text, ascending, and how many each text has."""
    data, ends, n = _LOWER[data], np.cumsum(lengths), len(lengths)
    starts, stops = rolling.word_bounds(data, ends)
    words = rolling.word_hashes(data, starts, stops)
    doc = np.searchsorted(ends, starts, side="right")
    per = np.bincount(doc, minlength=n)
    first = np.cumsum(per) - per
    found = []
    for size in range(1, shingle + 1):
        grams = rolling.mixed(rolling.word_grams(words, size) + np.uint64(size))
        if size < shingle:
            at = np.flatnonzero(per == size)
            found.append((at, grams[first[at]] if len(at) else grams[:0]))
        else:
            inside = doc[:len(grams)] == doc[len(doc) - len(grams):]
            found.append((doc[:len(grams)][inside], grams[inside]))
    of, hashes = (np.concatenate(x) for x in zip(*found, strict=True))
    hashes = hashes.astype(np.int64)
    order = np.lexsort((hashes, of))
    of, hashes = of[order], hashes[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[new], np.bincount(of[new], minlength=n)


def set_names(hashes: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """16 bytes for each set: two sums over its hashes."""
    ends = np.cumsum(sizes)
    sums = []
    for salt in (np.uint64(0), _OTHER):
        total = np.append(np.uint64(0), np.cumsum(rolling.mixed(hashes.astype(np.uint64) ^ salt), dtype=np.uint64))
        sums.append(total[ends] - total[ends - sizes])
    return np.column_stack(sums).astype("<u8").view("V16").ravel().tolist()


def sketches(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, of_text (a hash of the text), n (shingles), set, sketch."""
    def run(batches):
        for batch in batches:
            for begin, end, data, lengths in text_chunks(batch, size=PASS_BYTES):
                hashes, sizes = shingle_sets(data, lengths)
                start = np.cumsum(sizes) - sizes
                taken = np.minimum(sizes, k)
                at = np.repeat(start - np.cumsum(taken) + taken, taken) + np.arange(int(taken.sum()))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(taken)), pa.int32()), pa.array(hashes[at]))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(begin, end - begin), batch.column("of_text").slice(begin, end - begin),
                    pa.array(sizes, pa.int64()), pa.array(set_names(hashes, sizes), pa.binary()), lists],
                    names=["doc_id", "of_text", "n", "set", "sketch"])

    return _read(docs).mapInArrow(run, "doc_id long, of_text long, n long, set binary, sketch array<long>")


def _read(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("of_text"))


def full_sets(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """set, hashes of the sets in `needed` (set, of_text), made again from their texts."""
    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            keys = batch.column("of_text").to_pylist()
            fresh = [i for i, key in enumerate(keys) if key not in seen and not seen.add(key)]
            if not fresh:
                continue
            for _, _, data, lengths in text_chunks(batch.take(pa.array(fresh, pa.int64())), size=PASS_BYTES):
                hashes, sizes = shingle_sets(data, lengths)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(hashes))
                yield pa.RecordBatch.from_arrays([pa.array(set_names(hashes, sizes), pa.binary()), lists], names=["set", "hashes"])

    texts = needed.select(F.col("of_text").alias("asked")).distinct()
    read = _read(docs)
    made = joined_small(read, texts, read["of_text"] == F.col("asked"), "left_semi", most=500_000)
    return made.select("text", "of_text").mapInArrow(run, "set binary, hashes array<long>").dropDuplicates(["set"])


# candidates -------------------------------------------------------------------------------------------------------------

def _needed_overlap(size: Column, k: int) -> Column:
    """How many values a sketch of this size shares with that of any set that meets the threshold.

    A sketch below k is the whole set: either the union fits a sketch too and 80 % of it are shared, or at most a quarter
    of the set's size is missing from the k smallest of the union.
    """
    return F.when(size < k, F.ceil(size * 0.75)).otherwise(LEAST if k == K else least_shared(k)).cast("int")


def index(sets: DataFrame, k: int = K) -> DataFrame:
    """value, set, n: the inverted lists of the rarest values that a set must share one of."""
    values = sets.select("set", "n", F.size("sketch").alias("m"), F.explode("sketch").alias("value"))
    often = values.groupBy("value").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    shared = values.join(often, "value").groupBy("set", "n", "m").agg(F.sort_array(F.collect_list(F.struct("held", "value"))).alias("values"))
    # values held once are the rarest of all, and are shared with nobody
    room = F.col("m") - _needed_overlap(F.col("m"), k) + 1 - (F.col("m") - F.size("values"))
    return shared.select("set", "n", F.explode(F.slice("values", 1, F.greatest(F.lit(0), room))).alias("at")).select(
        F.col("at.value").alias("value"), "set", "n")


def _like_sizes(a: str, b: str) -> Column:
    return F.col(a) * 100 >= F.col(b) * PERCENT


def candidates(listed: DataFrame) -> DataFrame:
    """center, other: all pairs of short lists, and the pairs with the chosen members of long ones.

    `listed` has value, set, n, long (is the list long?) and chosen (structs with set and n).
    """
    one = listed.where("NOT long").select("value", F.col("set").alias("center"), F.col("n").alias("n_center"))
    two = listed.where("NOT long").select(F.col("value").alias("value_too"), F.col("set").alias("other"), F.col("n").alias("n_other"))
    short = one.join(two, (F.col("value") == F.col("value_too")) & (F.col("center") < F.col("other"))
                     & _like_sizes("n_center", "n_other") & _like_sizes("n_other", "n_center")).select("center", "other")
    around = listed.where("long").select("set", "n", F.explode("chosen").alias("near")).where(
        (F.col("set") != F.col("near.set")) & _like_sizes("n", "near.n") & _like_sizes("near.n", "n"))
    return short.unionByName(around.select(F.col("near.set").alias("center"), F.col("set").alias("other"))).distinct()


def estimated(pairs: DataFrame, sets: DataFrame, k: int = K) -> DataFrame:
    """The pairs whose union sketch holds enough common values."""
    x = sets.select(F.col("set").alias("center"), F.col("sketch").alias("x"))
    y = sets.select(F.col("set").alias("other"), F.col("sketch").alias("y"))
    both = pairs.join(x, "center").join(y, "other")
    union = both.select("center", "other", F.slice(F.array_sort(F.array_union("x", "y")), 1, k).alias("union"), F.array_intersect("x", "y").alias("shared"))
    least = F.when(F.size("union") < k, F.ceil(F.size("union") * PERCENT / 100)).otherwise(LEAST if k == K else least_shared(k))
    return union.where(F.size(F.array_intersect("shared", "union")) >= least).select("center", "other")


# verification -----------------------------------------------------------------------------------------------------------

def linked_pairs(hashes: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in left, in right) of the sets that meet the threshold; `left` and `right` are sets among all."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    _, code, held = np.unique(hashes, return_inverse=True, return_counts=True)
    often = held > 1
    code, doc = (np.cumsum(often) - 1)[code[often[code]]], doc[often[code]]
    rows, cols = np.full(len(sizes), -1), np.full(len(sizes), -1)
    rows[left], cols[right] = np.arange(len(left)), np.arange(len(right))
    common = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(code, kind="stable")
    code, doc = code[order], doc[order]
    for at in range(0, int(often.sum()), SLICE):
        a, b = np.searchsorted(code, [at, at + SLICE])
        sides = []
        for place, count in ((rows, len(left)), (cols, len(right))):
            here = place[doc[a:b]]
            ones = np.zeros((count, SLICE), np.float32)
            ones[here[here >= 0], code[a:b][here >= 0] - at] = 1
            sides.append(ones)
        common += sides[0] @ sides[1].T
    common = common.astype(np.int64)
    union = sizes[left][:, None] + sizes[right][None, :] - common
    return np.nonzero((100 * common >= PERCENT * union) & (left[:, None] != right[None, :]))


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest place reachable from each place."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if np.array_equal(low, label):
            return label
        label = low


def _tile(rows: pa.Table) -> pa.Table:
    """a, b: every set of a tile that is linked with others, and the first of its component. Sides: 1 left, 2 right, 3 both."""
    lists = rows.column("hashes").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    side, names = rows.column("side").to_numpy(), rows.column("set").to_pylist()
    left, right = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
    i, j = linked_pairs(lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64), left, right)
    root = _roots(left[i], right[j], len(names))
    moved = np.flatnonzero(root != np.arange(len(names)))
    return pa.table({"a": pa.array([names[k] for k in root[moved].tolist()], pa.binary()),
                     "b": pa.array([names[k] for k in moved.tolist()], pa.binary())})


def verified(members: DataFrame, full: DataFrame, keys: list[str]) -> DataFrame:
    """Trees of the components of each tile; `members` has the keys of tiles, set and side."""
    return members.join(full, "set").groupBy(*keys).applyInArrow(_tile, "a binary, b binary")


def _blocks(rows: Column, tile: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(rows / tile)).cast("int")


def _block(blocks: str) -> Column:
    return F.pmod(F.xxhash64("set"), F.col(blocks)).cast("int")


def candidate_tiles(pairs: DataFrame, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """Tiles of small clusters of candidates (cluster, set, side), and tiles around centers (center, part, set, side)."""
    links = pairs.select(F.col("center").alias("a"), F.col("other").alias("b"))
    ends = links.select(F.col("a").alias("fp")).union(links.select("b")).distinct()
    clusters = materialize(components(ends.withColumn("lead", F.col("fp")), links).select(
        F.col("fp").alias("set"), F.col("label").alias("cluster")), "clusters")
    large = materialize(clusters.groupBy("cluster").count().where(F.col("count") > tile).select("cluster"), "large-clusters")
    small = joined_small(clusters, large, "cluster", "left_anti").withColumn("side", F.lit(3))
    inside = joined_small(clusters, large, "cluster", "left_semi").select(F.col("set").alias("center"))
    around = pairs.join(inside, "center", "left_semi")
    parts = around.groupBy("center").agg(_blocks(F.count(F.lit(1)), tile).alias("parts"))
    others = around.join(parts, "center").select(
        "center", F.pmod(F.xxhash64("other"), F.col("parts")).cast("int").alias("part"), F.col("other").alias("set"), F.lit(2).alias("side"))
    centers = parts.select("center", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("center").alias("set"), F.lit(1).alias("side"))
    return small, others.unionByName(centers)


def open_tiles(listed: DataFrame, labels: DataFrame, tile: int = TILE) -> DataFrame:
    """value, kind, i, j, set, side: in long lists of several components, those outside the largest against all members."""
    known = labels.select(F.col("fp").alias("known"), F.col("label").alias("known_label"))
    placed = listed.where("long").select("value", "set").join(known, F.col("set") == F.col("known"), "left").select(
        "value", "set", F.coalesce("known_label", "set").alias("component"))
    placed = materialize(placed, "long-lists")
    counts = placed.groupBy("value", "component").count()
    lists = counts.groupBy("value").agg(F.max_by("component", F.struct("count", "component")).alias("main"), F.max("count").alias("inside"),
                                        (F.sum("count") - F.max("count")).alias("outside")).where("outside > 0")
    lists = lists.select(F.col("value").alias("of"), "main", _blocks(F.col("inside"), tile).alias("mains"), _blocks(F.col("outside"), tile).alias("rests"))
    members = placed.join(lists, F.col("value") == F.col("of")).withColumn("in_main", F.col("component") == F.col("main"))
    main = members.where("in_main").select("value", F.lit("main").alias("kind"), F.explode(F.sequence(F.lit(0), F.col("rests") - 1)).alias("i"),
                                           _block("mains").alias("j"), "set", F.lit(2).alias("side"))
    rest = members.where("NOT in_main").withColumn("block", _block("rests"))
    beside = rest.select("value", F.lit("main").alias("kind"), F.col("block").alias("i"),
                         F.explode(F.sequence(F.lit(0), F.col("mains") - 1)).alias("j"), "set", F.lit(1).alias("side"))
    among = rest.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("rests") - 1))).select(
        "value", F.lit("rest").alias("kind"), F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "set",
        F.when(F.col("block") == F.col("o"), 3).when(F.col("block") < F.col("o"), 1).otherwise(2).alias("side"))
    return main.unionByName(beside).unionByName(among)


# the whole --------------------------------------------------------------------------------------------------------------

def near_links(docs: DataFrame, sets: DataFrame, k: int = K, short: int = SHORT_LIST, chosen: int = CHOSEN, tile: int = TILE) -> DataFrame:
    """a, b: links that connect exactly the sets connected by pairs that meet the threshold."""
    entries = materialize(index(sets, k), "inverted-lists")
    picked = [F.min(F.struct(F.xxhash64("set", F.lit(i)).alias("order"), "set", "n")) for i in range(chosen)]
    lists = entries.groupBy("value").agg(F.count(F.lit(1)).alias("held"), F.array_distinct(
        F.transform(F.array(*picked), lambda x: F.struct(x["set"].alias("set"), x["n"].alias("n")))).alias("chosen")).where("held > 1")
    lists = lists.select(F.col("value").alias("of"), (F.col("held") > short).alias("long"), F.when(F.col("held") > short, F.col("chosen")).alias("chosen"))
    listed = materialize(entries.join(lists, F.col("value") == F.col("of")).drop("of"), "listed")
    pairs = materialize(estimated(materialize(candidates(listed), "candidates"), sets, k), "near-candidates")

    asked = pairs.select(F.col("center").alias("set")).union(pairs.select("other")).union(listed.where("long").select("set")).distinct()
    full = materialize(full_sets(docs, sets.join(asked, "set", "left_semi").select("set", "of_text")), "full-sets")
    small, around = candidate_tiles(pairs, tile)
    found = materialize(verified(small, full, ["cluster"]).unionByName(verified(around, full, ["center", "part"])), "tile-links")
    labels = components(sets.select(F.col("set").alias("fp"), F.col("set").alias("lead")), found)
    rest = materialize(verified(open_tiles(listed, labels, tile), full, ["value", "kind", "i", "j"]), "open-links")
    return found.unionByName(rest)


def minhash_groups(docs: DataFrame, k: int = K, short: int = SHORT_LIST, chosen: int = CHOSEN, tile: int = TILE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    made = materialize(sketches(docs, k), "sketches")
    sets = materialize(made.where("n > 0").groupBy("set").agg(
        F.min("doc_id").alias("lead"), F.min("of_text").alias("of_text"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "sets")
    linked = components(sets.select(F.col("set").alias("fp"), "lead"), near_links(docs, sets, k, short, chosen, tile))
    known = linked.select("fp", F.struct("label").alias("known"))
    final = sets.select("set", "lead").join(known, F.col("set") == F.col("fp"), "left").select(
        F.col("set").alias("of"), F.struct(F.when(F.col("known").isNull(), F.col("lead")).otherwise(F.col("known.label")).alias("label")).alias("found"))
    joined = made.select("doc_id", "n", "set").join(materialize(final, "set-components"), (F.col("set") == F.col("of")) & (F.col("n") > 0), "left")
    component = F.when(F.col("n") > 0, F.col("found.label")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
