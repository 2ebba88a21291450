"""Finding windows that repeat across documents: the sieve, content-defined shards and marks shared by two operators.

A window is `span` units (words or bytes) of one document. Every window has an anchor (see `rolling`), and equal windows
have equal anchors at equal places.

1. Sieve. Anchor hashes are counted over documents (combined before the shuffle). A window whose anchor occurs once in
   the whole corpus cannot repeat. The repeated hashes go into a filter of bounded size (`FILTER_BITS`), one bit array
   that is broadcast; if they are too many for it, documents are joined with their repeated hashes instead. A false hit
   of the filter or of a hash costs work and changes no result.
2. Shards. A second pass cuts out each run of windows with the same repeated anchor as a context, and contexts are dealt
   by anchor hash, sorted by it, and worked on in shards of bounded size that hold all contexts of their anchors. What
   the operator names as its method runs in a shard and yields marks.
3. Hot anchors, with more contexts than `HOT`, go another exact way: equal contexts collapse to their first document in a
   combining aggregation, their windows are grouped by full content, and the owners are joined back.
4. Marks are spans of units by document and part (see `removed_spans`).

Copies of a whole text are named by their digest and handled before the sieve where their list is small enough to
broadcast; else they pass through it like other documents, with the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.llm import rolling
from wattline.llm.common import joined_small
from wattline.session import materialize

CHUNK_BYTES = 1 << 18  # texts handled by one numpy pass; a longer text is a pass of its own
SHARD_BYTES = 2 << 20  # contexts of a shard, up to the end of the last anchor
SEGMENT_BITS = 1 << 19
FILTER_BITS = 1 << 28
HOT = 200_000
_HASH = np.uint64((1 << 48) - 1)
_CONTEXTS = "hash long, doc_id long, part string, starts array<long>, context binary"
_MARKS = "doc_id long, part string, start long, stop long"
LAST_ID = (1 << 63) - 1  # the id that texts without one count under


@dataclass(frozen=True)
class Units:
    """How texts are cut: `words` or bytes, the window and the anchor gram, and whether repeats inside a document count."""

    words: bool
    span: int
    gram: int

    @property
    def inside(self) -> bool:
        return self.words


WORDS = Units(True, 20, 8)
BYTES = Units(False, 50, 16)


def text_chunks(batch: pa.RecordBatch, column: str = "text", size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, lengths) of neighbouring texts of about `size` bytes; null texts are empty."""
    texts = batch.column(column).cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.empty(0, np.uint8)
    row = 0
    while row < len(texts):
        end = int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1
        end = min(max(end, row + 1), len(texts))
        yield row, end, data[offsets[row]:offsets[end]], np.diff(offsets[row:end + 1])
        row = end


class Sequences:
    """Units of a chunk: their number per document, gram hashes and where each unit begins and ends in the bytes."""

    def __init__(self, units: Units, data: np.ndarray, lengths: np.ndarray):
        self.data, ends = data, np.cumsum(lengths)
        if units.words:
            self.begin, self.end = rolling.word_bounds(data, ends)
            per = np.searchsorted(self.begin, ends)
            self.lengths = np.diff(per, prepend=0)
            self.grams = rolling.word_grams(rolling.word_hashes(data, self.begin, self.end), units.gram)
        else:
            self.begin = self.end = None
            self.lengths = lengths
            self.grams = rolling.byte_grams(data, units.gram)
        self.runs = rolling.anchor_runs(self.grams, self.lengths, units.span, units.gram)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.doc = np.searchsorted(np.cumsum(self.lengths), self.runs[0], side="right")
        self.hash = self.grams[self.runs[2]] & _HASH if len(self.runs[2]) else np.empty(0, np.uint64)


def _counted(units: Units) -> Callable:
    def count(batches):
        for batch in batches:
            for _, _, data, lengths in text_chunks(batch):
                s = Sequences(units, data, lengths)
                if not len(s.hash):
                    continue
                # one row for each anchor of a document, with its number of places
                order = np.lexsort((s.runs[2], s.hash, s.doc))
                d, h, p = s.doc[order], s.hash[order], s.runs[2][order]
                place = np.ones(len(d), bool)
                place[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1]) | (p[1:] != p[:-1])
                d, h = d[place], h[place]
                new = np.ones(len(d), bool)
                new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
                at = np.flatnonzero(new)
                # two places of one document are a repeat where that counts; more say nothing more
                times = np.minimum(np.diff(at, append=len(d)), 2) if units.inside else np.ones(len(at), np.int64)
                # anchors of several documents of the chunk combine here already
                keys, group = np.unique(h[at], return_inverse=True)
                sums = np.bincount(group, weights=times).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(sums)], names=["hash", "n"])
    return count


def repeated_hashes(docs: DataFrame, units: Units) -> DataFrame:
    """Anchor hashes with two places or more (words) or in two documents or more (bytes), and their number."""
    counted = docs.select("text").mapInArrow(_counted(units), "hash long, n long")
    return counted.groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1")


# filter -----------------------------------------------------------------------------------------------------------------

def _bit_places(hashes: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = rolling.mixed(hashes.astype(np.uint64) + np.uint64(0x51ED27))
    mask = np.uint64(SEGMENT_BITS - 1)
    return ((x >> np.uint64(40)) % np.uint64(segments)).astype(np.int64), (x & mask).astype(np.int64), (
        (x >> np.uint64(19)) & mask).astype(np.int64)


def hash_filter(hashes: DataFrame, rows: int) -> np.ndarray | None:
    """Bits of a filter over the hashes, 16 a hash while they fit; None if under 4 bits a hash would be left.

    Segments are built by tasks; the driver gets the bits, at most FILTER_BITS / 8 bytes whatever the input.
    """
    if rows * 4 > FILTER_BITS:
        return None
    bits = SEGMENT_BITS
    while bits < min(rows * 16, FILTER_BITS):
        bits *= 2
    segments = bits // SEGMENT_BITS

    def place(batches):
        for batch in batches:
            segment, one, two = _bit_places(batch.column(0).to_numpy(), segments)
            yield pa.RecordBatch.from_arrays([pa.array(segment), pa.array(one * SEGMENT_BITS + two)], names=["segment", "at"])

    def fill(key, frame):
        out = np.zeros(SEGMENT_BITS, np.uint8)
        at = frame.column("at").to_numpy()
        out[at // SEGMENT_BITS] = 1
        out[at % SEGMENT_BITS] = 1
        return pa.table({"segment": [key[0].as_py()], "bits": [np.packbits(out, bitorder="little").tobytes()]})

    placed = hashes.select("hash").mapInArrow(place, "segment long, at long")
    built = placed.groupBy("segment").applyInArrow(fill, "segment long, bits binary").collect()
    out = np.zeros((segments, SEGMENT_BITS // 8), np.uint8)
    for row in built:
        out[row["segment"]] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return out


def in_filter(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    segment, one, two = _bit_places(hashes, len(bits))
    hit = lambda at: (bits[segment, at >> 3] >> (at & 7).astype(np.uint8)) & 1
    return (hit(one) & hit(two)).astype(bool)


# contexts ---------------------------------------------------------------------------------------------------------------

def _cut_contexts(units: Units, s: Sequences, keep: np.ndarray, ids: np.ndarray, parts: pa.Array) -> pa.RecordBatch | None:
    """Rows of the kept runs; equal contexts of a document become one row with several starts."""
    found: dict[tuple[int, bytes], list[int]] = {}
    hashes = {}
    raw = s.data.tobytes()
    first, last, _ = s.runs
    for i in np.flatnonzero(keep).tolist():
        a, b, d = int(first[i]), int(last[i]) + units.span, int(s.doc[i])
        if units.words:
            context = b" ".join([raw[x:y] for x, y in zip(s.begin[a:b].tolist(), s.end[a:b].tolist(), strict=True)])
        else:
            context = raw[a:b]
        key = (d, context)
        if key in found:
            found[key].append(a - int(s.first[d]))
        else:
            found[key], hashes[key] = [a - int(s.first[d])], int(s.hash[i])
    if not found:
        return None
    return pa.RecordBatch.from_arrays([
        pa.array(list(hashes.values()), pa.int64()), pa.array([int(ids[d]) for d, _ in found], pa.int64()),
        parts.take(pa.array([d for d, _ in found], pa.int64())), pa.array(list(found.values()), pa.list_(pa.int64())),
        pa.array([c for _, c in found], pa.binary())], names=["hash", "doc_id", "part", "starts", "context"])


def contexts(docs: DataFrame, repeated: DataFrame, units: Units) -> DataFrame:
    """All contexts with a repeated anchor: (hash, doc_id, part, starts, context)."""
    spark = docs.sparkSession
    bits = hash_filter(repeated, repeated.count())
    if bits is not None:
        shared = spark.sparkContext.broadcast(bits)

        def cut(batches):
            for batch in batches:
                ids, parts = batch.column("doc_id").to_numpy(), batch.column("part")
                for row, end, data, lengths in text_chunks(batch):
                    s = Sequences(units, data, lengths)
                    if len(s.hash):
                        out = _cut_contexts(units, s, in_filter(s.hash, shared.value), ids[row:end], parts.slice(row, end - row))
                        if out is not None:
                            yield out

        return docs.select("doc_id", "part", "text").mapInArrow(cut, _CONTEXTS)

    def named(batches):
        for batch in batches:
            for row, _, data, lengths in text_chunks(batch):
                s = Sequences(units, data, lengths)
                pairs = np.unique(np.stack([row + s.doc.astype(np.int64), s.hash.astype(np.int64)], 1), axis=0)
                at = pa.array(pairs[:, 0].copy())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("part").take(at),
                                                  pa.array(pairs[:, 1].copy())], names=["doc_id", "part", "hash"])

    def cut_listed(batches):
        for batch in batches:
            ids, lists, parts = batch.column("doc_id").to_numpy(), batch.column("hashes").to_pylist(), batch.column("part")
            for row, end, data, lengths in text_chunks(batch):
                s = Sequences(units, data, lengths)
                if len(s.hash):
                    keep = np.zeros(len(s.hash), bool)
                    for d in range(end - row):
                        mine = s.doc == d
                        keep[mine] = np.isin(s.hash[mine], np.array(lists[row + d], np.uint64))
                    out = _cut_contexts(units, s, keep, ids[row:end], parts.slice(row, end - row))
                    if out is not None:
                        yield out

    anchors = docs.select("doc_id", "part", "text").mapInArrow(named, "doc_id long, part string, hash long")
    lists = anchors.join(repeated.select("hash"), "hash").groupBy("doc_id", "part").agg(F.collect_list("hash").alias("hashes"))
    return docs.select("doc_id", "part", "text").join(lists, ["doc_id", "part"]).mapInArrow(cut_listed, _CONTEXTS)


# shards -----------------------------------------------------------------------------------------------------------------

class Shard:
    """All contexts of some anchors: the different ones, in order of their first place, and who has them.

    `data`, `lengths`: the different contexts, one after another; `owner`: their smallest document; `of`, `doc`, `part`:
    context, document and part of each row; `listed`, `count`: the starts of the rows, one after another, and their number.
    """

    def __init__(self, units: Units, rows: pa.Table):
        rows = rows.combine_chunks()
        starts = rows.column("starts").chunk(0)
        first = starts.flatten().to_numpy(zero_copy_only=False)[np.cumsum(starts.value_lengths().to_numpy()) - starts.value_lengths().to_numpy()]
        named = rows.column("part").chunk(0).dictionary_encode()
        places = np.argsort(np.argsort(named.dictionary.to_numpy(zero_copy_only=False)))[named.indices.to_numpy()]
        order = np.lexsort((first, places, rows.column("doc_id").to_numpy()))
        rows = rows.take(pa.array(order)).combine_chunks()
        starts = rows.column("starts").chunk(0)
        coded = rows.column("context").chunk(0).cast(pa.large_binary()).dictionary_encode()
        texts = coded.dictionary
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        self.units = units
        self.data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
        self.lengths = np.diff(offsets)
        self.of = coded.indices.to_numpy().astype(np.int64)
        self.doc, self.part = rows.column("doc_id").to_numpy(), rows.column("part").chunk(0)
        self.listed = starts.flatten().to_numpy(zero_copy_only=False)
        self.count = starts.value_lengths().to_numpy().astype(np.int64)
        _, self.lead = np.unique(self.of, return_index=True)
        self.owner = self.doc[self.lead]

    def marks(self, contexts_: np.ndarray, begin: np.ndarray, end: np.ndarray, sizes: np.ndarray) -> list[pa.Array]:
        """doc_id, part, start, stop from spans (ascending context, begin, end); `sizes`: units of each context.

        The first holder of a context, and for bytes its whole document, loses the spans; every later one loses all.
        """
        row = np.repeat(np.arange(len(self.of)), self.count)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(self.count) - self.count, self.count)
        first = np.zeros(len(self.of), bool)
        first[self.lead] = True
        own = first[row] & (nth == 0) if self.units.inside else (self.doc == self.owner[self.of])[row]
        whole = row[~own]
        from_ = np.searchsorted(contexts_, np.arange(len(self.lengths)))
        per = np.diff(np.append(from_, len(contexts_)))
        mine = np.flatnonzero(own)
        times = per[self.of[row[mine]]]
        at = np.repeat(mine, times)
        span = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(from_[self.of[row[mine]]], times)
        rows = np.concatenate([whole, row[at]])
        return [pa.array(self.doc[rows]), self.part.take(pa.array(rows)),
                pa.array(np.concatenate([self.listed[~own], self.listed[at] + begin[span]])),
                pa.array(np.concatenate([self.listed[~own] + sizes[self.of[whole]], self.listed[at] + end[span]]))]


def _shards(batches, size: int) -> Iterator[pa.Table]:
    """Tables of about `size` context bytes that end where the anchor changes; rows come sorted by anchor."""
    held, weight = [], 0
    for batch in batches:
        held.append(batch)
        weight += batch.column("context").nbytes
        if weight >= size:
            rows = pa.Table.from_batches(held)
            hashes = rows.column("hash").to_numpy()
            cut = int(np.searchsorted(hashes, hashes[-1]))
            if cut:
                yield rows.slice(0, cut)
                held = rows.slice(cut).to_batches()
                weight = sum(b.column("context").nbytes for b in held)
    if held:
        yield pa.Table.from_batches(held)


def spans_of_windows(marked: np.ndarray, lengths: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, begin, end) of the units covered by windows that start at the ascending marked places."""
    if not len(marked):
        return (np.empty(0, np.int64),) * 3
    ends = np.cumsum(lengths)
    context = np.searchsorted(ends, marked, side="right")
    new = np.ones(len(marked), bool)
    new[1:] = (context[1:] != context[:-1]) | (marked[1:] - marked[:-1] > span)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(marked)) - 1
    base = (ends - lengths)[context[first]]
    return context[first], marked[first] - base, marked[last] + span - base


def _hot_marks(rows: DataFrame, units: Units) -> DataFrame:
    """Marks for contexts of hot anchors, by grouping windows on their whole content.

    Equal contexts and equal windows combine before their shuffles; the joins back can be split by adaptive execution.
    """
    span = units.span
    rows = materialize(rows, "hot-contexts")
    first = rows.groupBy("context").agg(F.min(F.struct("doc_id", "part", F.col("starts")[0].alias("start"))).alias("lead"))

    def split(batches):
        for batch in batches:
            for context, lead in zip(batch.column("context").to_pylist(), batch.column("lead").to_pylist(), strict=True):
                parts = context.split(b" ") if units.words else context
                cut = [parts[i:i + span] for i in range(len(parts) - span + 1)]
                n = len(cut)
                yield pa.RecordBatch.from_arrays([
                    pa.array([context] * n, pa.binary()),
                    pa.array([b" ".join(c) if units.words else c for c in cut], pa.binary()), pa.array(range(n), pa.int64()),
                    pa.array([lead["doc_id"]] * n, pa.int64()), pa.array([lead["part"]] * n, pa.string()),
                    pa.array([lead["start"] + i for i in range(n)], pa.int64())],
                    names=["context", "window", "at", "doc_id", "part", "start"])

    windows = materialize(first.mapInArrow(
        split, "context binary, window binary, at long, doc_id long, part string, start long"), "hot-windows")
    owners = windows.groupBy("window").agg(F.min(F.struct("doc_id", "part", "start")).alias("owner"))
    known = windows.join(owners, "window").groupBy("context").agg(F.collect_list(F.struct("at", "owner")).alias("owners"))
    placed = rows.select("doc_id", "part", "context", "starts").join(known, "context").select(
        "doc_id", "part", "owners", F.explode("starts").alias("start"))
    earlier = (lambda x: F.struct(F.col("doc_id"), F.col("part"), (F.col("start") + x["at"]).alias("start")) > x["owner"]) if units.inside else (
        lambda x: F.col("doc_id") > x["owner"]["doc_id"])
    marked = placed.select("doc_id", "part", "start", F.explode(F.filter("owners", earlier)).alias("hit"))
    return marked.select("doc_id", "part", (F.col("start") + F.col("hit.at")).alias("start"),
                         (F.col("start") + F.col("hit.at") + span).alias("stop"))


def find_marks(docs: DataFrame, units: Units, method: Callable, shard_bytes: int = SHARD_BYTES, hot: int = HOT) -> DataFrame:
    """(doc_id, part, start, stop) of units to remove. `docs` holds (doc_id, part) once each, and text; none is null.

    `method` takes a shard and gives spans (context, begin, end) in units and the number of units of each context.
    """
    repeated = materialize(repeated_hashes(docs, units), "anchor-hashes")
    rows = contexts(docs, repeated, units)

    def work(batches):
        for held in _shards(batches, shard_bytes):
            shard = Shard(units, held)
            yield pa.RecordBatch.from_arrays(shard.marks(*method(shard)), names=["doc_id", "part", "start", "stop"])

    frequent = repeated.where(F.col("n") > hot).select("hash")
    if frequent.limit(1).count() == 0:
        return rows.repartition("hash").sortWithinPartitions("hash").mapInArrow(work, _MARKS)
    rare = joined_small(rows, frequent, "hash", "left_anti")
    marks = rare.repartition("hash").sortWithinPartitions("hash").mapInArrow(work, _MARKS)
    return marks.unionByName(_hot_marks(joined_small(rows, frequent, "hash", "left_semi"), units))


# whole operator -----------------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Removed:
    """`spans`: (doc_id, part, spans, whole) of the documents that lose something; `several`: ids with different texts."""

    spans: DataFrame
    several: DataFrame


def _with_part(rows: DataFrame, several: DataFrame, digest: Column) -> DataFrame:
    """`part` tells different texts of one id apart by their digest; it is empty where an id has one text."""
    if several.limit(1).count():
        rows = joined_small(rows, several.withColumn("_several", F.lit(True)), "doc_id")
    else:
        rows = rows.withColumn("_several", F.lit(None).cast("boolean"))
    named = F.coalesce(F.col("_several"), F.col("doc_id") == LAST_ID)
    return rows.withColumn("part", F.when(named, digest).otherwise("")).drop("_several")


def removed_spans(docs: DataFrame, units: Units, method: Callable, **sizes) -> Removed:
    """Spans of removed units of each document that loses some; every different text of every id is searched.

    Different texts under one doc_id are parts of one document, in order of their digests: for words an earlier part is
    an earlier start, for bytes a part takes nothing from another one. Texts with a null doc_id are parts of one document
    that comes last, together with the id 2^63 - 1. A text equal to that of a smaller doc_id is removed whole if it has
    a window (`whole`). Rows that repeat a document are one document. Null and empty texts take no part.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc_id"), "text").where("length(text) > 0")
    digest = F.md5(F.col("text").cast("binary"))
    digests = materialize(texts.select("doc_id", digest.alias("digest")), "text-digests")
    several = materialize(digests.where(F.col("doc_id") < LAST_ID).groupBy("doc_id").agg(
        F.min("digest").alias("low"), F.max("digest").alias("high")).where("low < high").select("doc_id"), "text-several")
    one = materialize(_with_part(digests.groupBy("doc_id", "digest").agg(F.count("*").alias("rows")), several,
                                 F.col("digest")), "text-parts")
    first = one.groupBy("digest").agg(F.min("doc_id").alias("lead"))
    copies = materialize(one.join(first, "digest").where("doc_id > lead").select("doc_id", "part"), "text-copies")
    again = one.where("rows > 1").select("doc_id", "part")
    searched = joined_small(_with_part(texts, several, digest), copies, ["doc_id", "part"], "left_anti")
    if again.limit(1).count():
        marked = joined_small(searched, again.withColumn("_again", F.lit(True)), ["doc_id", "part"])
        once = marked.where(F.col("_again").isNull())
        searched = once.unionByName(marked.where("_again").dropDuplicates(["doc_id", "part"])).drop("_again")
    marks = find_marks(searched, units, method, **sizes)
    spans = marks.groupBy("doc_id", "part").agg(F.collect_list(F.struct("start", "stop")).alias("spans")).withColumn(
        "whole", F.lit(False))
    none = spark.createDataFrame([], spans.schema)
    every = spans.unionByName(copies.select("doc_id", "part", F.lit(None).cast(none.schema["spans"].dataType).alias("spans"),
                                            F.lit(True).alias("whole")))
    return Removed(every, several)


def _union(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], s["stop"]) for s in spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _whole_characters(body: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans grown so that no UTF-8 character is cut in two."""
    out = []
    for a, b in spans:
        while a > 0 and a < len(body) and body[a] & 0xC0 == 0x80:
            a -= 1
        while b < len(body) and body[b] & 0xC0 == 0x80:
            b += 1
        out.append((max(a, out[-1][1]) if out else a, b))
    return out


def without_spans(docs: DataFrame, removed: Removed, units: Units, whole_characters: bool = False) -> DataFrame:
    """All columns of `docs`, and _n_units, _n_removed, _spans (maximal, in units) and _kept (bytes) of every row.

    Words are kept joined by one space, bytes as they are, or with `whole_characters` without characters that lose a
    byte, so that _kept is valid UTF-8. Columns may have any names.
    """
    fields = docs.schema.fields
    names = [f"c{i}" for i in range(len(fields))]
    inner = docs.toDF(*names)
    key, text = names[docs.columns.index("doc_id")], names[docs.columns.index("text")]
    keyed = _with_part(inner.withColumn("doc_id", F.coalesce(key, F.lit(LAST_ID))), removed.several,
                       F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    joined = keyed.join(removed.spans, ["doc_id", "part"], "left").drop("doc_id", "part")
    plain = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, fields, strict=True))
    schema = f"{plain}, _n_units long, _n_removed long, _spans array<struct<start:bigint,stop:bigint>>, _kept binary"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def work(batches):
        for batch in batches:
            size, lost, listed, kept = [], [], [], []
            cells = zip(batch.column(text).cast(pa.large_binary()).to_pylist(), batch.column("spans").to_pylist(),
                        batch.column("whole").to_pylist(), strict=True)
            for body, found, whole in cells:
                body = body or b""
                parts = body.split() if units.words else body  # bytes.split() splits at the six ASCII blanks
                cut = []
                if whole and len(parts) >= units.span:
                    cut = [(0, len(parts))]
                elif found and parts:
                    cut = _union(found)
                left, at = [], 0
                taken = _whole_characters(body, cut) if whole_characters and not units.words else cut
                for a, b in [*taken, (len(parts), len(parts))]:
                    left.extend(parts[at:a]) if units.words else left.append(parts[at:a])
                    at = b
                size.append(len(parts))
                lost.append(sum(b - a for a, b in cut))
                listed.append([{"start": a, "stop": b} for a, b in cut])
                kept.append((b" " if units.words else b"").join(left))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(size, pa.int64()), pa.array(lost, pa.int64()),
                 pa.array(listed, kind), pa.array(kept, pa.binary())],
                names=[*names, "_n_units", "_n_removed", "_spans", "_kept"])

    out = joined.mapInArrow(work, schema)
    return out.toDF(*docs.columns, "_n_units", "_n_removed", "_spans", "_kept")
