"""Aligning the tokens of two tokenizers over the same text.

Both tokenizers cut the same bytes. A token points to the token that overlaps it and reaches farthest to the right (the
owner of the byte before its end, in the other tokenization; itself if none reaches farther). Successors are doubled in
numpy for all tokens at once until nothing changes: every token then points to the last token of its group, and groups
are the runs with the same last token.

Texts are cut before single spaces between other characters: the byte-level pattern of the one tokenizer starts a new
piece there, and no entry of the other has its space mark behind another character. Both therefore have a token boundary
at such a place, no group crosses it, and a segment is encoded and aligned once per task however often it occurs
(frequent segments are remembered, in a table of bounded size). The result of a text is put together from its segments.

How many documents hold a pair of ids linked is counted from the distinct pairs of each document, combined in each task.
The counts come back to the documents in two ways with the same result: the most frequent pairs, at most `FREQUENT` of
them whatever the input, are broadcast, and the others, which few documents hold, are joined by a shuffle.

Defined results: null and empty texts have no tokens, and so have texts that a tokenizer does not give back byte for
byte (the mark of a space inside a text, characters that are normalized); their numbers are zero and their digest empty.
Strings of special tokens are plain text. Every row is a document of its own, repeated rows count each, and null ids stay.
Other columns of the input are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm.repeats import text_chunks
from wattline.session import materialize

FREQUENT = 1_000_000
REMEMBERED = 100_000
LONGEST_KEPT = 1 << 16
LONG_GROUP = 4096
ENCODED = 1000
PASS_BYTES = 1 << 20
#: Bytes that may begin a blank for the byte-level pattern: control characters, and the lead bytes of Unicode blanks.
_UNSURE = np.zeros(256, bool)
_UNSURE[[*range(33), 127, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_MARK = "▁"


def _paths(first: str | None, second: str | None) -> tuple[str, str]:
    import public_tokenizers

    return first or public_tokenizers.path("byte_bpe_50k.json"), second or public_tokenizers.path("piece_bpe_32k.model")


def _byte_letters() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, the rest for letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoders:
    """Both tokenizers, and the bytes of every entry."""

    def __init__(self, first: str, second: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.a = Tokenizer.from_file(first)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        letters, added = _byte_letters(), {i: t.content.encode() for i, t in self.a.get_added_tokens_decoder().items()}
        entries = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = {i: added.get(i) or bytes([letters[c] for c in s]) for s, i in entries.items()}
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_sizes = np.zeros(max(self.a_bytes) + 1, np.int64)
        for i, raw in self.a_bytes.items():
            self.a_sizes[i] = len(raw)
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int64)

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(_MARK, " ").encode()

    def encode(self, raws: list[bytes]) -> list[tuple[list[int], list[int]] | None]:
        """Ids of both tokenizers for each text with a space before it; None where the bytes are not given back."""
        out = []
        for at in range(0, len(raws), ENCODED):  # an encoding takes far more memory than its ids
            part = raws[at:at + ENCODED]
            texts = [r.decode() for r in part]
            first = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
            for raw, a, b in zip(part, first, self.b.encode(texts, num_threads=1), strict=True):
                ids, whole = a.ids, b" " + raw
                same = b"".join([self.a_bytes[i] for i in ids]) == whole and b"".join([self.b_bytes[i] for i in b]) == whole
                out.append((ids, b) if same else None)
        return out


@lru_cache(maxsize=2)
def encoders(first: str, second: str) -> Encoders:
    return Encoders(first, second)


def last_of_group(a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """For all tokens of a, then of b, the place of the last token of the group (one of b), by pointer jumping.

    `a_ends`, `b_ends`: where the tokens, none of them empty, end in the same bytes.
    """
    n = len(a_ends)
    ends = np.concatenate([a_ends, b_ends])
    over = np.concatenate([n + np.searchsorted(b_ends, a_ends), np.searchsorted(a_ends, b_ends)])
    here = np.arange(len(ends))
    to = np.where((ends[over] > ends) | ((ends[over] == ends) & (here < n)), over, here)
    while True:
        jumped = to[to]
        if np.array_equal(jumped, to):
            return to
        to = jumped


def _added(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order and the exact sums of their times."""
    if not len(keys):
        return keys, times
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(times, first)


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers starts[i], ..., starts[i] + sizes[i] - 1 one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(int(sizes.sum()))


def _linked(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, pair, times) of the id pairs of each group; a pair has the id of a in its upper half."""
    at_a, at_b, links = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b, n_a * n_b
    small = np.flatnonzero(links <= LONG_GROUP)
    group = np.repeat(small, links[small])
    place = _runs(np.zeros(len(small), np.int64), links[small])
    found = [(group, a[at_a[group] + place // n_b[group]] << 32 | b[at_b[group] + place % n_b[group]], np.ones(len(group), np.int64))]
    for g in np.flatnonzero(links > LONG_GROUP).tolist():  # few different ids in many places
        (u, n), (v, m) = (np.unique(x[i:i + k], return_counts=True) for x, i, k in ((a, at_a[g], n_a[g]), (b, at_b[g], n_b[g])))
        found.append((np.full(len(u) * len(v), g), (u[:, None] << 32 | v).ravel(), (n[:, None] * m).ravel()))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


@dataclass
class Segments:
    """Aligned segments: numbers of each, the text of its groups, and its different linked pairs one after another."""

    whole: np.ndarray
    numbers: np.ndarray  # tokens of a, tokens of b, groups, links
    text: list[str]
    sizes: np.ndarray
    pairs: np.ndarray
    times: np.ndarray

    @classmethod
    def none(cls) -> Segments:
        return cls(np.empty(0, bool), np.empty((0, 4), np.int64), [], *(np.empty(0, np.int64) for _ in range(3)))

    def followed(self, other: Segments) -> Segments:
        mine, theirs = vars(self).values(), vars(other).values()
        return Segments(*[x + y if isinstance(x, list) else np.concatenate([x, y]) for x, y in zip(mine, theirs, strict=True)])


def align(tools: Encoders, raws: list[bytes]) -> Segments:
    """All segments at once: their tokens follow one another, and no group crosses from one to the next."""
    coded = tools.encode(raws)
    whole = np.array([x is not None for x in coded], bool)
    lists = [x or ([], []) for x in coded]
    counts = np.array([(len(a), len(b)) for a, b in lists], np.int64).reshape(-1, 2)
    a, b = (np.fromiter(chain.from_iterable(x[i] for x in lists), np.int64, int(counts[:, i].sum())) for i in (0, 1))
    to = last_of_group(np.cumsum(tools.a_sizes[a]), np.cumsum(tools.b_sizes[b]))
    last, group = np.unique(to, return_inverse=True)
    n_a, n_b = np.bincount(group[:len(a)], minlength=len(last)), np.bincount(group[len(a):], minlength=len(last))
    segment = np.repeat(np.arange(len(raws)), counts[:, 1])[last - len(a)]
    groups = np.bincount(segment, minlength=len(raws))
    links = np.zeros(len(raws), np.int64)
    np.add.at(links, segment, n_a * n_b)

    names_a, names_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
    ends_a, ends_b = np.cumsum(n_a).tolist(), np.cumsum(n_b).tolist()
    of_group = [",".join(names_a[i:j]) + "|" + ",".join(names_b[k:m])
                for i, j, k, m in zip([0, *ends_a], ends_a, [0, *ends_b], ends_b, strict=False)]
    ends = np.cumsum(groups).tolist()
    text = [";".join(of_group[i:j]) for i, j in zip([0, *ends], ends, strict=False)]

    at, pair, times = _linked(a, b, n_a, n_b)
    different, code = np.unique(pair, return_inverse=True)
    keys, times = _added(segment[at] * max(len(different), 1) + code, times)
    sizes = np.bincount(keys // max(len(different), 1), minlength=len(raws))
    return Segments(whole, np.column_stack([counts, groups, links]), text, sizes, different[keys % max(len(different), 1)], times)


class Aligner:
    """Aligned segments of texts; the first `REMEMBERED` different ones are kept for the texts to come."""

    def __init__(self, first: str, second: str):
        self.tools, self.place, self.kept = encoders(first, second), {}, Segments.none()

    def of(self, raws: list[bytes]) -> tuple[np.ndarray, Segments]:
        """Where each of the different segments lies in the table that follows."""
        at = np.array([self.place.get(r, -1) for r in raws], np.int64)
        new = np.flatnonzero(at < 0)
        table = self.kept
        if len(new):
            fresh = [raws[i] for i in new.tolist()]
            at[new] = len(table.text) + np.arange(len(new))
            table = table.followed(align(self.tools, fresh))
            if len(self.place) < REMEMBERED and max(map(len, fresh)) <= LONGEST_KEPT:
                self.place.update(zip(fresh, at[new].tolist(), strict=True))
                self.kept = table
        return at, table


def cut_texts(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes without the spaces at which texts are cut, where segments start in them, and the text of each segment."""
    ends = np.cumsum(lengths)
    begins = (ends - lengths)[lengths > 0]
    inner = np.ones(len(data) + 1, bool)
    inner[begins], inner[ends - 1] = False, False
    at = np.flatnonzero((data == 32) & inner[:-1])
    at = at[(data[at - 1] != 32) & ~_UNSURE[data[at + 1]]]
    keep = np.ones(len(data), bool)
    keep[at] = False
    starts = np.sort(np.concatenate([begins, at]))
    moved = np.cumsum(keep) - keep
    return data[keep], moved[starts], np.searchsorted(ends, starts, side="right")


_ALIGNERS: dict[tuple[str, str], Aligner] = {}
_ROWS = ("row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>,"
         " times array<long>")


def aligned_rows(docs: DataFrame, first: str | None = None, second: str | None = None) -> DataFrame:
    """Numbers, digest and different linked pairs of each document, numbered within its task."""
    def run(batches):
        paths = _paths(first, second)
        aligner = _ALIGNERS.setdefault(paths, _ALIGNERS.get(paths) or Aligner(*paths))
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for begin, end, data, lengths in text_chunks(batch, size=PASS_BYTES):
                n = end - begin
                solid, starts, doc = cut_texts(data, lengths)
                offsets = np.append(starts, len(solid)).astype(np.int32)
                cells = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(solid)]).dictionary_encode()
                at, table = aligner.of(cells.dictionary.to_pylist())
                code = at[cells.indices.to_numpy()] if len(starts) else np.empty(0, np.int64)
                whole = np.ones(n, bool)
                np.logical_and.at(whole, doc, table.whole[code])
                good = whole[doc]
                doc, code = doc[good], code[good]
                numbers = np.zeros((n, 4), np.int64)
                np.add.at(numbers, doc, table.numbers[code])
                cut = np.searchsorted(doc, np.arange(n + 1)).tolist()
                texts, codes = table.text, code.tolist()
                digests = [hashlib.sha256(";".join([texts[c] for c in codes[i:j]]).encode()).hexdigest() if j > i else ""
                           for i, j in zip(cut, cut[1:], strict=False)]
                held, times = np.unique(doc * max(len(texts), 1) + code, return_counts=True)
                doc, code = held // max(len(texts), 1), held % max(len(texts), 1)
                sizes = table.sizes[code]
                place = _runs((np.cumsum(table.sizes) - table.sizes)[code], sizes)
                different, pair = np.unique(table.pairs[place], return_inverse=True)
                keys, times = _added(np.repeat(doc, sizes) * max(len(different), 1) + pair, table.times[place] * np.repeat(times, sizes))
                lists = pa.array(np.searchsorted(keys, np.arange(n + 1) * max(len(different), 1)), pa.int32())
                pairs = pa.array(different[keys % max(len(different), 1)], pa.int64())
                yield pa.RecordBatch.from_arrays([
                    pa.array(row + begin + np.arange(n)), batch.column("doc_id").slice(begin, n),
                    *[pa.array(numbers[:, i]) for i in range(4)], pa.array(digests, pa.string()),
                    pa.ListArray.from_arrays(lists, pairs), pa.ListArray.from_arrays(lists, pa.array(times, pa.int64()))],
                    names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
            row += len(batch)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _ROWS)


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, docs (documents that hold it linked), best (no pair of its first id is held by more)."""
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("docs"))
    counts = materialize(counts, "pair-counts")
    most = counts.groupBy(F.shiftright("pair", 32).alias("first")).agg(F.max("docs").alias("most"))
    return counts.join(most, F.shiftright("pair", 32) == F.col("first")).select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def split_frequent(counts: DataFrame, most: int = FREQUENT) -> tuple[DataFrame, DataFrame]:
    """The most frequent pairs, `most` at most, and all others, cut at a step of their number of documents."""
    level = F.floor(F.log2("docs") * 8).cast("int")
    steps = counts.groupBy(level.alias("level")).count().orderBy(F.col("level").desc()).collect()  # a few hundred rows at most
    least, total = 1 << 20, 0
    for step in steps:
        total += step["count"]
        if total > most:
            break
        least = step["level"]
    return counts.where(level >= least), counts.where(level < least)


def alignment(docs: DataFrame, first: str | None = None, second: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    rows = materialize(aligned_rows(docs, first, second), "aligned-rows")
    often, seldom = split_frequent(materialize(pair_counts(rows), "pair-table"), frequent)
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select(
        "row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
            F.sum(F.col("times") * F.col("docs")).alias("count_sum")]
    near = links.join(F.broadcast(often), "pair").groupBy("row").agg(*sums)
    far = links.join(F.broadcast(often.select("pair")), "pair", "left_anti").join(seldom, "pair").groupBy("row").agg(*sums)
    valued = near.unionByName(far).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return rows.drop("pairs", "times").join(valued, "row", "left").na.fill(0, ["n_best", "count_sum"]).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
