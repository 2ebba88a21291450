"""Exact removal of byte strings that repeat across documents, with suffix arrays of shards.

A shard (see `repeats`) holds all contexts of some anchors, so that all places of any string it decides are inside it.
Its different contexts are cut into pieces of bounded size. Each piece gets a suffix array by Larsson-Sadakane
refinement: suffixes are sorted by their first 8 bytes, and only groups that are still unsorted are sorted again by the
rank of the suffix 8, 16, 32 places on, until the order reaches past the window. Common prefixes of neighbours are found
in text order against the predecessor in the array, as Kasai's method does, but eight bytes at a time for all places at
once, and only up to the window. Neighbours with a common prefix of a whole window hold the same string, and its owner
is their smallest document. Several pieces of a shard (a frequent anchor) are merged by binary search of the strings of
one piece in the ordered strings of each other.

Defined results (all from `repeats.removed_spans`): null, empty and short texts lose nothing; a copy of a whole text of
fifty bytes or more loses everything; repeated rows are one document and are treated alike; a repeat inside one document
alone is kept; different texts under one id are parts
of one document, and texts without an id are parts of one that comes last; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm import rolling
from wattline.llm.repeats import BYTES, Shard, removed_spans, spans_of_windows, without_spans

PIECE_BYTES = 8 << 20


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of `text` ordered by their first `depth` bytes at least."""
    n = len(text)
    key = rolling.byte_words(text).byteswap()
    order = np.argsort(key).astype(np.int32)  # a piece is far below 2 ** 31 bytes
    ordered = key[order]
    new = np.ones(n + 1, bool)
    new[1:n] = ordered[1:] != ordered[:-1]
    del key, ordered
    group = np.maximum.accumulate(np.where(new[:n], np.arange(n, dtype=np.int32), np.int32(0)))
    rank = np.empty(n, np.int32)
    rank[order] = group
    sorted_to = 8
    while sorted_to < depth:
        open_ = np.flatnonzero(~(new[:n] & new[1:])).astype(np.int32)
        if not len(open_):
            break
        places = order[open_]
        ahead = places + sorted_to
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        both = (group[open_].astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
        by = np.argsort(both)
        places, both = places[by], both[by]
        order[open_] = places
        new[open_[1:]] = both[1:] != both[:-1]
        new[open_[0]] = True
        at = np.maximum.accumulate(np.where(new[open_], open_, np.int32(0)))
        group[open_] = at
        rank[places] = at
        sorted_to *= 2
    return order


def same_as_before(words: np.ndarray, order: np.ndarray, span: int) -> np.ndarray:
    """Has each place of the ordered ones a common prefix of `span` bytes with the one before?

    The common prefix grows by eight bytes for all places at once; only places still equal go on.
    """
    alive = np.arange(1, len(order))
    for at in [*range(0, span - 8, 8), span - 8]:
        alive = alive[words[order[alive] + at] == words[order[alive - 1] + at]]
    out = np.zeros(len(order), bool)
    out[alive] = True
    return out


class Piece:
    """The ordered different strings of some contexts: where they start, and the smallest document of each."""

    def __init__(self, text: np.ndarray, lengths: np.ndarray, owner: np.ndarray, span: int):
        starts = rolling.window_starts(lengths, span)
        order = suffix_array(text, span)
        order = order[starts[order]]
        words = rolling.byte_words(text)
        self.order = order
        self.string = np.cumsum(~same_as_before(words, order, span)) - 1
        context = np.searchsorted(np.cumsum(lengths), order, side="right")
        self.mine = owner[context]
        first = np.flatnonzero(np.diff(self.string, prepend=-1))
        self.owner = np.minimum.reduceat(self.mine, first) if len(first) else self.mine
        self.text, self.first, self.span = text, order[first], span

    def strings(self) -> np.ndarray:
        cells = self.text[self.first[:, None] + np.arange(self.span)]
        return np.ascontiguousarray(cells).view(f"S{self.span}").ravel()

    def repeated(self) -> np.ndarray:
        """Ascending starts of strings whose owner is a smaller document."""
        return np.sort(self.order[self.owner[self.string] < self.mine]) if len(self.order) else self.order


def merge_owners(pieces: list[Piece]) -> None:
    """Give every string the smallest owner over all pieces, by binary search in their ordered strings."""
    strings, own = [p.strings() for p in pieces], [p.owner.copy() for p in pieces]
    for i, mine in enumerate(strings):
        for j, other in enumerate(strings):
            if i != j and len(mine) and len(other):
                at = np.minimum(np.searchsorted(other, mine), len(other) - 1)
                same = other[at] == mine
                pieces[i].owner[same] = np.minimum(pieces[i].owner[same], own[j][at[same]])


def repeated_starts(text: np.ndarray, lengths: np.ndarray, owner: np.ndarray, span: int = BYTES.span,
                    piece_bytes: int = PIECE_BYTES) -> np.ndarray:
    """Ascending starts of strings of `span` bytes that also start in a sequence with a smaller owner."""
    ends = np.cumsum(lengths)
    pieces, bases, row = [], [], 0
    while row < len(lengths):
        base = int(ends[row] - lengths[row])
        end = max(int(np.searchsorted(ends, base + piece_bytes, side="right")), row + 1)
        pieces.append(Piece(text[base:ends[end - 1]], lengths[row:end], owner[row:end], span))
        bases.append(base)
        row = end
    if len(pieces) > 1:
        merge_owners(pieces)
    return np.concatenate([p.repeated() + base for p, base in zip(pieces, bases, strict=True)])


def _method(shard: Shard, piece_bytes: int = PIECE_BYTES):
    marked = repeated_starts(shard.data, shard.lengths, shard.owner, piece_bytes=piece_bytes)
    return *spans_of_windows(marked, shard.lengths, BYTES.span), shard.lengths


def suffix_dedup(docs: DataFrame, whole_characters: bool = False, **sizes) -> DataFrame:
    """All columns of `docs`, and _n_units, _n_removed, _spans (in bytes) and _kept (bytes) of every row."""
    own = docs.select("doc_id", "text")
    return without_spans(docs, removed_spans(own, BYTES, _method, **sizes), BYTES, whole_characters)


def byte_report(docs: DataFrame, **sizes) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans and kept of every document."""
    done = suffix_dedup(docs.select("doc_id", "text"), **sizes)
    return done.select("doc_id", F.col("_n_units").alias("n_bytes"), F.col("_n_removed").alias("n_removed"),
                       F.size("_spans").cast("long").alias("n_spans"), F.col("_spans").alias("spans"), F.col("_kept").alias("kept"))
