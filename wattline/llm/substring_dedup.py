"""Exact removal of repeated word runs with fixed-block anchors.

The words of a shard (see `repeats`) are numbered in corpus order. Blocks of ten words that do not overlap are cut from
every context, and the first block of each content is the reference. Every rolling window of ten words probes the
references; a hit on an earlier place is extended to both sides while the words are equal, which gives the maximal exact
repeat around it as far as windows of the context reach. Windows of twenty words inside it are marked. A window that met
an earlier reference but is not covered by its repeat may still repeat a later block of the same content: those few
windows are compared by their whole content, and all but the first are marked. So every repeated window is found: its
first place holds a whole block, and unless that is the reference itself, both places meet the same earlier reference.

Words are compared by their 64-bit hashes, ten to thirty at a time. Defined results (all from `repeats.removed_spans`):
null, blank and short texts lose nothing; a copy of a whole text of twenty words or more loses everything; repeated rows
are one document and are treated alike; different texts under one id are parts
of one document, and texts without an id are parts of one that comes last; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm import rolling
from wattline.llm.repeats import WORDS, Shard, removed_spans, spans_of_windows, without_spans

BLOCK = 10


def _equal_run(ids: np.ndarray, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray, step: int,
               most: int) -> np.ndarray:
    """How many units from `left` and `right` on, in direction `step`, are equal inside their contexts, up to `most`."""
    run, alive = np.zeros(len(left), np.int64), np.ones(len(left), bool)
    for i in range(most):
        a, b = left + step * i, right + step * i
        alive &= (a >= low[0]) & (a < high[0]) & (b >= low[1]) & (b < high[1])
        alive[alive] = ids[a[alive]] == ids[b[alive]]
        run += alive
    return run


def repeated_windows(ids: np.ndarray, lengths: np.ndarray, span: int = WORDS.span, block: int = BLOCK) -> np.ndarray:
    """Ascending starts of the windows of `span` units, inside one sequence, that also start earlier."""
    ends = np.cumsum(lengths)
    begins = ends - lengths
    sequence = np.repeat(np.arange(len(lengths)), lengths)
    grams = rolling.word_grams(ids, block)
    probes = np.flatnonzero(rolling.window_starts(lengths, block)[:len(grams)])
    blocks = probes[(probes - begins[sequence[probes]]) % block == 0]
    content, first = np.unique(grams[blocks], return_index=True)
    reference = blocks[first]
    at = np.minimum(np.searchsorted(content, grams[probes]), max(len(content) - 1, 0))
    hit = (content[at] == grams[probes]) & (reference[at] < probes) if len(content) else np.zeros(len(probes), bool)
    q, r = probes[hit], reference[at[hit]]
    low = begins[sequence[q]], begins[sequence[r]]
    high = ends[sequence[q]], ends[sequence[r]]
    whole = _equal_run(ids, q, r, low, high, 1, block) == block
    q, r = q[whole], r[whole]
    low, high = (low[0][whole], low[1][whole]), (high[0][whole], high[1][whole])
    rest = span - block
    before = _equal_run(ids, q - 1, r - 1, low, high, -1, rest)
    after = _equal_run(ids, q + block, r + block, low, high, 1, rest)
    long = before + after >= rest
    open_ = np.zeros(len(ids) + 1, np.int64)
    np.add.at(open_, q[long] - before[long], 1)
    np.add.at(open_, q[long] - rest + after[long] + 1, -1)
    marked = np.cumsum(open_[:-1]) > 0
    near = np.zeros(len(ids) + 1, np.int64)
    np.add.at(near, np.maximum(q - rest, low[0]), 1)
    np.add.at(near, q + 1, -1)
    valid = rolling.window_starts(lengths, span)
    doubt = np.flatnonzero((np.cumsum(near[:-1]) > 0) & ~marked & valid)
    if len(doubt):
        rows = np.ascontiguousarray(ids[doubt[:, None] + np.arange(span)]).view(f"V{8 * span}").ravel()
        _, kept = np.unique(rows, return_index=True)
        again = np.ones(len(doubt), bool)
        again[kept] = False
        marked[doubt[again]] = True
    return np.flatnonzero(marked & valid)


def _method(shard: Shard):
    starts, ends = rolling.word_bounds(shard.data, np.cumsum(shard.lengths))
    lengths = np.diff(np.searchsorted(starts, np.cumsum(shard.lengths)), prepend=0)
    ids = rolling.word_hashes(shard.data, starts, ends)
    return *spans_of_windows(repeated_windows(ids, lengths), lengths, WORDS.span), lengths


def substring_dedup(docs: DataFrame, **sizes) -> DataFrame:
    """doc_id, n_words, n_removed, spans (in words) and kept (UTF-8 bytes of the kept words) of every document."""
    own = docs.select("doc_id", "text")
    done = without_spans(own, removed_spans(own, WORDS, _method, **sizes), WORDS)
    return done.select("doc_id", F.col("_n_units").alias("n_words"), F.col("_n_removed").alias("n_removed"),
                       F.col("_spans").alias("spans"), F.col("_kept").alias("kept"))
