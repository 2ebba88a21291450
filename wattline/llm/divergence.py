"""How far sources are apart in the terms they use, by factorizing texts into chunks.

A chunk is a run of characters without ASCII blanks. Chunks are counted per document, each distinct chunk of a pass over
neighbouring texts is cut into terms once, and its terms are joined back to the documents that hold it. A pass holds its
documents whole, so that it knows the distinct documents of a term beside its occurrences; both are sums from there on,
as no document is in two passes. Passes of a task are combined per group of language and source before the shuffle, so
what is shuffled are terms, of which there are fewer than chunks.

Shares are whole numbers, a billion to one, smoothed by two for each kept term. Sources are compared in tiles of sources
and terms: a tile is a dense block of shares in which an absent term has the group's share for no occurrence; terms that
no source of a tile holds add the same amount each, and are added once by their number.

Skew: a frequent term or a large source is combined in each task before the shuffle, so that a term has one row for each
group and task there, and one for each group later.

Defined results: null texts, languages and sources count as empty; every row is a document of its own, so that repeated rows
and null or repeated ids count each; a language without kept terms has pairs of value 0 and no terms; an empty table has
no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattline.llm import rolling
from wattline.llm.common import BLANKS
from wattline.llm.repeats import text_chunks
from wattline.session import materialize

#: Fixed by the contract: what a term is, how a share is scaled and smoothed.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE, SMOOTH = 1_000_000_000, 2
LEAST_DOCS, TOP = 10, 10
PASS_BYTES, TASK_BYTES = 8 << 20, 32 << 20  # texts of a pass, and those whose passes a task combines before it sends them on
SEND_ROWS = 1 << 16
SOURCE_BLOCK, TERM_BLOCK = 256, 4096
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same by bytes: all bytes of a character beyond ASCII belong to a term, and only A-Z are lowered.
_IN_TERM = np.array([bool(re.match(TERM, chr(i))) for i in range(128)] + [True] * 128)
_LOWERED = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def _groups(batch: pa.RecordBatch, group_of: dict[tuple[str, str], int]) -> np.ndarray:
    """The number of the language and source of each row; new ones are added to `group_of`."""
    rows = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
    return np.array([group_of.setdefault(r, len(group_of)) for r in rows], np.int64)


def _names(group_of: dict[tuple[str, str], int]) -> tuple[pa.Array, pa.Array]:
    langs, sources = (pa.array([g[i] for g in group_of], pa.string()) for i in (0, 1))
    return langs, sources


def _chunked(batch: pa.RecordBatch):
    """(first row, end row, distinct chunks, document of each (document, chunk) pair, its chunk, its count)."""
    for first, last, data, lengths in text_chunks(batch, size=PASS_BYTES):
        ends = np.cumsum(lengths)
        starts, _ = rolling.word_bounds(data, ends)
        if not len(starts):
            continue
        # a cell reaches to the next chunk, with the blanks between them
        offsets = np.append(starts, len(data)).astype(np.int32)
        cells = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        merged = pc.utf8_rtrim(cells.dictionary, characters=BLANKS).dictionary_encode()
        chunks, code = merged.dictionary, merged.indices.to_numpy()[cells.indices.to_numpy()].astype(np.int64)
        doc = np.searchsorted(ends, starts, side="right")
        pairs, times = np.unique(doc * len(chunks) + code, return_counts=True)
        yield first, last, chunks, pairs // len(chunks), pairs % len(chunks), times


def _count_chunks(batches):
    for batch in batches:
        group_of: dict[tuple[str, str], int] = {}
        group = _groups(batch, group_of)
        langs, sources = _names(group_of)
        for first, _, chunks, doc, code, times in _chunked(batch):
            keys, at = np.unique(group[first + doc] * len(chunks) + code, return_inverse=True)
            which = pa.array(keys // len(chunks))
            yield pa.RecordBatch.from_arrays([
                langs.take(which), sources.take(which), chunks.take(pa.array(keys % len(chunks))),
                pa.array(np.bincount(at, weights=times).astype(np.int64)), pa.array(np.bincount(at))],
                names=["lang", "source", "chunk", "n", "docs"])


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def chunk_counts(docs: DataFrame) -> DataFrame:
    """lang, source, chunk, n (occurrences), docs (documents with the chunk): the factors over a whole table."""
    counted = _plain(docs).mapInArrow(_count_chunks, "lang string, source string, chunk string, n long, docs long")
    return counted.groupBy("lang", "source", "chunk").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def chunk_terms(chunks: DataFrame) -> DataFrame:
    """chunk, term, times: every distinct chunk of a table is cut into terms once."""
    lowered = F.translate("chunk", _UPPER, _LOWER)
    cut = chunks.select("chunk").distinct().select("chunk", F.explode(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))).alias("term"))
    return cut.groupBy("chunk", "term").agg(F.count(F.lit(1)).alias("times"))


# terms of passes --------------------------------------------------------------------------------------------------------

def _cut(chunks: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct terms of distinct chunks; the terms of each chunk by number, and how many it has."""
    offsets = np.frombuffer(chunks.buffers()[1], np.int32)[chunks.offset:chunks.offset + len(chunks) + 1]
    data = np.frombuffer(chunks.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    solid = _IN_TERM[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    begins[offsets[:-1]] = solid[offsets[:-1]]  # no chunk is empty, and no term crosses into the next
    starts = np.flatnonzero(begins)
    ends = np.append((np.cumsum(solid) - 1)[starts], solid.sum()).astype(np.int32)
    terms = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(_LOWERED[data[solid]])]).dictionary_encode()
    return terms.dictionary, terms.indices.to_numpy().astype(np.int64), np.diff(np.searchsorted(starts, offsets))


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys in order, and the sums of their values."""
    order = np.argsort(keys)
    keys = keys[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[at], *[np.add.reduceat(v[order], at) if len(at) else v for v in values]


def _pass_terms(batch: pa.RecordBatch, group: np.ndarray):
    """(distinct terms, term of each (term, group) pair, its group, its occurrences, its documents) of each pass."""
    for first, last, chunks, doc, code, times in _chunked(batch):
        terms, of_chunk, per = _cut(chunks)
        each = per[code]
        at = np.repeat((np.cumsum(per) - per)[code] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        # documents in order of their groups: then the documents of a group are neighbours within a term
        by_group = np.argsort(group[first:last], kind="stable")
        place = np.empty(last - first, np.int64)
        place[by_group] = np.arange(last - first)
        held, n = _summed(of_chunk[at] * (last - first) + np.repeat(place[doc], each), np.repeat(times, each))
        term, own = held // (last - first), group[first:last][by_group][held % (last - first)]
        new = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (own[1:] != own[:-1]))[:len(held)])
        if len(new):
            yield terms, term[new], own[new], np.add.reduceat(n, new), np.diff(new, append=len(held))


def _combined(passes: list, group_of: dict[tuple[str, str], int]):
    """One row for each group and term of some passes."""
    if not passes:
        return
    langs, sources = _names(group_of)
    merged = pa.concat_arrays([p[0] for p in passes]).dictionary_encode()
    code = merged.indices.to_numpy().astype(np.int64)
    firsts = np.cumsum([0] + [len(p[0]) for p in passes])
    keys = np.concatenate([code[at + p[1]] * len(group_of) + p[2] for at, p in zip(firsts, passes, strict=False)])
    keys, n, docs = _summed(keys, *[np.concatenate([p[i] for p in passes]) for i in (3, 4)])
    for at in range(0, len(keys), SEND_ROWS):
        some = slice(at, at + SEND_ROWS)
        which = pa.array(keys[some] % len(group_of))
        yield pa.RecordBatch.from_arrays([
            langs.take(which), sources.take(which), merged.dictionary.take(pa.array(keys[some] // len(group_of))),
            pa.array(n[some]), pa.array(docs[some])], names=["lang", "source", "term", "n", "docs"])


def _count_terms(batches):
    passes, size, group_of = [], 0, {}
    for batch in batches:
        passes += _pass_terms(batch, _groups(batch, group_of))
        size += batch.column("text").nbytes
        if size >= TASK_BYTES:
            yield from _combined(passes, group_of)
            passes, size, group_of = [], 0, {}
    yield from _combined(passes, group_of)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, count (occurrences), docs (documents with the term); the rows of a language's term are together.

    Tasks have combined their rows already, so they are dealt by term at once, and sums need no further shuffle.
    """
    counted = _plain(docs).mapInArrow(_count_terms, "lang string, source string, term string, n long, docs long")
    return counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(
        F.sum("n").alias("count"), F.sum("docs").alias("docs"))


# statistics -------------------------------------------------------------------------------------------------------------

def term_statistics(docs: DataFrame, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """(lang, source, term, count) and (lang, term, count): occurrences of the kept terms in groups and languages.

    A term is kept in a language if at least `least_docs` of its documents hold it.
    """
    whole = F.sum("docs").over(Window.partitionBy("lang", "term"))
    held = term_counts(docs).withColumn("whole", whole).where(F.col("whole") >= least_docs)
    groups = materialize(held.select("lang", "source", "term", "count"), "kept-group-terms")
    return groups, materialize(groups.groupBy("lang", "term").agg(F.sum("count").alias("count")), "kept-terms")


def _share(count: str, total: str, kept: str):
    """The exact smoothed share of a count, one at least."""
    return F.expr(f"1 + CAST({SCALE} AS DECIMAL(10, 0)) * CAST({count} + {SMOOTH} AS DECIMAL(20, 0))"
                  f" div CAST({total} + {SMOOTH} * {kept} AS DECIMAL(20, 0))")


def _gap(p: str, q: str):
    return F.expr(f"({p} - {q}) * ({p} - {q}) div ({p} + {q})")


def _compare(key, cells, sources) -> pa.Table:
    """Gaps of all pairs of sources of a tile over the terms that one of them holds, and the number of these terms."""
    a, b = (x.as_py() for x in key[1:3])
    names, block = sources.column("source").to_pylist(), sources.column("block").to_numpy()
    place = {name: i for i, name in enumerate(names)}
    terms = cells.column("term").combine_chunks().dictionary_encode()
    seen = len(terms.dictionary)
    shares = np.repeat(sources.column("rest").to_numpy()[:, None], max(seen, 1), axis=1)
    if seen:
        at = np.array([place[x] for x in cells.column("source").to_pylist()], np.int64)
        shares[at, terms.indices.to_numpy()] = cells.column("share").to_numpy()
    left, right, sums = [], [], []
    for i in np.flatnonzero(block == a).tolist():
        others = np.flatnonzero((block == b) & ((np.arange(len(names)) > i) | (a != b)))
        if seen and len(others):
            gap = shares[i] - shares[others]
            sums += (gap * gap // (shares[i] + shares[others])).sum(axis=1).tolist()
        else:
            sums += [0] * len(others)
        left += [names[i]] * len(others)
        right += [names[j] for j in others.tolist()]
    lang = key[0].as_py()
    return pa.table({"lang": pa.array([lang] * len(left), pa.string()), "one": pa.array(left, pa.string()),
                     "two": pa.array(right, pa.string()), "gap": pa.array(sums, pa.int64()),
                     "seen": pa.array([seen] * len(left), pa.int64())})


def source_gaps(cells: DataFrame, groups: DataFrame, term_block: int = TERM_BLOCK) -> DataFrame:
    """lang, source, item, value: the summed gap of every two sources of a language.

    `groups` has lang, source, rest (the share of an absent term, null without kept terms), kept (terms of the language)
    and blocks (blocks of its sources); `cells` has lang, source, term, share.
    """
    parts = F.greatest(F.lit(1), F.ceil(F.col("kept") / term_block)).cast("int")
    block = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")
    placed = groups.withColumn("block", block).withColumn("parts", parts).withColumn("rest", F.coalesce("rest", F.lit(1)))
    beside = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    beside = materialize(beside.withColumn("a", F.least("block", "other")).withColumn("b", F.greatest("block", "other")), "source-tiles")
    rows = beside.select("lang", "a", "b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "source", "block", "rest")
    ends = beside.select(*[F.col(c).alias(f"of_{c}") for c in ("lang", "source", "a", "b", "parts")])
    ours = (cells["lang"] == ends["of_lang"]) & (cells["source"] == ends["of_source"])
    dealt = cells.join(ends, ours).select(
        "lang", F.col("of_a").alias("a"), F.col("of_b").alias("b"), F.pmod(F.xxhash64("term"), F.col("of_parts")).cast("int").alias("part"), "source", "term", "share")
    keys = ["lang", "a", "b", "part"]
    tiles = dealt.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(
        _compare, "lang string, one string, two string, gap long, seen long")
    summed = tiles.groupBy("lang", "one", "two").agg(F.sum("gap").alias("gap"), F.sum("seen").alias("seen"))
    rest = groups.select("lang", F.col("source").alias("name"), "rest", "kept")
    one, two = rest.withColumnRenamed("name", "one").withColumnRenamed("rest", "p"), rest.drop("kept").withColumnRenamed("name", "two").withColumnRenamed("rest", "q")
    valued = summed.join(one, ["lang", "one"]).join(two, ["lang", "two"])
    valued = valued.withColumn("value", F.col("gap") + F.when(F.col("kept") > 0, (F.col("kept") - F.col("seen")) * _gap("p", "q")).otherwise(0))
    ends = F.array(*[F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in (("one", "two"), ("two", "one"))])
    return valued.select("lang", F.explode(ends).alias("ends"), "value").select("lang", "ends.source", "ends.item", "value")


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, source_block: int = SOURCE_BLOCK,
               term_block: int = TERM_BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank: the gaps to all other sources, and the terms a source has more of than its
    language, the first `top` of them."""
    by_group, by_lang = term_statistics(docs, least_docs)
    langs = by_lang.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("count").alias("lang_total"))
    totals = by_group.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    groups = _plain(docs).select("lang", "source").distinct()
    sizes = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / source_block).cast("int").alias("blocks"))
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").join(sizes, "lang").na.fill(0, ["total", "kept", "lang_total"])
    groups = materialize(groups.withColumn("rest", F.when(F.col("kept") > 0, _share("0L", "total", "kept"))), "groups")

    cells = by_group.join(groups, ["lang", "source"]).withColumn("share", _share("count", "total", "kept"))
    pairs = source_gaps(cells.select("lang", "source", "term", "share"), groups, term_block)
    whole = by_lang.withColumnRenamed("count", "lang_count")
    more = cells.join(whole, ["lang", "term"]).withColumn("whole", _share("lang_count", "lang_total", "kept")).where(F.col("share") > F.col("whole"))
    terms = more.select("lang", "source", F.col("term").alias("item"), _gap("share", "whole").alias("value"))

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    ranked = [(pairs, "pair", F.lit(True)), (terms, "term", F.col("rank") <= top)]
    one, two = (x.withColumn("rank", rank).where(keep).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
                for x, part, keep in ranked)
    return one.unionByName(two)
