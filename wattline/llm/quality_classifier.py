"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text becomes counts of terms of four kinds: hashed words, hashed byte pairs, triples of byte classes (blank, line end,
small, capital, digit, point, call, symbol, control) and pairs of word shapes (holds small letters, capitals, digits or
symbols; equals the word before). Logarithms of the counts are weighted by inverse document frequency over all documents,
each block is scaled to length one, and the leading singular directions of the labelled sample map the result to a short
vector. The labelled vectors are broadcast (at most 2 x `per_class` rows of `rank` numbers, a parameter), and every document
gets exact cosine products with all of them, block by block. The `neighbours` nearest vote with their label, weighted by a
power of the similarity.

Learning: of each label the `per_class` rows with the smallest hash of their id, whole texts, and never rows whose
crc32(doc_id as text) mod 4 is 2; these are held out. Language, source and id are no inputs.

Defined results: a null, empty or blank text, and any text without a similar labelled one, scores 0.5; so does everything
if there are no labels, and with labels of one kind alone every vote is that label. A document with several labels counts
as 1 if one of them is; other label values and null ids are left out. Of different texts under one labelled id the one with
the smallest counts, compared as bytes, is learnt from. Repeated rows score alike. All other columns pass through, whatever
their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.llm import rolling
from wattline.llm.repeats import text_chunks

PER_CLASS = 2048
RANK = 64
NEIGHBOURS = 25
POWER = 4
WORD_CELLS, PAIR_CELLS = 2048, 1024
CLASSES, SHAPES = 9, 16
BLOCKS = (WORD_CELLS, PAIR_CELLS, CLASSES ** 3, SHAPES ** 2)
COUNTS = sum(BLOCKS)
THRESHOLD = 0.7
_BLOCK, _LEARN_BLOCK = 512, 128


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _classes() -> np.ndarray:
    """The class of each byte; bytes of longer characters count as small letters, so that languages look alike."""
    out = np.full(256, 5, np.int64)
    kinds = [(range(32), 7), ([127], 7), (b" \t", 0), (b"\n\r\x0b\x0c", 1), (range(97, 123), 2), (range(128, 256), 2),
             (range(65, 91), 3), (range(48, 58), 4), (b"!?", 6), (b"#*$%&|<>{}[]=@~^\\_", 8)]
    for members, kind in kinds:
        out[list(members)] = kind
    return out


_CLASS = _classes()


def _shapes(kinds: np.ndarray, hashes: np.ndarray, doc: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Four marks of each word: small letters, capitals, digits or calls or symbols, equal to the word before."""
    out = np.zeros(len(hashes), np.int64)
    for bit, members in enumerate(((2,), (3,), (4, 6, 8))):
        before = np.append(0, np.cumsum(np.isin(kinds, members)))
        out += (before[stops] > before[starts]).astype(np.int64) << bit
    out[1:] += ((hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])).astype(np.int64) << 3
    return out


def counts(batch: pa.RecordBatch, column: str = "text"):
    """(first row, end row, term counts) of the texts of a batch, in chunks."""
    pair_at, class_at, shape_at = np.cumsum(BLOCKS)[:3]
    for row, end, data, lengths in text_chunks(batch, column):
        n = end - row
        out = np.zeros(n * COUNTS, np.float32)
        if len(data):
            ends = np.cumsum(lengths)
            starts, stops = rolling.word_bounds(data, ends)
            hashes = rolling.word_hashes(data, starts, stops)
            doc = np.searchsorted(ends, starts, side="right")
            kinds = _CLASS[data]
            of = np.repeat(np.arange(n) * COUNTS, lengths)
            pair = (data[:-1].astype(np.int64) * 251 + data[1:].astype(np.int64) * 7919) % PAIR_CELLS
            triple = (kinds[:-2] * CLASSES + kinds[1:-1]) * CLASSES + kinds[2:]
            shape = _shapes(kinds, hashes, doc, starts, stops)
            found = [doc * COUNTS + (hashes >> np.uint64(40)).astype(np.int64) % WORD_CELLS,
                     (of[:-1] + pair_at + pair)[of[:-1] == of[1:]],
                     (of[:-2] + class_at + triple)[of[:-2] == of[2:]],
                     (doc[:-1] * COUNTS + shape_at + shape[:-1] * SHAPES + shape[1:])[doc[:-1] == doc[1:]]]
            for cells in found:
                out += np.bincount(cells, minlength=len(out))
            out.reshape(n, COUNTS)[np.bincount(doc, minlength=n) == 0] = 0  # without words a text has no terms
        yield row, end, out.reshape(n, COUNTS)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many documents hold each term, and how many hold any: one pass, at most one row per term from each task."""
    def held(batches):
        total = np.zeros(COUNTS + 1, np.int64)
        for batch in batches:
            for _, _, found in counts(batch):
                total[:COUNTS] += (found > 0).sum(0)
                total[COUNTS] += (found.sum(1) > 0).sum()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "n"])

    rows = docs.select("text").mapInArrow(held, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(COUNTS + 1, np.int64)
    for r in rows:  # COUNTS + 1 at most
        total[r["term"]] = r["n"]
    return total[:COUNTS], int(total[COUNTS])


def _weighted(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = np.log1p(found, dtype=np.float32) * idf
    for block in np.split(out, np.cumsum(BLOCKS)[:-1], axis=1):
        block /= np.maximum(np.linalg.norm(block, axis=1, keepdims=True), 1e-12)
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def latent_vectors(found: np.ndarray, idf: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Unit vectors along the singular directions of the counts."""
    return _unit(_weighted(found, idf) @ directions).astype(np.float32)


@dataclass
class Model:
    idf: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def scores(self, found: np.ndarray, neighbours: int = NEIGHBOURS, power: int = POWER) -> np.ndarray:
        out = np.full(len(found), 0.5)
        if not len(self.labels):
            return out
        latent = latent_vectors(found, self.idf, self.directions)
        k = min(neighbours, len(self.labels))
        for at in range(0, len(found), _BLOCK):
            near = latent[at:at + _BLOCK] @ self.vectors.T
            best = np.argpartition(-near, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(near, best, 1), 0).astype(np.float64) ** power
            total = weight.sum(1)
            vote = (weight * self.labels[best]).sum(1)
            out[at:at + _BLOCK] = np.where(total > 1e-12, vote / np.maximum(total, 1e-12), 0.5)
        out[found.sum(1) == 0] = 0.5
        return np.clip(out, 0.0, 1.0)


def _blocks(found: np.ndarray, idf: np.ndarray):
    """Weighted rows, a few at a time: the driver never holds all of them."""
    for at in range(0, len(found), _LEARN_BLOCK):
        yield _weighted(found[at:at + _LEARN_BLOCK], idf).astype(np.float64)


def _directions(found: np.ndarray, idf: np.ndarray, rank: int, seed: int = 5) -> np.ndarray:
    """Leading right singular vectors of the weighted rows by a seeded random range finder with three passes."""
    width = min(rank + 16, *found.shape)
    basis = np.random.default_rng(seed).standard_normal((found.shape[1], width))
    for _ in range(3):
        image = np.zeros_like(basis)
        for rows in _blocks(found, idf):
            image += rows.T @ (rows @ basis)
        basis, _ = np.linalg.qr(image)
    _, _, right = np.linalg.svd(np.concatenate([rows @ basis for rows in _blocks(found, idf)]), full_matrices=False)
    return (basis @ right.T)[:, :rank].astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, rank: int = RANK) -> Model:
    """Learn from at most `per_class` rows of each label. The driver gets their counts, bounded by that parameter."""
    usable = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("label"))
    usable = usable.where(~held_out(F.col("doc_id")))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [usable.where(F.col("label") == y).orderBy(*order).limit(per_class) for y in (0, 1)]
    sample = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 x per_class rows at most

    def count(batches):
        for batch in batches:
            ids, marks = batch.column("doc_id"), batch.column("label")
            for row, end, found in counts(batch):
                packed = [x.tobytes() for x in np.minimum(found, 65535).astype(np.uint16)]
                yield pa.RecordBatch.from_arrays([ids.slice(row, end - row), marks.slice(row, end - row).cast(pa.int64()),
                                                  pa.array(packed, pa.binary())], names=["doc_id", "label", "found"])

    rows = docs.select("doc_id", "text").join(sample, "doc_id").mapInArrow(
        count, "doc_id long, label long, found binary").groupBy("doc_id", "label").agg(
        F.min("found").alias("found")).orderBy("doc_id").collect()
    rows = [r for r in rows if any(r["found"])]
    found = np.empty((len(rows), COUNTS), np.uint16)
    marks = np.array([r["label"] for r in rows], np.float64)
    for i, r in enumerate(rows):
        found[i] = np.frombuffer(r["found"], np.uint16)
    del rows  # as large as the counts
    if not len(marks):
        return Model(np.ones(COUNTS, np.float32), np.zeros((COUNTS, 1), np.float32), np.zeros((0, 1), np.float32), marks)
    held, n = document_frequencies(docs)
    idf = (np.log((1 + n) / (1 + held)) + 1).astype(np.float32)
    directions = _directions(found, idf, rank)
    vectors = [latent_vectors(found[at:at + _LEARN_BLOCK], idf, directions) for at in range(0, len(found), _LEARN_BLOCK)]
    return Model(idf, directions, np.concatenate(vectors), marks)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All columns of `docs` and the score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def voted(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], names=["text"])
        parts = [shared.value.scores(found) for _, _, found in counts(batch)]
        return pa.array(np.concatenate(parts) if parts else np.empty(0))

    return docs.withColumn(name, voted(F.col("text")))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    own = docs.select("doc_id", "text")
    scored = score(own, fit(own, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
