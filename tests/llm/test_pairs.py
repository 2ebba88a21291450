"""SimHash groups and nearest vectors against brute force; the classifier on held-out rows."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.fixtures import empty_docs, odd_docs
from wattline.llm import nearest, quality_classifier, rolling, simhash_dedup

FOLDER = "/root/testdata/sf0.001"


def fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    parent = {d: d for d in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: root(d) for d in ids}


def test_simhash_of_odd_rows(spark):
    docs = odd_docs(spark).where("doc_id IS NOT NULL AND NOT (doc_id = 5 AND n_chars = 1)")
    prints = {r.doc_id: fingerprint(r.text) for r in docs.collect()}
    want = components(prints)
    got = simhash_dedup.simhash_groups(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.fp & (2 ** 64 - 1), r.component_id) == (prints[r.doc_id], want[r.doc_id])
    assert simhash_dedup.simhash_groups(odd_docs(spark)).count() == odd_docs(spark).count()
    assert simhash_dedup.simhash_groups(empty_docs(spark)).count() == 0


def test_links_and_chains_of_fingerprints(spark):
    rng = random.Random(2)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(200):
        prints.append(rng.choice(prints) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5))))
    chain = rng.getrandbits(64)
    for b in range(0, 63, 3):  # every step three bits further
        chain ^= 7 << b
        prints.append(chain)
    prints += [0, 2 ** 64 - 1, 1, 2 ** 63]
    rng.shuffle(prints)
    signed = {p - (1 << 64) if p >> 63 else p: i for i, p in enumerate(prints)}
    points = spark.createDataFrame([(f, i) for f, i in signed.items()], "fp long, lead long")
    pairs = {(r.a, r.b) for r in simhash_dedup.near_pairs(points).collect()}
    keys = sorted(signed)
    want = {(a, b) for i, a in enumerate(keys) for b in keys[i + 1:] if ((a ^ b) & (2 ** 64 - 1)).bit_count() <= 3}
    assert pairs == want
    labels = {r.fp: r.label for r in simhash_dedup.components(points, simhash_dedup.near_pairs(points)).collect()}
    groups = components({signed[f]: f & (2 ** 64 - 1) for f in keys})
    assert all(labels.get(f, signed[f]) == groups[signed[f]] for f in keys)


def test_a_null_id_between_two_others_joins_them(spark):
    rng = random.Random(8)
    middle = rng.choices([f"w{i}" for i in range(900)], k=500)
    own, sides = fingerprint(" ".join(middle)), []
    while len(sides) < 2:
        other = list(middle)
        other[rng.randrange(500)] = f"x{rng.randrange(10 ** 6)}"
        text = " ".join(other)
        near = [(fingerprint(text) ^ fingerprint(x)).bit_count() for x in sides]
        if 0 < (fingerprint(text) ^ own).bit_count() <= 3 and all(near):
            sides.append(text)
    rows = [(None, " ".join(middle)), (9, sides[0]), (4, sides[1]), (None, "far from these"), (7, "and this one too")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.fp & (2 ** 64 - 1)): r.component_id for r in simhash_dedup.simhash_groups(docs).collect()}
    assert got == {(d, fingerprint(t)): 4 if t in (rows[0][1], *sides) else d for d, t in rows}


def test_null_leads_do_not_win_a_component(spark):
    chain = [0, 7, 7 << 3 | 7, 511, 255 << 40, 254 << 40]  # the last two are a group of their own
    points = spark.createDataFrame(list(zip(chain, [9, None, 4, 6, None, None], strict=True)), "fp long, lead long")
    labels = {r.fp: r.label for r in simhash_dedup.components(points, simhash_dedup.near_pairs(points)).collect()}
    assert labels == {**dict.fromkeys(chain[:4], 4), **dict.fromkeys(chain[4:], None)}


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double, rank int")


def test_nearest_finds_nine_of_ten(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 24))
    rows = (centres[rng.integers(0, 6, 3000)] + 0.6 * rng.standard_normal((3000, 24))).astype(np.float32)
    rows[500:800] = rows[7]  # a large group of equal vectors
    docs = vectors(spark, [(i, r.tolist(), 0.0, 1) for i, r in enumerate(rows)])
    got = nearest.search(docs, F.col("vec_id") % 20 == 0, cell_rows=200).collect()
    exact, hits, total = rows.astype(np.float64), 0, 0
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert sorted(by) == list(range(0, 3000, 20))
    for q, found in by.items():
        score = exact @ exact[q]
        score[q] = -math.inf
        order = np.lexsort((np.arange(3000), -np.round(score, 9)))[:20]
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 21)) and q not in [r.vec_id for r in found]
        assert np.allclose([r.score for r in found], [exact[q] @ exact[r.vec_id] for r in found], rtol=0, atol=1e-9)
        hits, total = hits + len({r.vec_id for r in found} & set(order.tolist())), total + 20
    assert hits / total >= 0.9
    assert [r.vec_id for r in sorted(by[500], key=lambda r: r["rank"])] == [7, *range(501, 520)]


def test_ties_of_different_vectors_go_to_the_smaller_id(spark):
    rng = np.random.default_rng(6)
    rows = np.array([np.eye(24)[a] + np.eye(24)[b] for a in range(24) for b in range(a)])  # products are 0, 1 and 2
    rows = rows[rng.permutation(len(rows))]
    got = nearest.search(vectors(spark, [(i, r.tolist(), 0.0, 1) for i, r in enumerate(rows)]), F.col("vec_id") % 20 == 0, k=60, sure=1.0).collect()
    for q in range(0, len(rows), 20):
        score = rows @ rows[q]
        score[q] = -math.inf
        found = [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])]
        assert found == np.lexsort((np.arange(len(rows)), -score))[:60].tolist()


def test_nearest_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 0.0, 1), (1, [1.0, 0.0], 0.0, 1), (2, [0.0, 1.0], 0.0, 1), (3, None, 0.0, 1), (4, [0.0, 0.0], 0.0, 1),
            (5, [nan, 1.0], 0.0, 1), (6, [inf, 1.0], 0.0, 1), (7, [None, 1.0], 0.0, 1), (8, [], 0.0, 1), (9, [1.0, 2.0, 3.0], 0.0, 1),
            (None, [1.0, 1.0], 0.0, 1), (1, [1.0, 0.0], 0.0, 1), (20, [-0.0, 3.0], 0.0, 1)]
    got = nearest.search(vectors(spark, rows), F.col("vec_id") % 20 == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: (r.query_id, r["rank"]))] == [
        (0, 1, 1, 1.0), (0, 2, 2, 0.0), (0, 3, 20, 0.0), (20, 1, 2, 3.0), (20, 2, 0, 0.0), (20, 3, 1, 0.0)]
    assert nearest.search(vectors(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    assert nearest.search(vectors(spark, rows[:1]), F.col("vec_id") % 20 == 0).count() == 0


def test_one_of_different_vectors_under_an_id(spark):
    rows = [(20, [1.0, 0.0]), (21, [5.0, 0.0]), (21, [0.5, 9.0]), (22, [1.0, 1.0]), (21, [5.0, 0.0])]
    for order in (rows, rows[::-1]):
        for parts in (1, 3):
            docs = spark.createDataFrame(order, "vec_id long, embedding array<double>").repartition(parts)
            got = nearest.search(docs, F.col("vec_id") % 20 == 0).orderBy("rank").collect()
            assert [(r.vec_id, r.score) for r in got] == [(22, 1.0), (21, 0.5)]


def test_lengths_whose_squares_overflow(spark):
    rng = np.random.default_rng(12)
    rows = rng.standard_normal((400, 8))
    rows[::3] *= 1e160
    plain = {}
    for i in range(0, 400, 20):
        scores = sorted(((-float((rows[i] * rows[j]).sum()), j) for j in range(400) if j != i))[:20]
        plain[i] = [j for _, j in scores]
    docs = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<double>")
    got = nearest.search(docs, F.col("vec_id") % 20 == 0, sure=1.0).collect()
    finite = [i for i in plain if i % 3]  # products of two large vectors leave the range of doubles
    for i in finite:
        found = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == i)
        assert [v for _, v, _ in found] == plain[i]
        assert all(abs(s / float((rows[i] * rows[v]).sum()) - 1) < 1e-9 for _, v, s in found)
    assert len(got) == 20 * 20


def test_chi_square():
    assert np.allclose(nearest.chi_square_cdf(np.array([0.0, 2.732636, 7.344121, 15.507313]), 8), [0, 0.05, 0.5, 0.95], atol=1e-4)


def test_classifier_on_held_out_rows(spark):
    folder = FOLDER.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    scored = quality_classifier.quality_scores(docs, labels)
    held = scored.join(labels, "doc_id").where("held_out").toPandas()
    assert len(held) > 50 and (held.predicted == held.quality).mean() >= 0.95


def test_classifier_keeps_few_bad_rows(spark):
    folder = FOLDER.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    held = quality_classifier.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    bad, good = held[held.quality == 0], held[held.quality == 1]
    assert len(bad) > 100 and bad.predicted.mean() < 0.03 and good.predicted.mean() > 0.99


def term_counts(text):
    """The terms of a text, one by one: words by their hash, byte pairs, class triples, shape pairs."""
    data, found = (text or "").encode(), np.zeros(quality_classifier.COUNTS)
    raw = np.frombuffer(data, np.uint8)
    starts, stops = rolling.word_bounds(raw, np.array([len(raw)]))
    cells = [int(h >> np.uint64(40)) % 2048 for h in rolling.word_hashes(raw, starts, stops)]
    words = data.split()
    assert len(cells) == len(words)
    if not words:
        return found
    for c in cells:
        found[c] += 1
    for a, b in zip(data, data[1:]):
        found[2048 + (a * 251 + b * 7919) % 1024] += 1

    def kind(b):
        for k, members in enumerate((b" \t", b"\n\r\x0b\x0c", b"", b"", b"0123456789")):
            if b in members:
                return k
        if 97 <= b <= 122 or b > 127:
            return 2
        if 65 <= b <= 90:
            return 3
        return 6 if b in b"!?" else 8 if b in b"#*$%&|<>{}[]=@~^\\_" else 7 if b < 32 or b == 127 else 5

    kinds = [kind(b) for b in data]
    for a, b, c in zip(kinds, kinds[1:], kinds[2:]):
        found[3072 + 81 * a + 9 * b + c] += 1
    shapes = []
    for i, w in enumerate(words):
        has = {kind(b) for b in w}
        shapes.append((2 in has) + 2 * (3 in has) + 4 * bool(has & {4, 6, 8}) + 8 * (i > 0 and words[i - 1] == w))
    for a, b in zip(shapes, shapes[1:]):
        found[3072 + 729 + 16 * a + b] += 1
    return found


def test_votes_against_brute_force(spark):
    """Frequencies over all documents, exact singular vectors and every similarity, document by document."""
    rng = random.Random(8)
    good = [" ".join(rng.choice(["the", "of", "river", "Was", "stone,", "light.\n", "é"]) for _ in range(rng.randrange(5, 60))) for _ in range(50)]
    bad = [" ".join(rng.choice(["BUY", "###", "now!!", "| more", "$5", "go go"]) for _ in range(rng.randrange(5, 60))) for _ in range(50)]
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(500, ""), (501, None), (502, " \n "), (503, "x"), (3, "another text of three")]
    marks = [(i, int(i < 50)) for i in range(0, 100, 2)] + [(503, 1), (3, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    found = np.array([term_counts(t) for _, t in rows])
    got = [x for _, _, x in quality_classifier.counts(pa.RecordBatch.from_pydict({"text": [t for _, t in rows]}))]
    assert np.array_equal(np.concatenate(got), found)

    filled = found.sum(1) > 0
    idf = np.log((1 + filled.sum()) / (1 + (found > 0).sum(0))) + 1
    weighed = np.log1p(found) * idf
    for a, b in ((0, 2048), (2048, 3072), (3072, 3801), (3801, 4057)):
        weighed[:, a:b] /= np.maximum(np.linalg.norm(weighed[:, a:b], axis=1, keepdims=True), 1e-12)
    label, learnt = dict(marks), {}
    for i, (d, _) in enumerate(rows):
        if d in label and zlib.crc32(str(d).encode()) % 4 != 2 and filled[i]:
            key = found[i].astype(np.uint16).tobytes()
            learnt[d] = min(learnt.get(d, (key, i)), (key, i))
    chosen = [i for _, i in learnt.values()]
    _, _, right = np.linalg.svd(weighed[chosen], full_matrices=False)
    latent = weighed @ right[:64].T
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    want = []
    for i in range(len(rows)):
        near = sorted(((float(latent[i] @ latent[j]), label[rows[j][0]]) for j in chosen), reverse=True)[:25]
        weight = sum(max(c, 0) ** 4 for c, _ in near)
        want.append(sum(max(c, 0) ** 4 * y for c, y in near) / weight if filled[i] and weight > 1e-12 else 0.5)
    scores = quality_classifier.score(docs, quality_classifier.fit(docs, labels)).collect()
    have = {(r.doc_id, r.text): r.score for r in scores}
    assert len(have) == len(rows) and all(abs(have[r] - w) < 1e-3 for r, w in zip(rows, want, strict=True))
    mixed = quality_classifier.fit(docs.repartition(9), labels)
    assert np.array_equal(mixed.idf, quality_classifier.fit(docs, labels).idf) and np.array_equal(mixed.labels, [label[d] for d in sorted(learnt)])


def test_classifier_never_learns_from_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality_classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = quality_classifier.fit(docs, labels), quality_classifier.fit(docs, turned)
    assert np.array_equal(one.vectors, two.vectors) and np.array_equal(one.labels, two.labels)


def test_classifier_of_odd_rows(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(48)] + [(3, 0, 0), (None, 1, 0), (7, None, 0), (8, 5, 0), (999, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    got = quality_classifier.quality_scores(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert {r.score for r in got if r.doc_id in (100, 101, 102)} == {0.5}
    none = quality_classifier.quality_scores(docs, labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}
    good = quality_classifier.quality_scores(docs, labels.where("quality = 1")).collect()
    assert all(r.score in (0.5, 1.0) for r in good)
    assert quality_classifier.quality_scores(empty_docs(spark), labels).count() == 0
    assert set(CLASH for CLASH in docs.columns) < set(quality_classifier.score(docs, quality_classifier.fit(docs, labels), "own").columns)


@pytest.mark.parametrize("text", [None, "", " \n", "A b C", "one two three four", "É é Ü ü ABC abc " * 50])
def test_fingerprint_of_one_text(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert simhash_dedup.fingerprints(docs).first().fp & (2 ** 64 - 1) == fingerprint(text)
