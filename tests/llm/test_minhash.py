"""MinHash near-dedup against all pairs of full sets."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import DOCS, empty_docs, odd_docs
from wattline.llm import minhash_dedup as m

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = (text or "").translate(UPPER)
    for blank in "\t\n\x0b\x0c\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 4]) for i in range(max(1, len(words) - 3)))


def brute(rows):
    """Components over all pairs of rows; (id, text) in any order."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    different = {}
    for i, s in enumerate(sets):
        if s:
            if s in different:
                label[root(i)] = root(different[s])
            different[s] = i
    for a, b in combinations(different, 2):
        if len(a) * 5 >= len(b) * 4 and len(b) * 5 >= len(a) * 4:
            n = len(a & b)
            if 100 * n >= 80 * (len(a) + len(b) - n):
                label[root(different[a])] = root(different[b])
    first = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            first[root(i)] = min(first.get(root(i), key), key)
    out = []
    for i, (key, _) in enumerate(rows):
        component = first.get(root(i)) if sets[i] else key
        out.append((key, len(sets[i]), component, key == component))
    return sorted(out, key=repr)


def rows_of(docs, **options):
    return sorted(map(tuple, m.minhash_groups(docs, **options).collect()), key=repr)


def group_texts(rng, n, words, base, changes):
    texts = []
    for _ in range(n):
        parts = list(base)
        for _ in range(rng.randrange(changes)):
            parts[rng.randrange(len(parts))] = rng.choice(words)
        texts.append(" ".join(parts))
    return texts


@pytest.fixture(scope="module")
def groups():
    """Near copies at all distances of two bases that share a passage, a chain, and texts with a common passage."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(5000)]
    one, passage = rng.choices(words, k=90), rng.choices(words, k=40)
    texts = group_texts(rng, 120, words, one, 9) + group_texts(rng, 60, words, [*passage, *rng.choices(words, k=40)], 7)
    texts += [" ".join([*passage, *rng.choices(words, k=30)]) for _ in range(60)]
    chain = rng.choices(words, k=200)
    for _ in range(12):
        chain = [*chain[4:], *rng.choices(words, k=4)]
        texts.append(" ".join(chain))
    texts += ["A b c", "a B c", "a b", "a b c d", "A B C D", "x"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("options", [{}, {"short": 3, "chosen": 2, "tile": 8}, {"short": 2, "chosen": 1, "tile": 3}])
def test_groups_against_all_pairs(spark, groups, options):
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in groups], DOCS)
    assert rows_of(docs, **options) == brute(groups)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(docs) == brute(rows)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert rows_of(docs) == brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def test_null_ids_stand_back(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(None, text), (7, text + " more"), (3, text + " other"), (None, "alone here"), (None, "alone here"), (None, "")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    assert rows_of(docs) == brute(rows)


def test_exact_products():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200))) for _ in range(40)]
    sets += [np.delete(s, 0) for s in sets if len(s) > 5]
    sizes = np.array([len(s) for s in sets])
    left, right = np.arange(0, len(sets), 2), np.arange(len(sets))
    i, j = m.linked_pairs(np.concatenate(sets), sizes, left, right)
    want = {(a, b) for a in left.tolist() for b in right.tolist() if a != b
            and 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))}
    assert set(zip(left[i].tolist(), right[j].tolist(), strict=True)) == want and want


def test_least_shared_is_a_tail_bound():
    rng = np.random.default_rng(1)
    assert m.least_shared(64) < rng.binomial(64, 0.8, 200_000).min() <= 64
    assert m.least_shared(1) == 0


def test_empty_table(spark):
    assert rows_of(empty_docs(spark)) == []
    blank = rows_of(odd_docs(spark).where(F.col("doc_id").isin(100, 101, 102)))
    assert set(blank) == {(100, 0, 100, True), (101, 0, 101, True), (102, 0, 102, True)} and len(blank) == 4
