"""Token alignment against whole texts, one at a time, with both tokenizers as they are."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.fixtures import DOCS, empty_docs, odd_docs
from wattline.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = [*"aeb  \n\t.,'0é", " ", "  ", " a", "'s", "\u00a0", "\u3000", "\u2028", "\u0301", "語", "😀", "<|endoftext|>", "</s>", "▁", "\x00",
            "\x1c", "\x7f", "…", "\u200b", "ﬁ", "½", "&amp;", "word", " The", "zzzzqx"]


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B), alignment.encoders(A, B)


def tokens(tools, text):
    """Ids and ends of both tokenizers over the whole text, or nothing."""
    a, b, entries = tools
    whole = (" " + (text or "")).encode()
    if not text:
        return None
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a, bytes_b = [entries.a_bytes[i] for i in ids_a], [entries.b_bytes[i] for i in ids_b]
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return None
    return (ids_a, np.cumsum([len(x) for x in bytes_a]).tolist()), (ids_b, np.cumsum([len(x) for x in bytes_b]).tolist())


def groups_of(found):
    """Groups between byte offsets at which tokens of both end."""
    (ids_a, ends_a), (ids_b, ends_b) = found
    common = sorted(set(ends_a) & set(ends_b))
    def cut(ids, ends):
        parts, at = [], 0
        for stop in common:
            part = []
            while at < len(ids) and ends[at] <= stop:
                part.append(ids[at])
                at += 1
            parts.append(part)
        return parts
    return list(zip(cut(ids_a, ends_a), cut(ids_b, ends_b), strict=True))


def brute(tools, rows):
    groups = [groups_of(found) if (found := tokens(tools, text)) else [] for _, text in rows]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    held = Counter(p for n in links for p in n)
    best = {}
    for (x, _), n in held.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for (key, _), g, n in zip(rows, groups, links, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((key, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(n.values()),
                    sum(t for p, t in n.items() if held[p] == best[p[0]]), sum(t * held[p] for p, t in n.items()),
                    hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out, key=repr)


@pytest.mark.parametrize("frequent", [alignment.FREQUENT, 40])
def test_documents_against_whole_texts(spark, tools, frequent):
    docs = odd_docs(spark)
    got = sorted(map(tuple, alignment.alignment(docs, frequent=frequent).collect()), key=repr)
    assert got == brute(tools, [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def test_odd_strings(spark, tools):
    rng = random.Random(5)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randrange(1, 30))) for _ in range(1500)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    assert sorted(map(tuple, alignment.alignment(docs).collect()), key=repr) == brute(tools, rows)


def test_pointers_end_at_the_last_token_of_the_group():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        a, b = (np.append(np.flatnonzero(rng.random(n - 1) < p) + 1, n) for p in (0.3, 0.5))
        to = alignment.last_of_group(a, b)
        common = np.intersect1d(a, b)
        want = len(a) + np.searchsorted(b, common[np.searchsorted(common, np.concatenate([a, b]))])
        assert np.array_equal(to, want)


def test_no_entry_has_its_space_mark_behind_another_character(tools):
    pieces = [tools[1].id_to_piece(i) for i in range(tools[1].get_piece_size())]
    assert not [p for p in pieces if "▁" in p.lstrip("▁")]


def test_a_long_group_counts_all_pairs(spark, tools):
    rows = [(1, "a" * 3001), (2, "\u0301" * 400), (3, "x" + "\n" * 700)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    assert sorted(map(tuple, alignment.alignment(docs).collect()), key=repr) == brute(tools, rows)


def test_empty_table(spark):
    assert alignment.alignment(empty_docs(spark)).collect() == []
    clash = odd_docs(spark).withColumn("row", F.lit(1)).withColumn("pairs", F.lit(2))
    assert alignment.alignment(clash.limit(3)).count() == 3
