"""Word and byte repeats against brute force over whole texts."""

import hashlib

import pytest

from tests.llm.fixtures import empty_docs, odd_docs, plain_texts
from wattline.llm import repeats, suffix_dedup
from wattline.llm.repeats import BYTES, WORDS
from wattline.llm.substring_dedup import substring_dedup


def digest(text):
    return hashlib.md5(text.encode()).hexdigest()


def expected(rows, units):
    """{(doc_id, text): marks} by remembering every window of every different text in order; null ids come last."""
    docs = sorted({(d is None, d or 0, digest(t), t) for d, t in rows if t})
    seen, out = {}, {}
    for none, d, name, t in docs:
        parts = t.encode().split() if units.words else t.encode()
        mark = bytearray(len(parts))
        for i in range(len(parts) - units.span + 1):
            window = tuple(parts[i:i + units.span]) if units.words else parts[i:i + units.span]
            first = seen.setdefault(window, (none, d, name, i))
            if (first < (none, d, name, i)) if units.words else first[:2] < (none, d):
                mark[i:i + units.span] = b"\1" * units.span
        out[None if none else d, t] = mark
    return out


def check(got, rows, units):
    want = expected(rows, units)
    assert len(got) == len(rows)
    for row in got:
        parts = (row["text"] or "").encode()
        parts = parts.split() if units.words else parts
        mark = want.get((row["doc_id"], row["text"]), bytearray(len(parts)))
        left = [w for w, m in zip(parts, mark, strict=True) if not m]
        kept = b" ".join(left) if units.words else bytes(left)
        assert (row["n"], row["removed"], bytes(row["kept"])) == (len(parts), sum(mark), kept)


def run(docs, units, method, **sizes):
    done = repeats.without_spans(docs.select("doc_id", "text"), repeats.removed_spans(docs, units, method, **sizes), units)
    return [{"doc_id": r.doc_id, "text": r.text, "n": r._n_units, "removed": r._n_removed, "kept": r._kept} for r in done.collect()]


def methods():
    from wattline.llm.substring_dedup import _method as words
    return [(WORDS, words), (BYTES, suffix_dedup._method)]


@pytest.mark.parametrize("which", [0, 1])
@pytest.mark.parametrize("sizes", [{}, {"shard_bytes": 300}, {"hot": 3}], ids=["plain", "small shards", "hot anchors"])
def test_odd_rows(spark, which, sizes):
    units, method = methods()[which]
    docs = odd_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    check(run(docs, units, method, **sizes), rows, units)


@pytest.mark.parametrize("which", [0, 1])
def test_join_instead_of_filter(spark, monkeypatch, which):
    monkeypatch.setattr(repeats, "FILTER_BITS", 1)
    units, method = methods()[which]
    rows = list(enumerate(plain_texts(60, seed=8)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(run(docs, units, method), rows, units)


@pytest.mark.parametrize("which", [0, 1])
def test_big_group_of_copies_and_near_copies(spark, which):
    units, method = methods()[which]
    base = plain_texts(1, seed=5)[0] + " " + plain_texts(9, seed=6)[8]
    rows = [(i, base) for i in range(40)] + [(100 + i, f"{base} tail{i} " + plain_texts(7, seed=i)[6]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(run(docs, units, method), rows, units)
    check(run(docs, units, method, hot=5), rows, units)


def rows_of_shared_ids():
    """Ids with several texts, null ids and repeated rows, all with passages in common."""
    passage, other = " ".join(f"p{i}" for i in range(45)), " ".join(f"q{i}" for i in range(45))
    rows = [(5, f"{passage} one"), (5, f"two {passage} {other}"), (5, f"three {other}"), (9, f"nine {passage}"), (9, "nine"), (9, None)]
    rows += [(None, f"none {other} {passage}"), (None, f"{other} nothing"), (None, f"new {'word ' * 30}"), (None, f"{passage} one"), (None, "")]
    rows += [(2, f"only {other}"), (12, f"{passage} one"), (12, f"twelve {passage}")]
    return rows + rows[1:8]


@pytest.mark.parametrize("which", [0, 1])
@pytest.mark.parametrize("sizes", [{}, {"hot": 2}], ids=["plain", "hot anchors"])
@pytest.mark.parametrize("joined", [False, True], ids=["filter", "join"])
def test_every_text_of_repeated_and_null_ids(spark, monkeypatch, which, sizes, joined):
    if joined:
        monkeypatch.setattr(repeats, "FILTER_BITS", 1)
    units, method = methods()[which]
    rows = rows_of_shared_ids()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = run(docs, units, method, **sizes)
    check(got, rows, units)
    assert any(r["doc_id"] is None and r["removed"] for r in got)
    lost = {(r["doc_id"], r["text"]): r["removed"] for r in got}
    assert lost[9, f"nine {' '.join(f'p{i}' for i in range(45))}"] > 0  # a text of id 5 that was not searched before


def test_pieces_are_merged_by_binary_search():
    import numpy as np
    texts = [t.encode() for t in plain_texts(40, seed=4)]
    data, lengths = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
    owner = np.arange(len(texts))[::-1].copy()
    whole = suffix_dedup.repeated_starts(data, lengths, owner)
    for size in (1, 500, 3000):
        assert whole.tolist() == sorted(suffix_dedup.repeated_starts(data, lengths, owner, piece_bytes=size).tolist())
    assert len(whole)


def test_suffix_array_orders_to_its_depth():
    import numpy as np
    for text in (b"banana" * 30, b"\0" * 100, plain_texts(3)[2].encode(), b"x"):
        order = suffix_dedup.suffix_array(np.frombuffer(text, np.uint8), 50)
        assert sorted(order.tolist()) == list(range(len(text)))
        full = [i for i in order.tolist() if i + 64 <= len(text)]
        assert [text[i:i + 50] for i in full] == sorted(text[i:i + 50] for i in full)


def test_whole_characters(spark):
    base = "é" * 40
    docs = spark.createDataFrame([(1, base + "a"), (2, "é" + base + "bè"), (3, "abcé")], "doc_id long, text string")
    for row in suffix_dedup.suffix_dedup(docs, whole_characters=True).collect():
        bytes(row._kept).decode()


def test_empty_tables(spark):
    assert substring_dedup(empty_docs(spark)).count() == 0
    assert suffix_dedup.byte_report(empty_docs(spark)).count() == 0
