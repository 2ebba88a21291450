"""Chat templates, archives, packing, mixing and certified rules: round trips, odd rows and exact counts."""

import hashlib
import json
import math
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.fixtures import empty_docs, odd_docs
from wattline.llm import chat, mixing, packing, quality_rules, warc


# chat -----------------------------------------------------------------------------------------------------------------

TEXTS = ["", "plain", "</s>[INST] ok [/INST]", "<|user|>\nx<|end|>\n", "\\", "\\a<\\b", "<<SYS>> <</SYS>> <s>", "a\\z\\\\n", "<|", "|>", "<<|>>",
         "é   \x00 \U0001f600", "[[INST]INST]", "<</s>/s>", "line\nline\r\n"]


def test_escaping_is_reversible_and_leaves_no_control_string(spark):
    rows = spark.createDataFrame([(t + u,) for t in TEXTS for u in TEXTS], "t string")
    back = rows.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("b"),
                       chat.unescape_role(chat.escape_role(F.col("t"))).alias("r")).collect()
    for row in back:
        assert row.b == row.t == row.r
        assert not any(c in row.e for c in chat.CONTROLS)


def test_layouts_become_turns(spark):
    records = [
        (1, json.dumps({"prompt": "p", "completion": "c"})), (2, json.dumps({"completion": None, "prompt": "p"})),
        (3, json.dumps({"instruction": "i", "input": "u", "output": "o"})), (4, json.dumps({"question": "q", "answer": "a"})),
        (5, json.dumps({"messages": [{"role": "user", "content": "m"}, {"role": "tool", "content": None}]})),
        (6, json.dumps({"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]})),
        (7, json.dumps({"other": 1})), (8, "no json"), (9, None), (10, "[]"), (11, json.dumps({"messages": []})),
        (12, json.dumps({"prompt": 5, "completion": True}))]
    docs = spark.createDataFrame(records, "id long, record string").withColumn("turn", F.lit(0)).withColumn("text", F.lit("x"))
    got = {r.id: r for r in chat.format_records(docs, "record").collect()}
    said = {k: None if r.turns is None else [(t.role, t.text) for t in r.turns] for k, r in got.items()}
    assert said[1] == [("user", "p"), ("assistant", "c")] and said[2] == [("user", "p"), ("assistant", "")]
    assert said[3] == [("system", "i"), ("user", "u"), ("assistant", "o")] and said[4] == [("user", "q"), ("assistant", "a")]
    assert said[5] == [("user", "m"), ("tool", "")] and said[6] == [("user", "h"), ("assistant", "g")]
    assert said[7] is said[8] is said[9] is said[10] is None and got[7].formatted is None and got[7].schema_fingerprint
    assert said[12] == [("user", "5"), ("assistant", "true")]
    for key in (1, 3, 6):
        r = got[key]
        assert "".join(r.formatted[s.start:s.end] for s in r.loss_spans) == "".join(t.text for t in r.turns if t.role == "assistant")


def test_odd_conversations(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", TEXTS[2]), (2, 5, None, "x"), (2, 5, None, "x"), (3, 0, "a|>\nb", "y"), (None, 0, "user", "z"),
            (4, 1, "assistant", "late"), (4, 0, "assistant", "early")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    out = chat.format_records(chat.records_of_rows(table), "record").withColumn("back", chat.read_turns(F.col("formatted")))
    got = {r.conv_id: [(t.role, t.text) for t in r.back] for r in out.collect()}
    assert got == {1: [("user", ""), ("assistant", TEXTS[2])], 2: [("", "x"), ("", "x")], 3: [("a|>\nb", "y")], None: [("user", "z")],
                   4: [("assistant", "early"), ("assistant", "late")]}
    assert chat.format_records(chat.records_of_rows(table.where("false")), "record").count() == 0


# archives -------------------------------------------------------------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-5, 10 ** 12) | st.none(), st.text(), st.binary(max_size=200)), max_size=8), st.sampled_from([1, 2]))
def test_archives_round_trip(rows, version):
    arc, size = warc.arc_head("x.arc", version), 0
    for key, url, body in rows:
        arc += warc.arc_record(warc.safe_address(url, key), warc.http_message(key, body), version, "x.arc", size)
    read = list(warc.read_arc(arc))
    assert [warc.message_parts(r["content"])[1] for r in read] == [b for _, _, b in rows]
    assert all(len(r) == len(warc.FIELDS[version].split()) + 1 for r in read)
    made = list(warc.read_warc(warc.convert(arc, {})))
    assert [warc.message_parts(block)[1] for _, block in made] == [b for _, _, b in rows]
    for (key, _, body), (fields, block) in zip(rows, made, strict=True):
        assert fields["WARC-Record-ID"] == warc.record_id(key) and fields["WARC-Date"] == "2000-01-01T00:00:00Z"
        assert fields["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(body).hexdigest()
        assert fields["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(block).hexdigest()


def test_wrong_lengths_are_refused():
    arc = warc.arc_head("x", 1) + warc.arc_record("u", warc.http_message(1, b"abc"), 1, "x", 0)
    with pytest.raises(ValueError):
        list(warc.read_arc(arc[:-3]))
    with pytest.raises(ValueError):
        list(warc.read_arc(arc.replace(b"\n1 0 ", b"\n7 0 ")))


def test_odd_pages(spark):
    long = "<p>" + "ä" * 200_000
    rows = [(5, "http://a b\n", long), (2, None, long), (9, "", long), (1, "x", None), (3, "x", ""), (4, "y", "short"), (6, "y", "short"),
            (None, "z", long), (7, "q", "e" * 100), (8, "q", "e" * 100), (8, "q", "e" * 100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("refers", F.lit(1)).withColumn("digest", F.lit("x"))
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in warc.warc_round(pages, archive_bytes=1000).collect())
    size = len(long.encode())
    assert got == sorted([("5", size, "revisit", 2), ("2", size, "response", None), ("9", size, "revisit", 2), ("1", 0, "response", None),
                          ("3", 0, "response", None), ("4", 5, "response", None), ("6", 5, "response", None), ("None", size, "revisit", 2),
                          ("7", 100, "response", None), ("8", 100, "revisit", 7), ("8", 100, "revisit", 7)])
    assert warc.warc_round(pages.where("false")).count() == 0


# packing --------------------------------------------------------------------------------------------------------------

@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=14), st.integers(1, 60))
def test_fill_is_the_best_subset_sum(lengths, room):
    sums = {0}
    for n in lengths:
        sums |= {s + n for s in sums if s + n <= room}
    counts = {n: lengths.count(n) for n in lengths}
    taken = packing.fill_window(counts, sorted(counts, reverse=True), room)
    assert sum(n * k for n, k in taken) == max(sums) and all(k <= counts[n] for n, k in taken)


def test_pack_lengths_fills_windows():
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 4097, 2500)
    sequence, offset = packing.pack_lengths(lengths)
    used = np.bincount(sequence, weights=lengths)
    assert used.max() <= 4096 and len(used) <= 1.02 * lengths.sum() / 4096
    for s in range(0, len(used), 97):
        at = np.flatnonzero(sequence == s)
        at = at[np.argsort(offset[at])]
        assert offset[at].tolist() == np.append(0, np.cumsum(lengths[at])[:-1]).tolist()


def test_pieces_hold_every_id(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    docs = odd_docs(spark)
    want = {}
    for r in docs.select("doc_id", "text").collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        for start in range(0, len(ids), 4096):
            piece = np.array(ids[start:start + 4096], "<u4")
            key = (r.doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids))
            want[key] = want.get(key, 0) + 1
    got = packing.pack(docs, shard_pieces=20).collect()
    for r in got:
        want[r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens] -= 1
    assert not any(want.values())
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(empty_docs(spark)).count() == 0


def test_small_cache_gives_the_same_ids():
    path = packing._default_path()
    texts = [f"word{i % 13} Über{i} <|endoftext|> it's  \t42".encode() for i in range(40)]
    big, small = packing.WordTokens(path), packing.WordTokens(path, most=10)

    def ids(tokens, some):
        return [x.tolist() for x in tokens.encode(np.frombuffer(b"".join(some), np.uint8), np.array([len(t) for t in some]))]

    for t in texts:
        assert ids(big, [t]) == ids(small, [t])
    assert ids(big, texts) == [ids(small, [t])[0] for t in texts]
    assert ids(big, [b"", b" "]) == [[], []]


def test_ids_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer

    path = packing._default_path()
    tokenizer, tokens = Tokenizer.from_file(path), packing.WordTokens(path)
    tokenizer.encode_special_tokens = True
    odd = ["a.b, c... d., e.", "ÀÉ e\u0301 \u0130stanbul \u00df \u1e9e", "x\x1cy\u00a0z\u2003w\x85v", "it's IT'S 'tis o'clock's", "12,345.67.", "\u4e2d\u6587 \u0627\u0644 \U0001f600.",
           "a\r\nb\x0bc\x0cd", ".,. , .", "K\u212a \ufb01 \u01c5 \u2126", "\x00a\x01. b", "w,", ",w", "ñandú. Él,", "e\u0301. a\u030a, \u0301 x"]
    data = [t.encode() for t in odd]
    got = tokens.encode(np.frombuffer(b"".join(data), np.uint8), np.array([len(t) for t in data]))
    for text, ids in zip(odd, got, strict=True):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_added_tokens_in_texts_keep_their_ids(spark):
    from tokenizers import Tokenizer

    path = packing._default_path()
    tokenizer = Tokenizer.from_file(path)
    texts = ["end <|endoftext|> next a<|startoftext|>b", "plain <|end", "oftext|> plain", "<|ENDOFTEXT|> É <|EndOfText|>x", "", "<|endoftext|>",
             "Many words. <|startoftext|><|endoftext|>, it's 42", "a <|endoftext |> b", "end next a b"]
    data = [t.encode() for t in texts]
    got = packing.WordTokens(path).encode(np.frombuffer(b"".join(data), np.uint8), np.array([len(t) for t in data]))
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in got] == want
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: (r.doc_tokens, r.ids_crc32) for r in packing.pack(docs).collect()}
    assert rows == {i: (len(x) + 1, zlib.crc32(np.array([*x, 2], "<u4").tobytes())) for i, x in enumerate(want)}


# mixing ---------------------------------------------------------------------------------------------------------------

def test_targets_are_met_to_the_word(spark):
    rows = [(i, "w " * (1 + i * 7 % 50), f"s{i * i % 5}") for i in range(300)] + [(900, "one two", None), (901, None, "s0"), (902, "", "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("hash", F.lit("x")).withColumn("size", F.lit(1))
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size, target, taken = {}, {}, {}
    for r in got:
        size[r.source] = size.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r["size"] and r.source_size == sum(len((t or "").split()) for _, t, s in rows if s == r.source)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted((s for s in size if s is not None)) + [None])}
    left, open_, want = 1.5 * sum(size.values()), set(size), {}
    while open_:  # share by weight, close what is above, share the excess again
        share = left / sum(weight[s] for s in open_)
        above = [s for s in open_ if weight[s] * share > 2 * size[s]]
        for s in above or list(open_):
            want[s] = min(2 * size[s], weight[s] * share)
            left -= want[s]
            open_.discard(s)
    assert target == pytest.approx(want)
    assert all(abs(taken[s] - target[s]) < 1 for s in size)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)


def test_mixed_rows_hold_the_taken_words(spark):
    """Null ids, one id in several sources and different texts under one id included."""
    odd = odd_docs(spark).select("doc_id", "text", "lang", "source", "n_chars")
    more = [(None, "w " * (3 + 5 * i), "en", f"s{i % 3}", 1) for i in range(9)]
    more += [(7000 + i // 3, "x " * (1 + 11 * i % 23), "en", f"s{i % 3}", 1) for i in range(60)]
    more += [(7001, "y z", "fr", None, 1), (None, "q r s", "fr", None, 1), (None, None, None, "s0", None)]
    docs = odd.unionByName(spark.createDataFrame(more, odd.schema)).withColumn("size", F.lit("x")).withColumn("taken", F.lit("y"))
    want, got = {}, {}
    for r in mixing.mix(docs).collect():
        if r.taken:
            want.setdefault((r.doc_id, r.source), []).append(r.taken)
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns and rows.dtypes == docs.dtypes
    for r in rows.collect():
        got.setdefault((r.doc_id, r.source), []).append(len(r.text.encode().split()))
    assert {k: sum(v) for k, v in got.items()} == {k: sum(v) for k, v in want.items()}
    texts = {}
    for r in docs.collect():
        texts.setdefault((r.doc_id, r.source), set()).add(r.text)
    for r in rows.collect():
        whole = texts[r.doc_id, r.source]
        assert r.text in whole or (r.n_chars == len(r.text) and any(
            t and b" ".join(t.encode().split()).decode().startswith(r.text) for t in whole))
    again = mixing.mixed_rows(docs.repartition(5)).collect()
    assert sorted(map(str, rows.collect())) == sorted(map(str, again))


def test_odd_rows_mix(spark):
    assert mixing.mix(odd_docs(spark)).count() == odd_docs(spark).count()
    assert mixing.mix(empty_docs(spark)).count() == 0 and mixing.mixed_rows(empty_docs(spark)).count() == 0
    blank = spark.createDataFrame([(1, " ", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert {(r.target, r.taken) for r in mixing.mix(blank).collect()} == {(0.0, 0)}
    same = spark.createDataFrame([(7, "a b c", "x")] * 5 + [(8, "a", "y")], "doc_id long, text string, source string")
    rows = mixing.mix(same).collect()
    assert abs(sum(r.taken for r in rows if r.source == "x") - rows[0].target) < 6


# rules ----------------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("n,k,share", [(10, 0, 0.1), (100, 3, 0.05), (2000, 4, 0.007), (40000, 200, 0.0071), (5, 5, 0.5), (0, 0, 0.1)])
def test_binomial_tail(spark, n, k, share):
    got = spark.createDataFrame([(n, k)], "n long, k long").select(
        quality_rules.binomial_lower_tail(F.col("n"), F.col("k"), share)).first()[0]
    want = 1.0 if k > n * share else math.fsum(math.exp(
        math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(share) + (n - j) * math.log1p(-share)) for j in range(k + 1))
    assert got == pytest.approx(want, rel=1e-9)


def counted(text):
    body = text or ""
    words = [w.decode() for w in body.encode().split()]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    lines = [line for line in body.split("\n") if line.encode().split()]
    covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    return (len(words), sum(map(len, words)), sum(c in quality_rules.SYMBOLS for c in body), len(lines) - len(set(lines)), len(covered))


def test_rule_counts_of_odd_rows(spark):
    docs = odd_docs(spark).where("doc_id IS NULL OR doc_id <> 104")  # its brute force takes too long
    labels = spark.createDataFrame([(i, 1, 0) for i in range(48)], "doc_id long, quality int, toxic int")
    want = sorted((str(r.doc_id), *counted(r.text)) for r in docs.select("doc_id", "text").collect())
    got = quality_rules.quality_rules(docs, labels).collect()
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    assert quality_rules.quality_rules(empty_docs(spark), labels).count() == 0
    assert quality_rules.quality_rules(odd_docs(spark), labels.where("false")).where("kept = base_failed").count() == 0


def test_cutoffs_keep_their_promise(spark):
    """Good rows with a few loud ones in one stratum: the certified cutoffs reject no more of them than allowed."""
    rows = [(i, "en" if i % 2 else "fr", 200, 1000, 40 if i % 200 == 1 else 0) for i in range(8000)]
    rows += [(10000 + i, "en", 200, 1000, 300) for i in range(50)]
    scored = spark.createDataFrame(rows, "doc_id long, stratum string, n_words long, word_chars long, n_symbols long")
    for name in ("n_marks", "n_capitals", "n_dup_lines", "n_repeat_words"):
        scored = scored.withColumn(name, F.lit(0).cast("long"))
    scored = scored.withColumn("n_lines", F.lit(3).cast("long")).withColumn("base_failed", F.lit(False))
    labels = spark.createDataFrame([(i, 1) for i in range(8000)], "doc_id long, quality int")
    cuts = quality_rules.certified_cutoffs(scored, labels)
    kept = quality_rules.apply_rules(scored, cuts)
    by = {r.stratum: r for r in cuts.collect()}
    assert by["fr"].cut_symbols == 5 and by["en"].cut_symbols < 5  # one in 100 good rows of "en" would go
    assert kept.where("doc_id < 8000 AND NOT kept").count() == 0 and kept.where("doc_id >= 10000 AND kept").count() == 0
