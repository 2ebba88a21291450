"""Source divergence against SQL on tables with every odd case, and the counting of documents against brute force."""

import glob
import re
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import DOCS, empty_docs, odd_docs
from tools.check import canonical
from wattline.llm import divergence, oracles
from wattline.session import scratch_root, scratch_scope


def by_sql(docs, least_docs, top):
    db = duckdb.connect()
    db.register("documents", docs.select("lang", "source", "text").toPandas())
    return db.execute(oracles.op11(least_docs, top)).df()


@pytest.mark.parametrize("least_docs,top,blocks", [(10, 10, (256, 4096)), (2, 3, (2, 7)), (10_000, 10, (1, 1))])
def test_rows_match_sql(spark, least_docs, top, blocks):
    docs = odd_docs(spark)
    got = divergence.divergence(docs, least_docs, top, *blocks).toPandas()
    assert canonical(got) == canonical(by_sql(docs, least_docs, top))


def test_documents_of_open_terms_are_counted_one_by_one(spark):
    """`tie` is in 10 documents in several chunks each, `few` in 9 with more chunks than that, `sure` in 12 as one chunk."""
    rows = [(None, "tie, (tie) Tie! " + ("few few, few; FEW." if i < 9 else ""), "en", "ab"[i % 2], i) for i in range(10)]
    rows += [(i, "sure\u00a0x sure", "en", None, i) for i in range(12)]
    by_group, by_lang = divergence.term_statistics(spark.createDataFrame(rows, DOCS))
    assert {r["term"]: r["count"] for r in by_lang.collect()} == {"tie": 30, "sure": 12, "sure\u00a0x": 12}
    counts = {(r["source"], r["term"]): r["count"] for r in by_group.collect()}
    assert counts == {("a", "tie"): 15, ("b", "tie"): 15, ("", "sure"): 12, ("", "sure\u00a0x"): 12}


def test_chunks_and_terms_against_brute_force(spark):
    docs = odd_docs(spark)
    n, held = Counter(), defaultdict(set)
    for i, r in enumerate(docs.select("lang", "source", "text").collect()):
        for chunk in re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""):
            key = (r["lang"] or "", r["source"] or "", chunk)
            n[key] += 1
            held[key].add(i)
    got = {(r["lang"], r["source"], r["chunk"]): (r["n"], r["docs"]) for r in divergence.chunk_counts(docs).collect()}
    assert got == {k: (n[k], len(held[k])) for k in n}
    cut = divergence.chunk_terms(spark.createDataFrame([("a-B\u00e9a2a",), ("--",), ("a-B\u00e9a2a",)], "chunk string"))
    assert sorted((r["term"], r["times"]) for r in cut.collect()) == [("a", 2), ("b\u00e9a", 1)]


@pytest.mark.parametrize("pass_bytes,task_bytes,rows", [(8 << 20, 32 << 20, 1000), (64, 1 << 10, 7), (1, 1, 1)])
def test_terms_of_passes_against_brute_force(spark, monkeypatch, pass_bytes, task_bytes, rows):
    """Texts over several passes, batches and combinations; term characters beyond ASCII, texts without terms or blanks."""
    docs = [tuple(r) for r in odd_docs(spark, False).na.fill("", ["lang", "source", "text"]).select("lang", "source", "text").collect()]
    docs += [("en", "a", t) for t in ("--", "1 2", "\u00d1a\u00d1A-na\x00NA", "a\u00a0B", "\x85x\x7fy[z`{", "\U0001f600a, A", "", "z")]
    n, held = Counter(), Counter()
    for lang, source, text in docs:
        terms = Counter("".join(c.lower() if c < "\x80" else c for c in t) for t in re.findall(divergence.TERM, text))
        n.update({(lang, source, t): k for t, k in terms.items()})
        held.update((lang, source, t) for t in terms)
    monkeypatch.setattr(divergence, "PASS_BYTES", pass_bytes)
    monkeypatch.setattr(divergence, "TASK_BYTES", task_bytes)
    monkeypatch.setattr(divergence, "SEND_ROWS", rows)
    table = pa.table([pa.array(c, pa.string()) for c in zip(*docs, strict=True)], names=["lang", "source", "text"])
    got_n, got_docs, sent = Counter(), Counter(), 0
    for batch in divergence._count_terms(iter(table.to_batches(max_chunksize=rows))):
        for r in batch.to_pylist():
            got_n[r["lang"], r["source"], r["term"]] += r["n"]
            got_docs[r["lang"], r["source"], r["term"]] += r["docs"]
            sent += 1
    assert (got_n, got_docs) == (n, held)
    assert sent == len(n) or task_bytes < 32 << 20


def test_terms_of_passes_against_chunks_of_the_whole_table(spark):
    docs = odd_docs(spark).repartition(5)
    whole = divergence.chunk_counts(docs)
    whole = whole.join(divergence.chunk_terms(whole), "chunk").groupBy("lang", "source", "term").agg(F.sum(F.col("n") * F.col("times")))
    got = divergence.term_counts(docs).select("lang", "source", "term", "count")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))


def test_chunks_are_not_written(spark):
    """What is written for the counts has a row for each group and term, however many chunks there are."""
    rows = [(i, " ".join(f"Sure,{i * 200 + k} ({k}.{i})few" for k in range(200)), "en", "ab"[i % 2], i) for i in range(30)]
    with scratch_scope(spark):
        by_group, by_lang = divergence.term_statistics(spark.createDataFrame(rows, DOCS))
        counts = {(r["source"], r["term"]): r["count"] for r in by_group.collect()}
        root = scratch_root(spark).removeprefix("file://")
        total = sum(pq.read_metadata(p).num_rows for p in glob.glob(f"{root}/**/*.parquet", recursive=True))
    assert counts == {(s, t): 3000 for s in "ab" for t in ("sure", "few")}
    assert total == 6


def test_totals_beyond_64_bits(spark):
    rows = spark.range(1).select(F.lit(3 * 10**12).alias("c"), F.lit(10**13).alias("t"), F.lit(5).alias("v"))
    assert rows.select(divergence._share("c", "t", "v").alias("p")).first()["p"] == 1 + 10**9 * (3 * 10**12 + 2) // (10**13 + 10)


def test_empty_tables(spark):
    assert divergence.divergence(empty_docs(spark)).collect() == []
    only_null = spark.createDataFrame([(1, None, None, None, None), (2, None, None, "a", None)], DOCS)
    assert sorted(map(tuple, divergence.divergence(only_null).collect())) == [("", "", "pair", "a", 0, 1), ("", "a", "pair", "", 0, 1)]
