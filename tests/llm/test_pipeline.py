"""Each stage of the pipeline against what it must keep, and the whole run."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tests.llm.fixtures import DOCS, empty_docs, odd_docs, plain_texts
from tests.llm.test_pairs import components, fingerprint
from tests.llm.test_repeats import expected
from wattline.llm.common import table
from wattline.llm.repeats import BYTES

FOLDER = "/root/testdata/sf0.001"


def test_stages():
    assert len(pipeline.STAGES) == 5 and [f.__name__ for _, f in pipeline.STAGES] == [
        "classify", "drop_near_copies", "drop_repeats", "mix_sources", "pack_sequences"]


def test_classifier_stage_keeps_good_documents(spark):
    folder = FOLDER.replace("0.001", "0.01")
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    kept = pipeline.classify(spark, docs, folder)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    good = [r.doc_id for r in labels.where("quality = 1").collect()]
    bad = [r.doc_id for r in labels.where("quality = 0").collect()]
    assert sum(i in ids for i in good) > 0.97 * len(good) and sum(i in ids for i in bad) < 0.1 * len(bad)


def test_one_document_of_each_group_stays(spark):
    docs = odd_docs(spark).where("doc_id IS NOT NULL AND NOT (doc_id = 5 AND n_chars = 1)")
    prints = {r.doc_id: fingerprint(r.text) for r in docs.collect()}
    kept = pipeline.drop_near_copies(spark, docs, FOLDER)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({*components(prints).values()})


def test_rows_of_one_id_and_of_none_are_judged_one_by_one(spark):
    docs = odd_docs(spark)
    texts = plain_texts(48)
    more = [(None, "alone without an id " + t, "en", "a", 1) for t in texts[:3]] + [(5, "other words " + texts[9], "fr", "b", 2)]
    more += [(200, texts[9], "en", "a", 1), (200, "only under two hundred " + texts[13], "en", "a", 1), more[0]]
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(more, DOCS))
    rows = sorted({tuple(r) for r in docs.collect()}, key=lambda r: (r[0] is None, r[0] or 0, str(r)))
    root = components({i: fingerprint(r[1]) for i, r in enumerate(rows)})  # the first place of each group
    kept = [tuple(r) for r in pipeline.drop_near_copies(spark, docs, FOLDER).collect()]
    assert len(set(kept)) == len(kept)
    groups = [root[rows.index(r)] for r in kept]
    assert sorted(groups) == sorted({*root.values()})
    assert all(r[0] == rows[g][0] for r, g in zip(kept, groups, strict=True))
    assert sum(r[0] is None for r in kept) > 1 and sum(r[0] == 5 for r in kept) > 1 and sum(r[0] == 200 for r in kept) == 1


def test_repeats_stage_removes_whole_characters(spark):
    docs = odd_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = expected(rows, BYTES)
    kept = pipeline.drop_repeats(spark, docs, FOLDER)
    assert kept.columns == docs.columns
    by = {}
    for r in kept.collect():
        by.setdefault(r.doc_id, []).append(r.text)
    for (d, text), mark in want.items():
        if len(by.get(d, [])) > 1 or [x for x, _ in rows].count(d) > 1:
            continue
        cut, at = [], 0
        for c in text:
            size = len(c.encode())
            if not any(mark[at:at + size]):
                cut.append(c)
            at += size
        assert by.get(d, [""])[0] == "".join(cut)
    assert by[100] == [None, None] and by[101] == [""]


@pytest.mark.parametrize("make", [empty_docs, odd_docs])
def test_all_stages_take_odd_tables(spark, make):
    docs = make(spark)
    for _, stage in pipeline.STAGES:
        docs = pipeline.materialize(stage(spark, docs, FOLDER), "test-stage")
    assert docs.count() >= 0 and "sequence_id" in docs.columns


def test_run_packs_what_the_mix_takes(spark):
    out = pipeline.run(spark, FOLDER)
    assert out.count() > 0 and out.where("length > 4096 OR length < 1").count() == 0
    full = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert full.where("n <> end OR n > 4096").count() == 0
