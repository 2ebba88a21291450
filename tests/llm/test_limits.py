"""What operators hold in memory, and the kinds of input that decide their time."""

import tracemalloc

import numpy as np

from tests.llm.fixtures import plain_texts
from wattline.llm import packing, quality_classifier


def test_learning_holds_the_counts_once(spark):
    texts = plain_texts(1400)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(texts))], "doc_id long, quality int")
    tracemalloc.start()
    try:
        model = quality_classifier.fit(docs, labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    counts = len(model.labels) * quality_classifier.COUNTS * 2
    assert len(model.labels) > 900 and peak < 2.5 * counts + (24 << 20), peak / counts


class _Counted:
    """A normalizer or tokenizer whose calls are counted."""

    def __init__(self, inner):
        self.inner, self.calls = inner, 0

    def __getattr__(self, name):
        if name in ("normalize_str", "encode"):
            self.calls += 1
        return getattr(self.inner, name)


class _Tokenizer(_Counted):
    def __init__(self, inner):
        super().__init__(inner)
        self.normalizer = _Counted(inner.normalizer)


def test_words_of_letters_need_no_normalizer():
    tokens = packing.WordTokens(packing._default_path())
    letters = [chr(c) for c in range(0x80, 0x250) if chr(c).isalpha()]
    assert all(tokens.tokenizer.normalizer.normalize_str(c) == c.lower() for c in letters)
    words = [f"ka{a}{b}no" for a, b in zip(letters, reversed(letters), strict=True)]
    texts = [w for c in words for w in (f"{c}\t {c} {c.upper()}, {c}.\n", f" {c}")] + ["", " \n", "étİ x y a\x0b\x0cb"]
    want = [tokens.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    tokens.tokenizer = _Tokenizer(tokens.tokenizer)
    data = [t.encode() for t in texts]
    got = tokens.encode(np.frombuffer(b"".join(data), np.uint8), np.array([len(d) for d in data]))
    assert [g.tolist() for g in got] == want
    assert tokens.tokenizer.normalizer.calls == 0 and tokens.tokenizer.calls < 60
