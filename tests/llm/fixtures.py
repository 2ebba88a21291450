"""Small tables with every odd case: nulls, empty and very long texts, ties, repeated rows, clashing column names."""

import random

CLASHES = ["n_words", "size", "fp", "hash", "start", "stop", "context", "score", "digest", "label", "stratum", "words", "taken",
           "spans", "whole", "h", "point", "query", "refers", "first", "record", "_kept", "_score"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_texts(n, seed=3):
    rng = random.Random(seed)
    words = [a + b for a in ("ka", "lo", "mi", "ré", "tu", "zen") for b in ("ra", "no", "ß", "vil", "qu", "s", "thor")]
    texts = []
    for i in range(n):
        kind = i % 6
        if kind == 4 and texts:  # a copy with one word changed
            parts = rng.choice(texts).split(" ")
            parts[rng.randrange(len(parts))] = rng.choice(words)
            texts.append(" ".join(parts))
        elif kind == 5 and texts:  # a passage of another text inside new words
            parts = rng.choice(texts).split(" ")
            at = rng.randrange(max(1, len(parts) - 40))
            texts.append(" ".join([*rng.choices(words, k=15), *parts[at:at + 40], *rng.choices(words, k=15)]))
        else:
            texts.append(" ".join(rng.choices(words, k=rng.randrange(1, 120))))
    return texts


def odd_docs(spark, clashes=True):
    texts = plain_texts(48)
    rows = [(i, t, ("en", "fr", None)[i % 3], ("a", "b", None, "c")[i % 4], len(t)) for i, t in enumerate(texts)]
    rows += [(100, None, None, None, None), (101, "", "en", "a", 0), (102, " \t\n\x0b\x0c\r ", "en", "a", 7), (103, "one", "en", "a", 3)]
    rows += [(104, "x " * 6000 + "y", "en", "b", 12001), (105, "ab" * 9000, "en", "b", 18000)]  # one long line, one long word
    rows += [(106, texts[0], "en", "a", 1), (107, texts[0], "en", "a", 1)]  # copies
    rows += [rows[3], rows[3], rows[100 - 100 + 48]]  # repeated rows
    rows += [(5, texts[7], "en", "a", 1)]  # another text under a used id
    rows += [(None, texts[1], "en", "a", 1), (None, None, None, None, None)]
    rows += [(108, "same line here\n" * 30 + "end", "en", "c", 1), (109, "a b   c\x1cd e\x85f " * 12, "en", "c", 1)]
    rows += [(110, texts[2] + "\n" + texts[2], "en", "a", 1)]  # repeats inside one document
    docs = spark.createDataFrame(rows, DOCS)
    if clashes:
        for i, name in enumerate(CLASHES):
            docs = docs.withColumn(name, docs["doc_id"] + i if i % 2 else docs["lang"])
    return docs


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)
