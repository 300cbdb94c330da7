"""Fixtures of edge cases for document operators: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, contaminated boolean, kept boolean, _h string"


def edge_documents(spark, more=()):
    r = random.Random(7)
    words = [f"w{k}" for k in range(300)]
    long_text = " ".join(r.choice(words) for _ in range(30_000))
    texts = ["", None, " ", "One two three", "one TWO three", "one two three four five six", long_text, long_text, long_text[:-5] + "other", "É mais ça\nva", *more]
    rows = [(k, t, None if k % 3 else "en", "src0", None, 0.5, None, True, "x") for k, t in enumerate(texts)]
    rows += [(None, "one two three", None, None, None, None, None, None, None), rows[3]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)
