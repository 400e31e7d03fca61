"""Rows that every operator has to stand."""

import random

PASSAGE = "the harbour lights went out one after another while the last ferry turned slowly towards the open sea and nobody on the quay said a word about it until morning came"


def words(seed, n):
    draw = random.Random(seed)
    return " ".join("".join(draw.choices("abcdefghijklmnop", k=draw.randrange(2, 8))) for _ in range(n))


# Ids with nulls, empty, blank and very long texts, copies, ties and repeated rows.
ROWS = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one"),
    (5, words(5, 40_000)),
    (6, words(6, 80)),
    (7, words(6, 80)),
    (8, words(6, 78) + " other end"),
    (9, words(9, 30) + " " + PASSAGE),
    (10, PASSAGE + " " + words(10, 30)),
    (11, "ünïcödé 日本語 🙂 " + PASSAGE),
    (12, "x" * 100_000),
    (13, "...!!! 123"),
    (6, words(6, 80)),
    (None, words(14, 50)),
]
CLASHES = ("block", "node", "key", "text_", "component", "component_id", "kept", "label", "lang", "hits", "sketch", "bucket", "n_chars", "language_found", "benchmark_hits")


def docs(spark, rows=ROWS):
    """The rows with further columns of awkward names."""
    extra = [f"{name} string" for name in CLASHES]
    return spark.createDataFrame([(i, t, *(["extra"] * len(extra))) for i, t in rows], ", ".join(["doc_id long", "text string", *extra]))


def empty(spark):
    return docs(spark, ROWS[:1]).limit(0)
