"""Phrases against plain counting."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from provenir.llm import collocations as c
from provenir.llm import queries
from tests.llm.cases import docs, empty

UPPER = str.maketrans({chr(b): chr(b + 32) for b in range(65, 91)})


def by_hand(rows, longest, least, percent, top):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(UPPER)):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            inside = (b for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))))
            if any(100 * b >= percent * a for b in inside):
                continue
            score, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string")


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def random_rows(seed, n):
    draw = random.Random(seed)
    words = ["a", "A", "b", "ab", "b\x1c", "é", "É", "日本", "x-y", " ", "c", "d"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", " ! ", "\x0b", ";"]
    return [
        (draw.choice(["en", "fr", None, "und", ""]), "".join(draw.choice(words) + draw.choice(ends) for _ in range(draw.randrange(40))))
        for _ in range(n)
    ]


@pytest.mark.parametrize(("longest", "least", "percent", "top"), [(3, 3, 50, 2000), (2, 5, 50, 10), (4, 2, 80, 60)])
def test_random_texts(spark, monkeypatch, longest, least, percent, top):
    monkeypatch.setattr(c, "BUCKET_WORDS", 400)  # many buckets
    rows = random_rows(longest, 150) + [(None, None), ("en", ""), ("en", "...")]
    got = c.collocations(table(spark, rows), longest, least, percent, top)
    assert found(got) == by_hand(rows, longest, least, percent, top)


def test_small_blocks_cut_no_piece():
    text = b"one two three.four five.six" * 40
    c_bytes, c.BLOCK_BYTES = c.BLOCK_BYTES, 16
    try:
        parts = list(c._slices(text))
    finally:
        c.BLOCK_BYTES = c_bytes
    assert b".".join(parts) == text and len(parts) > 20


def test_a_pair_in_a_third_of_all_rows(spark):
    rows = [("en", "hot pair")] * 1000 + [("en", f"w{i} hot w{i}") for i in range(2000)]
    assert found(c.collocations(table(spark, rows))) == [("en", 1, "hot pair", 1000, 3000, 1000, 8000, 333_333)]


def test_awkward_rows(spark):
    """Repeated rows count again; extra columns and very long texts are no matter."""
    rows = docs(spark).withColumns({"rank": F.lit(1), "words": F.lit("x"), "f": F.lit(2)})
    plain = [(r.lang, r.text) for r in rows.select("lang", "text").collect()]
    assert found(c.collocations(rows, least=2)) == by_hand(plain, 3, 2, 50, 2000)
    assert c.collocations(empty(spark)).count() == 0
    assert c.collocations(docs(spark).where("doc_id = 2")).count() == 0


def test_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text").collect()
    assert found(queries.op12_phrase_collocations(spark, sf_dir)) == by_hand([tuple(r) for r in rows], 3, 10, 50, 2000)
