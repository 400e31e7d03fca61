"""Hits and items against a search for every window at every place."""

import hashlib
import random
import re
import tracemalloc
from types import SimpleNamespace

import pyarrow as pa
import pytest

from provenir.llm import decontaminate, queries
from tests.llm.cases import PASSAGE, docs, empty

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_force(rows, items, width):
    split = lambda t: WORD.findall((t or "").translate(LOWER))
    windows = {}
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - width + 1)) if w and i is not None else ():
            windows.setdefault(tuple(w[k : k + width]), set()).add(i)
    out = []
    for i, t in rows:
        w, hit, found = split(t), set(), set()
        for n in {len(p) for p in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= own
        out.append((i, len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("part", [100_000, 40])
def test_random_texts_of_few_words(spark, monkeypatch, part):
    monkeypatch.setattr(decontaminate, "PART_PATTERNS", part)
    draw = random.Random(4)
    some = lambda most: " ".join(draw.choices(["a", "B", "cc", "ñ", "3", "d-e", "日本"], k=draw.randrange(most)))
    items = [(i, some(9)) for i in range(40)] + [(41, None), (42, ""), (None, "a B cc"), (43, "cc cc"), (44, "cc cc")]
    rows = [(i, some(40)) for i in range(300)] + [(300, None), (300, ""), (301, "?!"), (302, "cc cc cc " * 5000)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_benchmark(docs(spark, rows).drop("hits"), benchmark, width=4).collect()
    have = [(r.doc_id, r.hits.n_words, sum(s.end - s.begin for s in r.hits.spans), list(r.hits["items"])) for r in got]
    assert sorted(map(repr, have)) == sorted(map(repr, brute_force(rows, items, 4)))
    for r in got:
        assert all(a.end < b.begin for a, b in zip(r.hits.spans, r.hits.spans[1:], strict=False))


def test_a_planted_passage_and_empty_tables(spark):
    benchmark = spark.createDataFrame([(7, PASSAGE)], "item_id long, text string")
    rows = [(1, "clean text of no interest"), (2, "before " + PASSAGE.upper().replace(" ", ", ") + " after"), (3, " ".join(PASSAGE.split()[:9]))]
    found = decontaminate.find_benchmark(docs(spark, rows), benchmark, out="found")
    assert {r.doc_id: list(r.found["items"]) for r in found.collect()} == {1: [], 2: [7], 3: []}
    assert decontaminate.find_benchmark(empty(spark), benchmark, out="found").count() == 0
    none = decontaminate.find_benchmark(docs(spark, rows), benchmark.limit(0), out="found")
    assert {r.found.n_words for r in none.collect()} and not any(r.found["items"] for r in none.collect())
    with pytest.raises(ValueError, match="already"):
        decontaminate.find_benchmark(docs(spark, rows), benchmark)


def test_query(spark, sf_dir):
    read = lambda n: [tuple(r)[:2] for r in spark.read.parquet(f"{sf_dir}/{n}.parquet").collect()]
    want = {
        i: (n, hit, len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), hit > 0)
        for i, n, hit, found in brute_force(read("documents"), read("benchmark"), 10)
    }
    assert {r[0]: tuple(r)[1:] for r in queries.op5_decontaminate(spark, sf_dir).collect()} == want


def test_texts_of_a_batch_are_not_all_held_as_strings():
    """24 MB of texts in the 10,000 rows that Spark hands over at once."""
    passage = tuple(decontaminate.words_of(PASSAGE))[:10]
    search = decontaminate._searcher(SimpleNamespace(value=[(passage, [7])]))
    texts = pa.array([None, PASSAGE, ""] + ["some words " * 220 + str(i) for i in range(9_997)])
    search(texts.slice(0, 1))
    tracemalloc.start()
    try:
        found = search(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 8 << 20, peak
    assert len(found) == 10_000 and found.type == decontaminate._HITS
    assert found.slice(0, 4).to_pylist() == [
        {"n_words": 0, "spans": [], "items": []},
        {"n_words": len(PASSAGE.split()), "spans": [{"begin": 0, "end": 10}], "items": [7]},
        {"n_words": 0, "spans": [], "items": []},
        {"n_words": 441, "spans": [], "items": []},
    ]
    assert search(texts.slice(0, 0)).type == decontaminate._HITS
