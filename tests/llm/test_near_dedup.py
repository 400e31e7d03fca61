"""Links and groups against all pairs in plain Python."""

import random
import tracemalloc

import pyarrow as pa
import pytest

from provenir.llm import near_dedup, queries
from provenir.llm.components import components
from tests.llm.cases import ROWS, docs, empty, words

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, n):
    own = [w for w in (text or "").translate(LOWER).replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    own = [w for part in own for w in part.replace("\t", "\n").replace("\r", "\n").split("\n") if w]
    if not own:
        return frozenset()
    return frozenset(tuple(own[i : i + n]) for i in range(max(1, len(own) - n + 1)))


def brute_force(rows, n, percent=80):
    sets = {i: shingles(t, n) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = {}
    for i, own in sets.items():
        for s in own:
            holders.setdefault(s, []).append(i)
    for i, own in sets.items():
        for j in {j for s in own for j in holders[s] if j < i}:
            if 100 * len(own & sets[j]) >= percent * len(own | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def check(spark, rows, n):
    got = near_dedup.near_duplicates(docs(spark, rows), words=n).collect()
    want = brute_force(rows, n)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
            assert r.kept == (r.doc_id == r.component_id)


def test_awkward_rows(spark):
    check(spark, ROWS, 5)
    assert near_dedup.near_duplicates(empty(spark)).count() == 0
    with pytest.raises(ValueError, match=r"0\.8"):
        near_dedup.near_duplicates(empty(spark), percent=50)


def test_groups_around_the_threshold(spark):
    """Copies with more and more edits, chains of them, and a passage many share."""
    draw = random.Random(8)
    rows, shared = [], words(99, 40).split()
    for base in range(12):
        text = words(base, draw.randrange(6, 150)).split()
        for _ in range(18):
            copy = list(text)
            for _ in range(draw.randrange(1 + len(copy) // 12)):
                copy[draw.randrange(len(copy))] = words(draw.random(), 1)
            rows.append(copy)
            text = copy if draw.random() < 0.5 else text  # chains
    rows += [words(1000 + i, draw.randrange(20, 60)).split() + shared for i in range(120)]
    draw.shuffle(rows)
    check(spark, [(i * 3, " ".join(r)) for i, r in enumerate(rows)], 4)


def test_keep_one_keeps_columns_and_null_ids(spark):
    table = docs(spark)
    kept = near_dedup.keep_one(table, near_dedup.near_duplicates(table))
    assert kept.columns == table.columns
    # The repeated row of 6 is the same document and stays; 7 is a copy of it.
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted((i or 0) for i, _ in ROWS if i not in (7, 8))


def test_components_of_chains_stars_and_loops(spark):
    pairs = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(200, 200), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 140)} | {200: 200}


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = brute_force(rows, 4)
    got = queries.op9_minhash_near_dedup(spark, sf_dir).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_sets_of_a_batch_are_not_all_held_at_once():
    """24 MB of texts in the 10,000 rows that Spark hands over at once."""
    texts = [None, ""] + [f"w{i} " + " ".join(f"v{i % 7 + k}" for k in range(480)) for i in range(9_998)]
    batch = pa.record_batch({"doc_id": pa.array(range(10_000), pa.int64()), "text": pa.array(texts)}).slice(1)
    next(near_dedup._sketch(iter([batch.slice(0, 9)]), 5))
    tracemalloc.start()
    try:
        n = sum(found.num_rows for found in near_dedup._sketch(iter([batch]), 5))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 9_999
    assert peak < 50 << 20, peak
    some = batch.slice(0, 2_000)
    assert pa.Table.from_batches(near_dedup._sketch(iter([some]), 5)).equals(pa.Table.from_batches([near_dedup._sketch_batch(some, 5)]))
