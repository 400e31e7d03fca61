"""Repeated windows against a table of all windows."""

import pyarrow as pa
import pytest

from provenir.llm import common, queries, suffix_dedup
from tests.llm.cases import PASSAGE, ROWS, docs, empty, words


def brute_force(rows, threshold):
    least = {}
    texts = [(2**63 - 1 if i is None else i, (t or "").encode()) for i, t in rows]
    for i, t in texts:
        for p in range(len(t) - threshold + 1):
            w = t[p : p + threshold]
            least[w] = min(least.get(w, i), i)
    out = []
    for i, t in texts:
        cut = bytearray(len(t))
        for p in range(len(t) - threshold + 1):
            if least[t[p : p + threshold]] < i:
                cut[p : p + threshold] = b"\x01" * threshold
        spans, at = [], 0
        while (at := cut.find(1, at)) >= 0:
            end = cut.find(0, at)
            end = len(t) if end < 0 else end
            spans.append((at, end))
            at = end
        out.append((bytes(b for b, c in zip(t, cut, strict=True) if not c), spans))
    return out


@pytest.mark.parametrize(("threshold", "block"), [(50, 4 << 20), (50, 3000), (7, 20_000), (2, 20_000)])
def test_awkward_rows(spark, monkeypatch, threshold, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
    rows = [r for r in ROWS if threshold == 50 or len(r[1] or "") < 10_000]
    got = suffix_dedup.remove_repeats(docs(spark, rows), threshold=threshold, keep=("block", "lang")).collect()
    want = [(i, len((t or "").encode()), kept, spans) for (i, t), (kept, spans) in zip(rows, brute_force(rows, threshold), strict=True)]
    have = [(r.doc_id, r.n_bytes, bytes(r.kept), [tuple(s) for s in r.removed]) for r in got]
    assert sorted(map(repr, have)) == sorted(map(repr, want))
    assert {(r.block, r.lang) for r in got} == {("extra", "extra")}


def test_windows_of_hot_digits(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(suffix_dedup, "HOT_BLOCKS", 3)
    rows = [r for r in ROWS if len(r[1] or "") < 10_000]
    rows += [(100 + i, f"{words(i, 20)} {PASSAGE[:30]} {words(50 + i % 7, 20)}") for i in range(40)] + [(None, PASSAGE), (100, PASSAGE)]
    got = suffix_dedup.remove_repeats(docs(spark, rows)).collect()
    want = [(i, *found) for (i, _), found in zip(rows, brute_force(rows, 50), strict=True)]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, bytes(r.kept), [tuple(s) for s in r.removed])) for r in got)


def test_a_phrase_of_many_documents_fills_no_bucket():
    """A phrase of one digit, and other text around it in every document."""
    n = 80
    schema = pa.schema({"block": pa.int32(), "doc_id": pa.int64(), "text": pa.string()})
    blocks = [
        pa.table([[b] * 20, range(b * 20, b * 20 + 20), [f"{words(b * 20 + i, 9)} {PASSAGE[:40]} {words(9000 + b * 20 + i, 9)}" for i in range(20)]], schema=schema)
        for b in range(n)
    ]

    def grouped(tables, *keys):
        rows = pa.concat_tables(tables).combine_chunks()
        names = list(zip(*(rows.column(k).to_pylist() for k in keys), strict=True))
        return {k: rows.take([i for i, x in enumerate(names) if x == k]) for k in sorted(set(names))}

    digits = grouped([suffix_dedup._send_digits(b, 50, n) for b in blocks], "bucket")
    flags = grouped([suffix_dedup._flag_digits(d, suffix_dedup.HOT_BLOCKS) for d in digits.values()], "block")
    spans = grouped([suffix_dedup._send_spans(b, flags[(k,)], 50, n) for k, b in enumerate(blocks)], "bucket", "kind")
    sizes = [sum(map(len, t.column("ids").to_pylist())) // 8 for t in spans.values()]
    assert sum(sizes) > 20 * n and max(sizes) < 0.05 * sum(sizes)


def test_long_texts_are_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    rows = [(1, words(1, 2000)), (2, words(2, 500) + words(1, 2000)[300:7000] + words(3, 100)), (3, "ab" * 4000), (4, "ba" * 300)]
    got = {r.doc_id: (bytes(r.kept), [tuple(s) for s in r.removed]) for r in suffix_dedup.remove_repeats(docs(spark, rows)).collect()}
    assert [got[i] for i in (1, 2, 3, 4)] == brute_force(rows, 50)


def test_text_keeps_whole_characters(spark):
    shared = "é" * 30
    rows = [(1, f"a{shared}b"), (2, f"日{shared}本")]
    got = {r.doc_id: r.kept for r in suffix_dedup.remove_repeats(docs(spark, rows), threshold=51, as_text=True).collect()}
    assert got == {1: f"a{shared}b", 2: "日本"}
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def test_query(spark, sf_dir):
    import hashlib

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = {
        i: (len(t.encode()), len(t.encode()) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
        for (i, t), (kept, spans) in zip(rows, brute_force(rows, 50), strict=True)
    }
    assert {r[0]: tuple(r)[1:] for r in queries.op3_suffix_dedup(spark, sf_dir).collect()} == want


def test_a_planted_passage_stays_once(spark):
    rows = [(i, f"{words(i, 40)} {PASSAGE} {words(100 + i, 40)}") for i in range(1, 30)]
    kept = [r.kept for r in suffix_dedup.remove_repeats(docs(spark, rows), as_text=True).collect()]
    assert sum(PASSAGE in k for k in kept) == 1


def test_each_group_gives_its_memory_back(monkeypatch):
    """Spark keeps the workers; the next stage would have what a block took on top of its own."""
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    block = pa.table({"block": pa.array([0, 0], pa.int32()), "doc_id": [1, 2], "text": [PASSAGE, "x " + PASSAGE]})
    digits = suffix_dedup._send_digits(block, 50, 1)
    flags = suffix_dedup._flag_digits(digits, 64)
    spans = suffix_dedup._send_spans(block, flags, 50, 1)
    replies = pa.concat_tables([flags, suffix_dedup._judge_spans(spans, 50)])
    left = suffix_dedup._remove(block, replies, 50, 1, [], True)
    assert left.column("kept").to_pylist() == [PASSAGE, "x "]
    assert len(calls) == 5
