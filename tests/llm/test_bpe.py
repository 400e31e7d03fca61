"""Ids and texts against the tokenizers library."""

import hashlib
import os
import random
import re
import sys
import time
import tracemalloc
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from provenir.llm import bpe, queries
from provenir.llm.common import give_back
from tests.llm.cases import ROWS, docs, empty

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load_vocabulary(PATH)


def expected(texts):
    tokenizer = Tokenizer.from_file(PATH)
    ids = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    return [(i, tokenizer.decode(i, skip_special_tokens=False)) for i in ids]


def test_awkward_rows(spark, vocabulary):
    got = bpe.decode(bpe.encode(docs(spark), vocabulary), vocabulary).collect()
    want = [(i, *e) for (i, t), e in zip(ROWS, expected([t for _, t in ROWS]), strict=True)]
    assert sorted(map(repr, ((r.doc_id, r.ids, r.decoded) for r in got))) == sorted(map(repr, want))
    assert bpe.encode(empty(spark), vocabulary).count() == 0


def test_spaces_specials_and_scripts_in_any_order(spark, vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 20_000)  # many blocks
    draw = random.Random(3)
    parts = [" ", "  ", "\n", " \n", "\t", "a", "Foo", "é", " ", "　", "\x1c", "\x85", "<|endoftext|>", "'s", "12", "!", "日本", "​", "🙂", "﻿", "é", "᠎"]
    texts = ["".join(draw.choices(parts, k=draw.randrange(14))) for _ in range(4000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.ids, r.decoded) for r in bpe.decode(bpe.encode(rows, vocabulary), vocabulary).collect()}
    assert [got[i] for i in range(len(texts))] == expected(texts)


def test_decoding_odd_arrays(spark, vocabulary):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [None, 64]), (4, [447])], "i int, ids array<int>")
    got = {r.i: r.decoded for r in bpe.decode(rows, vocabulary).collect()}
    assert (got[1], got[2], got[3]) == (None, "", "a") and got[4] == Tokenizer.from_file(PATH).decode([447])
    with pytest.raises(Exception, match="out of bounds"):
        bpe.decode(spark.createDataFrame([([10**6],)], "ids array<int>"), vocabulary).collect()


def test_words_of_a_block_are_not_all_held_as_strings(vocabulary, monkeypatch):
    """Two million words, few of them distinct, in many packets."""
    monkeypatch.setenv("PYTHONHASHSEED", "0")
    text = " ".join(f"w{i % 997}" for i in range(20_000))
    packet = pa.record_batch({"block": pa.array([0], pa.int32()), "doc_id": pa.array([1], pa.int64()), "text": pa.array([text])})
    block = pa.Table.from_batches(list(bpe._deal()(iter([packet] * 100))))
    words = bpe._send_words(block, vocabulary, 3)
    buckets = np.asarray(words["bucket"])
    replies = pa.concat_tables(bpe._encode_words(words.filter(pa.array(buckets == b)), vocabulary) for b in range(3))
    tracemalloc.start()
    try:
        placed = bpe._place_ids(block, replies, vocabulary, 3, "decoded")
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert placed.num_rows == 100 and set(placed.column("decoded").to_pylist()) == {text}
    assert peak < 5 * 100 * len(text)  # 64 bytes a word, 11 times the text, if each were a string


def test_words_are_ranges_of_the_texts(vocabulary):
    """Against splitting each text by itself; the seams of texts are no words and no added tokens."""
    draw = random.Random(4)
    parts = [" ", "  ", "\n", "a", "Foo", "é", "\u00a0", "\u3000", "\x85", "<|endof", "text|>", "<|endoftext|>", "日本", "\u200b", "🙂", "ł", "ệ", "’"]
    packets = [["".join(draw.choices(parts, k=draw.randrange(7))) for _ in range(40)] for _ in range(60)]
    for texts in [*packets, [""] * 3, [], ["a <|endof", "text|>", "", "text|> b"], [" "], ["a ", " b", "", " "]]:
        raw = [t.encode() for t in texts]
        words, counts = bpe._split(b"".join(raw), np.array([len(r) for r in raw], np.int64), vocabulary)
        want = [[first, *(" " + p for p in rest)] for first, *rest in (bpe._parts(t, vocabulary) for t in texts)]
        want = [[w for w in own if w] for own in want]
        # A first part that is empty is no word; what follows it begins the text.
        assert [w.decode() for w in words.to_pylist()] == [w for own in want for w in own]
        assert counts.tolist() == list(map(len, want))


def test_first_bytes_that_surely_are_no_white_space():
    sure = re.compile(f"[{bpe._SURE}]")
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]):
        assert not bpe._SURE_LEADS[c.encode()[0]] or sure.match(c), hex(ord(c))


def test_words_have_one_number_in_all_packets():
    arrays = [["a", "b"], [], ["b", "c", "a"], ["d"] * 3, ["c"]]
    numbers, words = bpe._numbered([pa.array([w.encode() for w in a], pa.binary()) for a in arrays])
    assert [[words[int(i)].as_py().decode() for i in own] for own in numbers] == arrays and len(words) == 4
    assert [len(n) for n in bpe._numbered([pa.array([], pa.binary())] * 2)[0]] == [0, 0]


def test_buckets_do_not_depend_on_the_order_of_words():
    words = pa.array([f"w{i}".encode() for i in range(500)], pa.binary())
    other = words.take(pa.array(np.random.default_rng(1).permutation(500)))
    (order, buckets), (others, same) = (bpe._by_bucket(w, 7) for w in (words, other))
    assert words.take(pa.array(order)).equals(other.take(pa.array(others))) and buckets.tolist() == same.tolist()
    assert set(buckets.tolist()) == set(range(7))


def test_a_word_that_occurs_again_costs_little(vocabulary, monkeypatch):
    """Two million words, few of them distinct, against splitting and looking up each in Python."""
    monkeypatch.setenv("PYTHONHASHSEED", "0")
    text = " ".join(f"w{i % 997}" for i in range(20_000))
    packet = pa.record_batch({"block": pa.array([0], pa.int32()), "doc_id": pa.array([1], pa.int64()), "text": pa.array([text])})
    block = pa.Table.from_batches(list(bpe._deal()(iter([packet] * 100))))
    words = bpe._send_words(block, vocabulary, 1)
    replies = bpe._encode_words(words, vocabulary)

    def plain():
        known = {w: w.encode() for w in text.split(" ")}
        return [b"".join(map(known.__getitem__, text.split(" "))) for _ in range(100)]

    def seconds(run) -> float:
        times = []
        for _ in range(3):
            begun = time.process_time()
            run()
            times.append(time.process_time() - begun)
        return min(times)

    both = seconds(lambda: bpe._send_words(block, vocabulary, 1)) + seconds(lambda: bpe._place_ids(block, replies, vocabulary, 1, None))
    assert both < 2.2 * seconds(plain)  # 3.3 to 4 times with each word a Python string, 1.1 to 1.5 times now


@pytest.mark.skipif(sys.platform != "linux" or "glibc" not in os.confstr("CS_GNU_LIBC_VERSION"), reason="needs malloc_trim")
def test_freed_memory_goes_back_to_the_system():
    def held() -> int:
        return int(Path("/proc/self/statm").read_text().split()[1]) * os.sysconf("SC_PAGE_SIZE")

    many = [bytes(2000) for _ in range(50_000)]
    last = many[::1000]  # so that none of the rest is at the end of the heap
    del many
    before = held()
    give_back()
    assert before - held() > 50_000_000 and len(last) == 50


def test_ids_of_every_document(spark, sf_dir):
    """Digests of ids and decoded texts against the library, document by document."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op1_bpe_round_trip(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for row, (ids, decoded) in zip(rows, expected([r.text for r in rows]), strict=True):
        own = got[row.doc_id]
        digests = (hashlib.sha256(t.encode()).hexdigest() for t in (",".join(map(str, ids)), decoded))
        assert (own.n_tokens, own.ids_sha256, own.decoded_sha256) == (len(ids), *digests)


def test_query(spark, sf_dir):
    got = queries.op1_bpe_round_trip(spark, sf_dir)
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha"))
    assert got.join(texts, "doc_id").where("sha = decoded_sha256 and n_tokens > 0").count() == 200
