"""Byte-level BPE by a table of distinct words, and back by a table of pieces.

Texts are split at spaces that begin a word, where the tokenizer always ends one
token and begins the next, so the parts are encoded alone with the same ids. Each
distinct word is encoded once, wherever it occurs, and the ids are joined back by
position. Decoding joins every id with its piece.

Plan: texts are dealt once into blocks of about ``BLOCK_BYTES``, compressed before the
shuffle, since they are most of what moves. A block sends its distinct words to buckets by their hash, packed, never more rows than words; a bucket
encodes each word once and sends the ids back, and a block looks up its words. The
table of words is nowhere held whole; the table of pieces is bounded by the vocabulary.
Words are ranges of the bytes of the texts, numbered and looked up as Arrow arrays; only
distinct ones become Python objects.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from math import ceil
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenir.llm.common import giving_back, id_and_text, text_bytes

BLOCK_BYTES = 8 << 20

# What surely is no white space in any edition of Unicode; a space before anything
# else begins no word here, which only makes parts longer.
_SURE = "!-~¡-ᙿ⁰-⿿、-퟿豈-﻾\U00010000-\U0010ffff"

# First bytes in UTF-8 of which every character is in ``_SURE``.
_SURE_LEADS = np.zeros(256, bool)
for _first, _last in ((0x21, 0x7E), (0xC3, 0xE0), (0xE4, 0xEC), (0xF0, 0xF4)):
    _SURE_LEADS[_first : _last + 1] = True


def load_vocabulary(path: str) -> str:
    """The tokenizer file as text; its size is that of the vocabulary."""
    with open(path, encoding="utf-8") as file:
        return file.read()


@lru_cache(maxsize=2)
def _tokenizer(vocabulary: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(vocabulary)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=2)
def _added(vocabulary: str) -> dict[str, int]:
    """Added tokens and their ids, from the file itself: a tokenizer is large to build."""
    return {t["content"]: t["id"] for t in json.loads(vocabulary).get("added_tokens") or ()}


@lru_cache(maxsize=2)
def _splitter(vocabulary: str) -> tuple[re.Pattern, re.Pattern]:
    """What makes a text odd, and where an odd text is split."""
    special = "|".join(map(re.escape, _added(vocabulary))) or "(?!)"
    return re.compile(f" (?![{_SURE}])|{special}"), re.compile(f" (?=[{_SURE}])(?!{special})")


@lru_cache(maxsize=2)
def _added_bytes(vocabulary: str) -> re.Pattern:
    return re.compile(b"|".join(re.escape(t.encode()) for t in _added(vocabulary)) or b"(?!)")


def _parts(text: str, vocabulary: str) -> list[str]:
    """The text up to the first splitting space, then what follows each such space."""
    odd, split = _splitter(vocabulary)
    return split.split(text) if odd.search(text) else text.split(" ")


@lru_cache(maxsize=2)
def _pieces(vocabulary: str) -> pa.Array:
    """The bytes of every id. Byte-level vocabularies write a byte as one character."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    ids = json.loads(vocabulary)["model"]["vocab"] | _added(vocabulary)
    out = [b""] * (max(ids.values()) + 1)
    for token, i in ids.items():
        known = all(c in byte_of for c in token)
        out[i] = bytes(byte_of[c] for c in token) if known else token.encode()
    return pa.array(out, pa.binary())


def _deal():
    """Texts to blocks by a hash of id and text, packed and compressed."""

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            order = np.argsort(blocks, kind="stable")
            edges = np.flatnonzero(np.r_[True, np.diff(blocks[order]) != 0, True]) if len(order) else [0]
            rows: list[tuple] = []
            for begin, end in zip(edges[:-1], edges[1:], strict=True):
                own = batch.take(pa.array(order[begin:end]))
                texts = [t.encode("utf-8", "surrogatepass") for t in own.column("text").to_pylist()]
                lengths = np.array([len(t) for t in texts], np.int64)
                rows.append((int(blocks[order[begin]]), own.column("doc_id"), _squeeze(lengths.tobytes()), _squeeze(b"".join(texts))))
            columns = list(zip(*rows, strict=True)) if rows else ([], [], [], [])
            ids = pa.array([c.to_pylist() for c in columns[1]], pa.list_(pa.int64()))
            yield pa.record_batch(
                {
                    "block": pa.array(columns[0], pa.int32()),
                    "ids": ids,
                    "lengths": pa.array(columns[2], pa.binary()),
                    "texts": pa.array(columns[3], pa.binary()),
                }
            )

    return run


def _squeeze(data: bytes | memoryview | pa.Buffer) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _binary(data: bytes | pa.Buffer, lengths: np.ndarray) -> pa.Array:
    """The values of such lengths that follow each other in ``data``, which is not copied."""
    offsets = np.r_[0, np.cumsum(lengths, dtype=np.int64)]
    if offsets[-1] > np.iinfo(np.int32).max:
        raise OverflowError(f"{offsets[-1]} bytes in one array")
    offsets = offsets.astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _flat(values: pa.Array) -> tuple[pa.Buffer, np.ndarray]:
    """The bytes of binary values without nulls one after another, and where each begins and the last ends."""
    if not len(values):
        return pa.py_buffer(b""), np.zeros(1, np.int32)
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int32)[values.offset : values.offset + len(values) + 1]
    data = data or pa.py_buffer(b"")
    return data.slice(int(at[0]), int(at[-1] - at[0])), at - at[0]


def _numbered(values: list[pa.Array]) -> tuple[list[np.ndarray], pa.Array]:
    """For each array the number of every value, and the distinct values by number.

    The chunks of one array have one dictionary between them.
    """
    found = pa.chunked_array(values, pa.binary()).dictionary_encode()
    chunks = [c for c in found.chunks if len(c)]
    numbers = np.concatenate([c.indices.to_numpy() for c in chunks]) if chunks else np.empty(0, np.int32)
    distinct = chunks[0].dictionary if chunks else pa.array([], pa.binary())
    return np.split(numbers, np.cumsum([len(v) for v in values])[:-1]), distinct


def _split(data: bytes, lengths: np.ndarray, vocabulary: str) -> tuple[pa.Array, np.ndarray]:
    """The words of texts that follow each other in ``data``, and how many each text has.

    A word keeps the space before it, so that words are ranges of the data as it stands.
    Only texts that may be odd become strings.
    """
    values = np.frombuffer(data, np.uint8)
    ends = np.cumsum(lengths)
    begins = ends - lengths
    cuts = values == 32
    spaces = np.flatnonzero(cuts)
    # A space that ends a text is looked at with what follows in the next one.
    unsure = spaces[~_SURE_LEADS[values[np.minimum(spaces + 1, len(values) - 1)]]]
    last = ends[lengths > 0] - 1
    maybe = [unsure, last[cuts[last]]]
    # An added token that only the seam of two texts makes marks both, which does no harm.
    for match in _added_bytes(vocabulary).finditer(data):
        maybe.append(np.arange(*match.span()))
    for i in np.unique(np.searchsorted(ends, np.concatenate(maybe), "right")).tolist():
        begin, end = int(begins[i]), int(ends[i])
        parts = _parts(data[begin:end].decode("utf-8", "surrogatepass"), vocabulary)
        sizes = np.fromiter((len(p.encode("utf-8", "surrogatepass")) for p in parts), np.int64, len(parts))
        cuts[begin:end] = False
        cuts[begin + np.cumsum(sizes[:-1] + 1) - 1] = True
    cuts[begins[lengths > 0]] = True
    at = np.flatnonzero(cuts)
    return _binary(data, np.diff(np.r_[at, len(values)])), np.searchsorted(at, ends) - np.searchsorted(at, begins)


Packet = tuple[list, np.ndarray, np.ndarray]


def _words(block: pa.Table, vocabulary: str) -> tuple[list[Packet], pa.Array]:
    """Of every packet the ids, the words a text and the number of each word; the distinct words by number."""
    ids, counts, words = [], [], []
    for own, lengths, data in zip(*(block.column(c) for c in ("ids", "lengths", "texts")), strict=True):
        found, n = _split(_unsqueeze(data.as_py()), np.frombuffer(_unsqueeze(lengths.as_py()), np.int64), vocabulary)
        ids.append(own.as_py())
        counts.append(n)
        words.append(found)
    numbers, distinct = _numbered(words)
    return list(zip(ids, counts, numbers, strict=True)), distinct


def _by_bucket(words: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of distinct words by bucket, in a bucket by word, and the bucket of each.

    Who holds the same words, in whatever order, comes to the same.
    """
    order = pc.array_sort_indices(words).to_numpy().astype(np.int64)
    buckets = np.fromiter(map(crc32, words.take(pa.array(order)).to_pylist()), np.int64, len(words)) % n
    by_bucket = np.argsort(buckets, kind="stable")
    return order[by_bucket], buckets[by_bucket]


@giving_back
def _send_words(block: pa.Table, vocabulary: str, n: int) -> pa.Table:
    name = block.column("block")[0].as_py()
    _, words = _words(block, vocabulary)
    order, buckets = _by_bucket(words, n)
    data, offsets = _flat(words.take(pa.array(order)))
    edges = np.flatnonzero(np.r_[True, np.diff(buckets) != 0, True]) if len(order) else [0]
    rows = []
    for begin, end in zip(edges[:-1], edges[1:], strict=True):
        own = memoryview(data)[offsets[begin] : offsets[end]]
        rows.append((name, int(buckets[begin]), _squeeze(own), _squeeze(np.diff(offsets[begin : end + 1]).tobytes())))
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    types = {"block": pa.int32(), "bucket": pa.int32(), "words": pa.binary(), "lengths": pa.binary()}
    return pa.table({k: pa.array(c, t) for (k, t), c in zip(types.items(), columns, strict=True)})


def _id_type(vocabulary: str) -> type:
    return np.uint16 if len(_pieces(vocabulary)) <= 1 << 16 else np.int32


@giving_back
def _encode_words(packets: pa.Table, vocabulary: str) -> pa.Table:
    """Ids of the words of a bucket; a word that many blocks sent is encoded once."""
    tokenizer, kind = _tokenizer(vocabulary), _id_type(vocabulary)
    sent = [
        _binary(_unsqueeze(words.as_py()), np.frombuffer(_unsqueeze(lengths.as_py()), np.int32))
        for words, lengths in zip(*(packets.column(c) for c in ("words", "lengths")), strict=True)
    ]
    numbers, words = _numbered(sent)
    del sent
    values, sizes = [], []
    for at in range(0, len(words), 2000):
        texts = [w.decode("utf-8", "surrogatepass") for w in words.slice(at, 2000).to_pylist()]
        found = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes += map(len, found)
        values.append(np.fromiter(chain.from_iterable(found), kind))
    sizes = np.array(sizes, np.int32)
    known = _binary(np.concatenate(values or [[]]).astype(kind).tobytes(), sizes.astype(np.int64) * np.dtype(kind).itemsize)
    ids, lengths = [], []
    for own in numbers:
        ids.append(_squeeze(_flat(known.take(pa.array(own)))[0]))
        lengths.append(_squeeze(sizes[own].tobytes()))
    return pa.table(
        {
            "block": packets.column("block"),
            "bucket": packets.column("bucket"),
            "ids": pa.array(ids, pa.binary()),
            "lengths": pa.array(lengths, pa.binary()),
        }
    )


@giving_back
def _place_ids(block: pa.Table, replies: pa.Table, vocabulary: str, n: int, decoded: str | None) -> pa.Table:
    # Of all words of a block only numbers are kept, and each distinct one once.
    packets, words = _words(block, vocabulary)
    order, _ = _by_bucket(words, n)
    kind = _id_type(vocabulary)
    size = np.dtype(kind).itemsize
    replies = replies.sort_by("bucket")
    data = b"".join(_unsqueeze(i.as_py()) for i in replies.column("ids"))
    sizes = np.frombuffer(b"".join(_unsqueeze(x.as_py()) for x in replies.column("lengths")), np.int32)
    if len(sizes) != len(order):
        raise RuntimeError(f"ids of {len(sizes)} words for {len(order)}")
    known = _binary(data, sizes.astype(np.int64) * size)
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order))
    del words, order, data, sizes
    pieces = _pieces(vocabulary) if decoded else None
    placed = []
    while packets:
        ids, counts, numbers = packets.pop()
        values, offsets = _flat(known.take(pa.array(place[numbers])))
        ends = offsets[np.r_[0, np.cumsum(counts)]] // size
        flat = pa.array(np.frombuffer(values, kind)[: ends[-1]].astype(np.int32))
        found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
        columns = {"doc_id": pa.array(ids, pa.int64()), "ids": found}
        if decoded:
            columns[decoded] = _joined(found, pieces)
        placed.append(pa.record_batch(columns))
    return pa.Table.from_batches(placed)


def _joined(ids: pa.Array, pieces: pa.Array) -> pa.Array:
    """The text of every array of ids."""
    texts: list[str | None] = []
    for at in range(0, len(ids), 500):
        some = ids.slice(at, 500)
        lengths = pc.fill_null(pc.list_value_length(some), 0).to_numpy(zero_copy_only=False)
        data, offsets = _flat(pc.fill_null(pieces.take(some.flatten()), b""))
        ends = offsets[np.r_[0, np.cumsum(lengths)]].tolist()
        whole, known = memoryview(data), some.is_valid().to_pylist()
        texts += [str(whole[a:b], "utf-8", "replace") if k else None for a, b, k in zip(ends, ends[1:], known, strict=False)]
    return pa.array(texts, pa.string())


def encode(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", decoded: str | None = None
) -> DataFrame:
    """``doc_id, ids array<int>``: each whole text as the tokenizer encodes it.

    ``decoded`` names a further column for what the ids decode to, as ``decode`` gives
    it; here the pieces are joined where the ids are, without another Python worker.

    ``vocabulary`` is the content of a byte-level tokenizer file without added prefix
    spaces, truncation and padding left aside and no special tokens put around. The
    string of an added token within a text becomes that token.

    Null and empty texts have no id. Every row has a result, whatever its id; an empty
    table gives no rows. A text without spaces is one word.
    """
    texts = id_and_text(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    n = max(1, ceil(text_bytes(texts) / BLOCK_BYTES))
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")
    dealt = texts.select(block.alias("block"), "*").mapInArrow(
        _deal(), "block int, ids array<long>, lengths binary, texts binary"
    )
    dealt = dealt.repartition(n, "block")
    words = dealt.groupBy("block").applyInArrow(
        lambda t: _send_words(t, shared.value, n), "block int, bucket int, words binary, lengths binary"
    )
    encoded = words.groupBy("bucket").applyInArrow(
        lambda t: _encode_words(t, shared.value), "block int, bucket int, ids binary, lengths binary"
    )
    return (
        dealt.groupBy("block")
        .cogroup(encoded.groupBy("block"))
        .applyInArrow(
            lambda t, r: _place_ids(t, r, shared.value, n, decoded),
            "doc_id long, ids array<int>" + (f", {decoded} string" if decoded else ""),
        )
    )


def decode(tokens: DataFrame, vocabulary: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``tokens`` with the text of its ids in ``out``.

    Pieces are joined as bytes; bytes that are no UTF-8 become replacement characters.
    An empty array gives '', a null array null, a null id nothing. An id outside the
    vocabulary raises.
    """
    shared = tokens.sparkSession.sparkContext.broadcast(vocabulary)

    def join_pieces(ids: pa.Array) -> pa.Array:
        return _joined(ids, _pieces(shared.value))

    return tokens.withColumn(out, F.arrow_udf(join_pieces, "string")(ids_col))
