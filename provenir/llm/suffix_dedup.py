"""Repeated passages across documents, by a depth-limited radix sort of suffixes.

The windows are the first ``threshold`` bytes of each suffix of the texts, as UTF-8.
Suffixes are ordered through these bytes alone, most significant digits first; the groups
that no digit parts are exactly the repeated windows. What makes this cheap where almost
all suffixes are alone is how they are parted before:

- The partition of a suffix is the minimiser of its window: the substring of ``DIGIT``
  bytes in it whose hash is least. Equal windows have equal minimisers at equal places, so
  no group is split, and some thirteen neighbouring suffixes share one, so a first pass
  moves one number for all of them. Suffixes of a minimiser that no two documents share
  are alone already, and done.
- The suffixes that are left are ordered within their partition, eight bytes a pass; those
  alone after a pass are dropped from the next ones. A block sends each distinct run of
  windows with the smallest id that has it, once, compressed.

Hashes pick partitions and buckets; whether windows are equal is told by their bytes.

Plan: texts are dealt once into blocks of about ``BLOCK_BYTES``, which the three steps
read (Spark reuses the exchange). Digits go to buckets by their hash in packed
arrays, never more rows than digits, and flags come back a bit each. A digit that is
in very many documents comes once from each block. Its spans may still differ in every
document, so the windows of a digit that at least ``HOT_BLOCKS`` blocks have are ordered
in their block first, and a block sends each distinct one with the smallest id that has
it to the bucket of its own hash. So no bucket is hot.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenir.llm.common import chunks, giving_back, mix64, random_words, text_bytes

BLOCK_BYTES = 4 << 20
PIECE = 1 << 18
HOT_BLOCKS = 64
_U64 = np.uint64


class _Rolling:
    """Hashes of all substrings of a few lengths, by doubling."""

    def __init__(self, data: np.ndarray, seed: int):
        self.multiplier = int(random_words(seed, 2)[1]) | 1
        self.at: dict[int, np.ndarray] = {1: random_words(seed + 1, 256)[data]}

    def _power(self, n: int) -> np.uint64:
        return _U64(pow(self.multiplier, n, 1 << 64))

    def _double(self, n: int) -> np.ndarray:
        """Substrings of ``n`` bytes, a power of two."""
        if n not in self.at:
            half = self._double(n // 2)
            self.at[n] = half[: len(half) - n // 2] * self._power(n // 2) + half[n // 2 :]
        return self.at[n]

    def of(self, length: int) -> np.ndarray:
        """A hash for each start of a substring of ``length`` bytes."""
        out, done = None, 0
        for bit in reversed(range(length.bit_length())):
            n = 1 << bit
            if length & n:
                part = self._double(n)
                out = part if out is None else out[: len(part) - done] * self._power(n) + part[done : len(out) + done]
                done += n
        return out


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values."""
    out, n = values, 1
    while 2 * n <= width:
        out = np.minimum(out[: len(out) - n], out[n:])
        n *= 2
    rest = width - n
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


class _Block:
    """The documents of a block and the runs of windows that share a digit.

    A run has a document, the place of its digit, first and last window, and the hash
    of the digit. Documents are in the order of their ids, whatever order they came in.
    """

    def __init__(self, ids: np.ndarray, texts: list[bytes], threshold: int):
        self.threshold, self.digit = threshold, ceil(threshold / 2)
        order = sorted(range(len(texts)), key=lambda i: (ids[i], texts[i]))
        self.order, self.ids, self.texts = np.array(order, np.int64), ids[order], [texts[i] for i in order]
        parts = [self._runs(b, e) for b, e in chunks(self.texts, PIECE)]
        self.doc, self.place, self.first, self.last, self.hash = (
            np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.int64) for i in range(5)
        )
        self.hash = self.hash.astype(_U64)

    def _runs(self, begin: int, end: int) -> list[np.ndarray]:
        found = []
        if end - begin == 1 and len(self.texts[begin]) > 2 * PIECE:
            text, step = self.texts[begin], PIECE
            for at in range(0, len(text) - self.threshold + 1, step):
                piece = text[at : at + step + self.threshold - 1]
                found.append(self._runs_of([piece], begin, at))
        else:
            found.append(self._runs_of(self.texts[begin:end], begin, 0))
        return [np.concatenate([f[i] for f in found]) for i in range(5)]

    def _runs_of(self, texts: list[bytes], doc: int, shift: int) -> tuple[np.ndarray, ...]:
        lengths = np.array([len(t) for t in texts])
        starts = np.cumsum(lengths) - lengths
        data = np.frombuffer(b"".join(texts), np.uint8)
        if len(data) < self.threshold:
            return (np.empty(0, np.int64),) * 4 + (np.empty(0, _U64),)
        hashed = mix64(_Rolling(data, 21).of(self.digit))
        low = _U64((1 << 20) - 1)
        ranked = (hashed & ~low) | np.arange(len(hashed), dtype=_U64)
        place = (_least(ranked, self.threshold - self.digit + 1) & low).astype(np.int64)
        owner = np.repeat(np.arange(len(texts)), lengths)[: len(place)]
        inside = np.arange(len(place)) + self.threshold <= (starts + lengths)[owner]
        window = np.flatnonzero(inside)
        if not len(window):
            return (np.empty(0, np.int64),) * 4 + (np.empty(0, _U64),)
        place, owner = place[window], owner[window]
        new = np.flatnonzero(np.r_[True, (np.diff(place) != 0) | (np.diff(owner) != 0)])
        last = np.r_[new[1:], len(window)] - 1
        base = starts[owner[new]] - shift
        # Chosen digits have small hashes; mixed once more, they fill all buckets alike.
        return owner[new] + doc, place[new] - base, window[new] - base, window[last] - base, mix64(~hashed[place[new]])

    def digits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct digits in order, whether two own documents have it, and each run's."""
        if not len(self.hash):
            return np.empty(0, _U64), np.empty(0, bool), np.empty(0, np.int64)
        distinct, of_run = np.unique(self.hash, return_inverse=True)
        least, most = np.full(len(distinct), np.iinfo(np.int64).max), np.full(len(distinct), np.iinfo(np.int64).min)
        own = self.ids[self.doc]
        np.minimum.at(least, of_run, own)
        np.maximum.at(most, of_run, own)
        return distinct, least != most, of_run

    def spans(self, shared: np.ndarray, of_run: np.ndarray):
        """The distinct byte spans of runs with a shared digit: bytes, digit's place, id, bucket key.

        Returns the runs concerned, the span of each, and per span its bytes, its
        first run and the smallest id that has it.
        """
        runs = np.flatnonzero(shared[of_run]) if len(of_run) else np.empty(0, np.int64)
        names: dict[tuple[int, bytes], int] = {}
        of = np.empty(len(runs), np.int64)
        first, last, doc, place = (x[runs].tolist() for x in (self.first, self.last, self.doc, self.place))
        tail = self.threshold
        for k in range(len(runs)):
            name = (place[k] - first[k], self.texts[doc[k]][first[k] : last[k] + tail])
            of[k] = names.setdefault(name, len(names))
        head = np.full(len(names), -1, np.int64)
        head[of[::-1]] = runs[::-1]  # documents ascend, so the first run has the smallest id
        return runs, of, [name[1] for name in names], head


def _block_of(table: pa.Table, threshold: int) -> _Block:
    ids = np.array([np.iinfo(np.int64).max if i is None else i for i in table.column("doc_id").to_pylist()], np.int64)
    texts = [t.encode("utf-8", "surrogatepass") for t in table.column("text").to_pylist()]
    return _Block(ids, texts, threshold)


def _bucket(hashes: np.ndarray, n: int) -> np.ndarray:
    """Ascending with the hash, so a bucket is a slice of sorted hashes."""
    return ((hashes >> _U64(32)) * _U64(n) >> _U64(32)).astype(np.int64)


def _slices(sorted_buckets: np.ndarray) -> Iterator[tuple[int, slice]]:
    edges = np.flatnonzero(np.r_[True, np.diff(sorted_buckets) != 0, True])
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(sorted_buckets[a]), slice(int(a), int(b))


DIGIT_ROWS = "block int, bucket int, digits binary"
# Kinds: of digits, whether shared and (4) which are hot; of spans (2) and of windows (3).
FLAG_ROWS = "block int, bucket int, kind int, reply binary"
SPAN_ROWS = "block int, bucket int, kind int, places binary, ids binary, lengths binary, bytes binary"


def _table(schema: dict[str, pa.DataType], rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.table({n: pa.array(c, t) for (n, t), c in zip(schema.items(), columns, strict=True)})


_INT, _BIN = pa.int32(), pa.binary()


@giving_back
def _send_digits(block: pa.Table, threshold: int, n: int) -> pa.Table:
    distinct, _, _ = _block_of(block, threshold).digits()
    name = block.column("block")[0].as_py()
    rows = [(name, b, distinct[s].tobytes()) for b, s in _slices(_bucket(distinct, n))] if len(distinct) else []
    return _table({"block": _INT, "bucket": _INT, "digits": _BIN}, rows)


@giving_back
def _flag_digits(packets: pa.Table, hot_blocks: int) -> pa.Table:
    """Which digits come from more than one block, and places of those from very many."""
    parts = [np.frombuffer(p, _U64) for p in packets.column("digits").to_pylist()]
    _, place, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    rows = []
    names = zip(packets.column("block").to_pylist(), packets.column("bucket").to_pylist(), strict=True)
    for name, own in zip(names, np.split(counts[place], np.cumsum([len(p) for p in parts])[:-1]), strict=True):
        rows.append((*name, 1, np.packbits(own > 1).tobytes()))
        if (own >= hot_blocks).any():
            rows.append((*name, 4, np.flatnonzero(own >= hot_blocks).astype(np.int32).tobytes()))
    return _table({"block": _INT, "bucket": _INT, "kind": _INT, "reply": _BIN}, rows)


def _by_kind(replies: pa.Table) -> dict[int, dict[int, bytes]]:
    out: dict[int, dict[int, bytes]] = {k: {} for k in range(1, 5)}
    for kind, bucket, reply in zip(*(replies.column(c).to_pylist() for c in ("kind", "bucket", "reply")), strict=True):
        out[kind][bucket] = reply
    return out


def _shared(block: _Block, replies: dict[int, dict[int, bytes]], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each distinct digit, whether it is shared but not hot, and whether it is hot; each run's digit."""
    distinct, shared, of_run = block.digits()
    shared, hot = shared.copy(), np.zeros(len(distinct), bool)
    if len(distinct):
        for bucket, s in _slices(_bucket(distinct, n)):
            bits = np.unpackbits(np.frombuffer(replies[1][bucket], np.uint8), count=s.stop - s.start)
            shared[s] |= bits.astype(bool)
            hot[s.start + np.frombuffer(replies[4].get(bucket, b""), np.int32)] = True
    return shared & ~hot, hot, of_run


def _starts(lengths: np.ndarray, threshold: int) -> np.ndarray:
    """Where the windows begin that lie in one of the spans written one after the other."""
    begins = np.cumsum(lengths) - lengths
    return _spread(lengths - threshold + 1, begins)


def _digits_at_all(data: np.ndarray, width: int) -> np.ndarray:
    """``width`` bytes from every place as one number, the first byte the highest."""
    out, n = data.astype(_U64), 1
    while n < width:
        out = (out[: len(out) - n] << _U64(8 * n)) | out[n:]
        n *= 2
    return out


def _without_lone(order: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kept = ~(new & np.r_[new[1:], True])
    return order[kept], new[kept]


def _radix_order(data: np.ndarray, starts: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows that are not alone in order of their bytes, and where a group of equal ones begins.

    Passes go from the first bytes to the last, ``width`` of them at a time; the last one
    may overlap the one before. A group in which a digit is the same throughout keeps its
    order; only the others are sorted by it.
    """
    if len(starts) < 2:
        return np.empty(0, np.int64), np.empty(0, bool)
    width = 1 << (min(threshold, 8).bit_length() - 1)
    digits = _digits_at_all(data, width)
    order = np.argsort(digits[starts], kind="stable")
    digit = digits[starts[order]]
    order, new = _without_lone(order, np.r_[True, digit[1:] != digit[:-1]])
    for at in dict.fromkeys((*range(width, threshold - width, width), threshold - width)):
        if not len(order):
            break
        digit = digits[starts[order] + at]
        parts = np.r_[False, digit[1:] != digit[:-1]] & ~new
        if parts.any():
            group = np.cumsum(new) - 1
            parted = np.zeros(int(group[-1]) + 1, bool)
            parted[group[parts]] = True
            mixed = np.flatnonzero(parted[group])
            resorted = mixed[np.lexsort((digit[mixed], group[mixed]))]
            order[mixed], digit[mixed] = order[resorted], digit[resorted]
            new = new | np.r_[False, digit[1:] != digit[:-1]]
            order, new = _without_lone(order, new)
    return order, new


def _grouped(data: np.ndarray, starts: np.ndarray, owner: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window of each group of equal ones, its least owner, and each window's group; the lone ones last."""
    order, new = _radix_order(data, starts, threshold)
    heads = np.flatnonzero(new)
    group = np.full(len(starts), -1, np.int64)
    group[order] = np.cumsum(new) - 1
    lone = np.flatnonzero(group < 0)
    group[lone] = len(heads) + np.arange(len(lone))
    least = np.minimum.reduceat(owner[order], heads) if len(heads) else np.empty(0, owner.dtype)
    return np.r_[order[heads], lone].astype(np.int64), np.r_[least, owner[lone]], group


def _hot_windows(block: _Block, hot: np.ndarray, of_run: np.ndarray, n: int):
    """Runs of hot digits, the span of each, windows of each span and their groups; bucket, bytes and least id of a group.

    Groups are in the order of their buckets.
    """
    runs, of, contents, head = block.spans(hot, of_run)
    if not len(runs):
        return None
    lengths = np.array([len(c) for c in contents], np.int64)
    data = np.frombuffer(b"".join(contents), np.uint8)
    starts, n_windows = _starts(lengths, block.threshold), lengths - block.threshold + 1
    first, least, group = _grouped(data, starts, np.repeat(block.ids[block.doc[head]], n_windows), block.threshold)
    hashes = np.empty(len(first), _U64)
    for at in range(0, len(first), PIECE // block.threshold + 1):
        some = slice(at, at + PIECE // block.threshold + 1)
        hashes[some] = _hash_of(_windows(data, starts[first[some]], block.threshold))
    buckets = _bucket(hashes, n)
    order = np.argsort(buckets, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return runs, of, n_windows, rank[group], buckets[order], _windows(data, starts[first[order]], block.threshold), least[order]


def _windows(data: np.ndarray, starts: np.ndarray, threshold: int) -> np.ndarray:
    """The bytes of the windows, one row each."""
    return np.lib.stride_tricks.sliding_window_view(data, threshold)[starts]


def _hash_of(windows: np.ndarray) -> np.ndarray:
    table = random_words(31, windows.shape[1] * 256).reshape(-1, 256)
    total = np.zeros(len(windows), _U64)
    for k in range(windows.shape[1]):
        total += table[k][windows[:, k]]
    return mix64(total)


def _by_bucket(block: _Block, shared: np.ndarray, of_run: np.ndarray, n: int):
    """Spans in the order in which they are sent: by bucket, then as found."""
    runs, of, contents, head = block.spans(shared, of_run)
    buckets = _bucket(block.hash[head], n) if len(head) else np.empty(0, np.int64)
    order = np.argsort(buckets, kind="stable")
    return runs, of, contents, head, buckets, order


@giving_back
def _send_spans(block_rows: pa.Table, flags: pa.Table, threshold: int, n: int) -> pa.Table:
    schema = {"block": _INT, "bucket": _INT, "kind": _INT, "places": _BIN, "ids": _BIN, "lengths": _BIN, "bytes": _BIN}
    if not block_rows.num_rows:
        return _table(schema, [])
    block = _block_of(block_rows, threshold)
    shared, hot, of_run = _shared(block, _by_kind(flags), n)
    _, _, contents, head, buckets, order = _by_bucket(block, shared, of_run, n)
    name, rows = block_rows.column("block")[0].as_py(), []
    if len(order):
        for bucket, s in _slices(buckets[order]):
            own = order[s]
            rows.append(
                (
                    name,
                    bucket,
                    2,
                    (block.place - block.first)[head[own]].astype(np.int32).tobytes(),
                    block.ids[block.doc[head[own]]].tobytes(),
                    np.array([len(contents[i]) for i in own], np.int32).tobytes(),
                    zstandard.ZstdCompressor(level=3).compress(b"".join(contents[i] for i in own)),
                )
            )
    if found := _hot_windows(block, hot, of_run, n):
        *_, own, windows, least = found
        for bucket, s in _slices(own):
            packed = zstandard.ZstdCompressor(level=3).compress(windows[s].tobytes())
            rows.append((name, bucket, 3, b"", least[s].tobytes(), b"", packed))
    return _table(schema, rows)


@giving_back
def _judge_spans(packets: pa.Table, threshold: int) -> pa.Table:
    """A bit for each window of every span, or for each window sent: a smaller id has it. Packets are of one kind."""
    kind = packets.column("kind")[0].as_py()
    ids = [np.frombuffer(x, np.int64) for x in packets.column("ids").to_pylist()]
    if kind == 3:
        lengths = [np.full(len(own), threshold, np.int64) for own in ids]
    else:
        lengths = [np.frombuffer(x, np.int32).astype(np.int64) for x in packets.column("lengths").to_pylist()]
    sizes = [int((n - threshold + 1).sum()) for n in lengths]
    data = b"".join(map(zstandard.ZstdDecompressor().decompress, packets.column("bytes").to_pylist()))
    every = np.concatenate(lengths)
    owner = np.repeat(np.concatenate(ids), every - threshold + 1)
    _, least, group = _grouped(np.frombuffer(data, np.uint8), _starts(every, threshold), owner, threshold)
    packed = [np.packbits(h).tobytes() for h in np.split(least[group] < owner, np.cumsum(sizes)[:-1])]
    n = packets.num_rows
    return pa.table(
        {"block": packets.column("block"), "bucket": packets.column("bucket"), "kind": pa.array([kind] * n, _INT), "reply": pa.array(packed, _BIN)}
    )


def _bits(replies: dict[int, bytes], buckets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Replies in the order of ``buckets``, which ascend; each has as many bits as ``sizes`` add up to."""
    parts = [np.unpackbits(np.frombuffer(replies[b], np.uint8), count=int(sizes[s].sum())) for b, s in _slices(buckets)]
    return np.concatenate(parts).astype(bool)


def _spread(width: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """``width`` consecutive numbers from each ``begin``."""
    return np.repeat(begin - (np.cumsum(width) - width), width) + np.arange(width.sum())


@giving_back
def _remove(block_rows: pa.Table, replies: pa.Table, threshold: int, n: int, kept: list[str], as_text: bool) -> pa.Table:
    block = _block_of(block_rows, threshold)
    by_kind = _by_kind(replies)
    shared, hot, of_run = _shared(block, by_kind, n)
    runs, of, contents, head, buckets, order = _by_bucket(block, shared, of_run, n)
    spans: list[list[tuple[int, int]]] = [[] for _ in block.texts]
    docs, windows = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    if len(order):
        n_windows = np.array([len(c) for c in contents], np.int64) - threshold + 1
        bits = _bits(by_kind[2], buckets[order], n_windows[order])
        begin = np.empty(len(order), np.int64)
        begin[order] = np.cumsum(n_windows[order]) - n_windows[order]
        # A document that isn't the smallest of its block with this span loses all of it.
        later = block.ids[block.doc[runs]] > block.ids[block.doc[head[of]]]
        width = n_windows[of]
        hit = bits[_spread(width, begin[of])] | np.repeat(later, width)
        docs.append(np.repeat(block.doc[runs], width)[hit])
        windows.append(_spread(width, block.first[runs])[hit])
    if found := _hot_windows(block, hot, of_run, n):
        runs, of, n_windows, group, own, _, least = found
        bits = _bits(by_kind[3], own, np.ones(len(own), np.int64))
        width = n_windows[of]
        own = group[_spread(width, (np.cumsum(n_windows) - n_windows)[of])]
        hit = bits[own] | (least[own] < np.repeat(block.ids[block.doc[runs]], width))
        docs.append(np.repeat(block.doc[runs], width)[hit])
        windows.append(_spread(width, block.first[runs])[hit])
    doc, window = np.concatenate(docs), np.concatenate(windows)
    if len(doc):
        order = np.lexsort((window, doc))
        doc, window = doc[order], window[order]
        new = np.r_[True, (np.diff(doc) != 0) | (np.diff(window) > threshold)]
        starts = np.flatnonzero(new)
        stops = np.r_[starts[1:], len(doc)] - 1
        for d, a, b in zip(doc[starts].tolist(), window[starts].tolist(), (window[stops] + threshold).tolist(), strict=True):
            spans[d].append((a, b))
    rest = []
    for text, cut in zip(block.texts, spans, strict=True):
        edges = [0, *(x for span in cut for x in span), len(text)]
        pieces = [text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]
        # Each piece by itself, or parts of two characters could make a third.
        rest.append("".join(p.decode("utf-8", "ignore") for p in pieces) if as_text else b"".join(pieces))
    sources = block_rows.take(pa.array(block.order))
    out = {c: sources.column(c) for c in ["doc_id", *kept]}
    out["n_bytes"] = pa.array([len(t) for t in block.texts], pa.int64())
    out["kept"] = pa.array(rest, pa.string() if as_text else pa.binary())
    out["removed"] = pa.array(
        [[{"begin": a, "end": b} for a, b in cut] for cut in spans],
        pa.list_(pa.struct({"begin": pa.int64(), "end": pa.int64()})),
    )
    return pa.table(out)


def remove_repeats(
    docs: DataFrame,
    threshold: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
    as_text: bool = False,
) -> DataFrame:
    """``doc_id, n_bytes, kept binary, removed array<begin, end>`` and the columns of ``keep``.

    Every byte covered by a string of ``threshold`` bytes that also starts in a
    document with a smaller id goes; ``kept`` is the rest and ``removed`` the maximal
    runs. Strings are judged on the input and do not cross documents. ``as_text`` makes
    ``kept`` a string, without the characters of which a byte goes.

    Null and empty texts, and texts shorter than ``threshold``, lose nothing. Rows of
    one id count as one document, so they take nothing from each other. A null id
    comes after all others. An empty table gives no rows. Columns in ``keep`` may
    have any name but those of the result.
    """
    if not 2 <= threshold <= 4096:
        raise ValueError("threshold must be from 2 to 4096 bytes")
    texts = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
        *(docs[c].alias(f"keep_{i}") for i, c in enumerate(keep)),
    )
    n, hot = max(1, ceil(text_bytes(texts) / BLOCK_BYTES)), HOT_BLOCKS
    kept = [f"keep_{i}" for i in range(len(keep))]
    # A long text is rare, so blocks are dealt by id and text; equal rows meet.
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")
    dealt = texts.select(block.alias("block"), "*").repartition(n, "block")

    digits = dealt.groupBy("block").applyInArrow(lambda t: _send_digits(t, threshold, n), DIGIT_ROWS)
    flags = digits.groupBy("bucket").applyInArrow(lambda t: _flag_digits(t, hot), FLAG_ROWS)
    spans = (
        dealt.groupBy("block")
        .cogroup(flags.groupBy("block"))
        .applyInArrow(lambda t, f: _send_spans(t, f, threshold, n), SPAN_ROWS)
    )
    verdicts = spans.groupBy("bucket", "kind").applyInArrow(lambda t: _judge_spans(t, threshold), FLAG_ROWS)
    carried = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in ((c, texts.schema[c]) for c in kept))
    schema = "doc_id long, " + (carried + ", " if kept else "")
    out = (
        dealt.groupBy("block")
        .cogroup(flags.unionByName(verdicts).groupBy("block"))
        .applyInArrow(
            lambda t, r: _remove(t, r, threshold, n, kept, as_text),
            schema + f"n_bytes long, kept {'string' if as_text else 'binary'}, removed array<struct<begin: bigint, end: bigint>>",
        )
    )
    return out.select("doc_id", *(F.col(k).alias(c) for k, c in zip(kept, keep, strict=True)), "n_bytes", "kept", "removed")
