"""Collocations by set-oriented mining over sorted occurrence relations.

The occurrences of words are a relation of place and word, sorted by piece and position,
written in blocks of columns. A block holds whole pieces, with a gap where one ends, so
that the merge join of a relation with the next position's words, by piece and adjacent
position, runs along two sorted columns of the same block and nothing moves for it. The
groups that arise are counted over all blocks, and the occurrences of frequent ones alone
are written as the relation that the next length extends.

Plan: each block counts its own groups and sends them to buckets by a hash, packed, never
more rows than groups; so a word or pair that is everywhere costs one number a block. A
bucket adds up and answers each block which of its groups are frequent. Groups are
compared by their words and by the numbers of frequent parts, never by a hash. Scores and
the final order come from joins of the frequent phrases.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provenir.functions.joins import is_small, join_lookup
from provenir.llm.common import LOWER, mix64, settle

BLOCK_BYTES = 4 << 20
BUCKET_WORDS = 750_000
UNKNOWN = "und"

# Everything that ends a piece becomes a full stop, which then stands for the gap.
GAP = b"."
_EDGES = bytes(ord(GAP) if b in b".,;:!?\n\x0b\x0c\r" else LOWER[b] for b in range(256))


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(values.tobytes())


def _unpack(data: bytes, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _slices(data: bytes) -> Iterator[bytes]:
    """``data`` in parts of about ``BLOCK_BYTES`` that end where a piece ends."""
    at = 0
    while at < len(data):
        end = data.find(GAP, at + BLOCK_BYTES)
        end = len(data) if end < 0 else end
        yield data[at:end]
        at = end + 1


def _block(data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of a block, how often each occurs, and the word of every place."""
    tokens = pa.array(data.replace(GAP, b" . ").split(), pa.binary()).dictionary_encode()
    words, codes = tokens.dictionary, tokens.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    counts = np.bincount(codes, minlength=len(words))
    gap = pc.index(words, pa.scalar(GAP, pa.binary())).as_py()
    if gap >= 0:
        codes[codes == gap] = -1
        counts[gap] = 0
    return words.cast(pa.string()), counts, codes


BLOCKS = "block long, lang string, n_words long, words array<string>, counts array<long>, codes binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    held: dict[str, list[bytes]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal number
        for lang, texts in held.items():
            for data in _slices(GAP.join(texts)):
                words, counts, codes = _block(data)
                if counts.any():
                    columns = ([number], [lang], [int(counts.sum())], [words], [counts.tolist()], [_pack(codes)])
                    types = (pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary())
                    arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                    yield pa.record_batch(arrays, names=["block", "lang", "n_words", "words", "counts", "codes"])
                    number += 1

    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
            data = text.as_buffer().to_pybytes().translate(_EDGES)
            held.setdefault(lang.as_py(), []).append(data)
            size += len(data)
            if size >= 4 * BLOCK_BYTES:
                yield from flush()
                held, size = {}, 0
    yield from flush()


def _rows(types: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(types)
    return pa.record_batch({k: pa.array(c, t) for (k, t), c in zip(types.items(), columns, strict=True)})


def _by_bucket(buckets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(buckets, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(buckets[order]) != 0, True]) if len(order) else [0]
    for begin, end in zip(edges[:-1], edges[1:], strict=True):
        yield int(buckets[order[begin]]), order[begin:end]


WORD_PACKETS = "block long, bucket int, lang string, words array<string>, counts array<long>, at binary"


def _send_words(n: int):
    """Each block's words to the buckets of their hashes. ``at`` are their places in the block's list."""
    types = {"block": pa.int64(), "bucket": pa.int32(), "lang": pa.string(), "words": pa.list_(pa.string()), "counts": pa.list_(pa.int64()), "at": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                words = batch.column("words")[row].values
                counts = batch.column("counts")[row].values.to_numpy()
                hashes = pd.util.hash_array(np.array(words.to_pylist(), object), categorize=False)
                out = []
                for bucket, at in _by_bucket((hashes % np.uint64(n)).astype(np.int64)):
                    at = at[counts[at] > 0]
                    if len(at):
                        own = (words.take(pa.array(at)), counts[at].tolist(), _pack(at.astype(np.int32)))
                        out.append((batch.column("block")[row].as_py(), bucket, batch.column("lang")[row].as_py(), *own))
                yield _rows(types, out)

    return run


# Frequent groups of a bucket where ``block`` is null, otherwise an answer to a block.
WORD_ANSWERS = "block long, at binary, ids binary, lang string, words array<string>, counts array<long>, total long"
PAIR_ANSWERS = "block long, at binary, ids binary, found array<long>, prefixes array<long>, lasts array<long>, counts array<long>"


def _count_words(packets: pa.Table, least: int) -> pa.Table:
    """Adds up the words of a bucket, each language apart."""
    types = {"block": pa.int64(), "at": pa.binary(), "ids": pa.binary(), "lang": pa.string(), "words": pa.list_(pa.string()), "counts": pa.list_(pa.int64()), "total": pa.int64()}
    next_id = packets.column("bucket")[0].as_py() << 32
    out = []
    for lang in sorted(set(packets.column("lang").to_pylist())):
        own = packets.filter(pc.equal(packets.column("lang"), lang))
        lists = own.column("words").combine_chunks()
        tokens = lists.flatten().dictionary_encode()
        at = tokens.indices.to_numpy(zero_copy_only=False)
        counts = np.zeros(len(tokens.dictionary), np.int64)
        np.add.at(counts, at, own.column("counts").combine_chunks().flatten().to_numpy())
        frequent = np.flatnonzero(counts >= least)
        ids = np.full(len(counts), -1, np.int64)
        ids[frequent] = next_id + np.arange(len(frequent))
        out.append((None, None, _pack(ids[frequent]), lang, tokens.dictionary.take(pa.array(frequent)), counts[frequent].tolist(), int(counts.sum())))
        next_id += len(frequent)
        ends = np.cumsum(lists.value_lengths().to_numpy())
        out += _answers(own, np.split(ids[at], ends[:-1]), 3 + 1)
    return pa.Table.from_batches([_rows(types, out)])


def _answers(packets: pa.Table, ids: list[np.ndarray], blanks: int) -> list[tuple]:
    out = []
    for block, at, own in zip(packets.column("block").to_pylist(), packets.column("at").to_pylist(), ids, strict=True):
        known = own >= 0
        if known.any():
            out.append((block, _pack(_unpack(at, np.int32)[known]), _pack(own[known]), *[None] * blanks))
    return out


def _number_of(values: np.ndarray, replies: pa.Table, size: int) -> np.ndarray:
    """The number of the group at every place, -1 where it is not frequent; ``values`` are groups' indices."""
    ids = np.full(size + 1, -1, np.int64)
    for at, own in zip(replies.column("at").to_pylist(), replies.column("ids").to_pylist(), strict=True):
        ids[_unpack(at, np.int32)] = _unpack(own)
    return ids[values]


RELATION = "block long, words binary, phrases binary"
_RELATION = {"block": pa.int64(), "words": pa.binary(), "phrases": pa.binary()}


def _place_words(block: pa.Table, replies: pa.Table) -> pa.Table:
    """The relation of single words: the number of the frequent word at every place."""
    out = []
    for number, data in zip(block.column("block").to_pylist(), block.column("codes").to_pylist(), strict=True):
        codes = _unpack(data, np.int32)
        words = _pack(_number_of(codes, replies, int(codes.max(initial=0)) + 1))
        out.append((number, words, words))
    return pa.Table.from_batches([_rows(_RELATION, out)])


def _extended(words: np.ndarray, phrases: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Merge join of phrases with the word ``length`` places on: places, group of each, groups.

    Groups are pairs of a phrase and a word. Where the phrase that starts a place later
    is not frequent, neither is the longer one.
    """
    if len(words) <= length:
        none = np.empty(0, np.int64)
        return none, none, none, none
    places = (phrases[:-length] >= 0) & (words[length:] >= 0)
    if length > 1:
        places &= phrases[1 : len(phrases) - length + 1] >= 0
    places = np.flatnonzero(places)
    return places, *_grouped(phrases[places], words[places + length])


def _grouped(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The group of every pair, and the two sides of each group."""
    left, lefts = pd.factorize(a)
    right, rights = pd.factorize(b)
    group, both = pd.factorize(left * max(len(rights), 1) + right)
    return group, lefts[both // max(len(rights), 1)], rights[both % max(len(rights), 1)]


PAIR_PACKETS = "block long, bucket int, prefixes binary, lasts binary, counts binary, at binary"


def _send_pairs(n: int, length: int):
    types = {"block": pa.int64(), "bucket": pa.int32(), "prefixes": pa.binary(), "lasts": pa.binary(), "counts": pa.binary(), "at": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, words, phrases in zip(*(batch.column(c).to_pylist() for c in ("block", "words", "phrases")), strict=True):
                _, group, prefixes, lasts = _extended(_unpack(words), _unpack(phrases), length)
                counts = np.bincount(group, minlength=len(prefixes))
                hashes = mix64(prefixes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + lasts.astype(np.uint64))
                out = [
                    (number, bucket, _pack(prefixes[at]), _pack(lasts[at]), _pack(counts[at]), _pack(at.astype(np.int32)))
                    for bucket, at in _by_bucket((hashes % np.uint64(n)).astype(np.int64))
                ]
                yield _rows(types, out)

    return run


def _count_pairs(least: int, answer: bool):
    return lambda packets: _add_pairs(packets, least, answer)


def _add_pairs(packets: pa.Table, least: int, answer: bool) -> pa.Table:
    types = {"block": pa.int64(), "at": pa.binary(), "ids": pa.binary(), **dict.fromkeys(("found", "prefixes", "lasts", "counts"), pa.list_(pa.int64()))}
    sides = [[_unpack(p) for p in packets.column(c).to_pylist()] for c in ("prefixes", "lasts", "counts")]
    group, prefixes, lasts = _grouped(np.concatenate(sides[0]), np.concatenate(sides[1]))
    counts = np.zeros(len(prefixes), np.int64)
    np.add.at(counts, group, np.concatenate(sides[2]))
    frequent = np.flatnonzero(counts >= least)
    ids = np.full(len(counts), -1, np.int64)
    ids[frequent] = (packets.column("bucket")[0].as_py() << 32) + np.arange(len(frequent))
    out = [(None, None, None, ids[frequent], prefixes[frequent], lasts[frequent], counts[frequent])]
    if answer:
        ends = np.cumsum([len(p) for p in sides[0]])
        out += _answers(packets, np.split(ids[group], ends[:-1]), 4)
    return pa.Table.from_batches([_rows(types, out)])


def _place_pairs(length: int):
    return lambda block, replies: _lengthen(block, replies, length)


def _lengthen(block: pa.Table, replies: pa.Table, length: int) -> pa.Table:
    """The relation of phrases one word longer, over the same places."""
    out = []
    for number, words, data in zip(*(block.column(c).to_pylist() for c in ("block", "words", "phrases")), strict=True):
        phrases = _unpack(data)
        places, group, prefixes, _ = _extended(_unpack(words), phrases, length)
        longer = np.full(len(phrases), -1, np.int64)
        longer[places] = _number_of(group, replies, len(prefixes))
        out.append((number, words, _pack(longer)))
    return pa.Table.from_batches([_rows(_RELATION, out)])


def frequent_phrases(texts: DataFrame, longest: int, least: int) -> tuple[DataFrame, DataFrame]:
    """``lang, words, f`` for phrases of up to ``longest`` words, and ``lang, n``; from ``lang, text``."""
    blocks = settle(texts.mapInArrow(_cut, BLOCKS), "blocks")
    n = 1 + (blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0] // BUCKET_WORDS)
    packets = blocks.select("block", "lang", "words", "counts").mapInArrow(_send_words(n), WORD_PACKETS)
    answers = packets.groupBy("bucket").applyInArrow(lambda t: _count_words(t, least), WORD_ANSWERS)
    answers = settle(answers, "words")
    is_group = F.col("block").isNull()
    numbers = F.arrow_udf(lambda ids: pa.array([None if i is None else _unpack(i).tolist() for i in ids.to_pylist()], pa.list_(pa.int64())), "array<long>")
    counted = answers.where(is_group).select("lang", numbers("ids").alias("ids"), "words", "counts")
    counted = counted.select("lang", F.explode(F.arrays_zip("ids", "words", "counts")).alias("p"))
    singles = settle(
        counted.select(F.col("p.ids").alias("id"), "lang", F.array("p.words").alias("words"), F.col("p.counts").alias("f")), "phrases"
    )
    totals = answers.where(is_group).groupBy("lang").agg(F.sum("total").alias("n"))

    phrases = [singles]
    relation = None
    for length in range(1, longest):
        replies = answers.where(~is_group).select("block", "at", "ids").groupBy("block")
        if relation is None:
            placed = blocks.select("block", "codes").groupBy("block").cogroup(replies).applyInArrow(_place_words, RELATION)
        else:
            placed = relation.groupBy("block").cogroup(replies).applyInArrow(_place_pairs(length - 1), RELATION)
        relation = settle(placed, "relation")
        packets = relation.mapInArrow(_send_pairs(n, length), PAIR_PACKETS)
        counted = packets.groupBy("bucket").applyInArrow(_count_pairs(least, answer=length + 1 < longest), PAIR_ANSWERS)
        answers = settle(counted, "groups")
        each = F.explode(F.arrays_zip("found", "prefixes", "lasts", "counts")).alias("p")
        found = answers.where(is_group).select(each).select(
            F.col("p.found").alias("id"), F.col("p.prefixes").alias("prefix"), F.col("p.lasts").alias("last"), F.col("p.counts").alias("f")
        )
        heads = phrases[-1].select(F.col("id").alias("prefix"), "lang", F.col("words").alias("head"))
        tails = singles.select(F.col("id").alias("last"), F.col("words").alias("tail"))
        named = join_lookup(join_lookup(found, heads, ["prefix"]), tails, ["last"])
        phrases.append(settle(named.select("id", "lang", F.concat("head", "tail").alias("words"), "f"), "phrases"))
    return reduce(DataFrame.unionByName, phrases).select("lang", "words", "f"), totals


def collocations(
    docs: DataFrame,
    longest: int = 3,
    least: int = 10,
    covered_percent: int = 50,
    top: int = 2000,
    lang_col: str = "lang",
    text_col: str = "text",
) -> DataFrame:
    """The strongest phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Texts are lower-cased (A-Z), parted into pieces at ``.,;:!?`` and line ends, and these
    into words at blanks; ``n`` is the number of words of the language. A phrase of 2 to
    ``longest`` words that occurs ``a >= least`` times is scored at each cut, into parts
    that occur ``l`` and ``r`` times, by ``1000000 * a * a / (l * r)`` rounded down; the
    lowest counts, of equal ones the first. A phrase inside a longer one that occurs at
    least ``covered_percent`` of ``a`` is left out. ``top`` are reported for each language,
    by score, then ``a``, then the phrase in the order of its bytes.

    A null text counts as empty, a null language as ``und``. Rows stand for themselves, so
    repeated ones count again; an empty table gives no rows. A very long text is cut into
    blocks where its pieces end. Numbers are exact: scores are decimals of 38 digits, which
    hold as long as a phrase occurs fewer than 3e15 times. Other columns of ``docs``,
    whatever their names, are not read.
    """
    text, lang = (docs[c].cast("string") for c in (text_col, lang_col))
    texts = docs.select(F.coalesce(lang, F.lit(UNKNOWN)).alias("lang"), F.coalesce(text, F.lit("")).alias("text"))
    phrases, totals = frequent_phrases(texts, longest, least)

    size = F.size("words")
    candidates = phrases.where(size >= 2)
    cut = F.explode(F.sequence(F.lit(1), size - 1)).alias("cut")
    cuts = candidates.select("lang", "words", F.col("f").alias("a"), cut)
    cuts = cuts.withColumns({"head": F.slice("words", 1, F.col("cut")), "tail": F.slice("words", F.col("cut") + 1, size - F.col("cut"))})
    for part, name in (("head", "l"), ("tail", "r")):
        cuts = join_lookup(cuts, phrases.select("lang", F.col("words").alias(part), F.col("f").alias(name)), ["lang", part])
    exact = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r")}
    ratio = F.call_function("div", F.lit(1_000_000).cast("decimal(19,0)") * exact["a"] * exact["a"], exact["l"] * exact["r"])
    best = F.min(F.struct(ratio.cast("long").alias("score"), "cut", "l", "r")).alias("best")
    scored = cuts.groupBy("lang", "words", "a").agg(best)

    longer = candidates.where(size >= 3)
    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), size - 1),
            lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda at: F.slice("words", at, k)),
        )
    )
    inside = longer.select("lang", F.explode(F.array_distinct(inner)).alias("words"), "f")
    covers = inside.groupBy("lang", "words").agg(F.max("f").alias("cover"))
    kept = join_lookup(scored, covers, ["lang", "words"])
    kept = kept.where(F.col("cover").isNull() | (F.col("cover") * 100 < F.col("a") * covered_percent))

    named = kept.select("lang", F.array_join("words", " ").alias("phrase"), "a", "best.l", "best.r", "best.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    full = join_lookup(ranked, totals, ["lang"], small=is_small(totals))
    return full.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
