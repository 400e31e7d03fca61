"""Benchmark passages in documents, by Wu-Manber multi-pattern search over words.

The patterns are the windows of ``width`` consecutive words of the benchmark items; an
item of fewer words is one shorter pattern. Patterns are searched by length. The block
is the last two words (the last, for patterns of one) under the window's end: the
shift table says how far the window may move so that no pattern can end in between,
the hash table of blocks that end a pattern selects the patterns to test, by their
first word, and the words are compared directly.

Plan: the documents are read once, without a shuffle. Patterns are broadcast in parts
of at most ``PART_PATTERNS``; more patterns take further parts, each searched by its
own step over the same rows, so no table of patterns is too large for an executor. Of
the rows that Spark hands over at once, a few hundred texts are held as Python strings.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenir.llm.common import each_text, free_name, giving_back, id_and_text, text_slices

# Patterns in a part that is broadcast: ten words each, some 20 MB.
PART_PATTERNS = 100_000

# A-Z to a-z; whatever is neither a letter, a digit nor beyond ASCII to a space.
_TO_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str) -> list[bytes]:
    """Words of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


class _OneLength:
    """Shift and hash tables for patterns of ``length`` words."""

    def __init__(self, patterns: list[tuple[bytes, ...]], length: int):
        self.length = length
        self.block = min(2, length)
        self.far = length - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.ending: dict[bytes, dict[bytes, list[tuple[bytes, ...]]]] = {}
        for pattern in patterns:
            for end in range(self.block, length + 1):
                block, left = b" ".join(pattern[end - self.block : end]), length - end
                if self.shift.get(block, self.far) > left:
                    self.shift[block] = left
            last = b" ".join(pattern[length - self.block :])
            self.ending.setdefault(last, {}).setdefault(pattern[0], []).append(pattern)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        """The start of every occurrence, with its pattern."""
        at, n, length, far, shift = self.length, len(words), self.length, self.far, self.shift
        two = self.block == 2
        while at <= n:
            block = words[at - 2] + b" " + words[at - 1] if two else words[at - 1]
            step = shift.get(block, far)
            if step:
                at += step
                continue
            for pattern in self.ending[block].get(words[at - length], ()):
                if tuple(words[at - length : at]) == pattern:
                    yield at - length, pattern
            at += 1


class WuManber:
    """All lengths of a part of the patterns, and the items that each pattern is in."""

    def __init__(self, patterns: list[tuple[tuple[bytes, ...], list[int]]]):
        self.items = dict(patterns)
        lengths = sorted({len(p) for p in self.items})
        self.tables = [_OneLength([p for p in self.items if len(p) == k], k) for k in lengths]

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """The spans of words that occurrences cover, and the items found."""
        spans, items = [], set()
        for table in self.tables:
            for at, pattern in table.search(words):
                spans.append((at, at + len(pattern)))
                items.update(self.items[pattern])
        return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def patterns_of(benchmark: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """``pattern array<binary>, items array<long>``: the distinct windows of the items."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text)
                own = {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else ()
                ids += [item] * len(own)
                found += own
            yield pa.record_batch({"item_id": pa.array(ids, pa.int64()), "pattern": pa.array(found, pa.list_(pa.binary()))})

    rows = id_and_text(benchmark, id_col, text_col).where("doc_id is not null")
    rows = rows.mapInArrow(windows, "item_id long, pattern array<binary>")
    return rows.groupBy("pattern").agg(F.collect_set("item_id").alias("items"))


HITS = "struct<n_words: bigint, spans: array<struct<begin: bigint, end: bigint>>, items: array<bigint>>"


def find_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = 10,
    out: str = "hits",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``docs`` and a column ``out``: number of words, hit spans of words, items found.

    A word is hit when it lies in an occurrence of a window of ``width`` words of an
    item; spans are merged, in order. ``items`` are distinct and in order.

    Null and empty texts have no word and no hit; neither have items without words and
    items whose id is null. Equal windows of several items count for each. Rows are
    independent, so repeated ids are fine; an empty benchmark hits nothing, an empty
    table gives no rows. A column of the name ``out`` raises.
    """
    if out in docs.columns:
        raise ValueError(f"there is a column {out} already")
    spark = docs.sparkSession
    patterns = patterns_of(benchmark, width, item_col, item_text_col).cache()
    n = patterns.count()
    parts = max(1, ceil(n / PART_PATTERNS))
    part = F.pmod(F.xxhash64("pattern"), F.lit(parts))
    found = docs
    for i in range(parts):
        rows = patterns.where(part == i).collect() if n else []
        known = spark.sparkContext.broadcast([(tuple(map(bytes, r["pattern"])), sorted(r["items"])) for r in rows])
        step = F.arrow_udf(_searcher(known), HITS)
        if i == 0:
            found = found.withColumn(out, step(text_col))
        else:
            more, before = free_name(found, "_more"), F.col(out)
            found = found.withColumn(more, step(text_col))
            found = found.withColumn(out, _both(before, F.col(more))).drop(more)
    patterns.unpersist()
    return found


_SPAN = pa.struct({"begin": pa.int64(), "end": pa.int64()})
_HITS = pa.struct({"n_words": pa.int64(), "spans": pa.list_(_SPAN), "items": pa.list_(pa.int64())})


def _searcher(known):
    searchers: list[WuManber] = []

    def hits_of(texts: pa.Array) -> pa.Array:
        rows = []
        for text in each_text(texts):
            words = words_of(text or "")
            spans, items = searchers[0].find(words)
            rows.append((len(words), [{"begin": a, "end": b} for a, b in spans], sorted(items)))
        columns = zip(*rows, strict=True)
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _HITS, strict=True)], fields=list(_HITS))

    @giving_back
    def search(texts: pa.Array) -> pa.Array:
        if not searchers:
            searchers.append(WuManber(known.value))
        found = [hits_of(texts.slice(a, b - a)) for a, b in text_slices(texts)]
        return pa.concat_arrays(found) if found else pa.array([], _HITS)

    return search


def _both(one, other):
    """Hits of two parts: their spans merged, their items together."""
    span = "struct<begin: bigint, end: bigint>"
    spans = F.array_sort(F.concat(one["spans"], other["spans"]))
    joined = F.aggregate(
        spans,
        F.array().cast(f"array<{span}>"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= s["begin"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(
                    F.struct(
                        F.element_at(done, -1)["begin"].alias("begin"),
                        F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end"),
                    )
                ),
            ),
        ).otherwise(F.concat(done, F.array(s))),
    )
    return F.struct(
        one["n_words"].alias("n_words"),
        joined.alias("spans"),
        F.array_sort(F.array_union(one["items"], other["items"])).alias("items"),
    ).cast(HITS)
