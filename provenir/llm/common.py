"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import inspect
import sys
import uuid
from collections.abc import Callable, Iterator
from functools import cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenir.sinks.scratch import scratch_path

# Ids are broadcast up to this many, 8 bytes each; beyond it they are joined by a shuffle.
MAX_BROADCAST_IDS = 1_000_000

# Lower-cases A-Z and nothing else.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the folder all executors share and read it back.

    This cuts the lineage and fixes what later steps read, so a lost executor costs
    no more than the tasks it ran.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "llm", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@cache
def _trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None


def give_back() -> None:
    """Return free memory that this process holds back to the system, where that has a call for it.

    Spark keeps Python workers for the tasks of later stages, and what one task has freed
    counts against the executor until then.
    """
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def giving_back(run: Callable) -> Callable:
    """``run``, a function or a generator, which gives back memory once it is through."""

    @wraps(run)
    def whole(*args):
        try:
            return run(*args)
        finally:
            give_back()

    @wraps(run)
    def by_batch(*args):
        try:
            yield from run(*args)
        finally:
            give_back()

    return by_batch if inspect.isgeneratorfunction(run) else whole


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id`` as long and ``text`` with null as '', whatever else ``docs`` holds."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text"))


def text_bytes(texts: DataFrame) -> int:
    return texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def bounded(ids: DataFrame) -> DataFrame:
    """``ids`` with a broadcast hint if there are few enough of them."""
    return F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one where ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_bucket(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``. A null id falls in bucket 0."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % n, F.lit(0))


def share(id_col: Column) -> Column:
    """A number in [0, 1) that depends on the id alone."""
    return F.pmod(F.xxhash64(id_col.cast("string"), F.lit("sample")), F.lit(1_000_003)) / F.lit(1_000_003.0)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit word over all of it (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def random_words(seed: int, n: int) -> np.ndarray:
    """``n`` fixed 64-bit numbers."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed << 32))


def word_hashes(buffer: np.ndarray, is_word: np.ndarray, piece: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of every word of a byte buffer.

    ``is_word`` says of each byte value whether it belongs to a word. The buffer is
    worked on in pieces that end between words, so memory does not follow its length.
    """
    table = random_words(7, 256)
    starts_all, hashes_all, at = [], [], 0
    while at < len(buffer):
        end = min(at + piece, len(buffer))
        while end < len(buffer) and is_word[buffer[end]]:
            # A word that crosses the end belongs to this piece.
            gaps = np.flatnonzero(~is_word[buffer[end : end + piece]])
            end += int(gaps[0]) if len(gaps) else min(piece, len(buffer) - end)
        part = buffer[at:end]
        inside = is_word[part]
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        starts, lengths = edges[::2], edges[1::2] - edges[::2]
        if len(starts):
            first = np.cumsum(lengths) - lengths
            power = np.cumprod(np.r_[np.uint64(1), np.full(int(lengths.max()), 0x2545F4914F6CDD1D, np.uint64)])
            values = table[part[inside]]
            values *= power[np.arange(len(values)) - np.repeat(first, lengths)]
            starts_all.append(starts + at)
            hashes_all.append(mix64(np.add.reduceat(values, first)))
        at = end
    if not starts_all:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(starts_all), np.concatenate(hashes_all)


def each_text(column: pa.Array, step: int = 256) -> Iterator[str | None]:
    """The texts of a column, so many of them as Python strings at a time."""
    for at in range(0, len(column), step):
        yield from column.slice(at, step).to_pylist()


def text_slices(column: pa.Array, size: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of a column of texts of about ``size`` bytes; a longer text ends its range.

    Spark hands over 10,000 rows at a time, however long their texts are.
    """
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    before = (np.cumsum(lengths) - lengths) // size
    edges = np.flatnonzero(np.r_[True, np.diff(before) != 0, True]) if len(before) else np.zeros(1, np.int64)
    yield from zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)


def chunks(texts: list[bytes], size: int) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``size`` bytes; a longer text stands alone."""
    begin, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > size:
            yield begin, i
            begin, held = i, 0
        held += len(text)
    if begin < len(texts):
        yield begin, len(texts)
