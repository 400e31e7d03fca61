"""MinHash near-duplicates by a multi-index Hamming join.

A document is the set of its word shingles. ``CHUNKS * WIDTH`` MinHash values of
16 bits make its signature; the distance of two signatures is the number of values
that differ. The signature is split into ``CHUNKS`` chunks of ``WIDTH`` values. Two
signatures that differ in fewer than ``CHUNKS * (ERRORS + 1)`` values agree, by the
pigeonhole principle, in all but ``ERRORS`` values of some chunk; for every chunk the
allowed errors are enumerated, a key for each set of values that may differ. So all
pairs below that distance share a key.

With 9 chunks of 5 and one error, a pair of similarity 0.8 has no chunk with at most
one error with a chance of 6e-6, one of 0.85 with 1e-7. No bucket is capped.

Plan: documents with equal sets are one node. Every node of a bucket is compared with
the bucket's smallest node; confirmed links make components. Buckets that still hold
more than one component are compared once more: the members outside a bucket's largest
component against all members of other components, in a join whose condition looks at
sketches of 1,280 bits, so that pairs of unlike documents are never emitted and
members of one group of copies never meet. All links are confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenir.llm.common import (
    LOWER,
    bounded,
    chunks,
    free_name,
    giving_back,
    id_and_text,
    mix64,
    random_words,
    settle,
    text_slices,
    word_hashes,
)
from provenir.llm.components import components

CHUNKS, WIDTH, ERRORS = 9, 5, 1
VALUES = CHUNKS * WIDTH
# One bit of each of the 45 values: a pair of similarity 0.8 differs in 4.5 on average, a
# binomial with a standard deviation of 2; more than 17 has a chance below 1e-6.
MAX_BITS = 17
# One bit of each of 1,280 other MinHash values, for documents in open buckets: 128 differ
# at similarity 0.8, with a standard deviation of 10.7; more than 184 has a chance of 1e-7.
# At 0.7 they are 192, with 12.8. Twice as many bits part better, but the code that Spark
# makes of them is too long for the JVM to compile.
SKETCH_WORDS, MAX_SKETCH_BITS = 20, 184

# Words end at these bytes: space, tab to carriage return.
IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False

_MULTIPLY = (random_words(11, VALUES) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_ADD = (random_words(12, VALUES) >> np.uint64(32)).astype(np.uint32)


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct shingles of ``words`` words.

    A text of fewer words is one shingle; a text without words has none.
    """
    raw = [text.encode("utf-8", "surrogatepass") for text in texts]
    out: list[np.ndarray] = []
    weights = random_words(13, words + 1)
    for begin, end in chunks(raw, 1 << 20):
        lengths = np.array([len(t) + 1 for t in raw[begin:end]])
        buffer = np.frombuffer(b" ".join(raw[begin:end]).translate(LOWER), np.uint8)
        starts, hashes = word_hashes(buffer, IS_WORD)
        ends = np.searchsorted(starts, np.cumsum(lengths))
        at = 0
        for stop in ends:
            own = hashes[at:stop]
            at = stop
            if not len(own):
                out.append(own)
                continue
            width = min(words, len(own))
            total = np.full(len(own) - width + 1, weights[words] + np.uint64(width), np.uint64)
            for i in range(width):
                total += own[i : len(own) - width + 1 + i] * (weights[i] | np.uint64(1))
            out.append(np.unique(mix64(total)))
    return out


def _sets_by_slice(text: pa.Array, words: int) -> Iterator[list[np.ndarray]]:
    for a, b in text_slices(text):
        yield shingle_sets(text.slice(a, b - a).to_pylist(), words)


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """16-bit MinHash values, a row for each non-empty set."""
    out = np.empty((len(sets), VALUES), np.uint16)
    begin = 0
    while begin < len(sets):
        end, held = begin, 0
        while end < len(sets) and (held == 0 or held + len(sets[end]) < 1 << 18):
            held += len(sets[end])
            end += 1
        sizes = np.array([len(s) for s in sets[begin:end]])
        first = np.cumsum(sizes) - sizes
        x = (np.concatenate(sets[begin:end]) >> np.uint64(32)).astype(np.uint32)
        for j in range(VALUES):
            least = np.minimum.reduceat(x * _MULTIPLY[j] + _ADD[j], first)
            out[begin:end, j] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
        begin = end
    return out


def _bit_sketches(sets: list[np.ndarray]) -> np.ndarray:
    """1,280 bits for each non-empty set, as ``SKETCH_WORDS`` words."""
    n = 64 * SKETCH_WORDS
    multiply = (random_words(15, n) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    add = (random_words(16, n) >> np.uint64(32)).astype(np.uint32)
    out = np.zeros((len(sets), SKETCH_WORDS), np.uint64)
    for i, own in enumerate(sets):
        x = (own >> np.uint64(32)).astype(np.uint32)
        least = np.full(n, np.iinfo(np.uint32).max, np.uint32)
        for at in range(0, len(x), 256):
            np.minimum(least, (multiply[:, None] * x[at : at + 256] + add[:, None]).min(axis=1), out=least)
        bit = (least * np.uint32(0x9E3779B1) >> np.uint32(16) & np.uint32(1)).astype(np.uint8)
        out[i] = np.packbits(bit, bitorder="little").view(np.uint64)
    return out


def _keys(signatures: np.ndarray) -> np.ndarray:
    """A key for each chunk and each value of it that may differ."""
    n = len(signatures)
    place = random_words(14, VALUES)
    hashed = mix64(signatures.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place)
    hashed = hashed.reshape(n, CHUNKS, WIDTH)
    rest = hashed.sum(axis=2, keepdims=True, dtype=np.uint64) - hashed
    return mix64(rest.reshape(n, VALUES) + place)


def _sketch_batch(batch: pa.RecordBatch, words: int) -> pa.RecordBatch:
    texts = batch.column("text").to_pylist()
    sets = shingle_sets(texts, words)
    full = [s for s in sets if len(s)]
    has = np.array([len(s) > 0 for s in sets], bool)
    signatures = _signatures(full)
    bits = np.zeros(len(sets), np.uint64)
    bits[has] = ((signatures & 1).astype(np.uint64) << np.arange(VALUES, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    one, two = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
    if full:
        sizes = np.array([len(s) for s in full])
        first, joined = np.cumsum(sizes) - sizes, np.concatenate(full)
        one[has] = np.add.reduceat(joined, first) + sizes.astype(np.uint64)
        two[has] = np.add.reduceat(mix64(joined), first)
    blob = iter(signatures)
    return pa.record_batch(
        {
            "doc_id": batch.column("doc_id"),
            "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
            "set_1": pa.array(one.view(np.int64)),
            "set_2": pa.array(two.view(np.int64)),
            "bits": pa.array(bits.view(np.int64)),
            "signature": pa.array([next(blob).tobytes() if h else None for h in has], pa.binary()),
        }
    )


@giving_back
def _sketch(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in text_slices(batch.column("text")):
            yield _sketch_batch(batch.slice(a, b - a), words)


def sketches(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: set size, two 64-bit sums that name the set, signature."""

    schema = "doc_id long, n_shingles long, set_1 long, set_2 long, bits long, signature binary"
    return id_and_text(docs, id_col, text_col).mapInArrow(lambda batches: _sketch(batches, words), schema)


@giving_back
def _key_array(signature: pa.Array) -> pa.Array:
    rows = signature.to_pylist()
    found = _keys(np.frombuffer(b"".join(rows), np.uint16).reshape(len(rows), VALUES))
    offsets = pa.array(np.arange(len(rows) + 1) * VALUES, pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(found.view(np.int64).ravel()))


def _close(one: str, other: str) -> Column:
    """The short signatures are near enough, and so are the long sketches."""
    differ = lambda name: F.bit_count(F.col(f"{one}.{name}").bitwiseXOR(F.col(f"{other}.{name}")))
    far = sum((differ(f"sketch_{i}") for i in range(1, SKETCH_WORDS)), differ("sketch_0"))
    return (differ("bits") <= MAX_BITS) & (far <= MAX_SKETCH_BITS)


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(bounded(ids), docs["doc_id"] == ids["node"], "left_semi")


def _with_sketches(members: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """``members`` with each node's long sketch, in columns of its own, and its keys here."""
    nodes = members.groupBy("node").agg(F.collect_set("key").alias("keys"))  # as many as a node has, at most
    nodes = settle(nodes, "open-nodes")
    ids = nodes.select("node")

    @giving_back
    def sketch_of(text: pa.Array) -> pa.Array:
        parts = [_bit_sketches(own) for own in _sets_by_slice(text, words)]
        found = np.concatenate([np.empty((0, SKETCH_WORDS), np.uint64), *parts]).view(np.int64)
        offsets = pa.array(np.arange(len(found) + 1) * SKETCH_WORDS, pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))

    sketch = F.arrow_udf(sketch_of, "array<long>")
    found = _texts_of(docs, ids).select(F.col("doc_id").alias("node"), sketch("text").alias("sketch")).distinct()
    found = settle(found, "bit-sketches")
    flat = found.select("node", *(F.col("sketch")[i].alias(f"sketch_{i}") for i in range(SKETCH_WORDS)))
    return members.join(settle(nodes.join(flat, "node"), "open-sketches"), "node")


def _confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of ``pairs (a, b)`` whose full sets are similar enough, as a written table."""
    ids = settle(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "pair-ends")

    @giving_back
    def set_of(text: pa.Array) -> pa.Array:
        found = [pa.array([], pa.list_(pa.int64()))]
        for sets in _sets_by_slice(text, words):
            offsets = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
            joined = np.concatenate([np.empty(0, np.uint64), *sets])
            found.append(pa.ListArray.from_arrays(offsets, pa.array(joined.view(np.int64))))
        return pa.concat_arrays(found)

    shingles = F.arrow_udf(set_of, "array<long>")("text")
    sets = _texts_of(docs, ids).select("doc_id", shingles.alias("shingles"))
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    either = F.size("set_a") + F.size("set_b") - both
    linked = pairs.join(left, "a").join(right, "b").where(100 * both >= percent * either)
    return settle(linked.select("a", "b"), "links")


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Documents are linked when ``100 * intersection >= percent * union`` of their sets of
    distinct shingles; ``component_id`` is the smallest id reachable over links and
    ``kept`` says that it is the own one. ``percent`` below 80 needs other chunks.

    Null and empty texts have no shingle, link with nothing and are kept. A text of
    fewer than ``words`` words is one shingle. Rows of one id are one document, whose
    sets are each counted. A null id links nothing: its component is null, it is kept.
    An empty table gives no rows.
    """
    if percent < 80:
        raise ValueError("the chunks are chosen for a similarity of 0.8 or more")
    texts = id_and_text(docs, id_col, text_col)
    sketched = settle(sketches(texts, words), "sketches")
    named = sketched.where("n_shingles > 0 and doc_id is not null")
    nodes = settle(named.groupBy("set_1", "set_2").agg(F.min("doc_id").alias("node")), "sets")

    keys_of = F.arrow_udf(_key_array, "array<long>")

    # A node for each distinct set, with the keys under which it can be found.
    reps = named.join(nodes, ["set_1", "set_2"]).where("doc_id = node").dropDuplicates(["node", "set_1", "set_2"])
    keyed = reps.select("node", "bits", "n_shingles", F.explode(keys_of("signature")).alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader < last")
    shared = settle(shared.drop("last"), "shared-keys")
    members = settle(keyed.join(shared, "key"), "members")

    sizes_fit = lambda a, b: (100 * F.least(a, b) >= percent * F.greatest(a, b))
    star = members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    star = settle(star, "star")
    links = _confirmed(star, texts, words, percent)

    # The smallest node of a copy's set stands for all its ids.
    comps = components(links)
    labelled = members.join(comps, "node", "left").select(
        "key", "node", "bits", "n_shingles", F.coalesce("component", "node").alias("component")
    )
    labelled = settle(labelled, "labelled")
    weights = labelled.groupBy("key", "component").count()
    largest = weights.groupBy("key").agg(
        F.max_by("component", F.col("count")).alias("largest"), F.count("*").alias("n")
    )
    open_keys = settle(largest.where("n > 1").drop("n"), "open-keys")
    contested = labelled.join(open_keys, "key")
    contested = settle(_with_sketches(contested, texts, words), "contested")
    m = contested.alias("m")
    strays = contested.where("component <> largest").alias("s")
    pairs = strays.join(
        m,
        (F.col("s.key") == F.col("m.key"))
        & (F.col("s.component") != F.col("m.component"))
        & ((F.col("m.component") == F.col("m.largest")) | (F.col("s.node") < F.col("m.node")))
        & sizes_fit(F.col("s.n_shingles"), F.col("m.n_shingles"))
        & _close("s", "m")
        # A pair that shares several keys is emitted under the first of them.
        & (F.array_min(F.array_intersect("s.keys", "m.keys")) == F.col("s.key")),
    )
    pairs = pairs.select(F.least("s.node", "m.node").alias("a"), F.greatest("s.node", "m.node").alias("b")).distinct()
    pairs = settle(pairs.join(star, ["a", "b"], "left_anti"), "pairs")
    if not pairs.isEmpty():
        more = _confirmed(pairs, texts, words, percent)
        comps = components(links.unionByName(more))

    node_of = settle(nodes.join(comps, "node", "left").select("set_1", "set_2", F.coalesce("component", "node").alias("root")), "roots")
    joined = sketched.join(node_of, ["set_1", "set_2"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("root"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True))
    )


def drop_repeated_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of those with the same id and text, nulls being equal; all columns, whatever their names.

    Rows are found by a hash of both, so only repeated ones move.
    """
    name, mark = free_name(docs, "row_hash"), free_name(docs, "repeated_hash")
    known = F.to_json(F.struct(docs[id_col].cast("string").alias("i"), F.md5(docs[text_col].cast("string")).alias("t")))
    hashed = docs.withColumn(name, F.md5(known))
    repeated = hashed.groupBy(name).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col(name).alias(mark))
    repeated = settle(repeated, "repeated-rows")
    if repeated.isEmpty():
        return docs
    bound = bounded(repeated)
    same = F.col(name) == F.col(mark)
    once = hashed.join(bound, same, "left_semi").dropDuplicates([name])
    return hashed.join(bound, same, "left_anti").unionByName(once).select(*docs.columns)


def keep_one(docs: DataFrame, result: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose document is kept; all columns, whatever their names."""
    dropped = settle(result.where("not kept").select(F.col("doc_id").alias("dropped")).distinct(), "dropped")
    return docs.join(bounded(dropped), docs[id_col] == dropped["dropped"], "left_anti")
