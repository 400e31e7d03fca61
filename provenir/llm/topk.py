"""Exact top-k by inner product, by distributed selection on score histograms.

Every candidate is scored against every query. Global histograms of the scores of each
query are refined, each around the bin that holds the k-th largest score, until that
score is known; then what lies above it is kept, and ties at it are broken by the
smaller id.

Plan: queries are taken in blocks of at most ``QUERY_BLOCK``, broadcast one block at a
time, and the candidates are read where they lie, never shuffled. The first pass
gives each query's range and a lower bound of its k-th score (the largest k-th score
of any task), so later histograms hold few scores. A task sends at most ``BINS``
counts a query, and at the end at most k rows a query, however many vectors tie.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provenir.llm.common import settle

QUERY_BLOCK = 1024
CANDIDATE_PIECE = 1024
BINS = 64


def integer_vectors(rows: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, vector array<long>``: floor(scale * x) of every component.

    Rows whose id or vector is null, and vectors that hold a component that is null or
    not finite, or nothing at all, are left out.
    """
    doubles = rows[vector_col].cast("array<double>")
    finite = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    found = rows.select(rows[id_col].cast("long").alias("vec_id"), doubles.alias("doubles"), finite.alias("fine"))
    found = found.where("vec_id is not null and doubles is not null and size(doubles) > 0 and fine")
    return found.select("vec_id", F.transform("doubles", lambda x: F.floor(x * scale).cast("long")).alias("vector"))


def _by_length(ids: np.ndarray, vectors: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and matrix of the vectors of each length."""
    lengths = np.array([len(v) for v in vectors], np.int64)
    return {
        int(n): (ids[lengths == n], np.array([vectors[i] for i in np.flatnonzero(lengths == n)], np.int64))
        for n in np.unique(lengths)
    }


class _Queries:
    """A block of queries and, for each, what is known of its k-th score."""

    def __init__(self, rows: list):
        ids = np.array([r["vec_id"] for r in rows], np.int64)
        self.groups = _by_length(ids, [r["vector"] for r in rows])

    def scores(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Query ids, candidate ids, and the matrix of scores without a query's own row.

        A score that is left out is the least 64-bit number. Products are taken in
        doubles where all sums are exact there, else in 64-bit integers.
        """
        for at in range(0, batch.num_rows, CANDIDATE_PIECE):
            piece = batch.slice(at, CANDIDATE_PIECE)
            ids = piece.column("vec_id").to_numpy()
            for n, (found, matrix) in _by_length(ids, piece.column("vector").to_pylist()).items():
                if n not in self.groups:
                    continue
                queries, other = self.groups[n]
                most = float(np.abs(matrix).max()) * float(np.abs(other).max()) * n
                if most < 2**53:
                    scores = (other.astype(np.float64) @ matrix.T.astype(np.float64)).astype(np.int64)
                elif most < 2**63:
                    scores = other @ matrix.T
                else:
                    raise ValueError("an inner product may not fit 64 bits")
                scores[queries[:, None] == found[None, :]] = np.iinfo(np.int64).min
                yield queries, found, scores


_LEAST = np.iinfo(np.int64).min


def _bounds(candidates: DataFrame, known, k: int) -> DataFrame:
    """Per query: candidates, largest score, and a lower bound of the k-th largest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}
        count: dict[int, int] = {}
        for batch in batches:
            for queries, _, scores in known.value.scores(batch):
                take = min(k, scores.shape[1])
                top = np.partition(scores, -take, axis=1)[:, -take:]
                valid = (scores != _LEAST).sum(axis=1)
                for q, own, n in zip(queries.tolist(), top, valid.tolist(), strict=True):
                    kept = np.concatenate([best[q], own]) if q in best else own
                    best[q] = np.sort(kept)[::-1][:k]
                    count[q] = count.get(q, 0) + n
        ids = [q for q in best if count[q]]
        rows = [best[q][best[q] != _LEAST] for q in ids]
        yield pa.record_batch(
            {
                "query_id": pa.array(ids, pa.int64()),
                "n": pa.array([count[q] for q in ids], pa.int64()),
                "high": pa.array([int(r[0]) for r in rows], pa.int64()),
                "low": pa.array([int(r[-1]) for r in rows], pa.int64()),
                "kth": pa.array([int(r[-1]) if len(r) == k else None for r in rows], pa.int64()),
            }
        )

    found = candidates.mapInArrow(run, "query_id long, n long, high long, low long, kth long")
    return found.groupBy("query_id").agg(
        F.sum("n").alias("n"), F.max("high").alias("high"), F.min("low").alias("low"), F.max("kth").alias("kth")
    )


def _histograms(candidates: DataFrame, known, ranges) -> DataFrame:
    """Counts of the scores of each query by bin of its range, and of those above it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for queries, _, scores in known.value.scores(batch):
                for q, own in zip(queries.tolist(), scores, strict=True):
                    if q not in ranges.value:
                        continue
                    low, width = ranges.value[q]
                    own = own[own >= low]
                    if len(own):
                        bins = np.minimum((own - low) // width, BINS)  # the last one holds all above
                        counts[q] = counts.get(q, 0) + np.bincount(bins, minlength=BINS + 1)
        rows = [(q, int(b), int(own[b])) for q, own in counts.items() for b in np.flatnonzero(own)]
        columns = list(zip(*rows, strict=True)) if rows else ([], [], [])
        yield pa.record_batch({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "bin", "n"), columns, strict=True)})

    found = candidates.mapInArrow(run, "query_id long, bin long, n long")
    return found.groupBy("query_id", "bin").agg(F.sum("n").alias("n"))


def _kth_scores(candidates: DataFrame, known, k: int) -> dict[int, int]:
    """The k-th largest score of each query of the block, or its least if it has fewer."""
    sc = candidates.sparkSession.sparkContext
    kth: dict[int, int] = {}
    ranges: dict[int, tuple[int, int]] = {}  # the k-th score is at least low
    for r in _bounds(candidates, known, k).collect():
        if r["n"] <= k:
            kth[r["query_id"]] = r["low"]
        else:
            low = r["kth"] if r["kth"] is not None else r["low"]
            ranges[r["query_id"]] = (low, max(1, ceil((r["high"] - low + 1) / BINS)))
    while ranges:
        counts: dict[int, dict[int, int]] = {}
        for r in _histograms(candidates, known, sc.broadcast(ranges)).collect():
            counts.setdefault(r["query_id"], {})[r["bin"]] = r["n"]
        narrowed = {}
        for q, (low, width) in ranges.items():
            above, b = 0, BINS + 1
            while above < k:
                b -= 1
                above += counts[q].get(b, 0)
            if width == 1:
                kth[q] = low + b
            else:
                narrowed[q] = (low + b * width, ceil(width / BINS))
        ranges = narrowed
    return kth


def _selected(candidates: DataFrame, known, kth, k: int) -> DataFrame:
    """Scores above the k-th, and of those equal to it each task's smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[int, list[tuple[int, int]]] = {}
        equal: dict[int, list[int]] = {}
        for batch in batches:
            for queries, found, scores in known.value.scores(batch):
                for q, own in zip(queries.tolist(), scores, strict=True):
                    if q not in kth.value:
                        continue
                    limit = kth.value[q]
                    at = np.flatnonzero(own > limit)
                    above.setdefault(q, []).extend(zip(found[at].tolist(), own[at].tolist(), strict=True))
                    tied = found[own == limit]
                    if len(tied) > k:
                        tied = np.partition(tied, k - 1)[:k]
                    if len(tied):
                        equal[q] = sorted(equal.get(q, []) + tied.tolist())[:k]
        rows = [(q, v, s) for q, own in above.items() for v, s in own]
        rows += [(q, v, kth.value[q]) for q, own in equal.items() for v in own]
        columns = list(zip(*rows, strict=True)) if rows else ([], [], [])
        yield pa.record_batch({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), columns, strict=True)})

    return candidates.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(
    candidates: DataFrame,
    queries: DataFrame,
    k: int = 5,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best candidates of each query.

    The score is the inner product of the vectors as integers, floor(scale * x). Ties
    go to the smaller id. A query is not its own candidate, by id; a query with fewer
    than ``k`` candidates gets them all. Vectors of another length than the query's
    are no candidates of it.

    Vectors that are null, empty or hold a null, NaN or infinite component take no
    part, nor do null ids. Rows of one id are candidates each; as queries they are
    one, the row with the smallest vector. No queries or no candidates, no rows.
    """
    vectors = settle(integer_vectors(candidates, scale, id_col, vector_col), "vectors")
    asked = integer_vectors(queries, scale, id_col, vector_col).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    asked = settle(asked, "queries")
    n = asked.count()
    blocks = max(1, ceil(n / (QUERY_BLOCK * 0.8)))  # dealt by hash, so blocks are uneven
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    sc = candidates.sparkSession.sparkContext
    out = None
    for i in range(blocks):
        rows = asked.where(block == i).collect() if n else []
        known = sc.broadcast(_Queries(rows))
        kth = sc.broadcast(_kth_scores(vectors, known, k))
        found = _selected(vectors, known, kth, k)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found = settle(found.select("query_id", "rank", "vec_id", "score"), f"top-{i}")
        out = found if out is None else out.unionByName(found)
    return out
