"""Whitening of embeddings through the exact characteristic polynomial of their scatter.

Vectors are integers after scaling, so their scatter matrix is known exactly. Its
characteristic polynomial follows exactly as well: modulo many primes, by reduction to
Hessenberg form, then by Chinese remaindering. All roots of a scatter matrix are real,
so the number of them above a point is the number of changes of sign in the
polynomial's coefficients around that point; bisection by that count isolates each
root, to far more digits than a double has. The components are the null spaces of the
matrix less a root, by inverse iteration in as many digits.

Plan: vectors are reduced to distinct ones by one shuffle, pre-aggregated, so a vector
that a third of the rows share is a row per task. Sums and products are added up within
tasks, and one row per pair of dimensions reaches the driver. Primes are dealt over
tasks. What the driver holds follows the number of dimensions, never that of rows.
Projection is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.llm.common import settle

# Binary places to which roots are found, and decimal digits of the inverse iteration.
ROOT_BITS = 160
DIGITS = 120
LIMB = 22

RESULT = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


@dataclass(frozen=True)
class Whitening:
    """What to take from a vector: ``(n * x - sums) @ axes``, ``axes`` one column a component."""

    n: int
    sums: list[int]
    axes: np.ndarray
    explained: list[float]


def _valid(vector: Column) -> Column:
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def scaled(rows: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, x``: the rows that take part and their integers."""
    vector = rows[vector_col].cast("array<double>")
    found = rows.select(rows[id_col].cast("long").alias("vec_id"), vector.alias("v")).where(_valid(F.col("v")))
    return found.select("vec_id", F.transform("v", lambda c: F.floor(F.lit(float(scale)) * c).cast("long")).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0), np.int64)


def _limbs(x: np.ndarray) -> list[np.ndarray]:
    """Numbers of at most ``LIMB`` bits and a sign that make up ``x``, lowest first, as doubles."""
    out = []
    while len(x) and max(int(x.max()), -int(x.min())) >= 1 << LIMB:
        out.append((x & ((1 << LIMB) - 1)).astype(np.float64))
        x = x >> LIMB
    return [*out, x.astype(np.float64)]


def _sums(x: np.ndarray) -> np.ndarray:
    """The sum of each column, in whole numbers of any size."""
    return sum(limb.sum(axis=0).astype(np.int64).astype(object) << (LIMB * i) for i, limb in enumerate(_limbs(x)))


def _scatter(x: np.ndarray) -> np.ndarray:
    """``x.T @ x`` in whole numbers: so many rows at a time that doubles add up exactly."""
    peak = max(int(x.max()), -int(x.min()), 1)
    step = (1 << 53) // (peak * peak) if peak < 1 << LIMB else 512
    total = np.zeros((x.shape[1], x.shape[1]), object)
    for at in range(0, len(x), step):
        limbs = _limbs(x[at : at + step])
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs):
                total += (a.T @ b).astype(np.int64).astype(object) << (LIMB * (i + j))
    return total


def _digits(value: int) -> Iterator[tuple[int, int]]:
    """``value`` in base 2**32, the last digit with the sign."""
    place = 0
    while not -(1 << 31) <= value < 1 << 31:
        yield place, value & 0xFFFFFFFF
        value >>= 32
        place += 1
    yield place, value


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``i, j, place, value``: products, sums under ``j = -1``, the count under ``i = -1``."""
    n, sums, scatter = 0, None, None
    for batch in batches:
        x = _matrix(batch.column("x"))
        if not len(x):
            continue
        n += len(x)
        sums = _sums(x) if sums is None else sums + _sums(x)
        scatter = _scatter(x) if scatter is None else scatter + _scatter(x)
    rows = [(-1, -1, *d) for d in _digits(n)]
    if n:
        size = len(sums)
        rows += [(i, -1, *d) for i in range(size) for d in _digits(int(sums[i]))]
        rows += [(i, j, *d) for i in range(size) for j in range(i, size) for d in _digits(int(scatter[i, j]))]
    columns = zip(*rows, strict=True)
    yield pa.record_batch({k: pa.array(c, pa.int64()) for k, c in zip(("i", "j", "place", "value"), columns, strict=True)})


def _moments(fit: DataFrame, size: int) -> tuple[int, list[int], list[list[int]]]:
    found = fit.select("x").mapInArrow(_add_up, "i long, j long, place long, value long")
    found = found.groupBy("i", "j", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    total: dict[tuple[int, int], int] = {}
    for r in found.collect():
        total[r.i, r.j] = total.get((r.i, r.j), 0) + (int(r.value) << (32 * r.place))
    sums = [total[i, -1] for i in range(size)]
    products = [[total[min(i, j), max(i, j)] for j in range(size)] for i in range(size)]
    return total[-1, -1], sums, products


def _is_prime(n: int) -> bool:
    """Miller and Rabin's test with bases that decide every number below 2**32."""
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 7, 61):
        power = pow(base, odd, n)
        if power in (1, n - 1):
            continue
        for _ in range(twos - 1):
            power = power * power % n
            if power == n - 1:
                break
        else:
            return False
    return True


def _primes(bound: int) -> list[int]:
    """Primes below 2**31, largest first, whose product exceeds ``bound``."""
    out, product, n = [], 1, (1 << 31) - 1
    while product <= bound:
        if _is_prime(n):
            out.append(n)
            product *= n
        n -= 2
    return out


def polynomial_modulo(matrix: list[list[int]], p: int) -> list[int]:
    """Coefficients modulo ``p``, lowest first, of the characteristic polynomial."""
    h = np.array([[v % p for v in row] for row in matrix], np.int64)
    size = len(h)
    for k in range(size - 2):
        found = np.flatnonzero(h[k + 1 :, k])
        if not len(found):
            continue
        at = k + 1 + int(found[0])
        if at != k + 1:
            h[[k + 1, at]] = h[[at, k + 1]]
            h[:, [k + 1, at]] = h[:, [at, k + 1]]
        factors = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - factors[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * factors % p).sum(axis=1)) % p
    # The polynomial of every leading block follows from those of the smaller ones.
    polys = np.zeros((size + 1, size + 1), np.int64)
    polys[0, 0] = 1
    for k in range(size):
        weights, product = np.zeros(k, np.int64), 1
        for i in range(k - 1, -1, -1):
            product = product * int(h[i + 1, i]) % p
            weights[i] = int(h[i, k]) * product % p
        new = np.roll(polys[k], 1)
        new = (new - h[k, k] * polys[k] % p) % p
        polys[k + 1] = (new - (weights[:, None] * polys[:k] % p).sum(axis=0)) % p
    return polys[size].tolist()


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Exact coefficients, lowest first, for a symmetric matrix of no negative root.

    By the inequality of means no coefficient exceeds ``(1 + trace / size) ** size``.
    """
    size = len(matrix)
    trace = sum(matrix[i][i] for i in range(size))
    primes = _primes(2 * (1 + -(-trace // size)) ** size)
    shared = spark.sparkContext.broadcast([list(map(str, row)) for row in matrix])

    def reduce_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = [list(map(int, row)) for row in shared.value]
        for batch in batches:
            own = batch.column("p").to_pylist()
            found = [polynomial_modulo(whole, p) for p in own]
            yield pa.record_batch({"p": pa.array(own, pa.int64()), "found": pa.array(found, pa.list_(pa.int64()))})

    dealt = spark.createDataFrame([(p,) for p in primes], "p long").repartition(min(len(primes), 64))
    rows = sorted(dealt.mapInArrow(reduce_all, "p long, found array<long>").collect())
    modulus, out = 1, [0] * (size + 1)
    for p, found in rows:
        inverse = pow(modulus, -1, p)
        out = [c + modulus * ((r - c) * inverse % p) for c, r in zip(out, found, strict=True)]
        modulus *= p
    return [c - modulus if 2 * c > modulus else c for c in out]


def _changes(poly: list[int], at: int) -> int:
    """Changes of sign in the coefficients around ``at``: the number of roots above it."""
    work = list(poly)
    signs, size = [], len(work)
    for done in range(size):
        for k in range(size - 2, done - 1, -1):
            work[k] += at * work[k + 1]
        if work[done]:
            signs.append(work[done] > 0)
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def _value(poly: list[int], at: int) -> int:
    total = 0
    for c in reversed(poly):
        total = total * at + c
    return total


def largest_roots(poly: list[int], count: int, bound: int) -> list[int]:
    """The largest positive roots, ``count`` at most, repeated ones as often as they occur.

    Each is the number below it in steps of ``2**-ROOT_BITS``: the root lies above that
    and at most a step higher. No root exceeds ``bound``.
    """
    size = len(poly) - 1
    fine = [c << (ROOT_BITS * (size - i)) for i, c in enumerate(poly)]
    out: list[int] = []
    for rank in range(1, min(count, _changes(fine, 0)) + 1):
        low, high = 0, (bound + 1) << ROOT_BITS
        above_low, above_high = _changes(fine, low), 0
        while high - low > 1 and above_low - above_high > 1:
            middle = (low + high) // 2
            above = _changes(fine, middle)
            low, high, above_low, above_high = (middle, high, above, above_high) if above >= rank else (low, middle, above_low, above)
        # A single root is left: the sign of the polynomial tells the sides apart.
        beyond = _value(fine, high)
        if not beyond:
            low = high - 1
        while high - low > 1:
            middle = (low + high) // 2
            here = _value(fine, middle)
            if not here:
                low, high = middle - 1, middle
            elif (here > 0) == (beyond > 0):
                high = middle
            else:
                low = middle
        out.append(low)
    return out


def _solve(lower: list[list[Decimal]], order: list[int], b: list[Decimal]) -> list[Decimal]:
    size = len(b)
    x = [b[i] for i in order]
    for i in range(size):
        row = lower[i]
        x[i] -= sum((row[k] * x[k] for k in range(i)), Decimal(0))
    for i in range(size - 1, -1, -1):
        row = lower[i]
        x[i] = (x[i] - sum((row[k] * x[k] for k in range(i + 1, size)), Decimal(0))) / row[i]
    return x


def _factor(matrix: list[list[Decimal]], least: Decimal) -> tuple[list[list[Decimal]], list[int]]:
    """Lower and upper factors in one matrix; a pivot of zero becomes ``least``."""
    size = len(matrix)
    order = list(range(size))
    for k in range(size):
        at = max(range(k, size), key=lambda i: abs(matrix[i][k]))
        matrix[k], matrix[at] = matrix[at], matrix[k]
        order[k], order[at] = order[at], order[k]
        if abs(matrix[k][k]) < least:
            matrix[k][k] = least
        pivot = matrix[k]
        for i in range(k + 1, size):
            row = matrix[i]
            if row[k]:
                factor = row[k] / pivot[k]
                row[k] = factor
                for j in range(k + 1, size):
                    row[j] -= factor * pivot[j]
    return matrix, order


def components(matrix: list[list[int]], roots: list[int]) -> list[list[Decimal]]:
    """A unit vector for each root; those of a repeated root stand at right angles."""
    out: list[list[Decimal]] = []
    size = len(matrix)
    with localcontext() as context:
        context.prec = DIGITS
        step = Decimal(2) ** -ROOT_BITS
        least = (Decimal(1) + max(abs(v) for row in matrix for v in row)) * Decimal(10) ** (20 - DIGITS)
        for c, root in enumerate(roots):
            value = (Decimal(root) + Decimal("0.5")) * step
            shifted = [[Decimal(v) - (value if i == j else 0) for j, v in enumerate(row)] for i, row in enumerate(matrix)]
            factors, order = _factor(shifted, least)
            near = [v for v, other in zip(out, roots, strict=False) if abs(other - root) <= 2]
            # Any start will do that is not at right angles to the null space.
            vector = [Decimal(1 + (i * i * 31 + i * 17 + c * 7919) % 101) for i in range(size)]
            for _ in range(3):
                vector = _solve(factors, order, vector)
                for _ in range(2):
                    for other in near:
                        along = sum((a * b for a, b in zip(vector, other, strict=True)), Decimal(0))
                        vector = [a - along * b for a, b in zip(vector, other, strict=True)]
                    length = sum((a * a for a in vector), Decimal(0)).sqrt()
                    vector = [a / length for a in vector]
            largest = max(vector, key=abs)
            out.append([-a for a in vector] if largest < 0 else vector)
    return out


def fit(vectors: DataFrame, size: int, count: int) -> Whitening:
    """The whitening of distinct vectors ``x``, each of ``size`` whole numbers."""
    n, sums, products = _moments(vectors, size)
    matrix = [[n * products[i][j] - sums[i] * sums[j] for j in range(size)] for i in range(size)]
    trace = sum(matrix[i][i] for i in range(size))
    if not trace:
        return Whitening(n, sums, np.empty((size, 0)), [])
    poly = characteristic_polynomial(vectors.sparkSession, matrix)
    roots = largest_roots(poly, count, trace)
    axes = np.empty((size, len(roots)))
    explained = []
    with localcontext() as context:
        context.prec = DIGITS
        for c, (root, vector) in enumerate(zip(roots, components(matrix, roots), strict=True)):
            value = (Decimal(root) + Decimal("0.5")) * Decimal(2) ** -ROOT_BITS
            # The root belongs to n * n times the covariance, as n * x - sums is n times the deviation.
            axes[:, c] = [float(v / value.sqrt()) for v in vector]
            explained.append(float(value / trace))
    return Whitening(n, sums, axes, explained)


def project(vectors: DataFrame, model: Whitening) -> DataFrame:
    """``vectors`` with ``deviation long`` and ``w array<double>`` in place of ``x``.

    ``deviation`` is exact, and null where it does not fit 64 bits.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(model)
    others = [c for c in vectors.columns if c != "x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        widest = max(map(abs, model.sums))
        for batch in batches:
            x = _matrix(batch.column("x"))
            large = model.n * int(np.abs(x.astype(np.float64)).max(initial=0) + 1) + widest
            if large * large * len(model.sums) < 1 << 62:
                off = model.n * x - np.array(model.sums, np.int64) if len(x) else np.empty((0, len(model.sums)), np.int64)
                deviation = (off * off).sum(axis=1).tolist()
            else:
                off = np.array([[model.n * v - s for v, s in zip(row, model.sums, strict=True)] for row in x.tolist()], object)
                deviation = [d if d < 1 << 63 else None for d in (sum(v * v for v in row) for row in off.tolist())]
            w = off.astype(np.float64) @ model.axes
            offsets = pa.array(np.arange(len(x) + 1) * w.shape[1], pa.int32())
            yield pa.record_batch(
                [*(batch.column(c) for c in others), pa.array(deviation, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))],
                names=[*others, "deviation", "w"],
            )

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema.fields if f.name in others)
    return vectors.mapInArrow(run, f"{kept + ', ' if kept else ''}deviation long, w array<double>")


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """How far the covariance of what ``project`` gives is from the identity, entry by entry."""
    count = model.axes.shape[1]
    found = project(vectors, model).select(*(F.col("w")[c].alias(f"w{c}") for c in range(count)))
    means = found.agg(*(F.avg(f"w{c}") for c in range(count))).first()
    pairs = [(i, j) for i in range(count) for j in range(i, count)]
    centred = [F.col(f"w{c}") - F.lit(means[c]) for c in range(count)]
    moments = found.agg(*(F.avg(centred[i] * centred[j]) for i, j in pairs)).first()
    return max(abs(m - (i == j)) for m, (i, j) in zip(moments, pairs, strict=True))


def whiten(
    rows: DataFrame, count: int = 4, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """A row for each vector and component, numbered from 1 by falling variance.

    A vector takes part unless it is null or empty or holds a null or a number that is
    not finite. Each entry ``c`` counts as ``floor(scale * c)``, held within 64 bits.
    The covariance is that of the distinct vectors, so copies do not weigh in; every row
    gets its values, repeated rows and null ids too. Components without variance do not
    exist: fewer than ``count`` come out where the vectors span less, and no row at all
    for an empty table or one with a single distinct vector. Components of equal
    variance are at right angles, in an order that the data alone decide. Vectors of
    several lengths raise. Other columns of ``rows``, whatever their names, are not read.
    """
    spark = rows.sparkSession
    vectors = scaled(rows, scale, id_col, vector_col)
    lengths = sorted(r[0] for r in vectors.select(F.size("x")).distinct().take(3))
    if len(lengths) > 1:
        raise ValueError(f"vectors have several lengths, among them {lengths}")
    if not lengths:
        return spark.createDataFrame([], RESULT)
    distinct = settle(vectors.select("x").distinct(), "whitening")
    model = fit(distinct, lengths[0], count)
    if not model.explained:
        return spark.createDataFrame([], RESULT)
    error = identity_error(distinct, model)
    found = project(vectors, model).select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    explained = F.element_at(F.array(*map(F.lit, model.explained)), F.col("at") + 1)
    return found.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        explained.alias("explained"),
        F.lit(error).alias("identity_error"),
    )
