"""Whitening against plain linear algebra, and its exact parts against whole numbers."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from provenir.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>"


def by_hand(x, count):
    """Deviations, values whitened up to sign, and shares, from distinct rows."""
    distinct = np.unique(x, axis=0)
    n, sums = len(distinct), distinct.sum(axis=0)
    off = distinct - sums / n
    values, vectors = np.linalg.eigh(off.T @ off / n)
    values, vectors = values[::-1][:count], vectors[:, ::-1][:, :count]
    return n, ((n * x - sums) ** 2).sum(axis=1), (x - sums / n) @ vectors / np.sqrt(values), values / (off * off).sum() * n


def test_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas().sort_values("vec_id")
    x = np.floor(256 * np.stack(rows.embedding).astype(np.float64)).astype(np.int64)
    n, deviation, white, explained = by_hand(x, 4)
    got = queries.op11_embedding_whitening(spark, sf_dir).toPandas()
    assert len(got) == 4 * len(rows) and set(got.n) == {n}
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-12
    for c in range(4):
        own = got[got.component == c + 1].sort_values("vec_id")
        assert (own.vec_id.to_numpy() == rows.vec_id.to_numpy()).all()
        assert (own.deviation.to_numpy() == deviation).all()
        sign = np.sign((own.whitened.to_numpy() * white[:, c]).sum())
        assert np.abs(own.whitened.to_numpy() - sign * white[:, c]).max() < 1e-9
        assert abs(own.explained.iloc[0] - explained[c]) < 1e-12


def test_rows_that_take_no_part_and_copies(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 0.0, 0.25], [0.0, 2.0, 0.5], [3.0, -1.0, 0.0], [0.5, 0.5, -4.0], [-0.0, 0.001, -0.001]]
    rows = [(i, v) for i, v in enumerate(good)] + [(90, None), (91, []), (92, [1.0, None, 2.0]), (93, [nan, 0.0, 0.0]), (94, [inf, 0.0, 0.0])]
    rows += [(7, good[0])] * 50 + [(None, good[1])]
    table = spark.createDataFrame(rows, SCHEMA).withColumns({"w": F.lit("x"), "n": F.lit(1), "at": F.lit(2), "x": F.lit(3)})
    got = whitening.whiten(table, count=9).collect()
    x = np.floor(256 * np.array(good)).astype(np.int64)
    _, deviation, _, _ = by_hand(x, 3)
    assert len(got) == 3 * (len(good) + 51) and {r.component for r in got} == {1, 2, 3} and {r.n for r in got} == {5}
    assert {(r.vec_id, r.deviation) for r in got} == {*enumerate(deviation.tolist()), (7, deviation[0]), (None, deviation[1])}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5, 0.5]), (2, [0.5, 0.5])]])
def test_nothing_varies(spark, rows):
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA))
    assert got.count() == 0 and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_equal_and_missing_variances(spark):
    """Three directions of the same variance and one without any."""
    axes = [[s * (i == j) for j in range(3)] + [5] for i in range(3) for s in (1, -1)]
    table = spark.createDataFrame([(i, [v / 256 for v in a]) for i, a in enumerate(axes)], SCHEMA)
    got = whitening.whiten(table).toPandas()
    assert set(got.component) == {1, 2, 3} and np.allclose(got.explained, 1 / 3) and got.identity_error[0] < 1e-12
    white = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.allclose(white.T @ white / 6, np.eye(3))


def test_lengths_must_agree(spark):
    with pytest.raises(ValueError, match="several lengths"):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], SCHEMA))


def characteristic(matrix):
    """Coefficients, lowest first, by the traces of powers in fractions."""
    size = len(matrix)
    m, power, out = [[Fraction(v) for v in row] for row in matrix], None, [Fraction(1)]
    power = [[Fraction(i == j) for j in range(size)] for i in range(size)]
    for k in range(1, size + 1):
        product = [[sum(a * b for a, b in zip(row, col)) for col in zip(*power)] for row in m]
        c = -sum(product[i][i] for i in range(size)) / k
        out.append(c)
        power = [[product[i][j] + (c if i == j else 0) for j in range(size)] for i in range(size)]
    return [int(c) for c in reversed(out)]


@pytest.mark.parametrize("size", [1, 2, 3, 8])
def test_polynomial_and_roots(spark, size):
    draw = np.random.default_rng(size)
    part = draw.integers(-(10**6), 10**6, (size, max(size - 1, 1))).astype(object)
    matrix = (part @ part.T).tolist()  # one root is 0 where size > 1
    poly = whitening.characteristic_polynomial(spark, matrix)
    assert poly == characteristic(matrix)
    for p in (101, 2147483647):
        assert whitening.polynomial_modulo(matrix, p) == [c % p for c in poly]
    trace = sum(matrix[i][i] for i in range(size))
    roots = [r / 2.0**whitening.ROOT_BITS for r in whitening.largest_roots(poly, size, trace)]
    known = np.linalg.eigvalsh(np.array(matrix, float))[::-1][: max(size - 1, 1)]
    assert len(roots) == len(known) and np.allclose(roots, known, rtol=1e-6)


def test_whole_roots_are_found_from_below():
    poly = [-6 * 6 * 2, 6 * 6 + 2 * 6 * 2, -(6 + 6 + 2), 1]  # 2 and twice 6
    assert [(r >> whitening.ROOT_BITS) + 1 for r in whitening.largest_roots(poly, 5, 14)] == [6, 6, 2]


def test_sums_beyond_doubles():
    draw = np.random.default_rng(1)
    x = draw.integers(-(2**62), 2**62, (700, 3))
    whole = x.astype(object)
    assert (whitening._scatter(x) == whole.T @ whole).all() and (whitening._sums(x) == whole.sum(axis=0)).all()
    for value in (0, -1, 2**31, -(2**31), 5**60, -(5**60)):
        assert sum(d << (32 * p) for p, d in whitening._digits(value)) == value
