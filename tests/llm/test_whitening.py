"""Whitening against numpy's eigenvectors, and the exact steps against plain whole numbers."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from dashloom.llm import whitening
from dashloom.llm.queries import op13_whitening
from dashloom.llm.registry import table

R = random.Random(9)


def by_numpy(vectors, how_many=4):
    x = np.floor(256 * np.array(vectors, np.float64)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    apart = fit - s / n
    e, q = np.linalg.eigh(apart.T @ apart / n)
    e, q = e[::-1][:how_many], q[:, ::-1][:, :how_many]
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    return n, deviation, (x - s / n) @ q / np.sqrt(e), e / np.trace(apart.T @ apart / n)


def check(got, vectors, how_many=4):
    n, deviation, y, explained = by_numpy(list(vectors.values()), how_many)
    found = {(r["vec_id"], r["component"]): r for r in got}
    assert len(found) == len(got) == len(vectors) * how_many
    for k in range(how_many):
        own = np.array([found[i, k + 1]["whitened"] for i in vectors])
        assert min(np.abs(own - y[:, k]).max(), np.abs(own + y[:, k]).max()) < 1e-8
    for at, i in enumerate(vectors):
        for k in range(how_many):
            r = found[i, k + 1]
            assert (r["n"], r["deviation"]) == (n, deviation[at])
            assert r["explained"] == pytest.approx(explained[k], rel=1e-9) and r["identity_error"] < 1e-9


def test_query(spark, sf):
    vectors = {r[0]: r[1] for r in table(spark, sf, "embeddings").select("vec_id", "embedding").collect()}
    got = op13_whitening(spark, sf)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(got.collect(), vectors)


def test_odd_rows(spark):
    vectors = {i: [R.gauss(0, 1 + k) for k in range(5)] for i in range(40)}
    vectors |= {100 + i: vectors[0] for i in range(30)}
    bad = [None, [], [1.0, None, 0.0], [math.nan, 0.0, 0.0], [math.inf] * 5]
    rows = [(i, v, "x") for i, v in vectors.items()] + [(900 + i, v, "x") for i, v in enumerate(bad)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string")).collect()
    check(got, vectors)


def test_lengths_and_few_components(spark):
    rows = [(i, [float(i % 7), float(i % 3)]) for i in range(40)] + [(100 + i, [float(i)]) for i in range(5)] + [(200, [1.0] * 9)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    check([r for r in got if r["vec_id"] < 100], {i: v for i, v in rows if i < 100}, 2)
    check([r for r in got if 100 <= r["vec_id"] < 200], {i: v for i, v in rows if 100 <= i < 200}, 1)
    assert not [r for r in got if r["vec_id"] == 200]  # one vector has no variance
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [2.0, 3.0])] * 5, schema)).count() == 0


def test_large_entries(spark):
    """Sums and products beyond the doubles' whole numbers stay exact; beyond 64 bits there is an error."""
    rows = [(i, [float(R.randrange(-(10**5), 10**5)), float(i)]) for i in range(20)]
    check(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect(), dict(rows), 2)
    x = np.array([[2**40 + 1, -(2**41)], [3, 2**33]], object)
    assert (whitening._product(x.astype(np.int64)) == x.T @ x).all()
    with pytest.raises(Exception, match="(?i)overflow|too large|large"):
        whitening.whiten(spark.createDataFrame([(i, [i * 1e12, 0.0]) for i in range(9)], "vec_id long, embedding array<double>")).collect()


def characteristic(matrix):
    """Faddeev and LeVerrier's way, in fractions."""
    d = len(matrix)
    a = np.array([[Fraction(v) for v in row] for row in matrix], object)
    m, out = np.array([[Fraction(0)] * d for _ in range(d)], object), [Fraction(1)]
    one = np.array([[Fraction(int(i == j)) for j in range(d)] for i in range(d)], object)
    for k in range(1, d + 1):
        m = a @ m + one * out[-1]
        out.append(-sum((a @ m)[i, i] for i in range(d)) / k)
    return [int(c) for c in reversed(out)]


def scatter(d, rank, top=50):
    x = np.array([[R.randrange(-top, top) for _ in range(d)] for _ in range(rank)], object)
    return (x.T @ x).tolist()


@pytest.mark.parametrize("matrix", [[[0]], [[7]], np.diag([9, 9, 9, 4, 0]).tolist(), [[1] * 3] * 3, scatter(6, 9), scatter(8, 3), scatter(5, 9, 10**9), np.diag([10**15, 10**15 + 1, 1, 1]).tolist()])
def test_polynomial_roots_components(spark, matrix):
    matrix = [[int(v) for v in row] for row in matrix]
    poly = whitening.characteristic(spark, matrix)
    assert poly == characteristic(matrix)
    roots = whitening.largest_roots(poly, 4)
    want = np.linalg.eigvalsh(np.array(matrix, np.float64))[::-1][:4]
    positive = len(poly) - 1 - next(i for i, c in enumerate(poly) if c)
    assert len(roots) == min(4, positive)
    assert np.allclose([float(r) for r in roots], want[: len(roots)], rtol=1e-9)
    axes = whitening.components_of(matrix, roots)
    a = np.array([[float(v) for v in axis] for axis in axes]).reshape(len(roots), len(matrix))
    assert np.abs(a @ a.T - np.eye(len(roots))).max(initial=0) < 1e-12
    for root, axis in zip(roots, axes, strict=True):
        rest = [sum(v * c for v, c in zip(row, axis, strict=True)) - root * own for row, own in zip(matrix, axis, strict=True)]
        assert max(abs(float(r / roots[0])) for r in rest) < 1e-12


def test_modular_reduction_needs_pivots():
    p = whitening.primes_for(1)[0]
    matrix = [[0, 0, 1, 2], [0, 3, 0, 1], [1, 0, 0, 0], [2, 1, 0, 5]]
    assert whitening.characteristic_mod(np.array(matrix, np.int64), p) == [c % p for c in characteristic(matrix)]
