"""Factorizations of one matrix in blocks, tall QR and SVD against NumPy."""

import numpy as np
import pytest

from tabulon.operators import blocked, tall
from tabulon.operators.blocked import Blocks
from tabulon.plans.tensor import ShapeError, Tensor


def table(spark, a):
    a = np.asarray(a, float)
    i, j = np.nonzero(a)
    rows = [(int(x), int(y), float(a[x, y])) for x, y in zip(i, j, strict=True)]
    return Tensor(spark.createDataFrame(rows, "i0 long, i1 long, v double"), a.shape)


def dense(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r["i0"], r["i1"]] += r["v"]
    return out


@pytest.mark.parametrize("n", [1, 23])
def test_lu_solve_and_determinant(spark, n):
    rng = np.random.default_rng(n)
    a, b = rng.normal(size=(n, n)), rng.normal(size=(n, 3))
    a[0] = 0 if n == 1 else a[0]
    a = a + (n == 1)
    f = blocked.lu(Blocks.of(table(spark, a), 4), Blocks.of(table(spark, b), 4))
    order = [r["row"] for r in f.order.orderBy("place").collect()]
    low, up = dense(f.lower(), (n, n)), dense(f.upper(), (n, n))
    assert sorted(order) == list(range(n)) and np.allclose(low @ up, a[order], atol=1e-9)
    assert np.allclose(np.diag(low), 1) and np.abs(low).max() < 10 and np.allclose(np.tril(up, -1), 0)
    assert np.allclose(dense(f.solution().cells(), (n, 3)), np.linalg.solve(a, b), atol=1e-8)
    assert np.isclose(f.det(), np.linalg.det(a), rtol=1e-8)


def test_sparse_blocks_fill_and_singular_matrices(spark):
    n = 20
    rng = np.random.default_rng(1)
    a = np.diag(rng.normal(size=n)) + np.diag(rng.normal(size=n - 3), 3) + np.diag(rng.normal(size=n - 9), -9)
    a[2, 17] = 3
    f = blocked.lu(Blocks.of(table(spark, a), 4))
    order = [r["row"] for r in f.order.orderBy("place").collect()]
    assert np.allclose(dense(f.lower(), (n, n)) @ dense(f.upper(), (n, n)), a[order], atol=1e-8)
    a[7] = a[3] * 2
    a[:, 11] = 0
    f = blocked.lu(Blocks.of(table(spark, a), 4))
    order = [r["row"] for r in f.order.orderBy("place").collect()]
    assert np.allclose(dense(f.lower(), (n, n)) @ dense(f.upper(), (n, n)), a[order], atol=1e-8) and f.det() == 0
    zeros = blocked.lu(Blocks.of(table(spark, np.zeros((6, 6))), 4))
    assert zeros.det() == 0 and zeros.order.count() == 6
    with pytest.raises(ShapeError):
        blocked.lu(Blocks.of(table(spark, np.ones((3, 4))), 2))


def test_inverse_and_products(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(11, 11))
    assert np.allclose(dense(blocked.inverse(Blocks.of(table(spark, a), 4)).cells(), (11, 11)), np.linalg.inv(a), atol=1e-8)
    x, y = rng.normal(size=(9, 70)), rng.normal(size=(70, 5))
    assert np.allclose(dense(blocked.multiply(Blocks.of(table(spark, x), 2), Blocks.of(table(spark, y), 2)).cells(), (9, 5)), x @ y)


def test_cholesky(spark):
    rng = np.random.default_rng(3)
    for n in (1, 8, 13):
        g = rng.normal(size=(n, n))
        s = g @ g.T + n * np.eye(n)
        low = dense(blocked.cholesky(Blocks.of(table(spark, s), 4)).cells(), (n, n))
        assert np.allclose(low, np.linalg.cholesky(s), atol=1e-9)
    s = np.diag(np.full(12, 4.0)) + np.diag(np.ones(7), 5) + np.diag(np.ones(7), -5)
    assert np.allclose(dense(blocked.cholesky(Blocks.of(table(spark, s), 4)).cells(), (12, 12)), np.linalg.cholesky(s))
    with pytest.raises(ValueError, match="positive"):
        blocked.cholesky(Blocks.of(table(spark, -s), 4))


def _rows(spark, a, parts):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(a)], "i long, vec array<double>").repartition(parts)


def _array(df):
    rows = df.collect()
    return np.array([r["vec"] for r in sorted(rows, key=lambda r: r["i"])])


@pytest.mark.parametrize(("n", "k", "parts"), [(1, 1, 1), (3, 5, 2), (700, 6, 40), (90, 4, 1)])
def test_tall_factors(spark, n, k, parts, monkeypatch):
    monkeypatch.setattr(tall, "FAN", 3)
    a = np.random.default_rng(n).normal(size=(n, k))
    a[:, -1] = a[:, 0] if k == 6 else a[:, -1]  # a column that repeats
    q, r = tall.qr(_rows(spark, a, parts), k)
    q = _array(q)
    assert np.allclose(q @ r, a, atol=1e-9) and np.allclose(r, np.triu(r))
    if n >= k and k != 6:
        assert np.allclose(q.T @ q, np.eye(k), atol=1e-10)
    u, s, vt = tall.svd(_rows(spark, a, parts), k)
    assert np.allclose((_array(u) * s) @ vt, a, atol=1e-9) and np.allclose(s[: min(n, k)], np.linalg.svd(a)[1][: min(n, k)], atol=1e-9)


def test_tall_polar_pinverse_and_least_squares(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(200, 4))
    u, p = tall.polar(_rows(spark, a, 7), 4)
    assert np.allclose(_array(u) @ p, a) and np.allclose(p, p.T)
    assert np.allclose(_array(tall.pinverse(_rows(spark, a, 7), 4)).T, np.linalg.pinv(a))
    assert np.allclose(tall.lstsq(_rows(spark, a, 7), 4), np.linalg.lstsq(a[:, :3], a[:, 3], rcond=None)[0])
    with pytest.raises(ValueError, match="rows"):
        tall.tsqr(_rows(spark, a, 2).limit(0), 4)
