"""CP and Tucker with a long mode against plain array forms of the same steps."""

import numpy as np
import pytest

from tabulon.operators import long_decompose as L
from tabulon.plans.tensor import ShapeError, Tensor


def slices(spark, a):
    return L.Slices.of(spark.createDataFrame([(i, a[i].ravel().tolist()) for i in range(len(a))], "i long, vec array<double>").repartition(3), a.shape[1:])


def rows(df, n):
    held = {r["i"]: r["vec"] for r in df.collect()}
    return np.array([held[i] for i in range(n)])


def unfold(a, k): return np.moveaxis(a, k, 0).reshape(a.shape[k], -1)


@pytest.mark.parametrize("reduce", [0, 512])
def test_cp_takes_the_steps_of_dense_als(spark, monkeypatch, reduce):
    monkeypatch.setattr(L, "REDUCE", reduce)
    rng = np.random.default_rng(0)
    a = rng.normal(size=(50, 3, 4, 2))
    start = [rng.normal(size=(n, 3)) for n in a.shape[1:]]
    factors = [None, *(f.copy() for f in start)]
    for _ in range(4):
        for k in range(4):
            others = [factors[j] for j in range(4) if j != k]
            factors[k] = unfold(a, k) @ L.khatri_rao(others) @ np.linalg.pinv(np.prod([f.T @ f for f in others], axis=0))
    want = np.einsum("ar,br,cr,dr->abcd", *factors)
    got = L.cp(slices(spark, a), 3, 4, start=start)
    assert np.allclose(rows(got.reconstruct(), 50), want.reshape(50, -1))
    assert np.isclose(got.error, np.linalg.norm(a - want) / np.linalg.norm(a))
    f = rows(got.long_factor(), 50)
    assert np.allclose([np.linalg.norm(x, axis=0) for x in (f, *got.factors)], 1)


def test_cp_finds_planted_terms(spark):
    rng = np.random.default_rng(2)
    a = np.einsum("ar,br,cr->abc", *(rng.normal(size=(n, 2)) for n in (60, 5, 4)))
    got = L.cp(slices(spark, a), 2, 60, tolerance=1e-12)
    assert got.error < 1e-6 and np.allclose(rows(got.reconstruct(), 60), a.reshape(60, -1), atol=1e-5)


def test_tucker(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(70, 4, 5)) + 3 * np.einsum("a,b,c->abc", *(rng.normal(size=n) for n in (70, 4, 5)))
    x = slices(spark, a)
    plain, better, full = L.tucker(x, (3, 2, 2), 0), L.tucker(x, (3, 2, 2), 8), L.tucker(x, (20, 4, 5), 0)
    assert np.allclose(rows(full.reconstruct(), 70), a.reshape(70, -1)) and full.error < 1e-7
    assert better.error <= plain.error + 1e-12
    u = [np.linalg.svd(unfold(a, k), full_matrices=False)[0] for k in range(3)]
    inside = np.kron(u[1][:, :2], u[2][:, :2])
    for t in (plain, better):
        f, made = rows(t.long_factor(), 70), rows(t.reconstruct(), 70)
        assert np.allclose(f.T @ f, np.eye(3)) and np.isclose(t.error, np.linalg.norm(a.reshape(70, -1) - made) / np.linalg.norm(a))
    left = np.linalg.svd(unfold(a, 0) @ inside)[0][:, :3]
    assert np.allclose(rows(plain.reconstruct(), 70), left @ left.T @ unfold(a, 0) @ inside @ inside.T)
    # a stationary point: no single factor can be bettered with the others as they are
    y = np.einsum("abc,ax,cz->xbz", a, rows(better.long_factor(), 70), better.factors[1])
    best = np.linalg.svd(unfold(y, 1), full_matrices=False)[0][:, :2]
    assert np.linalg.norm(best.T @ unfold(y, 1)) <= np.linalg.norm(better.core) * (1 + 1e-4)


def test_any_mode_of_cells_and_sums_over_many_tasks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(3, 40, 2)) * (rng.random((3, 40, 2)) < 0.7)
    x = L.Slices.of_tensor(Tensor.from_slice(spark, a.ravel().tolist(), a.shape), 1)
    m, w = unfold(a, 1), rng.normal(size=(6, 2))
    assert x.shape == (3, 2) and np.allclose(rows(L.times(x, w), 40), m @ w)
    monkeypatch.setattr(L, "FAN", 2)
    many = L.Slices(x.rows.repartition(7), x.shape)
    fx, ff, xx = L.projected(many, w)
    assert np.allclose(fx, (m @ w).T @ m) and np.allclose(ff, (m @ w).T @ m @ w) and np.isclose(xx, (m * m).sum())
    r = L.last_r(many, w)
    assert np.allclose(r.T @ r, (m @ w).T @ (m @ w))


def test_empty_zero_and_odd_rows(spark):
    empty = spark.createDataFrame([], "i long, vec array<double>")
    x = L.Slices.of(empty, (2, 2))
    assert L.cp(x, 2, 2).error == 0 and L.cp(x, 2, 2).reconstruct().count() == 0 and L.tucker(x, (1, 1, 1)).error == 0
    zero = L.Slices.of(spark.createDataFrame([(0, [0.0] * 4, "x"), (None, [1.0] * 4, "y"), (2, None, "z"), (3, [None, 0.0, 0.0, 0.0], "w")], "i long, vec array<double>, node string"), (2, 2))
    assert sorted(r["i"] for r in L.cp(zero, 2, 2).reconstruct().collect()) == [0, 3]
    assert rows(L.tucker(zero, (1, 1, 1)).reconstruct().where("i = 0"), 1).tolist() == [[0.0] * 4]
    with pytest.raises(ShapeError):
        L.tucker(zero, (1, 1))
