"""Incomplete factors, colours, matchings and orderings of sparse matrices against dense or sequential versions."""

import numpy as np
import pytest

from tabulon.operators import iterative
from tabulon.operators import sparse_levels as L
from tabulon.operators.sparse import Sparse
from tabulon.operators.sparse_direct import _ilu, _pattern
from tabulon.plans.tensor import Tensor


def sparse(spark, a):
    i, j = np.nonzero(a)
    return Sparse(spark.createDataFrame([(int(x), int(y), float(a[x, y])) for x, y in zip(i, j, strict=True)], "row long, col long, v double"), a.shape)


def dense(s):
    out = np.zeros(s.shape)
    for r in s.df.collect():
        out[r["row"], r["col"]] = r["v"]
    return out


def random(n, density, seed, symmetric=False):
    rng = np.random.default_rng(seed)
    a = np.where(rng.random((n, n)) < density, rng.normal(size=(n, n)), 0)
    a = (a + a.T) / 2 if symmetric else a
    return a + np.diag(np.abs(a).sum(1) + 1)


@pytest.mark.parametrize("level", [0, 1, 2])
def test_incomplete_lu(spark, level):
    a = random(14, 0.15, 1)
    f = L.ilu(sparse(spark, a), level)
    kept = _pattern(a, level)
    low, up = _ilu(a, kept)
    assert np.allclose(dense(f.lower()), low) and np.allclose(dense(f.upper()), up)
    assert {(r["row"], r["col"]) for r in L.fill_pattern(sparse(spark, a), level).collect()} == set(zip(*np.nonzero(kept), strict=True))


def test_levels_and_incomplete_cholesky(spark):
    a = random(12, 0.2, 2, True)
    levels = {r["row"]: r["level"] for r in L.row_levels(sparse(spark, a)).collect()}
    want = {}
    for i in range(12):
        want[i] = max((want[k] + 1 for k in range(i) if a[i, k]), default=0)
    assert levels == want
    low = dense(L.ic(sparse(spark, a)))
    assert np.allclose((low @ low.T)[a != 0], a[a != 0]) and not low[np.tril(a) == 0].any()
    with pytest.raises(ValueError, match="positive"):
        L.ic(sparse(spark, np.array([[1.0, 2.0], [2.0, 1.0]])))


def test_colours_and_sor(spark):
    a = random(30, 0.08, 3, True)
    got = {r["row"]: r["colour"] for r in L.colours(sparse(spark, a)).collect()}
    assert set(got) == set(range(30)) and all(got[i] != got[j] for i, j in zip(*np.nonzero(a), strict=True) if i != j)
    degree = ((a != 0) & ~np.eye(30, dtype=bool)).sum(1).max()
    assert max(got.values()) <= degree
    order = {r["row"]: r["place"] for r in L.colour_order(sparse(spark, a)).collect()}
    assert sorted(order.values()) == list(range(30)) and [got[i] for i in sorted(order, key=order.get)] == sorted(got.values())
    x = np.arange(1, 31.0)
    out = iterative.sor(sparse(spark, a), Tensor.from_slice(spark, (a @ x).tolist(), (30,)), 1.1, rtol=1e-8)
    assert out.converged and np.allclose(out.x.to_vec(), x, atol=1e-5)


@pytest.mark.parametrize("seed", range(4))
def test_maximum_matching(spark, seed):
    rng = np.random.default_rng(seed)
    a = (rng.random((12, 15)) < 0.12).astype(float)
    if seed == 3:  # a chain in which greedy choices must be turned over
        a = np.eye(12, 15) + np.eye(12, 15, 1)
        a[-1, 12] = 0
    pairs = [(r["row"], r["col"]) for r in L.maximum_matching(sparse(spark, a)).collect()]
    assert all(a[p] for p in pairs) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
    of = {}

    def augment(j, seen):
        for i in np.flatnonzero(a[:, j]):
            if i not in seen:
                seen.add(i)
                if i not in of or augment(of[i], seen):
                    of[i] = j
                    return True
        return False

    assert len(pairs) == sum(augment(j, set()) for j in range(15))


def test_reverse_cuthill_mckee(spark):
    rng = np.random.default_rng(4)
    path = rng.permutation(24)
    a = np.eye(30)
    for x, y in zip(path[:-1], path[1:], strict=True):
        a[x, y] = a[y, x] = 1
    a[path[3], path[5]] = a[path[5], path[3]] = 1
    s = sparse(spark, a)
    order = L.reverse_cuthill_mckee(s)
    places = {r["row"]: r["place"] for r in order.collect()}
    assert sorted(places) == sorted(places.values()) == list(range(30))
    assert L.bandwidth(L.permuted(s, order)) <= 2 < L.bandwidth(s)
