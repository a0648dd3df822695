"""Multigrid on grid matrices: its parts against their definitions, its steps against those of plain conjugate gradients."""

import numpy as np
import pytest

from tabulon.operators import iterative, multigrid
from tabulon.operators.sparse import Sparse
from tabulon.plans.scratch import Scratch
from tabulon.plans.tensor import Tensor


def grid(w, seed=0):
    rng = np.random.default_rng(seed)
    a = np.zeros((w * w, w * w))
    for i in range(w):
        for j in range(w):
            for di, dj in ((0, 1), (1, 0)):
                if i + di < w and j + dj < w:
                    x, y, v = i * w + j, (i + di) * w + j + dj, 1 + rng.random()
                    a[x, y] = a[y, x] = -v
                    a[x, x] += v
                    a[y, y] += v
    return a + 0.01 * np.eye(w * w)


def sparse(spark, a):
    i, j = np.nonzero(a)
    return Sparse(spark.createDataFrame([(int(x), int(y), float(a[x, y])) for x, y in zip(i, j, strict=True)], "row long, col long, v double"), a.shape)


def dense(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r["row"], r["col"]] = r["v"]
    return out


def test_coarsening_interpolation_and_product(spark):
    a = grid(6)
    a[0, 1] = a[1, 0] = -0.01
    cells = sparse(spark, a).df
    strong = multigrid.strong_connections(cells)
    got = {(r["row"], r["col"]) for r in strong.collect()}
    off = a - np.diag(np.diag(a))
    want = {(i, j) for i, j in zip(*np.nonzero(off), strict=True) if abs(off[i, j]) >= 0.25 * np.abs(off[i]).max()}
    assert got == want
    split = multigrid.coarse_rows(Scratch(spark), strong)
    coarse = {r["row"]: r["coarse"] for r in split.collect()}
    around = want | {(j, i) for i, j in want}
    assert all(not (coarse[i] and coarse[j]) for i, j in around) and all(coarse[i] or any(coarse[j] for k, j in around if k == i) for i in coarse)
    up, n = multigrid.interpolation(cells, strong, split)
    p = dense(up, (36, n))
    assert n == sum(coarse.values()) and (p[[i for i in coarse if coarse[i]]].sum(1) == 1).all()
    assert np.allclose(dense(multigrid.galerkin(cells, up), (n, n)), p.T @ a @ p)


def test_fewer_steps_than_plain_cg(spark):
    a = grid(9)
    x = np.random.default_rng(1).normal(size=len(a))
    s, b = sparse(spark, a), Tensor.from_slice(spark, (a @ x).tolist(), (len(a),))
    h = multigrid.setup(s, coarse=12)
    assert len(h.levels) >= 2 and [level.n for level in h.levels] == sorted((level.n for level in h.levels), reverse=True)
    out = multigrid.preconditioned_cg(s, b, h, rtol=1e-4)
    assert out.converged and np.allclose(out.x.to_vec(), x, atol=1e-1)
    plain = iterative.cg(s, b, rtol=1e-4, max_iter=out.iterations)
    assert not plain.converged


def test_small_and_stubborn_matrices(spark):
    a = np.array([[2.0, -1.0], [-1.0, 2.0]])
    out = multigrid.preconditioned_cg(sparse(spark, a), Tensor.from_slice(spark, [1.0, 1.0], (2,)))
    assert out.iterations <= 2 and np.allclose(out.x.to_vec(), [1, 1])
    with pytest.raises(ValueError, match="strong"):
        multigrid.setup(sparse(spark, np.eye(40)), coarse=3)
