"""Narrow bands against NumPy: pivots, right-hand sides, singular matrices; no block is packed."""

import numpy as np
import pytest

from tabulon.operators import banded, blocked
from tabulon.operators.blocked import Blocks
from tests.test_blocked import dense, table


def band(n, below, above, seed):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(n, n))
    i, j = np.indices(a.shape)
    return np.where((i - j <= below) & (j - i <= above), a, 0.0)


@pytest.mark.parametrize(("n", "below", "above"), [(200, 2, 3), (131, 0, 1), (128, 4, 0), (70, 1, 1)])
def test_lu_and_solve(spark, n, below, above, monkeypatch):
    monkeypatch.setattr(banded, "ROWS", 50 if n == 131 else 64)
    monkeypatch.setattr(banded, "STEP", 16)
    a, b = band(n, below, above, n), np.random.default_rng(1).normal(size=(n, 2))
    a[0, 0] = 0 if below and above else a[0, 0]
    a += 0 if below and above else np.eye(n) * 6
    f = blocked.lu(Blocks.of(table(spark, a), 8), Blocks.of(table(spark, b), 8))
    assert f.up.thin and f.low.thin
    order = [r["row"] for r in f.order.orderBy("place").collect()]
    low, up = dense(f.lower(), (n, n)), dense(f.upper(), (n, n))
    assert sorted(order) == list(range(n)) and np.allclose(low @ up, a[order], atol=1e-9) and np.abs(low).max() <= 1
    assert np.allclose(a @ dense(f.solution().cells(), (n, 2)), b, atol=1e-6)
    assert np.isclose(f.slogdet()[1], np.linalg.slogdet(a)[1]) and f.slogdet()[0] == np.linalg.slogdet(a)[0]
    assert np.allclose(dense(blocked.multiply(f.low, f.up).cells(), (n, n)), a, atol=1e-9)
    assert np.allclose(dense(Blocks(f.up.df, f.up.shape, 8).cells(), (n, n)), up)


def test_singular_band(spark):
    a = band(90, 1, 2, 3)
    a[:, 40] = 0
    f = blocked.lu(Blocks.of(table(spark, a), 8))
    order = [r["row"] for r in f.order.orderBy("place").collect()]
    assert f.up.thin and f.det() == 0 and np.allclose(dense(f.lower(), (90, 90)) @ dense(f.upper(), (90, 90)), a[order], atol=1e-9)


def test_cholesky(spark, monkeypatch):
    monkeypatch.setattr(banded, "STEP", 16)
    a = band(130, 3, 3, 5)
    s = (a + a.T) / 2 + 12 * np.eye(130)
    low = blocked.cholesky(Blocks.of(table(spark, s), 8))
    assert low.thin and np.allclose(dense(low.cells(), s.shape), np.linalg.cholesky(s))
    assert np.allclose(dense(blocked.multiply(low, low.transpose()).cells(), s.shape), s)
    with pytest.raises(ValueError, match="positive"):
        blocked.cholesky(Blocks.of(table(spark, -s), 8))
