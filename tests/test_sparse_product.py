"""Blocked sparse products against dense ones: every shape of grid, heavy lines, repeated and odd cells."""

import numpy as np
import pytest

from tabulon.operators import sparse_product
from tabulon.operators.sparse_product import Counts, Grid


def table(spark, a):
    i, j = np.nonzero(a)
    return spark.createDataFrame([(int(x), int(y), float(a[x, y])) for x, y in zip(i, j, strict=True)], "row long, col long, v double")


def dense(df, shape):
    out, rows = np.zeros(shape), df.collect()
    assert len({(r["row"], r["col"]) for r in rows}) == len(rows)
    for r in rows:
        out[r["row"], r["col"]] = r["v"]
    return out


def matrices(seed=0, m=40, k=30, n=50):
    """One heavy row, one heavy column and one heavy inner index among scattered cells; empty lines too."""
    rng = np.random.default_rng(seed)
    a, b = (rng.normal(size=s) * (rng.random(s) < 0.06) for s in ((m, k), (k, n)))
    a[7], a[:, 11], b[11], b[:, 3] = rng.normal(size=k), rng.normal(size=m), rng.normal(size=n), rng.normal(size=k)
    a[9], b[:, 5] = 0, 0
    return a, b


@pytest.mark.parametrize("grid", [None, Grid(1, 1, 1), Grid(4, 2, 1), Grid(1, 1, 8), Grid(4, 4, 4)])
def test_equals_dense_product(spark, grid):
    a, b = matrices()
    assert np.allclose(dense(sparse_product.multiply(table(spark, a), table(spark, b), grid), (40, 50)), a @ b)


def test_counts_and_grid(spark):
    a, b = matrices()
    c = sparse_product.counts(table(spark, a), table(spark, b))
    work = int(((a != 0).sum(0) * (b != 0).sum(1)).sum())
    assert c == Counts(int((a != 0).sum()), int((b != 0).sum()), work, int((a != 0).any(1).sum()), int((b != 0).any(0).sum()), 30)
    # much work on few result cells: sums stay where they are made, whatever splits the work leaves the blocks small
    assert sparse_product.grid(Counts(600_000, 600_000, 18_000_000, 1000, 1000, 700), 8).inner == 1
    # as many products as cells, results scattered: inputs move once, by the inner index
    assert sparse_product.grid(Counts(10**7, 10**7, 2 * 10**7, 10**7, 10**7, 10), 8).inner >= 8
    # a row of many times what a task holds is split by the inner index
    assert sparse_product.grid(Counts(10**7, 10**6, 10**8, 1000, 1000, 9 * 10**6), 8).inner >= 9


def test_local_product_in_turns(monkeypatch):
    """Products come a few at a time, summed in a plain array or by sorted cell."""
    a, b = matrices(3)
    sides = []
    for m, inner in ((a, 1), (b.T, 1)):
        i, j = np.nonzero(m)
        order = np.argsort(j, kind="stable")
        sides.append((i[order], j[order], m[i, j][order]))
    for plain in (1 << 20, 0):
        monkeypatch.setattr(sparse_product, "TOGETHER", 64)
        monkeypatch.setattr(sparse_product, "PLAIN", plain)
        out = np.zeros((40, 50))
        row, col, v = sparse_product.local_product(*sides)
        assert len(set(zip(row.tolist(), col.tolist(), strict=True))) == len(row)
        out[row, col] = v
        assert np.allclose(out, a @ b)


def test_odd_cells(spark):
    a = spark.createDataFrame([(0, 0, 1.0, "x"), (0, 0, 2.0, "y"), (1, 1, float("nan"), None), (2, 0, None, "z"), (None, 0, 5.0, "w"), (3, 2, 1.0, ""), (3, 3, 1.0, "")], "row long, col long, v double, block string")
    b = spark.createDataFrame([(0, 4, 10.0), (1, 4, 1.0), (2, 5, 7.0), (3, 5, -7.0)], "row long, col long, v double")
    got = {(r["row"], r["col"]): r["v"] for r in sparse_product.multiply(a, b).collect()}
    assert set(got) == {(0, 4), (1, 4)} and got[0, 4] == 30 and np.isnan(got[1, 4])
    assert sparse_product.multiply(a.limit(0), b).count() == 0 and sparse_product.multiply(a, b.where("row > 9")).columns == ["row", "col", "v"]


def test_heavy_lines_leave_no_heavy_block(spark):
    """A row with a third of all cells is a range of its own, and its block is cut by the inner index."""
    heavy = spark.range(4000).selectExpr("0L AS row", "id AS col", "1.0D AS v").unionByName(spark.range(8000).selectExpr("1 + id % 97 AS row", "id % 4000 AS col", "2.0D AS v"))
    grid = Grid(4, 1, 8)
    edges = sparse_product.bounds(heavy, "row", grid.rows)
    packed = heavy.select("row", "col", "v").mapInArrow(sparse_product._pack(0, edges, grid, 1), "block long, side int, ends binary, inner binary, vs binary")
    sizes = [r[1] for r in packed.selectExpr("block", "length(vs) div 8 AS n").groupBy("block").sum("n").collect()]
    assert sum(sizes) == 12_000 and max(sizes) <= 3 * sorted(sizes)[len(sizes) // 2]


def test_rows_take_turns(spark, monkeypatch):
    """No more sums are held than a turn makes, unless one row makes more; the cells stay whole and come once."""
    monkeypatch.setattr(sparse_product, "TURN", 40)
    a, b = matrices(5)
    sides = []
    for m in (a, b.T):
        i, j = np.nonzero(m)
        order = np.argsort(j, kind="stable")
        sides.append((i[order], j[order], m[i, j][order]))
    turns = list(sparse_product.in_turns(*sides))
    out = np.zeros((40, 50))
    for row, col, v in turns:
        assert not out[row, col].any()
        out[row, col] = v
    assert np.allclose(out, a @ b) and len(turns) > 5
    assert np.allclose(dense(sparse_product.multiply(table(spark, a), table(spark, b), Grid(1, 1, 1)), (40, 50)), a @ b)
