"""Incomplete and complete factorizations of batches of small sparse matrices (m, i0, i1, v), one group per matrix, and triangular solves by levels.

A factorization is sequential within a matrix, so one matrix is one task's work; what scales is the number of matrices. A single large system goes
to the iterative solvers.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulon.operators.linalg import _lu, per_matrix, per_pair
from tabulon.operators.sparse import Sparse
from tabulon.plans.scratch import Scratch
from tabulon.plans.tensor import Tensor


def _pattern(x: np.ndarray, level: int) -> np.ndarray:
    """Cells that level-of-fill keeps."""
    n, fill = len(x), np.where(x != 0, 0, 10**6)
    np.fill_diagonal(fill, 0)
    for k in range(n):
        fill = np.minimum(fill, np.where((np.arange(n) > k)[:, None] & (np.arange(n) > k)[None], fill[:, [k]] + fill[[k]] + 1, 10**6))
    return fill <= level


def _ilu(x: np.ndarray, kept: np.ndarray):
    a = x.copy()
    for i in range(1, len(a)):
        for k in range(i):
            if kept[i, k]:
                a[i, k] /= a[k, k]
                a[i, k + 1 :] -= np.where(kept[i, k + 1 :], a[i, k] * a[k, k + 1 :], 0)
    return np.tril(a, -1) + np.eye(len(a)), np.triu(a)


def iluk(a: DataFrame, level: int = 0) -> DataFrame: return per_matrix(a, lambda x: dict(zip("lu", _ilu(x, _pattern(x, level)), strict=True)))
def ilu0(a: DataFrame) -> DataFrame: return iluk(a, 0)
def iluk_symbolic(a: DataFrame, level: int = 0) -> DataFrame: return per_matrix(a, lambda x: {"pattern": _pattern(x, level).astype(float)})
def ilu0_symbolic(a: DataFrame) -> DataFrame: return iluk_symbolic(a, 0)
def iluk_numeric(a: DataFrame, symbolic: DataFrame) -> DataFrame: return per_pair(a, symbolic.select("m", "i0", "i1", F.col("re").alias("v")), lambda x, p: dict(zip("lu", _ilu(x, p > 0), strict=True)))


ilu0_numeric = iluk_numeric


def ic0(a: DataFrame) -> DataFrame:
    """Incomplete Cholesky without fill."""
    def f(x):
        low = np.tril(x).copy()
        for k in range(len(low)):
            low[k, k] = np.sqrt(low[k, k])
            low[k + 1 :, k] /= low[k, k]
            for j in range(k + 1, len(low)):
                low[j:, j] -= np.where(x[j:, j] != 0, low[j:, k] * low[j, k], 0)
        return {"l": low}

    return per_matrix(a, f)


def sparse_lu(a: DataFrame) -> DataFrame:
    """Row-pivoted factors, the order of the rows and the fill: stored cells of the factors by those of the matrix."""
    def f(x):
        low, up, order = _lu(x)
        return {"l": low, "u": up, "p": order.astype(float), "fill": np.float64((np.count_nonzero(low) + np.count_nonzero(up)) / max(np.count_nonzero(x), 1))}

    return per_matrix(a, f)


sparse_lu_simple = sparse_lu_with_metrics = sparse_lu


def sparse_lu_solve(a: DataFrame, b: DataFrame) -> DataFrame:
    def f(x, y):
        low, up, order = _lu(x)
        return {"x": np.linalg.solve(up, np.linalg.solve(low, y[order]))}

    return per_pair(a, b, f)


def sparse_qr(a: DataFrame) -> DataFrame: return per_matrix(a, lambda x: dict(zip("qr", np.linalg.qr(x), strict=True)))
def sparse_qr_lstsq(a: DataFrame, b: DataFrame) -> DataFrame: return per_pair(a, b, lambda x, y: {"x": np.linalg.lstsq(x, y, rcond=None)[0]})


def _matching(x: np.ndarray) -> np.ndarray:
    """The row that each column is matched to, or -1: augmenting paths."""
    of_row = np.full(x.shape[0], -1)

    def augment(c, seen):
        for r in np.flatnonzero(x[:, c]):
            if r not in seen:
                seen.add(r)
                if of_row[r] < 0 or augment(of_row[r], seen):
                    of_row[r] = c
                    return True
        return False

    for c in range(x.shape[1]):
        augment(c, set())
    out = np.full(x.shape[1], -1)
    for r, c in enumerate(of_row):
        if c >= 0:
            out[c] = r
    return out


def maximum_transversal(a: DataFrame) -> DataFrame: return per_matrix(a, lambda x: {"row": _matching(x).astype(float)})
def structural_rank(a: DataFrame) -> DataFrame: return per_matrix(a, lambda x: {"rank": np.float64((_matching(x) >= 0).sum())})


def column_ordering(a: DataFrame) -> DataFrame:
    """Columns by how many others they meet in a row, fewest first: place of each column. Joins and aggregates, for matrices of any size."""
    stored = a.where("v <> 0").select("m", "i0", "i1")
    met = stored.join(stored.select("m", "i0", F.col("i1").alias("j")), ["m", "i0"]).where("i1 <> j")
    degree = stored.select("m", "i1").distinct().join(met.groupBy("m", "i1").agg(F.countDistinct("j").alias("d")), ["m", "i1"], "left").fillna(0)
    return degree.select("m", "i1", (F.row_number().over(W.partitionBy("m").orderBy("d", "i1")) - 1).alias("place"))


symmetric_ordering = column_ordering


def sparse_solve_triangular(t: Sparse, b: Tensor, lower: bool = True, unit: bool = False, most: int = 10_000) -> Tensor:
    """By levels: a row is solved in the step after all it depends on, so there are as many joins as the longest chain is long."""
    scratch = Scratch(b.df.sparkSession)
    inside = "col < row" if lower else "col > row"
    diag = t.df.where("row = col").select("row", F.col("v").alias("d"))
    off = scratch.save(t.df.where(inside))
    rows = b.df.sparkSession.range(t.shape[0]).withColumnRenamed("id", "row").join(b.df.select(F.col("i0").alias("row"), F.col("v").alias("b")), "row", "left").join(diag, "row", "left").join(off.groupBy("row").agg(F.count("*").alias("waits")), "row", "left").fillna(0, ["waits"]).fillna(0.0, ["b"])
    rows = scratch.save(rows.select("row", "b", (F.lit(1.0) if unit else F.col("d")).alias("d"), "waits"))
    done = scratch.save(rows.where("waits = 0").select("row", (F.col("b") / F.col("d")).alias("x")))
    for _ in range(most):
        known = off.join(done.withColumnRenamed("row", "col"), "col").groupBy("row").agg(F.count("*").alias("n"), F.sum(F.col("v") * F.col("x")).alias("s"))
        fresh = rows.join(done, "row", "left_anti").join(known, "row").where("n = waits").select("row", ((F.col("b") - F.col("s")) / F.col("d")).alias("x"))
        fresh = scratch.save(fresh)
        if fresh.isEmpty():
            break
        done = scratch.save(done.unionByName(fresh))
    return Tensor(done.select(F.col("row").alias("i0"), F.col("x").alias("v")), (t.shape[0],))
