"""Algebraic multigrid for symmetric positive definite matrices, and conjugate gradients with a cycle of it as preconditioner.

Every level is made from the one before by joins: strong connections, an independent set of coarse rows found in parallel rounds by hashed measures,
weights that interpolate the other rows from their coarse neighbours, and the product P' A P of two sparse joins. A cycle smooths, restricts what is left,
corrects from the coarser level and smooths again; its vectors are tables (i, v), written once on the way down and once on the way up. The last level, of
a few hundred rows at most, is inverted once, and its inverse is a table like any other.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.operators.iterative import ATOL, RTOL, STEPS, Result
from tabulon.operators.sorting import ranked
from tabulon.operators.sparse import Sparse
from tabulon.plans.scratch import Scratch
from tabulon.plans.tensor import ShapeError, Tensor

#: A connection is strong from this part of a row's largest; levels; rows of a level that is inverted; damping and number of the smoothing steps.
STRENGTH, LEVELS, COARSE, DAMPING, SWEEPS = 0.25, 25, 200, 2 / 3, 1


@dataclass(frozen=True)
class Level:
    """a: row, col, v; scaled: i, d (damping over diagonal); up: row, col, v of the interpolation from the next level's rows, None on the last."""

    a: DataFrame
    n: int
    scaled: DataFrame
    up: DataFrame | None


@dataclass(frozen=True)
class Hierarchy:
    levels: list[Level]
    inverse: DataFrame
    sweeps: int
    scratch: Scratch


def strong_connections(a: DataFrame, strength: float = STRENGTH) -> DataFrame:
    """row, col, v of the cells off the diagonal whose magnitude is at least `strength` of the row's largest one there."""
    off = a.where("row <> col AND v <> 0")
    largest = off.groupBy("row").agg(F.max(F.abs("v")).alias("top"))
    return off.join(largest, "row").where(F.abs("v") >= strength * F.col("top")).select("row", "col", "v")


def coarse_rows(scratch: Scratch, strong: DataFrame, seed: int = 0) -> DataFrame:
    """row and coarse (boolean) of all rows with a strong connection: no two coarse rows are strongly connected, all others are connected with a coarse one.

    A row's measure is how many rows depend on it, and a hash below 1. In each round the undecided rows whose measure beats that of all
    undecided rows around them become coarse, and the undecided rows around these become fine.
    """
    pairs = strong.select("row", "col")
    pairs = scratch.save(pairs.unionByName(pairs.select(F.col("col").alias("row"), F.col("row").alias("col"))).distinct(), "around")
    depend = strong.groupBy(F.col("col").alias("row")).agg(F.count("*").alias("n"))
    noise = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "row"), 11) * 2.0**-53
    left = pairs.select("row").distinct().join(depend, "row", "left").select("row", (F.coalesce("n", F.lit(0)) + noise).alias("m"))
    left, done = scratch.save(left, "undecided"), []
    while not left.isEmpty():
        other = left.select(F.col("row").alias("col"), F.col("m").alias("other"))
        best = pairs.join(left, "row").join(other, "col").groupBy("row").agg(F.max(F.struct("other", "col")).alias("best"))
        picked = left.join(best, "row", "left").where(F.col("best").isNull() | (F.struct(F.col("m").alias("other"), F.col("row").alias("col")) > F.col("best"))).select("row")
        picked = scratch.save(picked.withColumn("coarse", F.lit(True)), "coarse")
        fine = pairs.join(picked.select("row"), "row").select(F.col("col").alias("row")).distinct().join(left.select("row"), "row", "left_semi")
        fine = scratch.save(fine.join(picked.select("row"), "row", "left_anti").withColumn("coarse", F.lit(False)), "fine")
        done += [picked, fine]
        later = scratch.save(left.join(picked.select("row").unionByName(fine.select("row")), "row", "left_anti"), "undecided")
        scratch.drop(left)
        left = later
    out = strong.select("row").limit(0).withColumn("coarse", F.lit(True))
    for part in done:
        out = out.unionByName(part)
    return out


def interpolation(a: DataFrame, strong: DataFrame, split: DataFrame) -> tuple[DataFrame, int]:
    """row, col, v from the coarse rows (numbered from 0) to all, and how many coarse rows there are. A fine row takes -a_ij / a_ii of its strong coarse
    neighbours, scaled so that they stand for all of its cells off the diagonal; a row without any is left to smoothing."""
    names = ranked(split.where("coarse").select("row"), ["row"], "k")
    n = names.count()
    sums = a.groupBy("row").agg(F.sum(F.when(F.col("row") != F.col("col"), F.col("v")).otherwise(0.0)).alias("off"), F.sum(F.when(F.col("row") == F.col("col"), F.col("v")).otherwise(0.0)).alias("d"))
    held = strong.join(split.where("NOT coarse").select("row"), "row").join(names.withColumnRenamed("row", "col"), "col")
    some = held.groupBy("row").agg(F.sum("v").alias("some"))
    fine = held.join(some, "row").join(sums, "row").where("some <> 0").select("row", F.col("k").alias("col"), (-F.col("v") / F.col("d") * F.col("off") / F.col("some")).alias("v"))
    return names.select("row", F.col("k").alias("col"), F.lit(1.0).alias("v")).unionByName(fine), n


def galerkin(a: DataFrame, up: DataFrame) -> DataFrame:
    """P' A P: cells meet the rows of P on the right, are summed, then those on the left."""
    right = a.join(up.select(F.col("row").alias("col"), F.col("col").alias("q"), F.col("v").alias("w")), "col").groupBy("row", "q").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    left = right.join(up.select("row", F.col("col").alias("p"), F.col("v").alias("w")), "row").groupBy(F.col("p").alias("row"), F.col("q").alias("col")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    return left.where("v <> 0 OR row = col")


def setup(a: Sparse, strength: float = STRENGTH, levels: int = LEVELS, coarse: int = COARSE, damping: float = DAMPING, sweeps: int = SWEEPS) -> Hierarchy:
    """The levels, until one has `coarse` rows at most. Diagonals must not be zero."""
    if a.shape[0] != a.shape[1]:
        raise ShapeError(f"{a.shape}: a square matrix is needed")
    scratch = Scratch(a.df.sparkSession)
    made, cells, n = [], scratch.save(a.df.select("row", "col", "v"), "a"), a.shape[0]
    while True:
        scaled = scratch.save(cells.where("row = col").select(F.col("row").alias("i"), (damping / F.col("v")).alias("d")), "diagonal")
        up, m = None, n
        if n > coarse and len(made) + 1 < levels:
            strong = scratch.save(strong_connections(cells, strength), "strong")
            split = coarse_rows(scratch, strong)
            up, m = interpolation(cells, strong, scratch.save(split, "split"))
        if not 0 < m < n:
            made.append(Level(cells, n, scaled, None))
            break
        up = scratch.save(up, "up")
        made.append(Level(cells, n, scaled, up))
        cells, n = scratch.save(galerkin(cells, up), "a"), m
    last = made[-1]
    if last.n > 10 * coarse:
        raise ValueError(f"{last.n} rows are left that no strong connection makes fewer")
    dense = np.zeros((last.n, last.n))
    for r in last.a.collect():  # a few hundred rows
        dense[r["row"], r["col"]] = r["v"]
    i, j = np.indices(dense.shape)
    # rows that interpolate nothing have empty cells here
    cells = [(int(x), int(y), float(v)) for x, y, v in zip(i.ravel(), j.ravel(), np.linalg.pinv(dense).ravel(), strict=True) if v]
    inverse = scratch.save(a.df.sparkSession.createDataFrame(cells, "row long, col long, v double"), "inverse")
    return Hierarchy(made, inverse, sweeps, scratch)


def _times(cells: DataFrame, x: DataFrame, transposed: bool = False) -> DataFrame:
    """(i, v) of a sparse matrix by a vector (i, v); rows without cells are missing."""
    row, col = ("col", "row") if transposed else ("row", "col")
    return cells.join(x.select(F.col("i").alias(col), F.col("v").alias("x")), col).groupBy(F.col(row).alias("i")).agg(F.sum(F.col("v") * F.col("x")).alias("v"))


def _relaxed(level: Level, r: DataFrame, x: DataFrame) -> DataFrame:
    """x and one damped Jacobi step of a x = r; x has all rows."""
    ax = _times(level.a, x).withColumnRenamed("v", "ax")
    return x.join(r.withColumnRenamed("v", "r"), "i", "left").join(ax, "i", "left").join(level.scaled, "i").select("i", (F.col("v") + F.col("d") * (F.coalesce("r", F.lit(0.0)) - F.coalesce("ax", F.lit(0.0)))).alias("v"))


def cycle(h: Hierarchy, r: DataFrame, at: int = 0) -> DataFrame:
    """An approximate solution (i, v) of A x = r by one V-cycle: a symmetric operation, as conjugate gradients need it."""
    level = h.levels[at]
    if level.up is None:
        return h.scratch.save(_times(h.inverse, r), "x")
    x = level.scaled.join(r, "i", "left").select("i", (F.col("d") * F.coalesce("v", F.lit(0.0))).alias("v"))
    for _ in range(h.sweeps - 1):
        x = _relaxed(level, r, x)
    x = h.scratch.save(x, "x")
    rest = x.select("i").join(r.withColumnRenamed("v", "r"), "i", "left").join(_times(level.a, x), "i", "left").select("i", (F.coalesce("r", F.lit(0.0)) - F.coalesce("v", F.lit(0.0))).alias("v"))
    below = h.scratch.save(_times(level.up, rest, True), "rest")
    e = cycle(h, below, at + 1)
    y = x.join(_times(level.up, e).withColumnRenamed("v", "e"), "i", "left").select("i", (F.col("v") + F.coalesce("e", F.lit(0.0))).alias("v"))
    y = h.scratch.save(y, "x")
    h.scratch.drop(x, below, e)
    for _ in range(h.sweeps):
        y = _relaxed(level, r, y)
    return h.scratch.save(y, "x")


def _dots(rows: DataFrame, *pairs: str) -> list[float]: return [x or 0.0 for x in rows.agg(*(F.sum(F.expr(p)).alias(f"s{k}") for k, p in enumerate(pairs))).first()]


def preconditioned_cg(a: Sparse, b: Tensor, hierarchy: Hierarchy | None = None, rtol: float = RTOL, atol: float = ATOL, max_iter: int = STEPS) -> Result:
    """Conjugate gradients whose residuals pass through a V-cycle in each step."""
    h = setup(a) if hierarchy is None else hierarchy
    scratch, n = h.scratch, a.shape[0]
    start = a.df.sparkSession.range(n).withColumnRenamed("id", "i").join(b.df.select(F.col("i0").alias("i"), F.col("v").alias("r")), "i", "left").fillna(0.0)
    state = scratch.save(start.select("i", F.lit(0.0).alias("x"), "r"), "state")
    size = float(np.sqrt(_dots(state, "r * r")[0]))
    limit, residual, k, rz = max(rtol * size, atol), size, 0, 0.0
    while residual > limit and k < max_iter:
        z = cycle(h, state.select("i", F.col("r").alias("v")))
        joined = state.join(z.withColumnRenamed("v", "z"), "i", "left").fillna(0.0, ["z"])
        after = _dots(joined, "r * z")[0]
        ratio = after / rz if k else 0.0
        p = F.col("z") + F.lit(ratio) * F.col("p") if k else F.col("z")
        moved = scratch.save(joined.select("i", "x", "r", p.alias("p")), "state")
        both = scratch.save(moved.join(_times(a.df, moved.select("i", F.col("p").alias("v"))).withColumnRenamed("v", "ap"), "i", "left").fillna(0.0, ["ap"]), "state")
        step = after / _dots(both, "p * ap")[0]
        scratch.drop(state, z, moved)
        state = scratch.save(both.select("i", (F.col("x") + step * F.col("p")).alias("x"), (F.col("r") - step * F.col("ap")).alias("r"), "p"), "state")
        scratch.drop(both)
        residual, rz, k = float(np.sqrt(_dots(state, "r * r")[0])), after, k + 1
    return Result(Tensor(state.select(F.col("i").alias("i0"), F.col("x").alias("v")), (n,)), k, residual, residual <= limit)
