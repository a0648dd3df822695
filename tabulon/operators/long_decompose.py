"""CP and Tucker decompositions of a tensor with one long mode, whose factor stays a table.

A row holds one index of the long mode and the cells of all others, a slice. In both decompositions the long factor is the unfolding times a small
matrix W (slice cells by rank), so every task makes its rows of it on the way and no join brings it back to the slices. One pass over the slices sums
F'X and F'F for F = X W within tasks, which is all that the other factors' updates need: a sweep is one pass without a shuffle of cells. Slices of up to REDUCE cells take one pass in all,
as the same sums come from the R of the unfolding's QR. What reaches
the driver are rank x slice sums and factors of the small modes, whose sizes don't grow with the long mode.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.plans.scratch import Scratch
from tabulon.plans.tensor import ShapeError, Tensor

#: Partial results that one task adds or stacks, and bytes of slices held as one dense block.
FAN, BLOCK_BYTES = 32, 32 << 20
#: Slices of at most so many cells are replaced by the R of their unfolding, at most 2 MB, for the sweeps of CP.
REDUCE = 512


@dataclass(frozen=True)
class Slices:
    """rows: i (long) and vec (array of prod(shape) doubles, row-major); shape: that of a slice. Indices without a row are slices of zeros."""

    rows: DataFrame
    shape: tuple[int, ...]

    @property
    def width(self) -> int: return prod(self.shape)

    @staticmethod
    def of(rows: DataFrame, shape: Sequence[int]) -> Slices:
        """Rows (i, vec), written once. Rows with a null i or vec are left out, a null component is zero; another length is a ShapeError in the task."""
        vec = F.transform(F.col("vec").cast("array<double>"), lambda x: F.coalesce(x, F.lit(0.0)))
        return Slices(Scratch(rows.sparkSession).save(rows.select(F.col("i").cast("long").alias("i"), vec.alias("vec")).dropna(subset=["i", "vec"]), "slices"), tuple(shape))

    @staticmethod
    def of_tensor(t: Tensor, long: int = 0) -> Slices:
        """Any tensor of cells, its mode `long` as the long one and the others in their order; a slice must fit one task."""
        small = [k for k in range(t.rank) if k != long]
        place = F.lit(0).cast("long")
        for k in small:
            place = place * t.shape[k] + F.col(f"i{k}")
        width = prod(t.shape[k] for k in small)
        cells = t.df.groupBy(F.col(f"i{long}").alias("i")).agg(F.map_from_entries(F.collect_list(F.struct(place.alias("at"), "v"))).alias("m"))
        vec = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long")), lambda x: F.coalesce(F.col("m")[x], F.lit(0.0)))
        return Slices.of(cells.select("i", vec.alias("vec")), [t.shape[k] for k in small])


def _blocks(batches, width: int):
    """Ids and dense blocks of the slices of a partition."""
    step = max(1, BLOCK_BYTES // (8 * width))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            piece = batch.slice(at, step)
            flat = piece.column(1).flatten().to_numpy(zero_copy_only=False)
            if len(flat) != piece.num_rows * width:
                raise ShapeError(f"slices of {width} cells expected")
            yield piece.column(0), flat.reshape(-1, width)


def _together(parts: DataFrame, join) -> np.ndarray | None:
    """One array from a row (node, m: packed doubles) a task: FAN of them at a time, until FAN are left for the driver."""
    scratch = Scratch(parts.sparkSession)
    parts = scratch.save(parts, "parts")
    n = parts.agg(F.max("node")).first()[0]
    if n is None:
        return None

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        node = table.column("node")[0].as_py() // FAN
        return pa.table({"node": pa.array([node], pa.int64()), "m": pa.array([join([np.frombuffer(x.as_buffer()) for x in table.column("m")]).tobytes()], pa.binary())})

    while n >= FAN:
        parts, n = scratch.save(parts.groupBy(F.expr(f"node div {FAN}")).applyInArrow(run, "node long, m binary"), "parts"), n // FAN
    out = join([np.frombuffer(r["m"]) for r in parts.orderBy("node").collect()])  # FAN rows at most
    return out


def projected(x: Slices, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """F'X (rank x width), F'F and the sum of squares of X, for F = X W: one pass, sums within tasks."""
    width, rank = w.shape

    def run(batches):
        fx, ff, xx = np.zeros((rank, width)), np.zeros((rank, rank)), 0.0
        for _, block in _blocks(batches, width):
            f = block @ w
            fx += f.T @ block
            ff += f.T @ f
            xx += float(np.einsum("ij,ij->", block, block))
        packed = np.concatenate([fx.ravel(), ff.ravel(), [xx]]).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([packed], pa.binary())], ["node", "m"])

    out = _together(x.rows.mapInArrow(run, "node long, m binary"), lambda parts: np.sum(parts, axis=0))
    out = np.zeros(rank * (width + rank) + 1) if out is None else out
    return out[: rank * width].reshape(rank, width), out[rank * width : -1].reshape(rank, rank), float(out[-1])


def last_r(x: Slices, w: np.ndarray) -> np.ndarray:
    """R of the QR of X W, without its Q: every task folds its blocks into one R, and these are stacked and factored again."""
    width, k = w.shape

    def fold(parts):
        r = np.linalg.qr(np.vstack([p.reshape(-1, k) for p in parts]), "r")
        return np.vstack([r, np.zeros((k - len(r), k))]).ravel()

    def run(batches):
        r = np.zeros((0, k))
        for _, block in _blocks(batches, width):
            r = np.linalg.qr(np.vstack([r, block @ w]), "r")
        packed = np.vstack([r, np.zeros((k - len(r), k))]).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([packed], pa.binary())], ["node", "m"])

    out = _together(x.rows.mapInArrow(run, "node long, m binary"), fold)
    return np.zeros((k, k)) if out is None else out.reshape(k, k)


def times(x: Slices, w: np.ndarray) -> DataFrame:
    """i and vec of X W."""
    width = x.width

    def run(batches):
        for ids, block in _blocks(batches, width):
            out = block @ w
            yield pa.RecordBatch.from_arrays([ids, pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), out.shape[1]).cast(pa.list_(pa.float64()))], ["i", "vec"])

    return x.rows.mapInArrow(run, "i long, vec array<double>")


def khatri_rao(factors: Sequence[np.ndarray]) -> np.ndarray:
    """Column-wise Kronecker product, the last factor's index fastest."""
    out = np.ones((1, factors[0].shape[1]))
    for f in factors:
        out = (out[:, None, :] * f[None, :, :]).reshape(-1, f.shape[1])
    return out


def kronecker(factors: Sequence[np.ndarray]) -> np.ndarray:
    out = np.ones((1, 1))
    for f in factors:
        out = np.kron(out, f)
    return out


@dataclass(frozen=True)
class CP:
    """The long factor is X W with columns of length one; weights hold the lengths of the terms."""

    x: Slices
    w: np.ndarray
    weights: np.ndarray
    factors: list[np.ndarray]
    error: float

    def long_factor(self) -> DataFrame: return times(self.x, self.w)
    def reconstruct(self) -> DataFrame: return times(self.x, (self.w * self.weights) @ khatri_rao(self.factors).T)


def cp(x: Slices, rank: int, sweeps: int = 25, tolerance: float = 0.0, seed: int = 0, start: Sequence[np.ndarray] | None = None) -> CP:
    """Alternating least squares, the long factor first in each sweep; it ends early when the relative error falls by at most `tolerance`.

    error: root of the sum of squared differences over that of X (0 for a tensor of zeros). The factors of the small modes have columns of length
    one. A sweep reads the slices once (short ones: all sweeps together do); the last one's error comes from its own sums.
    """
    if sweeps < 1:
        raise ValueError("at least one sweep")
    rng = np.random.default_rng(seed)
    small = [np.array(f, float) for f in start] if start is not None else [rng.standard_normal((n, rank)) for n in x.shape]
    grams = [f.T @ f for f in small]
    sums = lambda w: projected(x, w)
    if x.width <= REDUCE:
        r = last_r(x, np.eye(x.width))
        sums = lambda w: ((r @ w).T @ r, (r @ w).T @ (r @ w), float((r * r).sum()))
    error, w, d = np.inf, np.zeros((x.width, rank)), len(x.shape)
    for _ in range(sweeps):
        w = khatri_rao(small) @ np.linalg.pinv(np.prod(grams, axis=0))
        fx, ff, xx = sums(w)
        cube = fx.reshape(rank, *x.shape)
        for k in range(d):
            m = cube
            for j in reversed(range(d)):
                if j != k:
                    # sums mode j out, term by term
                    m = np.einsum("rj...,jr->r...", np.moveaxis(m, j + 1, 1), small[j])
            small[k] = m.reshape(rank, x.shape[k]).T @ np.linalg.pinv(ff * np.prod([grams[j] for j in range(d) if j != k], axis=0))
            grams[k] = small[k].T @ small[k]
        inner, norm = float((fx.T * khatri_rao(small)).sum()), float((ff * np.prod(grams, axis=0)).sum())
        before, error = error, np.sqrt(max(xx - 2 * inner + norm, 0) / xx) if xx > 0 else 0.0
        if before - error <= tolerance and np.isfinite(before) and tolerance > 0:
            break
    lengths = [np.sqrt(np.diag(g)) for g in grams]
    first = np.sqrt(np.maximum(np.diag(ff), 0))
    unit = lambda a, n: a / np.where(n > 0, n, 1)
    return CP(x, unit(w, first), first * np.prod(lengths, axis=0), [unit(f, n) for f, n in zip(small, lengths, strict=True)], float(error))


@dataclass(frozen=True)
class Tucker:
    """The long factor is X W, orthonormal; core: ranks of the long mode, then of the others; error relative to X."""

    x: Slices
    w: np.ndarray
    core: np.ndarray
    factors: list[np.ndarray]
    error: float

    def long_factor(self) -> DataFrame: return times(self.x, self.w)
    def reconstruct(self) -> DataFrame: return times(self.x, self.w @ self.core.reshape(len(self.core), -1) @ kronecker(self.factors).T)


def tucker(x: Slices, ranks: Sequence[int], sweeps: int = 5) -> Tucker:
    """Higher-order orthogonal iteration from the truncated higher-order SVD (sweeps = 0: that alone); ranks: the long mode's first.

    The small modes start from the R of the unfolding's QR, whose squares are those of X; each sweep takes two passes: an R of X times the other factors,
    whose singular vectors give W, and the sums F'X. Directions without any weight are left out, so the core may be smaller than asked.
    """
    d = len(x.shape)
    if len(ranks) != d + 1:
        raise ShapeError(f"{len(ranks)} ranks for {d + 1} modes")
    r = last_r(x, np.eye(x.width)).reshape(-1, *x.shape)
    factors = []
    for k in range(d):
        u, s, _ = np.linalg.svd(np.moveaxis(r, k + 1, 0).reshape(x.shape[k], -1), full_matrices=False)
        factors.append(u[:, : min(ranks[k + 1], x.shape[k])])
    xx = float((r * r).sum())
    w, fx = _long(x, factors, ranks[0])
    for _ in range(sweeps):
        for k in range(d):
            y = fx.reshape(-1, *x.shape)
            for j in range(d):
                if j != k:
                    y = np.moveaxis(np.tensordot(y, factors[j], (j + 1, 0)), -1, j + 1)
            u, _, _ = np.linalg.svd(np.moveaxis(y, k + 1, 0).reshape(x.shape[k], -1), full_matrices=False)
            factors[k] = u[:, : factors[k].shape[1]]
        w, fx = _long(x, factors, ranks[0])
    core = (fx @ kronecker(factors)).reshape(-1, *(f.shape[1] for f in factors))
    return Tucker(x, w, core, factors, float(np.sqrt(max(xx - (core * core).sum(), 0) / xx)) if xx > 0 else 0.0)


def _long(x: Slices, factors: Sequence[np.ndarray], rank: int) -> tuple[np.ndarray, np.ndarray]:
    """W of the long factor's leading left vectors given the others, and F'X."""
    inside = kronecker(factors)
    _, s, vt = np.linalg.svd(last_r(x, inside))
    keep = max(1, min(rank, int((s > 1e-12 * s[0]).sum())))  # a tensor of zeros keeps one term of zeros
    w = inside @ (vt[:keep].T / np.where(s[:keep] > 0, s[:keep], 1))
    return w, projected(x, w)[0]
