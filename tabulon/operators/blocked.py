"""Factorizations and solves of one large matrix that lies in a table of blocks (r, c, m): row block, column block, packed doubles. Blocks of zeros need not be stored.

Both factorizations are right-looking: a panel of one block column is factored, then the blocks to its right are updated by a join with the panel's rows and
columns. LU picks its pivots by tournament: every block of the panel nominates its best rows, winners meet in groups of FAN until one set is left, so
no task holds more than FAN blocks of a panel. Pivot rows never move; the order they were picked in is a table of its own. What reaches the driver
is the one diagonal block of a step and the names of its block rows and columns. A matrix whose cells lie in a narrow band is factored by `banded`, as cells.
"""

from __future__ import annotations

import dataclasses
import functools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.operators import banded
from tabulon.operators.contraction import _blocks
from tabulon.operators.sparse import Sparse
from tabulon.plans.scratch import Scratch
from tabulon.plans.tensor import ShapeError, Tensor

#: Rows and columns of a block; sets of pivot candidates, or blocks to be summed, that one task takes together.
SIDE, FAN = 256, 8
#: Panels of at most so many bytes are broadcast, larger ones are joined by a shuffle.
BROADCAST_BYTES = 64 << 20


@dataclass(frozen=True)
class Blocks:
    df: DataFrame
    shape: tuple[int, int]
    side: int
    #: The cells (i0, i1, v) that the blocks were packed from; thin: they are few, so products and readers take them instead of the blocks.
    source: DataFrame | None = None
    thin: bool = False

    @staticmethod
    def of(a: Tensor | Sparse, side: int = SIDE) -> Blocks:
        """The blocks of a matrix that hold a cell; missing cells are zero."""
        t = a.tensor() if isinstance(a, Sparse) else a
        if t.rank != 2:
            raise ShapeError("a matrix has two dimensions")
        return Blocks(_blocks(t, "r", "c", side), t.shape, side, t.df)

    @staticmethod
    def few(cells: DataFrame, shape: tuple[int, int], side: int) -> Blocks:
        """Blocks of few cells (i0, i1, v), packed only where blocks are asked for."""
        return Blocks(_blocks(Tensor(cells, shape), "r", "c", side), shape, side, cells, True)

    def cells(self) -> DataFrame:
        """i0, i1, v of all stored blocks, zeros included; of few cells, those."""
        if self.thin:
            return self.source.select("i0", "i1", "v")
        side, (height, width) = self.side, self.shape

        def run(batches):
            for batch in batches:
                for r, c, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    a = _matrix(m, side)[: max(0, height - r * side), : max(0, width - c * side)]
                    i, j = np.indices(a.shape)
                    yield pa.RecordBatch.from_arrays([pa.array((r * side + i).ravel()), pa.array((c * side + j).ravel()), pa.array(a.ravel())], ["i0", "i1", "v"])

        return self.df.select("r", "c", "m").mapInArrow(run, "i0 long, i1 long, v double")

    def tensor(self) -> Tensor: return Tensor(self.cells(), self.shape)

    def transpose(self) -> Blocks:
        side = self.side
        if self.thin:
            return Blocks.few(self.source.select(F.col("i1").alias("i0"), F.col("i0").alias("i1"), "v"), self.shape[::-1], side)
        return Blocks(_mapped(self.df.select("c", "r", "m"), "r long, c long, m binary", lambda m: _matrix(m, side).T), self.shape[::-1], side)


def _matrix(m, side: int) -> np.ndarray: return np.frombuffer(m.as_buffer()).reshape(-1, side)
def _bytes(a: np.ndarray) -> bytes: return np.ascontiguousarray(a, np.float64).tobytes()


def _mapped(df: DataFrame, schema: str, f) -> DataFrame:
    """df (two keys, then packed matrices) with f of the matrices as the last column; rows where f gives None go."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            out = [f(*row) for row in zip(*batch.columns[2:], strict=True)]
            kept = [k for k, x in enumerate(out) if x is not None]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(kept, pa.int64())) for i in (0, 1)), pa.array([_bytes(out[k]) for k in kept], pa.binary())], names)

    return df.mapInArrow(run, schema)


def _panel(df: DataFrame, blocks: int, side: int) -> DataFrame:
    """df with a broadcast hint if so many blocks are small enough."""
    return F.broadcast(df) if blocks * side * side * 8 <= BROADCAST_BYTES else df


def add_up(df: DataFrame, side: int, depth: int) -> DataFrame:
    """Sums of the blocks (r, c, k, m) with the same r and c, FAN of them at a time; k counts the summands of a sum and stays below depth."""
    def run(key, table):
        total = np.sum([np.frombuffer(m.as_buffer()) for m in table.column("m")], axis=0)
        return pa.table({"r": [key[0].as_py()], "c": [key[1].as_py()], "k": [key[2].as_py()], "m": pa.array([_bytes(total)], pa.binary())})

    while depth > 1:
        df = df.withColumn("k", F.expr(f"k div {FAN}")).groupBy("r", "c", "k").applyInArrow(run, "r long, c long, k long, m binary")
        depth = -(-depth // FAN)
    return df.select("r", "c", "m")


def multiply(a: Blocks, b: Blocks) -> Blocks:
    """The product by blocks: partial products meet in a tree, so no task holds all of a result block's."""
    if a.shape[1] != b.shape[0] or a.side != b.side:
        raise ShapeError(f"{a.shape} by {b.shape}")
    side = a.side
    if a.thin and b.thin:
        both = a.source.select("i0", F.col("i1").alias("k"), "v").join(b.source.select(F.col("i0").alias("k"), "i1", F.col("v").alias("w")), "k")
        return Blocks.few(both.groupBy("i0", "i1").agg(F.sum(F.col("v") * F.col("w")).alias("v")), (a.shape[0], b.shape[1]), side)
    met = a.df.select("r", F.col("c").alias("k"), "m").join(b.df.select(F.col("r").alias("k"), "c", F.col("m").alias("n")), "k").select("r", "c", "k", "m", "n")

    def run(batches):
        for batch in batches:
            out = [_bytes(_matrix(x, side) @ _matrix(y, side)) for x, y in zip(batch.column(3), batch.column(4), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], ["r", "c", "k", "m"])

    return Blocks(add_up(met.mapInArrow(run, "r long, c long, k long, m binary"), side, -(-a.shape[1] // side)), (a.shape[0], b.shape[1]), side)


# LU

def _elect(a: np.ndarray, most: int) -> np.ndarray:
    """The rows that elimination with row pivots takes first, in order, `most` at most; where only zeros are left, the rest as they stand."""
    u, order = a.copy(), np.arange(len(a))
    for k in range(min(most, *a.shape)):
        p = k + int(np.abs(u[k:, k]).argmax())
        if u[p, k] == 0:
            continue
        u[[k, p]], order[[k, p]] = u[[p, k]], order[[p, k]]
        u[k + 1 :] -= np.outer(u[k + 1 :, k] / u[k, k], u[k])
    return order[:most]


def _split(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """L and U of a square block whose rows are in order."""
    u, low = w.copy(), np.eye(len(w))
    for k in range(len(w)):
        if u[k, k]:
            low[k + 1 :, k] = u[k + 1 :, k] / u[k, k]
            u[k + 1 :] -= np.outer(low[k + 1 :, k], u[k])
            u[k + 1 :, k] = 0
    return low, u


def _lower_solve(low: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x of low x = y."""
    x = np.array(y, float)
    for i in range(len(low)):
        x[i] = (x[i] - low[i, :i] @ x[:i]) / low[i, i]
    return x


def _upper_solve(up: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x of up x = y; a zero on the diagonal gives infinities, as the matrix is singular."""
    x = np.array(y, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        for i in reversed(range(len(up))):
            x[i] = (x[i] - up[i, i + 1 :] @ x[i + 1 :]) / up[i, i]
    return x


@dataclass(frozen=True)
class LU:
    """Row r of `order` (place, row) is the matrix's row that was picked at that place. low: blocks of L with the rows where they were in the matrix
    (so low times up is the matrix itself); up: blocks of U, and of what elimination made of the right-hand sides, by place."""

    low: Blocks
    up: Blocks
    order: DataFrame
    rhs: int
    scratch: Scratch
    #: Of a band: the eliminated right-hand sides as cells (place i, side j, v), and how far U reaches from its diagonal.
    sides: DataFrame | None = None
    reach: int = 0

    def lower(self) -> DataFrame:
        """i0, i1, v of L, rows by place."""
        return self.low.cells().join(self.order.select(F.col("row").alias("i0"), "place"), "i0").select(F.col("place").alias("i0"), "i1", "v").where("i1 <= i0")

    def upper(self) -> DataFrame:
        return self.up.cells().where(F.col("i0") <= F.col("i1")).where(F.col("i1") < self.low.shape[1])

    def slogdet(self) -> tuple[float, float]:
        """Sign and logarithm of the magnitude of the determinant."""
        n = self.low.shape[0]
        diag = self.up.cells().where("i0 = i1")
        zero, negative, size = diag.agg(F.count(F.when(F.col("v") == 0, 1)), F.count(F.when(F.col("v") < 0, 1)), F.sum(F.log(F.when(F.col("v") != 0, F.abs("v"))))).first()
        if zero:
            return 0.0, -math.inf
        return float((-1) ** ((negative or 0) % 2) * permutation_sign(self.scratch, self.order, n)), float(size or 0.0)

    def det(self) -> float:
        sign, size = self.slogdet()
        return sign * math.exp(size) if sign else 0.0

    def solution(self) -> Blocks:
        """x for the right-hand sides that were eliminated along: blocks from the last to the first."""
        side, n, blocks = self.up.side, self.low.shape[0], -(-self.low.shape[0] // self.up.side)
        if self.up.thin:
            up = self.up.source.select(F.col("i0").alias("i"), F.col("i1").alias("j"), "v")
            return Blocks.few(self.scratch.save(banded.back(up, self.sides, n, self.reach, self.rhs), "x"), (n, self.rhs), side)
        solved: DataFrame | None = None
        for k in reversed(range(blocks)):
            row = self.up.df.where(F.col("r") == k)
            rest = row.where(F.col("c") >= blocks).select("r", "c", F.lit(0).cast("long").alias("k"), "m")
            depth = 1
            if solved is not None:
                met = row.where((F.col("c") > k) & (F.col("c") < blocks)).select("r", F.col("c").alias("k"), "m").join(solved.select(F.col("r").alias("k"), "c", F.col("m").alias("n")), "k")
                less = _mapped_triples(met.select("r", "c", "k", "m", "n"), lambda m, x: -(_matrix(m, side) @ _matrix(x, side)))
                rest, depth = rest.unionByName(less), blocks + 1
            summed = add_up(rest, side, depth)
            corner = row.where(F.col("c") == k).select(F.col("m").alias("u")).first()
            up, width = np.frombuffer(corner["u"]).reshape(side, side), min(side, n - k * side)
            part = _mapped(summed.select("r", "c", "m"), "r long, c long, m binary", lambda m, up=up, width=width: np.vstack([_upper_solve(up[:width, :width], _matrix(m, side)[:width]), np.zeros((side - width, side))]))
            part = self.scratch.save(part, "x")
            solved = part if solved is None else solved.unionByName(part)
        shape = (n, self.rhs)
        return Blocks(solved.select("r", (F.col("c") - blocks).alias("c"), "m"), shape, side)


def _mapped_triples(df: DataFrame, f) -> DataFrame:
    """df (r, c, k, two matrices) with f of the matrices."""
    def run(batches):
        for batch in batches:
            out = [_bytes(f(x, y)) for x, y in zip(batch.column(3), batch.column(4), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], ["r", "c", "k", "m"])

    return df.mapInArrow(run, "r long, c long, k long, m binary")


def permutation_sign(scratch: Scratch, order: DataFrame, n: int) -> int:
    """1 or -1: the parity of n less the number of cycles; every row learns its cycle's least member by doubling, in log2(n) joins."""
    at = scratch.save(order.select(F.col("place").alias("i"), F.col("row").alias("next"), F.least("place", "row").alias("least")), "cycles")
    for _ in range(max(1, math.ceil(math.log2(max(n, 2))))):
        ahead = at.select(F.col("i").alias("next"), F.col("next").alias("after"), F.col("least").alias("further"))
        saved = scratch.save(at.join(ahead, "next").select("i", F.col("after").alias("next"), F.least("least", "further").alias("least")), "cycles")
        scratch.drop(at)
        at = saved
    return -1 if (n - at.where("i = least").count()) % 2 else 1


def _nominate(panel: DataFrame, free: DataFrame, side: int, most: int) -> DataFrame:
    """g, ids, m: the candidates of every block of the panel (r, m); free: r, rows (places within the block that are no pivots yet)."""
    def run(batches):
        for batch in batches:
            out = []
            for r, m, rows in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                rows = np.array(rows, np.int64)
                a = _matrix(m, side)[rows]
                best = _elect(a[:, :most], most)
                out.append((r, (r * side + rows[best]).tolist(), _bytes(a[best])))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.int64())), pa.array([x[2] for x in out], pa.binary())], ["g", "ids", "m"])

    return panel.select("r", "m").join(free.where(F.size("rows") > 0), "r").select("r", "m", "rows").mapInArrow(run, "g long, ids array<long>, m binary")


def _winners(candidates: DataFrame, side: int, most: int) -> DataFrame:
    """One round of the tournament: the best of FAN sets each."""
    def run(key, table):
        table = table.sort_by("g")
        ids = np.concatenate([np.array(x, np.int64) for x in table.column("ids").to_pylist()])
        a = np.vstack([_matrix(m, side) for m in table.column("m")])
        best = _elect(a[:, :most], most)
        return pa.table({"g": [key[0].as_py()], "ids": pa.array([ids[best].tolist()], pa.list_(pa.int64())), "m": pa.array([_bytes(a[best])], pa.binary())})

    return candidates.withColumn("h", F.expr(f"g div {FAN}")).groupBy("h").applyInArrow(run, "g long, ids array<long>, m binary")


def _stacked(k: int, low: np.ndarray, side: int):
    """Puts the rows of a block of U together, by place, and solves them by the corner's L."""
    def run(key, table):
        rows = np.zeros((side, side))
        for place, row in zip(table.column("place").to_pylist(), table.column("row"), strict=True):
            rows[place] = np.frombuffer(row.as_buffer())
        rows[: len(low)] = _lower_solve(low, rows[: len(low)])
        return pa.table({"r": [k], "c": [key[0].as_py()], "m": pa.array([_bytes(rows)], pa.binary())})

    return run


def _union(tables: list[DataFrame], none: DataFrame) -> DataFrame: return functools.reduce(DataFrame.unionByName, tables, none)


def _narrow(a: Blocks, scratch: Scratch) -> tuple[DataFrame, int, int] | None:
    """The cells as a written table and how far they lie below and above the diagonal, if that is a narrow band."""
    if a.source is None:
        return None
    cells = scratch.save(a.source.where("v <> 0").select(F.col("i0").cast("long").alias("i0"), F.col("i1").cast("long").alias("i1"), F.col("v").cast("double").alias("v")), "cells")
    found = banded.width(cells, a.shape[0])
    return (cells, *found) if found else None


def _banded_lu(a: Blocks, b: Blocks | None, scratch: Scratch) -> LU | None:
    """LU as cells if the matrix is a narrow band with few right-hand sides."""
    n, count = a.shape[0], b.shape[1] if b is not None else 0
    if count > banded.MOST or not (found := _narrow(a, scratch)):
        return None
    cells, below, above = found
    sides = None if b is None else b.cells() if b.source is None else b.source
    out = scratch.save(banded.lu(cells, sides, n, below, above, count), "factors")
    low, up = (Blocks.few(out.where(F.col("kind") == k).select(F.col("i").alias("i0"), F.col("j").alias("i1"), "v"), (n, n), a.side) for k in (banded.LOW, banded.UP))
    order = out.where(F.col("kind") == banded.ORDER).select(F.col("i").alias("place"), F.col("j").alias("row"))
    return LU(low, up, order, count, scratch, out.where(F.col("kind") == banded.SIDES).select("i", "j", "v"), below + above)


def lu(a: Blocks, b: Blocks | None = None) -> LU:
    """Row-pivoted L and U of a square matrix, with right-hand sides (b) eliminated along if given.

    Singular matrices are factored too, with zeros on the diagonal of U. An empty matrix has no factors.
    """
    side, n = a.side, a.shape[0]
    if a.shape[0] != a.shape[1] or (b is not None and (b.shape[0] != n or b.side != side)):
        raise ShapeError(f"{a.shape}: LU takes square matrices and as many right-hand rows")
    scratch, blocks = Scratch(a.df.sparkSession), -(-n // side)
    if band := _banded_lu(a, b, scratch):
        return band
    spark = a.df.sparkSession
    left = a.df.select("r", "c", "m")
    if b is not None:
        left = left.unionByName(b.df.select("r", (F.col("c") + blocks).alias("c"), "m"))
    left = scratch.save(left, "left")
    free = scratch.save(spark.range(blocks).select(F.col("id").alias("r"), F.expr(f"sequence(0L, least({side}L, {n}L - id * {side}L) - 1)").alias("rows")), "free")
    low, up, order = [], [], []
    for k in range(blocks):
        width = min(side, n - k * side)
        panel = left.where(F.col("c") == k)
        # a block row without a block in this column takes part with zeros, else a singular panel would lack rows
        panel = free.select("r").join(panel, "r", "left").select("r", F.coalesce("m", F.lit(bytes(side * side * 8))).alias("m"))
        candidates, sets = _nominate(panel, free, side, width), blocks
        while sets > 1:
            candidates, sets = _winners(candidates, side, width), -(-sets // FAN)
        best = candidates.first()
        picked, w = best["ids"], np.frombuffer(best["m"]).reshape(-1, side)[:, :width]
        corner_low, corner_up = _split(w)
        of_block: dict[int, list] = {}
        for place, i in enumerate(picked):
            of_block.setdefault(i // side, []).append((i % side, place))
        pivots = spark.createDataFrame([(r, rows) for r, rows in of_block.items()], "r long, pivots array<struct<at:long,place:long>>")  # one entry per pivot: `side` at most
        order.append(spark.createDataFrame([(k * side + p, i) for p, i in enumerate(picked)], "place long, row long"))

        def lower(r, m, rows, own, corner_low=corner_low, corner_up=corner_up, width=width):
            out, at = np.zeros((side, side)), {x["at"]: x["place"] for x in own or ()}
            rest = [i for i in rows if i not in at]
            with np.errstate(divide="ignore", invalid="ignore"):
                solved = _lower_solve(corner_up.T, m[rest][:, :width].T).T if rest else np.zeros((0, width))
            out[rest, :width] = np.where(np.isfinite(solved), solved, 0.0)  # below a zero pivot there are only zeros
            for i, place in at.items():
                out[i, :width] = corner_low[place]
            return out

        def run(batches, lower=lower, k=k):
            for batch in batches:
                out = [_bytes(lower(r, _matrix(m, side), rows, own)) for r, m, rows, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([k] * len(out), pa.int64()), pa.array(out, pa.binary())], ["r", "c", "m"])

        own_low = panel.join(free.where(F.size("rows") > 0), "r").join(F.broadcast(pivots), "r", "left").select("r", "m", "rows", "pivots").mapInArrow(run, "r long, c long, m binary")
        low.append(scratch.save(own_low, "low"))

        # the pivot rows of the blocks to the right become a block row of U
        def take(batches, width=width):
            for batch in batches:
                c, place, row = [], [], []
                for col, m, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                    m = _matrix(m, side)
                    for x in own:
                        c.append(col)
                        place.append(x["place"])
                        row.append(_bytes(m[x["at"]]))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(place, pa.int64()), pa.array(row, pa.binary())], ["c", "place", "row"])

        right = left.where(F.col("c") > k)
        taken = right.join(F.broadcast(pivots), "r").select("c", "m", "pivots").mapInArrow(take, "c long, place long, row binary")
        row_of_u = scratch.save(taken.groupBy("c").applyInArrow(_stacked(k, corner_low, side), "r long, c long, m binary"), "up")
        corner = np.zeros((side, side))
        corner[:width, :width] = corner_up
        up += [row_of_u, spark.createDataFrame([(k, k, bytearray(_bytes(corner)))], "r long, c long, m binary")]
        columns = [x[0] for x in row_of_u.select("c").collect()]
        if columns:
            rows_left = low[-1].select("r", F.col("m").alias("l"))
            # blocks that are stored, and those that the update fills
            cells = rows_left.select("r", F.explode(F.array(*(F.lit(c).cast("long") for c in columns))).alias("c")).join(right, ["r", "c"], "full").select("r", "c", "m")
            met = cells.join(_panel(rows_left, blocks, side), "r", "left").join(_panel(row_of_u.select("c", F.col("m").alias("u")), len(columns), side), "c", "left").join(F.broadcast(pivots), "r", "left")

            def update(m, low_block, up_block, own):
                out = np.zeros((side, side)) if not m.is_valid else _matrix(m, side).copy()
                if low_block.is_valid and up_block.is_valid:
                    out -= _matrix(low_block, side) @ _matrix(up_block, side)
                for x in own.as_py() or ():
                    out[x["at"]] = 0
                return out if out.any() else None

            after = scratch.save(_mapped(met.select("r", "c", "m", "l", "u", "pivots"), "r long, c long, m binary", update), "left")
        else:
            after = scratch.save(right, "left")
        gone = spark.createDataFrame([(i // side, i % side) for i in picked], "r long, at long").groupBy("r").agg(F.collect_list("at").alias("gone"))
        later = scratch.save(free.join(F.broadcast(gone), "r", "left").select("r", F.when(F.col("gone").isNull(), F.col("rows")).otherwise(F.array_except("rows", "gone")).alias("rows")), "free")
        scratch.drop(left, free)
        left, free = after, later
    none = left.limit(0)
    rhs = b.shape[1] if b is not None else 0
    return LU(Blocks(_union(low, none), (n, n), side), Blocks(_union(up, none), (n, blocks * side + rhs), side), _union(order, spark.createDataFrame([], "place long, row long")), rhs, scratch)


def solve(a: Blocks, b: Blocks) -> Blocks:
    """x of a x = b."""
    return lu(a, b).solution()


def inverse(a: Blocks) -> Blocks:
    n, side, spark = a.shape[0], a.side, a.df.sparkSession
    unit = spark.range(-(-n // side)).select(F.col("id").alias("r"), F.col("id").alias("c"), F.lit(_bytes(np.eye(side))).alias("m"))
    return solve(a, Blocks(unit, (n, n), side))


def det(a: Blocks) -> float: return lu(a).det()


# Cholesky

def cholesky(a: Blocks) -> Blocks:
    """L of a symmetric positive definite matrix, whose lower triangle is read. ValueError if it isn't positive definite."""
    side, n, spark = a.side, a.shape[0], a.df.sparkSession
    if a.shape[0] != a.shape[1]:
        raise ShapeError(f"{a.shape}: Cholesky takes square matrices")
    scratch, blocks, done = Scratch(spark), -(-n // side), []
    if found := _narrow(dataclasses.replace(a, source=a.source.where("i0 >= i1")) if a.source is not None else a, scratch):
        out = scratch.save(banded.cholesky(found[0], n, found[1]), "factor")
        if out.where(F.col("kind") == banded.FAILED).count():
            raise ValueError("the matrix is not positive definite")
        return Blocks.few(out.select(F.col("i").alias("i0"), F.col("j").alias("i1"), "v"), (n, n), side)
    left = scratch.save(a.df.where("r >= c").select("r", "c", "m"), "left")
    for k in range(blocks):
        width = min(side, n - k * side)
        corner = left.where((F.col("r") == k) & (F.col("c") == k)).select("m").first()
        d = np.frombuffer(corner["m"]).reshape(side, side)[:width, :width] if corner else np.zeros((width, width))
        own = _root(d)

        def lower(m, own=own, width=width):
            out = np.zeros((side, side))
            out[:, :width] = _lower_solve(own, _matrix(m, side)[:, :width].T).T
            return out

        first = np.zeros((side, side))
        first[:width, :width] = own
        below = scratch.save(_mapped(left.where((F.col("c") == k) & (F.col("r") > k)), "r long, c long, m binary", lower), "low")
        done += [below, spark.createDataFrame([(k, k, bytearray(_bytes(first)))], "r long, c long, m binary")]
        rows = [x[0] for x in below.select("r").collect()]
        right = left.where(F.col("c") > k)
        if rows:
            ids = F.array(*(F.lit(c).cast("long") for c in rows))
            cells = below.select("r", F.explode(ids).alias("c")).where("r >= c").join(right, ["r", "c"], "full").select("r", "c", "m")
            met = cells.join(_panel(below.select("r", F.col("m").alias("l")), len(rows), side), "r", "left").join(_panel(below.select(F.col("r").alias("c"), F.col("m").alias("t")), len(rows), side), "c", "left")

            def update(m, low_block, other):
                out = np.zeros((side, side)) if not m.is_valid else _matrix(m, side).copy()
                if low_block.is_valid and other.is_valid:
                    out -= _matrix(low_block, side) @ _matrix(other, side).T
                return out

            right = _mapped(met.select("r", "c", "m", "l", "t"), "r long, c long, m binary", update)
        after = scratch.save(right, "left")
        scratch.drop(left)
        left = after
    return Blocks(_union(done, left.limit(0)), (n, n), side)


def _root(d: np.ndarray) -> np.ndarray:
    """The Cholesky factor of one block."""
    low = np.tril(d).copy()
    for k in range(len(low)):
        if not low[k, k] > 0:
            raise ValueError("the matrix is not positive definite")
        low[k, k] = math.sqrt(low[k, k])
        low[k + 1 :, k] /= low[k, k]
        for j in range(k + 1, len(low)):
            low[j:, j] -= low[j:, k] * low[j, k]
    return low
