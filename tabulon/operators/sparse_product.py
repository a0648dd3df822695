"""Product of two sparse matrices over a grid of blocks.

Rows of the left matrix, columns of the right one and the inner index are each cut into ranges or hash classes; a task multiplies one block of either
matrix and sums what falls on one cell before anything leaves it. Ranges hold about equal counts of stored cells. A heavy row or column fills ranges of
its own and is split by the inner index; a heavy inner index is split by the rows and columns it meets. Cells travel packed, some thousands a record.
The grid is the one that moves the fewest cells: with one inner class the tasks' sums are the result; with more, they are added in a last shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stored cells of either matrix that one task holds at most (about), products that it makes (about), and products that it makes at a time.
CELLS, WORK, TOGETHER = 1_000_000, 16_000_000, 1 << 20
#: Products whose sums a task holds at once (about); a block's rows take turns.
TURN = 1 << 21
#: Results of smaller magnitude are left out.
ZERO = 1e-15
#: Cells of a block that may be summed in a plain array (32 MB); beyond it, sums are kept by sorted cell.
PLAIN = 1 << 22


@dataclass(frozen=True)
class Grid:
    """Ranges of rows, ranges of columns and inner classes."""

    rows: int
    cols: int
    inner: int


@dataclass(frozen=True)
class Counts:
    """Stored cells of both matrices, products of single cells, the result's rows and columns with any, the longest row and column."""

    left: int
    right: int
    work: int
    rows: int
    cols: int
    longest: int


def counts(a: DataFrame, b: DataFrame) -> Counts:
    """Exact counts by grouped sums; products are counted by inner index, none is made."""
    ka, kb = a.groupBy(F.col("col").alias("k")).agg(F.count("*").alias("m")), b.groupBy(F.col("row").alias("k")).agg(F.count("*").alias("n"))
    work = F.sum(F.coalesce(F.col("m") * F.col("n"), F.lit(0)))
    inner = ka.join(kb, "k", "full").agg(F.sum("m"), F.sum("n"), work).first()
    ends = [df.groupBy(key).agg(F.count("*").alias("n")).agg(F.count("*"), F.max("n")).first() for df, key in ((a, "row"), (b, "col"))]
    return Counts(inner[0] or 0, inner[1] or 0, inner[2] or 0, ends[0][0], ends[1][0], max(ends[0][1] or 0, ends[1][1] or 0))


def grid(c: Counts, tasks: int) -> Grid:
    """The grid of least traffic among those whose blocks hold at most CELLS cells and WORK products on average and that give each task a block."""
    least = max(tasks, -(-c.work // WORK))
    top = 1 << max(int(least - 1).bit_length(), (-(-max(c.left, c.right) // CELLS)).bit_length(), (-(-c.longest // CELLS)).bit_length())
    sizes = [1 << k for k in range(top.bit_length())]
    best = None
    for p, q, r in product(sizes, sizes, sizes):
        if p * q * r < least or p * r * CELLS < c.left or q * r * CELLS < c.right or r * CELLS < c.longest:
            continue
        traffic = c.left * q + c.right * p + (min(c.work, r * c.rows * c.cols) if r > 1 else 0)
        if best is None or (traffic, p * q * r) < best[0]:
            best = (traffic, p * q * r), Grid(p, q, r)
    return best[1]


def bounds(df: DataFrame, key: str, n: int) -> list[int]:
    """First keys of all ranges but the first, by quantiles of the stored cells, within a tenth of a range."""
    return sorted({int(x) for x in df.approxQuantile(key, [k / n for k in range(1, n)], 0.1 / n)}) if n > 1 else []


def _pack(side: int, own: list[int], g: Grid, others: int):
    """Records (block, side, end, inner, v) of cells (end, inner, v); each goes to every range of the other matrix's end."""
    edges = np.array(own, np.int64)

    def run(batches):
        for batch in batches:
            end, k, v = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            part = np.searchsorted(edges, end, "right").astype(np.int64) * g.inner + (k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % g.inner
            order = np.argsort(part, kind="stable")
            part, end, k, v = part[order], end[order], k[order], v[order]
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
            out = []
            for at, to in zip(starts, [*starts[1:], len(part)], strict=True):
                own_range, inner = divmod(int(part[at]), g.inner)
                packed = (end[at:to].tobytes(), k[at:to].tobytes(), v[at:to].tobytes())
                for other in range(others):
                    i, j = (own_range, other) if side == 0 else (other, own_range)
                    out.append(((i * g.cols + j) * g.inner + inner, side, *packed))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["block", "side", "ends", "inner", "vs"])

    return run


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    joined = [np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("ends", np.int64), ("inner", np.int64), ("vs", np.float64))]
    order = np.argsort(joined[1], kind="stable")
    return tuple(x[order] for x in joined)


def local_product(a, b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and summed values of the product of (rows, inner, values) by (cols, inner, values), both sorted by inner."""
    (ra, ka, va), (cb, kb, vb) = a, b
    lo, hi = np.searchsorted(kb, ka, "left"), np.searchsorted(kb, ka, "right")
    met = hi > lo
    ra, va, lo, n = ra[met], va[met], lo[met], (hi - lo)[met]
    rows, r = np.unique(ra, return_inverse=True)
    cols, c = np.unique(cb, return_inverse=True)
    size = len(rows) * len(cols)
    plain = size <= PLAIN
    total, hit = (np.zeros(size), np.zeros(size, bool)) if plain else (None, None)
    cells, sums = [], []
    ends = np.cumsum(n)
    at = 0
    while at < len(n):
        # whole cells of the left matrix whose products fit together, one at least
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER, "right")))
        m = n[at:to]
        first = np.repeat(lo[at:to] - np.r_[0, np.cumsum(m)[:-1]], m)
        right = first + np.arange(m.sum())
        cell, v = np.repeat(r[at:to], m) * len(cols) + c[right], np.repeat(va[at:to], m) * vb[right]
        if plain:
            total += np.bincount(cell, v, size)
            hit[cell] = True
        else:
            u, where = np.unique(cell, return_inverse=True)
            cells.append(u)
            sums.append(np.bincount(where, v))
            if sum(map(len, cells)) > 2 * max(TOGETHER, len(cells[0])):
                u, where = np.unique(np.concatenate(cells), return_inverse=True)
                cells, sums = [u], [np.bincount(where, np.concatenate(sums))]
        at = to
    if plain:
        cell = np.flatnonzero(hit)
        value = total[cell]
    elif cells:
        cell, where = np.unique(np.concatenate(cells), return_inverse=True)
        value = np.bincount(where, np.concatenate(sums))
    else:
        cell, value = np.zeros(0, np.int64), np.zeros(0)
    return rows[cell // max(len(cols), 1)], cols[cell % max(len(cols), 1)], value


def in_turns(a, b) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """local_product by rows of the left block, as many at a time as make about TURN products (one at least), so that no more sums are held at once."""
    ra, ka, va = a
    n = np.searchsorted(b[1], ka, "right") - np.searchsorted(b[1], ka, "left")
    rows, at = np.unique(ra, return_inverse=True)
    part = (np.cumsum(np.bincount(at, n, len(rows)).astype(np.int64)) - 1) // TURN
    for k in np.unique(part):
        own = part[at] == k
        yield local_product((ra[own], ka[own], va[own]), b)


def _multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(list(batches))
    left, right = (_unpacked(table.filter(pc.equal(table.column("side"), s))) for s in (0, 1))
    del table
    for row, col, v in in_turns(left, right) if len(left[0]) and len(right[0]) else ():
        for at in range(0, len(row), TOGETHER):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + TOGETHER]) for x in (row, col, v)], ["row", "col", "v"])


def multiply(a: DataFrame, b: DataFrame, shape: Grid | None = None) -> DataFrame:
    """row, col, v of the product of two tables (row, col, v); cells that repeat count as their sum, null values and keys as no cell.

    Cells of a magnitude below ZERO are left out; NaN stays. An empty table gives an empty product. Other columns are ignored. The tables are
    read several times (counts, bounds, cells): save a costly one first.
    """
    spark = a.sparkSession
    a, b = (x.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("v").cast("double").alias("v")).where("row IS NOT NULL AND col IS NOT NULL AND v IS NOT NULL") for x in (a, b))
    if shape is None:
        c = counts(a, b)
        if not c.work:
            return spark.createDataFrame([], "row long, col long, v double")
        shape = grid(c, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows, cols = bounds(a, "row", shape.rows), bounds(b, "col", shape.cols)
    fields = "block long, side int, ends binary, inner binary, vs binary"
    # quantiles that repeat make fewer ranges
    left = a.select(F.col("row").alias("e"), F.col("col").alias("k"), "v").mapInArrow(_pack(0, rows, shape, len(cols) + 1), fields)
    right = b.select(F.col("col").alias("e"), F.col("row").alias("k"), "v").mapInArrow(_pack(1, cols, shape, len(rows) + 1), fields)
    out = left.unionByName(right).groupBy("block").applyInArrow(_multiply, "row long, col long, v double")
    if shape.inner > 1:
        out = out.groupBy("row", "col").agg(F.sum("v").alias("v"))
    return out.where(F.abs("v") >= ZERO)
