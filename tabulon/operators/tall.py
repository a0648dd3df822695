"""QR and singular values of one matrix of many rows and few columns, with the orthogonal factor as a table.

Rows are gathered into blocks where they lie; every block is factored, the small R's meet in groups of FAN until one is left, and every group keeps the
rows of its own Q that belong to each member. These pieces, k x k each, are multiplied on the way back down, so that a block's Q is its local one times
one k x k matrix. Nothing but the last R reaches the driver, and no rows are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.plans.scratch import Scratch

#: Rows of a block, and R's that one task stacks.
ROWS, FAN = 4096, 16


def _bytes(a: np.ndarray) -> bytes: return np.ascontiguousarray(a, np.float64).tobytes()


def _square(m, k: int) -> np.ndarray: return np.frombuffer(m.as_buffer() if hasattr(m, "as_buffer") else m).reshape(-1, k)


def _reflect(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Q and R of a block (thin, R with a diagonal that isn't negative); blocks of fewer rows than columns get rows of zeros in R."""
    q, r = np.linalg.qr(a)
    sign = np.where(np.diag(r) < 0, -1.0, 1.0)
    q, r = q * sign, r * sign[:, None]
    k, short = a.shape[1], a.shape[1] - len(r)
    return np.hstack([q, np.zeros((len(q), short))]), np.vstack([r, np.zeros((short, k))])


@dataclass(frozen=True)
class Tall:
    """blocks: node, ids and the local q of every block; up: the k x k matrix of every node that turns its q into rows of Q; r: the last R."""

    blocks: DataFrame
    up: DataFrame
    r: np.ndarray
    scratch: Scratch

    def rows(self, last: np.ndarray | None = None) -> DataFrame:
        """i and vec (array) of Q, or of Q times `last`."""
        k = len(self.r)
        last = np.eye(k) if last is None else last

        def run(batches):
            for batch in batches:
                for ids, q, t in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                    out = _square(q, k) @ (_square(t, k) @ last)
                    yield pa.RecordBatch.from_arrays([ids.values, pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), out.shape[1]).cast(pa.list_(pa.float64()))], ["i", "vec"])

        return self.blocks.join(self.up, "node").select("ids", "q", "t").mapInArrow(run, "i long, vec array<double>")


def _gather(rows: DataFrame, k: int) -> DataFrame:
    """node, ids, q and r of blocks of up to ROWS rows (i, vec) of one partition."""
    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        ids, held, size = [], [], 0

        def done():
            q, r = _reflect(np.vstack(held))
            return pa.RecordBatch.from_arrays([pa.array([(part << 24) + n]), pa.array([np.concatenate(ids)], pa.list_(pa.int64())), pa.array([_bytes(q)], pa.binary()), pa.array([_bytes(r)], pa.binary())], ["node", "ids", "q", "r"])

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                piece = batch.slice(at, ROWS)
                ids.append(piece.column(0).to_numpy())
                held.append(piece.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, k))
                size += piece.num_rows
                if size >= ROWS:
                    yield done()
                    ids, held, size, n = [], [], 0, n + 1
        if size:
            yield done()

    return rows.mapInArrow(run, "node long, ids array<long>, q binary, r binary")


def _combined(k: int):
    """R of the stacked R's of a group, and for each member its rows of Q."""
    def run(key, table):
        table = table.sort_by("node")
        q, r = _reflect(np.vstack([_square(m, k) for m in table.column("r")]))
        pieces = [_bytes(q[at : at + k]) for at in range(0, len(q), k)]
        n = len(pieces)
        return pa.table({"node": table.column("node"), "parent": pa.array([key[0].as_py()] * n, pa.int64()), "t": pa.array(pieces, pa.binary()), "r": pa.array([_bytes(r)] + [None] * (n - 1), pa.binary())})

    return run


def tsqr(rows: DataFrame, width: int) -> Tall:
    """Thin QR of the matrix with rows (i, vec: array of `width` doubles). The rows of equal i count as different rows. ValueError if there is no row."""
    scratch = Scratch(rows.sparkSession)
    blocks = scratch.save(_gather(rows.select(F.col("i").cast("long").alias("i"), F.col("vec").cast("array<double>").alias("vec")), width), "blocks")
    # nodes by rank, so that groups of FAN are full; a row a block
    names = blocks.select("node").orderBy("node").rdd.map(lambda x: x[0]).zipWithIndex().toDF("node long, k long") if blocks.count() > 1 else blocks.select("node", F.lit(0).cast("long").alias("k"))
    blocks = scratch.save(blocks.join(F.broadcast(names), "node").select(F.col("k").alias("node"), "ids", "q", "r"), "blocks")
    level, levels, n = blocks.select("node", "r"), [], blocks.count()
    if not n:
        raise ValueError("a matrix without rows has no QR")
    while n > 1:
        step = level.withColumn("parent", F.expr(f"node div {FAN}")).groupBy("parent").applyInArrow(_combined(width), "node long, parent long, t binary, r binary")
        step = scratch.save(step, "level")
        levels.append(step.select("node", "parent", "t"))
        level, n = step.where("r IS NOT NULL").select(F.col("parent").alias("node"), "r"), -(-n // FAN)
    r = np.frombuffer(level.select("r").first()[0]).reshape(width, width)
    up = rows.sparkSession.createDataFrame([(0, bytearray(_bytes(np.eye(width))))], "node long, t binary")

    def times(batches):
        for batch in batches:
            out = [_bytes(_square(t, width) @ _square(u, width)) for t, u in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["node", "t"])

    for step in reversed(levels):
        met = step.join(up.select(F.col("node").alias("parent"), F.col("t").alias("u")), "parent").select("node", "t", "u")
        up = scratch.save(met.mapInArrow(times, "node long, t binary"), "down")
    return Tall(blocks.select("node", "ids", "q"), up, r, scratch)


def qr(rows: DataFrame, width: int) -> tuple[DataFrame, np.ndarray]:
    """(i, vec) of Q, and R."""
    t = tsqr(rows, width)
    return t.rows(), t.r


def svd(rows: DataFrame, width: int, rank: int | None = None) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(i, vec) of U, the singular values from the largest and V' (rank x width): the SVD of R, and Q times its left vectors."""
    t = tsqr(rows, width)
    u, s, vt = np.linalg.svd(t.r)
    rank = width if rank is None else min(rank, width)
    return t.rows(u[:, :rank]), s[:rank], vt[:rank]


def polar(rows: DataFrame, width: int) -> tuple[DataFrame, np.ndarray]:
    """(i, vec) of the orthogonal factor and the symmetric one."""
    t = tsqr(rows, width)
    u, s, vt = np.linalg.svd(t.r)
    return t.rows(u @ vt), (vt.T * s) @ vt


def pinverse(rows: DataFrame, width: int, rcond: float | None = None) -> DataFrame:
    """(i, vec): the columns of the pseudo-inverse, one for each row of the matrix."""
    t = tsqr(rows, width)
    u, s, vt = np.linalg.svd(t.r)
    least = (width * np.finfo(float).eps if rcond is None else rcond) * s[0]
    return t.rows((u * np.where(s > least, 1 / np.where(s > least, s, 1), 0)) @ vt)


def lstsq(rows: DataFrame, width: int) -> np.ndarray:
    """x of least squares; the last of the width columns is the right-hand side."""
    r = tsqr(rows, width).r
    return np.linalg.lstsq(r[:-1, :-1], r[:-1, -1], rcond=None)[0]
