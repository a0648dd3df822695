"""Factorizations of one large matrix whose cells lie near the diagonal, without blocks: the rows pass through one task in order, which holds a window as wide as
the band, and the factors leave it as cells. Work and memory are those of the band: rows times its width, not times the side of a block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns that a window eliminates, rows of a packed record, cells of an output batch, widest band, most right-hand sides.
STEP, ROWS, OUT, WIDEST, MOST = 64, 4096, 100_000, 2048, 64
LOW, UP, ORDER, SIDES, FAILED = range(5)
FIELDS = "kind int, i long, j long, v double"


def width(cells: DataFrame, n: int) -> tuple[int, int] | None:
    """How far cells (i0, i1, v) lie below and above the diagonal, if that is narrow beside n."""
    low, up = cells.where("v <> 0").agg(F.coalesce(F.max(F.col("i0") - F.col("i1")), F.lit(0)), F.coalesce(F.max(F.col("i1") - F.col("i0")), F.lit(0))).first()
    low, up = max(low, 0), max(up, 0)
    return (low, up) if low + up + 1 <= min(WIDEST, n // 8) else None


def _in_order(cells: DataFrame, descending: bool = False) -> DataFrame:
    """Cells (i, j, v) in one task, packed, sorted by i in records of ROWS."""
    def pack(key, table):
        table = table.sort_by("i")
        return pa.table({"part": [key[0].as_py()], **{c: pa.array([table.column(c).to_numpy().tobytes()], pa.binary()) for c in ("i", "j", "v")}})

    packed = cells.select("i", "j", "v").withColumn("part", F.expr(f"i div {ROWS}")).groupBy("part").applyInArrow(pack, "part long, i binary, j binary, v binary")
    return packed.repartition(1).sortWithinPartitions(F.desc("part") if descending else "part").select("i", "j", "v")


def _unpacked(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            yield [np.frombuffer(batch.column(c)[k].as_buffer(), t) for c, t in enumerate((np.int64, np.int64, np.float64))]


class _Rows:
    """Cells of the rows that have not been taken yet, in order."""

    def __init__(self, records):
        self.records, self.held = records, [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]

    def below(self, end: int) -> list[np.ndarray]:
        """Cells of all rows before end that are left."""
        while not len(self.held[0]) or self.held[0][-1] < end:
            more = next(self.records, None)
            if more is None:
                break
            self.held = [np.concatenate(x) for x in zip(self.held, more, strict=True)]
        at = int(np.searchsorted(self.held[0], end))
        out, self.held = [x[:at] for x in self.held], [x[at:] for x in self.held]
        return out


class _Out:
    """Cells by kind, given out some at a time."""

    def __init__(self):
        self.parts, self.n = [], 0

    def add(self, kind: int, i, j, v) -> None:
        self.parts.append((np.full(len(i), kind, np.int32), i, j, v))
        self.n += len(i)

    def batches(self, least: int):
        if self.n > least:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*self.parts, strict=True)], ["kind", "i", "j", "v"])
            self.parts, self.n = [], 0


def _kept(a: np.ndarray, diagonal: bool = False) -> tuple[np.ndarray, np.ndarray]:
    hit = a != 0
    if diagonal:
        np.fill_diagonal(hit, True)
    return np.nonzero(hit)


def lu(cells: DataFrame, sides: DataFrame | None, n: int, below: int, above: int, count: int) -> DataFrame:
    """kind, i, j, v of L (row where it was, column), of U (place, column), of the order (place, row) and of the eliminated right-hand sides (place, side).
    Pivots are the largest of their column. cells and sides: i0, i1, v."""
    rows = cells.select(F.col("i0").alias("i"), F.col("i1").alias("j"), "v")
    if sides is not None:
        rows = rows.unionByName(sides.select(F.col("i0").alias("i"), (F.col("i1") + n).alias("j"), "v"))
    far = below + above

    def run(batches):
        source, out = _Rows(_unpacked(batches)), _Out()
        wide, loaded = STEP + far, 0
        rest, ids = np.zeros((0, wide + count)), np.zeros(0, np.int64)
        for at in range(0, n, STEP):
            own = min(STEP, n - at)
            end = min(n, at + own + below)
            i, j, v = source.below(end)
            w = np.zeros((len(ids) + end - loaded, wide + count))
            w[: len(rest)] = rest
            w[i - loaded + len(ids), np.where(j < n, j - at, j - n + wide)] = v
            ids, loaded = np.r_[ids, np.arange(loaded, end)], end
            for k in range(own):
                last, right = k + below + 1, k + far + 1
                p = k + int(np.abs(w[k:last, k]).argmax())
                if w[p, k] == 0:
                    continue
                if p != k:
                    w[[k, p]], ids[[k, p]] = w[[p, k]], ids[[p, k]]
                f = w[k + 1 : last, k] / w[k, k]
                w[k + 1 : last, k] = f
                w[k + 1 : last, k + 1 : right] -= f[:, None] * w[k, k + 1 : right]
                if count:
                    w[k + 1 : last, wide:] -= f[:, None] * w[k, wide:]
            r, c = _kept(np.tril(w[:, :own], -1))
            out.add(LOW, ids[r], at + c, w[r, c])
            out.add(LOW, ids[:own], at + np.arange(own), np.ones(own))
            r, c = _kept(np.triu(w[:own, :wide]), True)
            out.add(UP, at + r, at + c, w[r, c])
            out.add(ORDER, at + np.arange(own), ids[:own], np.zeros(own))
            if count:
                r, c = np.indices((own, count)).reshape(2, -1)
                out.add(SIDES, at + r, c, w[r, wide + c])
            rest, ids = np.zeros((len(ids) - own, wide + count)), ids[own:]
            rest[:, :far], rest[:, wide:] = w[own:, own : own + far], w[own:, wide:]
            yield from out.batches(OUT)
        yield from out.batches(0)

    return _in_order(rows).mapInArrow(run, FIELDS)


def back(up: DataFrame, sides: DataFrame, n: int, far: int, count: int) -> DataFrame:
    """i0, i1, v of x of U x = the eliminated right-hand sides, from the last row to the first; a zero on the diagonal gives infinities."""
    rows = up.select("i", "j", "v").unionByName(sides.select("i", (F.col("j") + n).alias("j"), "v"))

    def run(batches):
        ahead = np.zeros((far, count))
        for i, j, v in _unpacked(batches):
            first = int(i[0]) // ROWS * ROWS
            rows = min(ROWS, n - first)
            for at in reversed(range(0, rows, STEP)):
                own = min(STEP, rows - at)
                a, b = np.searchsorted(i, [first + at, first + at + own])
                w = np.zeros((own, STEP + far + count))
                w[i[a:b] - first - at, np.where(j[a:b] < n, j[a:b] - first - at, j[a:b] - n + STEP + far)] = v[a:b]
                x = w[:, STEP + far :] - w[:, own : own + far] @ ahead
                with np.errstate(divide="ignore", invalid="ignore"):
                    for k in reversed(range(own)):
                        x[k] = (x[k] - w[k, k + 1 : own] @ x[k + 1 :]) / w[k, k]
                ahead = np.vstack([x, ahead])[:far]
                r, c = np.indices((own, count)).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(first + at + r), pa.array(c), pa.array(x.ravel())], ["i0", "i1", "v"])

    return _in_order(rows, True).mapInArrow(run, "i0 long, i1 long, v double")


def cholesky(cells: DataFrame, n: int, below: int) -> DataFrame:
    """kind, i, j, v of L; a cell of the kind FAILED if the matrix isn't positive definite. cells: i0, i1, v of the lower triangle."""
    def run(batches):
        source, out = _Rows(_unpacked(batches)), _Out()
        rest = np.zeros((0, 0))
        for at in range(0, n, STEP):
            own = min(STEP, n - at)
            end = min(n, at + own + below)
            i, j, v = source.below(end)
            w = np.zeros((end - at, end - at))
            w[: len(rest), : len(rest)] = rest
            w[i - at, j - at] = v
            try:
                low = np.linalg.cholesky(w[:own, :own])
            except np.linalg.LinAlgError:
                low = np.zeros((own, own))
            if not (np.diag(low) > 0).all():
                out.add(FAILED, np.array([at]), np.array([at]), np.zeros(1))
                break
            under = np.linalg.solve(low, np.tril(w)[own:, :own].T).T
            rest = w[own:, own:] - under @ under.T
            r, c = _kept(np.vstack([low, under]))
            out.add(LOW, at + r, at + c, np.vstack([low, under])[r, c])
            yield from out.batches(OUT)
        yield from out.batches(0)

    return _in_order(cells.select(F.col("i0").alias("i"), F.col("i1").alias("j"), "v")).mapInArrow(run, FIELDS)
