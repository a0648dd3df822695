"""Pairwise distances of row vectors. Vectors travel in packed blocks; pairs of blocks are dealt to tasks and compared there, component by component or by one
product. METRICS are the same distances as column expressions on two arrays: pair by pair, they are what the blocks are tested against."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.plans.scratch import Scratch
from tabulon.plans.tensor import ShapeError

#: Rows of a block, numbers of a tile that is compared at a time, and pairs of blocks that a task takes (about).
ROWS, TILE, EACH = 256, 16_384, 64
#: Tables of blocks of at most so many bytes are broadcast, larger ones are joined by a shuffle.
BROADCAST_BYTES = 64 << 20
#: Instead of its length: an array that is null, one with a null component.
NONE, HOLE = -2, -1


def _z(x: Column, y: Column, f) -> Column:
    return F.aggregate(F.zip_with(x, y, f), F.lit(0.0), lambda a, e: a + e)


def squared_euclidean(x, y): return _z(x, y, lambda a, b: (a - b) * (a - b))
def euclidean(x, y): return F.sqrt(squared_euclidean(x, y))
def manhattan(x, y): return _z(x, y, lambda a, b: F.abs(a - b))
def chebyshev(x, y): return F.aggregate(F.zip_with(x, y, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, e: F.when(~F.isnan(e) & (e > a), e).otherwise(a))
def minkowski(p: float): return lambda x, y: F.pow(_z(x, y, lambda a, b: F.pow(F.abs(a - b), F.lit(float(p)))), F.lit(1.0 / p))


def cosine(x, y):
    """0 if a vector is zero."""
    norm = F.sqrt(_z(x, x, lambda a, b: a * b) * _z(y, y, lambda a, b: a * b))
    return F.when(norm == 0, 0.0).otherwise(1 - F.try_divide(_z(x, y, lambda a, b: a * b), norm))


def correlation(x, y):
    """Cosine distance of the centred vectors; 0 if one has no spread."""
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, b: a + b) / F.size(c)
    # bound to a lambda's variable, the mean is computed once and not for each component
    centred = lambda c: F.get(F.transform(F.array(mean(c)), lambda m: F.transform(c, lambda e: e - m)), F.lit(0))
    return cosine(centred(x), centred(y))


def hamming(x, y): return _z(x, y, lambda a, b: (a != b).cast("double")) / F.size(x)


def jaccard(x, y):
    """1 less the share of places where both are not zero in those where one is; 0 if none is."""
    some = _z(x, y, lambda a, b: ((a != 0) | (b != 0)).cast("double"))
    return F.when(some == 0, 0.0).otherwise(1 - F.try_divide(_z(x, y, lambda a, b: ((a != 0) & (b != 0)).cast("double")), some))


METRICS = {"euclidean": euclidean, "sqeuclidean": squared_euclidean, "manhattan": manhattan, "chebyshev": chebyshev, "cosine": cosine, "correlation": correlation, "hamming": hamming, "jaccard": jaccard}


# the same by blocks: x (n rows) and y (m rows) of one width, missing components NaN; the result is n x m

def _by_component(x: np.ndarray, y: np.ndarray, step) -> np.ndarray:
    """The sum over components, in their order, of what step makes of their differences in place."""
    out, columns = np.zeros((len(x), len(y))), np.ascontiguousarray(y.T)
    high = max(1, TILE // max(len(y), 1))
    d = np.empty((high, len(y)))
    for at in range(0, len(x), high):
        total = out[at : at + high]
        part = d[: len(total)]
        for k, column in enumerate(columns):
            np.subtract(x[at : at + high, k, None], column, out=part)
            step(part, total)
    return out


def _add(d: np.ndarray, total: np.ndarray) -> None: total += d


def _squares(x, y): return _by_component(x, y, lambda d, total: _add(np.multiply(d, d, out=d), total))


def _cosines(x, y):
    xx, yy = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
    norm = np.sqrt(np.outer(xx, yy))
    return np.where(norm == 0, 0.0, 1 - (x @ y.T) / np.where(norm == 0, 1.0, norm))


def _centred(x):
    """Rows less their mean; one without spread is zero."""
    flat = (x == x[:, :1]).all(axis=1) if x.shape[1] else np.ones(len(x), bool)
    return np.where(flat[:, None], 0.0, x - (x.sum(axis=1, keepdims=True) / max(x.shape[1], 1)))


def _jaccards(x, y):
    """Counts are whole, so one product of zeros and ones has them exactly."""
    x, y = ((m != 0).astype(float) for m in (x, y))
    both = x @ y.T
    some = x.sum(axis=1)[:, None] + y.sum(axis=1) - both
    return np.where(some == 0, 0.0, 1 - both / np.where(some == 0, 1.0, some))


def _minkowskis(p: float):
    """Small whole powers by multiplication."""
    def step(d, total):
        np.abs(d, out=d)
        if p in (1, 2, 3, 4):
            size = d.copy() if p > 2 else d
            for _ in range(int(p) - 1):
                np.multiply(d, size, out=d)
        else:
            np.power(d, p, out=d)
        _add(d, total)

    return lambda x, y: np.power(_by_component(x, y, step), 1 / p)


def _hammings(x, y):
    """By the bits of the numbers, as NaN is NaN and -0 is 0."""
    x, y = (np.ascontiguousarray(np.where(np.isnan(m), np.nan, m + 0.0)).view(np.int64) for m in (x, y))
    out, columns = np.zeros((len(x), len(y)), np.int32), np.ascontiguousarray(y.T)
    high = max(1, TILE // max(len(y), 1))
    for at in range(0, len(x), high):
        for k, column in enumerate(columns):
            out[at : at + high] += x[at : at + high, k, None] != column
    return out / x.shape[1] if x.shape[1] else np.full(out.shape, np.nan)


KERNELS = {
    "euclidean": lambda x, y: np.sqrt(_squares(x, y)), "sqeuclidean": _squares, "correlation": lambda x, y: _cosines(_centred(x), _centred(y)), "hamming": _hammings, "manhattan": lambda x, y: _by_component(x, y, lambda d, total: _add(np.abs(d, out=d), total)), "chebyshev": lambda x, y: _by_component(x, y, lambda d, total: np.fmax(np.abs(d, out=d), total, out=total)), "jaccard": _jaccards, "cosine": _cosines,
}


def _kernel(metric: str, p: float | None):
    return _minkowskis(float(p)) if metric == "minkowski" else KERNELS.get(metric)


def _pack(batches):
    """Blocks of rows (i, vec): number, ids, lengths (or NONE, HOLE), width and values, rows padded with NaN."""
    number = TaskContext.get().partitionId() << 32
    names = ["b", "ids", "lengths", "width", "m"]
    for batch in batches:
        ids, vec = batch.column(0), batch.column(1)
        for at in range(0, len(ids), ROWS):
            own = vec.slice(at, ROWS)
            size = pc.fill_null(pc.list_value_length(own), 0).to_numpy().astype(np.int64)
            values = own.flatten()
            width, row = int(size.max(initial=0)), np.repeat(np.arange(len(own)), size)
            m = np.full((len(own), width), np.nan)
            m[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = values.to_numpy(zero_copy_only=False)
            if values.null_count:
                size[row[values.is_null().to_numpy(zero_copy_only=False)]] = HOLE
            size[own.is_null().to_numpy(zero_copy_only=False)] = NONE
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([ids.slice(at, ROWS).to_pylist()], pa.list_(pa.int64())), pa.array([size.tolist()], pa.list_(pa.int64())), pa.array([width], pa.int32()), pa.array([m.tobytes()], pa.binary())], names)
            number += 1


def _widened(m, n: int, width: int, to: int) -> np.ndarray:
    x = np.frombuffer(m.as_buffer()).reshape(n, width)
    return x if width == to else np.hstack([x, np.full((n, to - width), np.nan)])


def _compared(f, metric: str, one: tuple, other: tuple) -> np.ma.MaskedArray:
    """All distances of two blocks; null where a vector is, has a null component or the lengths differ (unless one has no direction)."""
    (la, wa, ma), (lb, wb, mb) = one, other
    width = max(wa, wb)
    x, y = _widened(ma, len(la), wa, width), _widened(mb, len(lb), wb, width)
    with np.errstate(all="ignore"):
        v = f(x, y)
    if (la == width).all() and (lb == width).all():
        return np.ma.MaskedArray(v)
    if metric in ("cosine", "correlation"):
        beyond = [np.arange(width) >= n[:, None] for n in (la, lb)]
        zero, finite = ([(own | past).all(axis=1) for own, past in zip(all_of, beyond, strict=True)] for all_of in ([m == (0 if metric == "cosine" else m[:, :1]) for m in (x, y)], [np.isfinite(m) for m in (x, y)]))
        still = (zero[0][:, None] | zero[1]) & finite[0][:, None] & finite[1]
        v = np.where(still, 0.0, v)
    else:
        still = np.zeros(v.shape, bool)
    la, lb = la[:, None], lb[None, :]
    return np.ma.MaskedArray(v, ((la == NONE) | (lb == NONE)) if metric == "chebyshev" else ((la < 0) | (lb < 0) | ((la != lb) & ~still)))


def _pairs(x: DataFrame, y: DataFrame | None, metric: str, p: float | None) -> DataFrame:
    """(i0, i1, v) of all rows of x with all of y, or, without y, of each two rows of x once, the lower id first (equal ids and null are no pair)."""
    f, scratch, itself = _kernel(metric, p), Scratch(x.sparkSession), y is None
    tables = [scratch.save(t.select(F.col("i").cast("long").alias("i"), F.col("vec").cast("array<double>").alias("vec")).mapInArrow(_pack, "b long, ids array<long>, lengths array<long>, width int, m binary"), "blocks") for t in ((x,) if itself else (x, y))]
    sizes = [t.agg(F.count("*"), F.coalesce(F.sum(F.length("m")), F.lit(0))).first() for t in tables]
    left, right = tables[0], tables[-1].toDF(*(f"{c}2" for c in tables[-1].columns))
    met = left.select("b").crossJoin(F.broadcast(right.select("b2")))
    n = sizes[0][0] * sizes[-1][0]
    if itself:
        met, n = met.where("b <= b2"), (n + sizes[0][0]) // 2
    tasks = max(int(x.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // EACH))
    met = met.repartition(max(1, min(n, tasks)))
    for t, key, size in ((right, "b2", sizes[-1]), (left, "b", sizes[0])):
        met = met.join(F.broadcast(t) if size[1] <= BROADCAST_BYTES else t, key)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = [batch.column(c)[k] for c in range(batch.num_columns)]
                ia, ib = row[2].values, row[6].values
                v = _compared(f, metric, *((np.array(row[c].as_py(), np.int64), row[c + 1].as_py(), row[c + 2]) for c in (3, 7)))
                if itself:
                    at = np.triu_indices(len(ia), 1) if row[0].as_py() == row[1].as_py() else np.indices(v.shape).reshape(2, -1)
                    a, b, v = ia.take(pa.array(at[0])), ib.take(pa.array(at[1])), v[tuple(at)]
                    i0, i1 = pc.min_element_wise(a, b, skip_nulls=False), pc.max_element_wise(a, b, skip_nulls=False)
                else:
                    i0, i1 = (ids.take(pa.array(at)) for ids, at in ((ia, np.repeat(np.arange(len(ia)), len(ib))), (ib, np.tile(np.arange(len(ib)), len(ia)))))
                out = pa.RecordBatch.from_arrays([i0, i1, pa.array(v.data.ravel(), mask=None if v.mask is np.ma.nomask else v.mask.ravel())], ["i0", "i1", "v"])
                yield out.filter(pc.less(i0, i1)) if itself else out

    return met.select("b", "b2", "ids", "lengths", "width", "m", "ids2", "lengths2", "width2", "m2").mapInArrow(run, "i0 long, i1 long, v double")


def _metric(metric: str, p: float | None):
    return minkowski(p) if metric == "minkowski" else METRICS[metric]


def cdist(x: DataFrame, y: DataFrame, metric: str = "euclidean", p: float | None = None) -> DataFrame:
    """(i0, i1, v) for every row of x and every row of y; both: i (long) and vec (array of double). All pairs are what is asked for."""
    if _kernel(metric, p):
        return _pairs(x, y, metric, p)
    right = y.select(F.col("i").alias("i1"), F.col("vec").alias("w"))
    pairs = x.select(F.col("i").alias("i0"), "vec").crossJoin(right)
    return pairs.select("i0", "i1", _metric(metric, p)(F.col("vec"), F.col("w")).alias("v"))


def pdist(x: DataFrame, metric: str = "euclidean", p: float | None = None) -> DataFrame:
    """(i0, i1, v) of the pairs i0 < i1."""
    if _kernel(metric, p):
        return _pairs(x, None, metric, p)
    right = x.select(F.col("i").alias("i1"), F.col("vec").alias("w"))
    return x.select(F.col("i").alias("i0"), "vec").join(right, F.col("i0") < F.col("i1")).select("i0", "i1", _metric(metric, p)(F.col("vec"), F.col("w")).alias("v"))


def condensed(pairs: DataFrame, n: int) -> DataFrame:
    """pdist's rows numbered in condensed order: place and v."""
    return pairs.select((F.expr(f"{n} * i0 - i0 * (i0 + 1) div 2") + F.col("i1") - F.col("i0") - 1).alias("place"), "v")


def squareform(pairs: DataFrame, n: int) -> DataFrame:
    """The full symmetric matrix with a zero diagonal."""
    diagonal = pairs.sparkSession.range(n).select(F.col("id").alias("i0"), F.col("id").alias("i1"), F.lit(0.0).alias("v"))
    # both directions of a pair from one reading of the pairs
    return pairs.select(F.stack(F.lit(2), "i0", "i1", "v", "i1", "i0", "v").alias("i0", "i1", "v")).unionByName(diagonal)


def squareform_inverse(square: DataFrame) -> DataFrame: return square.where("i0 < i1")


def vectors(df: DataFrame, index: str, array: str, width: int | None = None) -> DataFrame:
    if width is not None and width < 1:
        raise ShapeError("vectors need a width")
    return df.select(F.col(index).cast("long").alias("i"), F.col(array).cast("array<double>").alias("vec"))
