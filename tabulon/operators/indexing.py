"""Gather, scatter and masks: lookup joins and filters. Which out-of-bounds indices count as zero, are skipped or raise is stated at each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.plans.tensor import ShapeError, Tensor, names

REDUCE = {"sum": (F.sum, 0.0), "mean": (F.avg, 0.0), "max": (F.max, float("-inf")), "min": (F.min, float("inf")), "prod": (F.product, 1.0)}


def _as(t: Tensor, prefix: str, value: str) -> DataFrame:
    return t.df.select(*(F.col(c).alias(f"{prefix}{k}") for k, c in enumerate(t.index)), F.col("v").alias(value))


def gather(t: Tensor, d: int, index: Tensor) -> Tensor:
    """t at the indices along d, other coordinates as in index; out of bounds: 0."""
    d = t.dim(d)
    at = _as(index, "x", "at").withColumn("at", F.col("at").cast("long"))
    on = [F.col("at" if k == d else f"x{k}") == F.col(f"i{k}") for k in range(t.rank)]
    out = at.join(t.df, on, "left").select(*(F.col(f"x{k}").alias(f"i{k}") for k in range(t.rank)), F.coalesce("v", F.lit(0.0)).alias("v"))
    return Tensor(out, index.shape)


def _targets(index: Tensor, src: Tensor, d: int) -> DataFrame:
    """Target coordinates, place in row-major order and value of every source element."""
    pair = index.df.select(*index.index, F.col("v").cast("long").alias("at")).join(src.df, index.index)
    return pair.select(*(F.col("at").alias("i%d" % k) if k == d else F.col(f"i{k}") for k in range(src.rank)), src.flat().alias("place"), "v")


def scatter(t: Tensor, d: int, index: Tensor, src: Tensor) -> Tensor:
    """src written to t at the indices along d; the last in row-major order wins; out of bounds: skipped."""
    d = t.dim(d)
    last = _targets(index, src, d).groupBy(*t.index).agg(F.max_by("v", "place").alias("new"))
    return Tensor(t.df.join(last, t.index, "left").select(*t.index, F.coalesce("new", "v").alias("v")), t.shape)


def scatter_reduce(t: Tensor, d: int, index: Tensor, src: Tensor, op: str = "sum", include_self: bool = True) -> Tensor:
    """src reduced into t; without include_self, untouched cells become the operation's identity. Out of bounds: skipped."""
    d = t.dim(d)
    reduce, identity = REDUCE[op]
    new = _targets(index, src, d).select(*t.index, "v")
    if include_self:
        inside = new.join(t.df.select(*t.index), t.index, "left_semi")
        return Tensor(t.df.select(*t.index, "v").unionByName(inside).groupBy(*t.index).agg(reduce("v").alias("v")), t.shape)
    made = new.groupBy(*t.index).agg(reduce("v").alias("new"))
    return Tensor(t.df.join(made, t.index, "left").select(*t.index, F.coalesce("new", F.lit(identity)).alias("v")), t.shape)


def _checked(hit, value, what: str):
    return F.when(hit.isNull(), F.raise_error(F.lit(f"{what}: index out of bounds"))).otherwise(value)


def index_select(t: Tensor, d: int, index: Tensor) -> Tensor:
    """Slices of t along d in the order of index; out of bounds: an error."""
    d, n = t.dim(d), t.shape[t.dim(d)]
    at = _as(index, "x", "at").select(F.col("x0"), F.when(F.col("at").between(0, n - 1), F.col("at").cast("long")).otherwise(F.raise_error(F.lit("index_select: index out of bounds")).cast("long")).alias("at"))
    out = t.df.join(at, F.col(f"i{d}") == F.col("at"))
    return Tensor(out, t.shape)._moved(d, F.col("x0"), index.shape[0])


def index_put(t: Tensor, d: int, index: Tensor, src: Tensor) -> Tensor:
    """src's slices written to t at the indices along d; the last wins; out of bounds: an error."""
    d, n = t.dim(d), t.shape[t.dim(d)]
    at = _as(index, "x", "at").select(F.when(F.col("at").between(0, n - 1), F.col("at").cast("long")).otherwise(F.raise_error(F.lit("index_put: index out of bounds")).cast("long")).alias("at"), "x0")
    last = at.groupBy("at").agg(F.max("x0").alias("x0"))
    moved = src.df.join(last, F.col(f"i{d}") == F.col("x0")).select(*(F.col("at").alias(c) if k == d else F.col(c) for k, c in enumerate(src.index)), F.col("v").alias("new"))
    return Tensor(t.df.join(moved, t.index, "left").select(*t.index, F.coalesce("new", "v").alias("v")), t.shape)


def take(t: Tensor, index: Tensor) -> Tensor: return index_select(t.flatten(), 0, index)
def put(t: Tensor, index: Tensor, values: Tensor) -> Tensor: return index_put(t.flatten(), 0, index, values).reshape(t.shape)


def masked_select(t: Tensor, mask: Tensor) -> DataFrame:
    """(place, v) of the elements whose mask is not zero; place is the row-major index in t."""
    pair = t.zip(mask, lambda v, m: F.struct(v.alias("v"), m.alias("m")))
    return pair.df.where("v.m <> 0").select(pair.flat().alias("place"), F.col("v.v").alias("v"))


def masked_fill(t: Tensor, mask: Tensor, value: float) -> Tensor:
    return t.zip(mask, lambda v, m: F.when(m != 0, F.lit(float(value))).otherwise(v))


def embedding_lookup(table: Tensor, index: Tensor) -> Tensor:
    """Rows of table for each index; out of bounds: zeros."""
    width = table.shape[1]
    rows = table.df.groupBy("i0").agg(F.sort_array(F.collect_list(F.struct("i1", "v"))).alias("row"))
    at = _as(index, "x", "at")
    out = at.join(rows, F.col("at").cast("long") == F.col("i0"), "left").select(*(F.col(f"x{k}") for k in range(index.rank)), F.posexplode(F.coalesce(F.transform("row", lambda r: r["v"]), F.array_repeat(F.lit(0.0), width))).alias("j", "v"))
    return Tensor(out.select(*(F.col(f"x{k}").alias(f"i{k}") for k in range(index.rank)), F.col("j").cast("long").alias(f"i{index.rank}"), "v"), (*index.shape, width))


def gather_nd(t: Tensor, index: Tensor) -> Tensor:
    """t at whole coordinates (index: n x m, m <= rank); out of bounds: 0."""
    n, m = index.shape
    at = index.df.groupBy("i0").pivot("i1", list(range(m))).agg(F.first("v")).select(F.col("i0").alias("x"), *(F.col(str(k)).cast("long").alias(f"x{k}") for k in range(m)))
    rest = t.shape[m:]
    if rest:
        grid = Tensor.zeros(t.df.sparkSession, rest).df.select(*(F.col(f"i{k}").alias(f"x{m + k}") for k in range(len(rest))))
        at = at.crossJoin(F.broadcast(grid))
    out = at.join(t.df, [F.col(f"x{k}") == F.col(f"i{k}") for k in range(t.rank)], "left")
    index_columns = [F.col("x").alias("i0"), *(F.col(f"x{m + k}").alias(f"i{k + 1}") for k in range(len(rest)))]
    return Tensor(out.select(*index_columns, F.coalesce("v", F.lit(0.0)).alias("v")), (n, *rest))


def gather_2d(t: Tensor, rows: Tensor, cols: Tensor) -> Tensor:
    """t at (row, column) pairs; out of bounds: an error."""
    at = _as(rows, "x", "r").join(_as(cols, "x", "c"), "x0")
    out = at.join(t.df, (F.col("r").cast("long") == F.col("i0")) & (F.col("c").cast("long") == F.col("i1")), "left")
    return Tensor(out.select(F.col("x0").alias("i0"), _checked(F.col("i1"), F.col("v"), "gather_2d").alias("v")), rows.shape)


def bincount(values: DataFrame, column: str, weight: str | None = None, minlength: int = 0) -> Tensor:
    """Count (or sum of weights) of each whole number from 0; negative numbers: an error."""
    spark = values.sparkSession
    safe = F.when(F.col(column) < 0, F.raise_error(F.lit("bincount: negative value")).cast("long")).otherwise(F.col(column).cast("long"))
    counts = values.groupBy(safe.alias("i0")).agg((F.sum(weight) if weight else F.count("*")).cast("double").alias("v"))
    top = counts.agg(F.max("i0")).first()[0]
    n = max(minlength, (top if top is not None else -1) + 1)
    return Tensor(counts, (n,)).dense()


def slice_assign(t: Tensor, src: Tensor, d: int, start: int) -> Tensor:
    d = t.dim(d)
    if start < 0 or start + src.shape[d] > t.shape[d]:
        raise ShapeError("slice out of bounds")
    outside = t.df.where(~F.col(f"i{d}").between(start, start + src.shape[d] - 1))
    moved = src._moved(d, F.col(f"i{d}") + start, t.shape[d])
    return Tensor(outside.select(*names(t.rank), "v").unionByName(moved.df), t.shape)
