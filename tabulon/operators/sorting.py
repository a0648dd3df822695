"""Sorting, top-k and set-like operators. NaN sorts greatest; ties keep the order of the index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulon.plans.scratch import Scratch
from tabulon.plans.tensor import ShapeError, Tensor


def _ranked(t: Tensor, d: int, descending: bool) -> tuple[DataFrame, int]:
    """Adds r, the place of each element in its sorted slice along d."""
    d = t.dim(d)
    kept = [f"i{k}" for k in range(t.rank) if k != d]
    order = [F.desc("v") if descending else F.asc("v"), F.asc(f"i{d}")]
    if kept:
        return t.df.withColumn("r", F.row_number().over(W.partitionBy(*kept).orderBy(*order)) - 1), d
    return ranked(t.df, order, "r"), d


def ranked(df: DataFrame, order: list, name: str = "place") -> DataFrame:
    """df with the place of each row in the order, from 0. The rows are written in sorted partitions; a row's place is its place in its partition and the
    sizes of the partitions before. order must leave no ties, or rows that tie get their places as they were written."""
    scratch = Scratch(df.sparkSession)
    rows = scratch.save(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()), "sorted").withColumn("_p", F.shiftright("_m", 33))
    # a row a partition
    sizes = rows.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_o", F.coalesce(F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return rows.join(F.broadcast(sizes.select("_p", "_o")), "_p").withColumn(name, F.col("_o") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m", "_p", "_o")


def sort_with_indices(t: Tensor, d: int = -1, descending: bool = False) -> DataFrame:
    """Index columns of the result, v and source (the index along d that v came from)."""
    rows, d = _ranked(t, d, descending)
    return rows.select(*(F.col("r").cast("long").alias(f"i{k}") if k == d else F.col(f"i{k}") for k in range(t.rank)), "v", F.col(f"i{d}").alias("source"))


def sort(t: Tensor, d: int = -1, descending: bool = False) -> Tensor:
    return Tensor(sort_with_indices(t, d, descending).drop("source"), t.shape)


def argsort(t: Tensor, d: int = -1, descending: bool = False) -> Tensor:
    return Tensor(sort_with_indices(t, d, descending).drop("v").withColumnRenamed("source", "v"), t.shape)


def topk(t: Tensor, k: int, d: int = -1, largest: bool = True, ordered: bool = True) -> DataFrame:
    """The k largest (or least) of each slice: index columns, v, source; not ordered: by source."""
    d = t.dim(d)
    if k > t.shape[d]:
        raise ShapeError("k is larger than the dimension")
    kept = [f"i{j}" for j in range(t.rank) if j != d]
    if not kept:
        best = t.df.orderBy(F.desc("v") if largest else F.asc("v"), F.asc(f"i{d}")).limit(k)
        t = Tensor(best, t.shape)
    order = [F.desc("v") if largest else F.asc("v"), F.asc(f"i{d}")]
    part = W.partitionBy(*kept or [F.lit(0)])
    rows = t.df.withColumn("r", F.row_number().over(part.orderBy(*order)) - 1).where(F.col("r") < k)
    if not ordered:
        rows = rows.withColumn("r", F.row_number().over(part.orderBy(f"i{d}")) - 1)
    return rows.select(*(F.col("r").cast("long").alias(f"i{j}") if j == d else F.col(f"i{j}") for j in range(t.rank)), "v", F.col(f"i{d}").alias("source"))


def unique(df: DataFrame, column: str = "v") -> DataFrame:
    """Distinct values in order; NaNs count as one."""
    return df.select(F.col(column).alias("v")).distinct().orderBy("v")


def unique_with_counts(t: Tensor) -> tuple[DataFrame, DataFrame]:
    """(place, v, n) of the distinct values, and (index columns, inverse) of the elements."""
    values = ranked(t.df.groupBy("v").agg(F.count("*").alias("n")), ["v"])
    return values.select("place", "v", "n"), t.df.join(values.select("v", "place"), "v").select(*t.index, F.col("place").alias("inverse"))


def nonzero(t: Tensor) -> DataFrame:
    """Index columns of the elements that are not zero, in row-major order."""
    return t.df.where("v <> 0").select(*t.index).orderBy(*t.index)


def searchsorted(sequence: Tensor, values: Tensor, right: bool = False) -> Tensor:
    """How many of the sorted sequence are below each value (right: not above).

    Sequence and values are sorted together: a running count over range partitions, so no value meets the sequence in a join.
    """
    rank = 0 if right else 1
    both = sequence.df.select(F.col("v"), F.lit(rank).alias("side"), F.lit(1).alias("one"), F.lit(None).cast("long").alias("i0"))
    both = both.unionByName(values.df.select("v", F.lit(1 - rank).alias("side"), F.lit(0).alias("one"), "i0"))
    rows = both.orderBy("v", "side").withColumn("m", F.monotonically_increasing_id()).withColumn("p", F.shiftright("m", 33)).persist()
    totals = rows.groupBy("p").agg(F.sum("one").alias("n")).withColumn("o", F.coalesce(F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    within = W.partitionBy("p").orderBy("m").rowsBetween(W.unboundedPreceding, 0)
    counted = rows.withColumn("c", F.sum("one").over(within)).where("one = 0").join(F.broadcast(totals.select("p", "o")), "p")
    return Tensor(counted.select("i0", (F.col("c") + F.col("o")).cast("double").alias("v")), values.shape)
