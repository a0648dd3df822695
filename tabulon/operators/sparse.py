"""Sparse matrices: (row, col, v) tables. Compressed forms are grouped arrays; every operator works on the coordinate form."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulon.functions import elementwise as E
from tabulon.operators import sparse_product
from tabulon.operators.contraction import semiring_matmul
from tabulon.plans.tensor import ShapeError, Tensor

#: Results of smaller magnitude are left out.
ZERO = 1e-15


@dataclass(frozen=True)
class Sparse:
    df: DataFrame
    shape: tuple[int, int]

    @staticmethod
    def from_dense(t: Tensor, threshold: float = 0.0) -> Sparse:
        """Cells of magnitude over the threshold."""
        return Sparse(t.df.where(F.abs("v") > threshold).select(F.col("i0").alias("row"), F.col("i1").alias("col"), "v"), t.shape)

    @staticmethod
    def summed(df: DataFrame, shape) -> Sparse:
        """Coordinates that repeat are added."""
        return Sparse(df.groupBy("row", "col").agg(F.sum("v").alias("v")), shape)

    def tensor(self) -> Tensor: return Tensor(self.df.select(F.col("row").alias("i0"), F.col("col").alias("i1"), "v"), self.shape)
    def to_dense(self) -> Tensor: return self.tensor().dense(0.0)
    def transpose(self) -> Sparse: return Sparse(self.df.select(F.col("col").alias("row"), F.col("row").alias("col"), "v"), self.shape[::-1])
    def nnz(self) -> int: return self.df.count()
    def density(self) -> float: return self.nnz() / (self.shape[0] * self.shape[1])
    def sparsity(self) -> float: return 1 - self.density()

    def _same(self, other: Sparse) -> None:
        if self.shape != other.shape:
            raise ShapeError(f"{self.shape} and {other.shape}")

    def add(self, other: Sparse, sign: float = 1.0) -> Sparse:
        """Union of the patterns; results near zero are left out."""
        self._same(other)
        both = self.df.unionByName(other.df.select("row", "col", (F.col("v") * sign).alias("v")))
        return Sparse(both.groupBy("row", "col").agg(F.sum("v").alias("v")).where(F.abs("v") >= ZERO), self.shape)

    def sub(self, other: Sparse) -> Sparse: return self.add(other, -1.0)

    def _meet(self, other: Sparse, f) -> Sparse:
        self._same(other)
        joined = self.df.join(other.df.withColumnRenamed("v", "w"), ["row", "col"])
        return Sparse(joined.select("row", "col", f(F.col("v"), F.col("w")).alias("v")).where(F.abs("v") >= ZERO), self.shape)

    def mul(self, other: Sparse) -> Sparse: return self._meet(other, lambda a, b: a * b)
    def div(self, other: Sparse) -> Sparse: return self._meet(other, E.ieee_div)

    def matmul(self, other: Sparse) -> Sparse:
        """Sparse product over a grid of blocks; the matrices are read several times, so save a costly one first."""
        if self.shape[1] != other.shape[0]:
            raise ShapeError(f"{self.shape} by {other.shape}")
        return Sparse(sparse_product.multiply(self.df, other.df), (self.shape[0], other.shape[1]))

    def spmv(self, x: Tensor) -> Tensor:
        """Matrix by vector; every row is in the result."""
        if x.shape != (self.shape[1],):
            raise ShapeError(f"{self.shape} by {x.shape}")
        part = self.df.join(x.df.select(F.col("i0").alias("col"), F.col("v").alias("x")), "col").groupBy(F.col("row").alias("i0")).agg(F.sum(F.col("v") * F.col("x")).alias("v"))
        return Tensor(part, (self.shape[0],)).dense(0.0)

    def spmm(self, b: Tensor) -> Tensor: return semiring_matmul(self.tensor(), b).dense(0.0)
    def scale(self, s: float) -> Sparse: return Sparse(self.df.withColumn("v", F.col("v") * float(s)), self.shape)

    def add_scalar(self, s: float) -> Sparse:
        raise ShapeError("adding a number to every cell makes a sparse matrix dense; use scalar_add for the stored ones")

    def scalar_add(self, s: float) -> Sparse: return Sparse(self.df.withColumn("v", F.col("v") + float(s)), self.shape)
    add_to_nonzeros = scalar_add

    def sum(self) -> DataFrame: return self.df.agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("v"))

    def _per(self, key: str, agg: Column, n: int) -> Tensor:
        return Tensor(self.df.groupBy(F.col(key).alias("i0")).agg(agg.cast("double").alias("v")), (n,)).dense(0.0)

    def sum_rows(self) -> Tensor: return self._per("row", F.sum("v"), self.shape[0])
    def sum_cols(self) -> Tensor: return self._per("col", F.sum("v"), self.shape[1])
    def nnz_per_row(self) -> Tensor: return self._per("row", F.count("*"), self.shape[0])
    def nnz_per_col(self) -> Tensor: return self._per("col", F.count("*"), self.shape[1])
    row_nnz = nnz_per_row

    def diagonal(self) -> Tensor: return Tensor(self.df.where("row = col").select(F.col("row").alias("i0"), "v"), (min(self.shape),)).dense(0.0)
    def has_full_diagonal(self) -> bool: return self.df.where("row = col").count() == min(self.shape)

    def norms(self, key: str, kind: str = "l2") -> Tensor:
        agg = {"l1": F.sum(F.abs("v")), "l2": F.sqrt(F.sum(F.col("v") * F.col("v"))), "linf": F.max(F.abs("v"))}[kind]
        return self._per(key, agg, self.shape[0 if key == "row" else 1])

    def row_norms(self, kind="l2") -> Tensor: return self.norms("row", kind)
    def col_norms(self, kind="l2") -> Tensor: return self.norms("col", kind)

    def _scaled(self, key: str, scales: Tensor) -> Sparse:
        s = scales.df.select(F.col("i0").alias(key), F.col("v").alias("s"))
        return Sparse(self.df.join(s, key).select("row", "col", (F.col("v") * F.col("s")).alias("v")), self.shape)

    def scale_rows(self, scales: Tensor) -> Sparse: return self._scaled("row", scales)
    def scale_cols(self, scales: Tensor) -> Sparse: return self._scaled("col", scales)

    def equilibrate(self) -> tuple[Sparse, Tensor, Tensor]:
        """Scaled so that rows and then columns have a largest magnitude of 1; with the scales. Empty rows and columns scale by 1."""
        inverse = lambda v: F.when(v > 0, F.try_divide(F.lit(1.0), v)).otherwise(1.0)
        rows = self.row_norms("linf").map(inverse)
        part = self.scale_rows(rows)
        cols = part.col_norms("linf").map(inverse)
        return part.scale_cols(cols), rows, cols

    def update_values(self, f) -> Sparse: return Sparse(self.df.withColumn("v", f(F.col("v"))), self.shape)

    # compressed forms

    def to_csr(self) -> DataFrame:
        """row, start (its place among the stored values), cols and vals, by column."""
        return self._compressed("row", "col", self.shape[0])

    def to_csc(self) -> DataFrame: return self._compressed("col", "row", self.shape[1])

    def _compressed(self, major: str, minor: str, n: int) -> DataFrame:
        lists = self.df.groupBy(major).agg(F.sort_array(F.collect_list(F.struct(minor, "v"))).alias("l"))
        rows = self.df.sparkSession.range(n).withColumnRenamed("id", major).join(lists, major, "left")
        rows = rows.select(major, F.coalesce(F.transform("l", lambda e: e[minor]), F.array().cast("array<bigint>")).alias(minor + "s"), F.coalesce(F.transform("l", lambda e: e["v"]), F.array().cast("array<double>")).alias("vals"))
        return rows.withColumn("start", F.coalesce(F.sum(F.size("vals")).over(W.partitionBy(F.lit(0)).orderBy(major).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))

    @staticmethod
    def from_csr(df: DataFrame, shape) -> Sparse:
        return Sparse(df.select("row", F.explode(F.arrays_zip("cols", "vals")).alias("e")).select("row", F.col("e.cols").alias("col"), F.col("e.vals").alias("v")), shape)

    @staticmethod
    def from_csc(df: DataFrame, shape) -> Sparse:
        return Sparse(df.select("col", F.explode(F.arrays_zip("rows", "vals")).alias("e")).select(F.col("e.rows").alias("row"), "col", F.col("e.vals").alias("v")), shape)


def dsmm(a: Tensor, b: Sparse) -> Tensor:
    """Dense by sparse."""
    return semiring_matmul(a, b.tensor()).dense(0.0)


column_parallel_dsmm = dsmm


def csr_to_csc(df: DataFrame, shape) -> DataFrame: return Sparse.from_csr(df, shape).to_csc()
def csc_to_csr(df: DataFrame, shape) -> DataFrame: return Sparse.from_csc(df, shape).to_csr()
