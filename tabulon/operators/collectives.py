"""Collective operations over arrays that hold one part per rank (rank, i0, ..., v)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPS = {"sum": F.sum, "prod": F.product, "min": F.min, "max": F.max}


def _index(parts: DataFrame) -> list[str]: return [c for c in parts.columns if c not in ("rank", "v")]


def reduce(parts: DataFrame, op: str = "sum") -> DataFrame: return parts.groupBy(*_index(parts)).agg(OPS[op]("v").alias("v"))


def all_reduce(parts: DataFrame, op: str = "sum") -> DataFrame:
    """Every rank's cell becomes the cell's total."""
    return parts.drop("v").join(reduce(parts, op), _index(parts))


def all_gather(parts: DataFrame) -> DataFrame:
    """Every rank's part on every rank; `part` names where it came from."""
    return parts.select("rank").distinct().crossJoin(parts.withColumnRenamed("rank", "part"))


def broadcast(parts: DataFrame, root: int) -> DataFrame: return parts.select("rank").distinct().crossJoin(parts.where(F.col("rank") == root).drop("rank"))


def reduce_scatter(parts: DataFrame, ranks: int, op: str = "sum") -> DataFrame:
    """Totals, dealt to the ranks by the first index in even runs."""
    first = _index(parts)[0]
    total = reduce(parts, op)
    n = total.agg((F.max(first) + 1).alias("n"))
    return total.crossJoin(F.broadcast(n)).withColumn("rank", F.expr(f"int({first} * {ranks} div n)")).drop("n")
