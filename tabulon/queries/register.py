"""Registration of queries whose double columns are rounded alike in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.operators.sparse import Sparse
from tabulon.plans.tensor import Tensor


def registrar(queries: dict, oracles: dict):
    """q(name, sql, f, digits) for a function f of (spark, sf_dir) that returns a Tensor, a Sparse or a DataFrame."""
    def q(name: str, sql: str, f, digits: int = 5) -> None:
        def query(spark, sf_dir):
            out = f(spark, sf_dir)
            df = out.df if isinstance(out, Tensor | Sparse) else out
            return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))

        queries[name] = query
        oracles[name] = sql

    return q
