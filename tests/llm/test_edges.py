"""Registered queries and the pipeline on an empty table and on one of nulls, repeated rows and an empty text."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabulon.llm import registry

NAMES = sorted(n for n in registry.queries() if not n.startswith(("op1_", "op11_", "op12_", "op13_")))  # these have tables and tests of their own


@pytest.fixture(scope="module")
def tables(spark, small, tmp_path_factory):
    """(folder, rows): no rows; three of nulls, two without doc_id, one twice, another three times, the least with an empty text."""
    root = tmp_path_factory.mktemp("edges")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    least = docs.agg(F.min("doc_id")).first()[0]
    first = docs.where(F.col("doc_id").isin(least, least + 1))
    nothing = spark.range(3).select(*(F.lit(None).cast(t).alias(c) for c, t in docs.dtypes))
    odd = nothing.unionByName(first.withColumn("doc_id", F.lit(None).cast("long"))).unionByName(first).unionByName(first)
    odd = odd.unionByName(first.where(f"doc_id = {least}")).unionByName(first.where(f"doc_id = {least}").withColumn("text", F.lit("")))
    docs.limit(0).write.parquet(f"{root}/none/documents.parquet")
    odd.coalesce(1).write.parquet(f"{root}/odd/documents.parquet")
    return f"{root}/none", f"{root}/odd"


@pytest.mark.parametrize("name", NAMES)
def test_empty_and_odd_tables(spark, tables, name):
    none, odd = tables
    assert registry.queries()[name](spark, none).count() == 0
    out = registry.queries()[name](spark, odd).toPandas()
    if name.startswith("op9_"):  # a row a piece; each document has an id at least
        assert (out.groupby("sequence_id").length.sum() <= 4096).all() and len(out) >= 11
    else:
        assert len(out) == 11 and out.doc_id.isna().sum() == 5


def test_pipeline_of_empty_and_odd_tables(spark, tables):
    none, odd = tables
    assert corpus_pipeline.run(spark, none).count() == 0
    corpus_pipeline.run(spark, odd).toPandas()
