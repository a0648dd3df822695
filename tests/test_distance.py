"""Distances by blocks against the column expressions, pair by pair."""

import math

import pytest
from pyspark.sql import functions as F

from tabulon.operators import distance

ODD = [
    (0, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 3.0]), (2, [0.0, 0.0, 0.0]), (3, [5.0, 5.0, 5.0]), (4, [0.1, 0.1, 0.1]), (5, [-0.0, 4.0, 0.0]), (6, [math.nan, 1.0, 2.0]), (7, [math.inf, 1.0, -1.0]),
    (8, [None, 1.0, 2.0]), (9, None), (10, [1.0, 2.0]), (11, [1.5, -2.5, 0.25]), (11, [7.0, 8.0, 9.5]), (None, [3.0, 1.0, 2.0]), (12, [math.nan, 1.0, 2.0]), (-4, [1e-3, 1e3, 1.0]),
]


def found(df):
    key = lambda r: tuple((x is None, 0 if x is None else "nan" if x != x else x) if not isinstance(x, float) else (x is None, str(round(x, 9) + 0.0)) for x in r)
    return sorted(((r["i0"], r["i1"], r["v"]) for r in df.collect()), key=key)


def same(ours, want):
    assert len(ours) == len(want)
    for a, b in zip(ours, want, strict=True):
        assert a[:2] == b[:2] and (a[2] is None) == (b[2] is None), (a, b)
        assert a[2] is None or (math.isnan(a[2]) and math.isnan(b[2])) or a[2] == b[2] or abs(a[2] - b[2]) <= 1e-12 * (1 + abs(b[2])), (a, b)


def plain(x, y, metric, p=None):
    pairs = x.select(F.col("i").alias("i0"), "vec").crossJoin(y.select(F.col("i").alias("i1"), F.col("vec").alias("w")))
    return pairs.select("i0", "i1", distance._metric(metric, p)(F.col("vec"), F.col("w")).alias("v"))


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "i long, vec array<double>").repartition(3).cache()


BY_BLOCKS = [("euclidean", None), ("sqeuclidean", None), ("correlation", None), ("hamming", None), ("manhattan", None), ("chebyshev", None), ("minkowski", 1), ("minkowski", 3), ("minkowski", 2.5), ("jaccard", None), ("cosine", None)]


@pytest.mark.parametrize("rows", [4, 256])
@pytest.mark.parametrize(("metric", "p"), BY_BLOCKS, ids=lambda x: str(x))
def test_blocks_equal_columns(odd, metric, p, rows, monkeypatch):
    monkeypatch.setattr(distance, "ROWS", rows)
    y = odd.where("i % 2 = 1 OR i IS NULL OR i = 4")
    # 0.1 has no spread, though its mean is not it in rounding
    skipped = (lambda df: df.where("(i0 <> 4 OR i0 IS NULL) AND (i1 <> 4 OR i1 IS NULL)")) if metric == "correlation" else lambda df: df
    same(found(skipped(distance.cdist(odd, y, metric, p))), found(skipped(plain(odd, y, metric, p))))


@pytest.mark.parametrize("rows", [4, 256])
def test_each_two_once(odd, rows, monkeypatch):
    """Blocks meet once, rows of one block too; equal ids and null are no pair."""
    monkeypatch.setattr(distance, "ROWS", rows)
    same(found(distance.pdist(odd)), found(plain(odd, odd, "euclidean").where("i0 < i1")))
    assert distance.pdist(odd).rdd.getNumPartitions() > 1


def test_squareform_reads_its_pairs_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    pairs = spark.createDataFrame([(0, 1, 1.5), (0, 2, None), (1, 2, 2.5)], "i0 long, i1 long, v double").mapInArrow(counted, "i0 long, i1 long, v double")
    square = {(r["i0"], r["i1"]): r["v"] for r in distance.squareform(pairs, 3).collect()}
    assert square == {(0, 0): 0, (1, 1): 0, (2, 2): 0, (0, 1): 1.5, (1, 0): 1.5, (0, 2): None, (2, 0): None, (1, 2): 2.5, (2, 1): 2.5} and seen.value == 3


def test_no_row_is_alone_in_its_task(spark, small):
    """One file of vectors is one task; the pairs are many."""
    x = distance.vectors(spark.read.parquet(f"{small}/embeddings.parquet"), "vec_id", "embedding")
    assert x.rdd.getNumPartitions() == 1 and x.count() > distance.ROWS / 2
    x = x.unionByName(x.select(F.col("i") + 1000, "vec").toDF("i", "vec")).unionByName(x.select(F.col("i") + 2000, "vec").toDF("i", "vec"))
    out = distance.cdist(x.coalesce(1), x.coalesce(1), "correlation")
    assert out.rdd.getNumPartitions() > 1 and out.count() == x.count() ** 2


def test_no_rows(spark):
    none = spark.createDataFrame([], "i long, vec array<double>")
    some = spark.createDataFrame([(1, [1.0])], "i long, vec array<double>")
    assert distance.cdist(none, some, "correlation").count() == distance.cdist(some, none, "correlation").count() == 0
