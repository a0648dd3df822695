"""Mixing sources to target weights: words per source, repetition rates, whole copies and one hash-seeded Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulon.llm.common import WORD, Scratch, checked_broadcast, documents

#: Production parameters: weights of the sources in order, repeating; the mix's size in all sizes; a source's most repetitions.
WEIGHTS, SHARE, MOST, SEED = (3, 1, 2), 1.5, 2.0, 17
#: Up to so many sources are broadcast; more are joined by salted keys.
SOURCES, SALTS = 100_000, 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds target to (source, source_size): share of all sizes by weight, at most `most` times a source's size, the excess reshared by weight.

    Capped sources are those of least size for their weight: sorted by size / weight, the cap holds for a prefix, and the level of the rest
    follows from the sums beyond it. One row per source, so its windows are small.
    """
    order = W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight)
    everything = W.partitionBy(F.lit(0))
    by_ratio = everything.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    behind = by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing)
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything)
    # the level if all sources before this one were capped
    rows = rows.withColumn("level", F.greatest(F.lit(0.0), share * total - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(behind))
    free = F.col("weight") * F.col("level") <= most * F.col("source_size")
    level = F.min(F.when(free, F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(everything)["level"]
    return rows.withColumn("target", F.least(most * F.col("source_size"), F.coalesce(F.col("weight") * level, most * F.col("source_size")))).select("source", "source_size", "target")


def uniform(seed: int, *columns) -> Column:
    """[0, 1) from a hash of the columns."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) * F.lit(2.0**-53)


def _with_rates(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """rows (source, size, ...) with source_size, target and copies."""
    per = scratch.save(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    n = per.count()
    if n <= SOURCES:
        joined = rows.alias("k").join(checked_broadcast(per, n, SOURCES).alias("t"), F.col("k.source").eqNullSafe(F.col("t.source")))
    else:
        salted = per.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).alias("t")
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS)).cast("int")).alias("k")
        joined = rows.join(salted, F.col("k.source").eqNullSafe(F.col("t.source")) & (F.col("k.salt") == F.col("t.salt")))
    rate = F.when(F.col("t.source_size") > 0, F.col("t.target") / F.col("t.source_size")).otherwise(0.0)
    copies = F.floor(rate) + (F.col("k.u") < rate - F.floor(rate)).cast("long")
    return joined.select("k.*", "t.source_size", "t.target", copies.cast("long").alias("copies")).drop("salt")


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """docs, each row as often as the mix takes it (0 to 2 times); its columns are unchanged.

    Words are `[^\\x20\\x09-\\x0D]+`; a null or empty text has size 0 and adds nothing to its source. A null source is a source of its own, the
    last. Equal rows draw the same number, so they are repeated alike. Empty input: no rows. Columns with any other names pass through.
    """
    scratch = Scratch(docs.sparkSession)
    sized = docs.select(F.struct("*").alias("row"), F.col("source").alias("source"), word_count(F.col("text")).alias("size"), F.col("doc_id").alias("doc_id"), uniform(seed, "doc_id", "text").alias("u"))
    return _with_rates(scratch, sized).withColumn("copy", F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(1).cast("long"), F.col("copies"))))).select("row.*")


def mixed_sizes(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target (of its source), taken (words that the mix takes, repeats counted) of every row of docs; see mix()."""
    scratch = Scratch(docs.sparkSession)
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), uniform(seed, "doc_id", "text").alias("u"))
    return _with_rates(scratch, scratch.save(sized, "sizes")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_sizes(documents(spark, sf_dir))
