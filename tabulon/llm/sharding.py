"""Proportional stratified interleaving: rows in seeded order within each source, dealt by their fractional rank, cut into even shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.common import Scratch, bucket_count, checked_broadcast, documents, in_buckets

SHARDS, SEED = 16, 29


def _spread(scratch: Scratch, rows: DataFrame, seed: int) -> tuple[DataFrame, int]:
    """rows (source, h, ...) with `at`, the 0-based place in the interleaved order; and their number."""
    rows = rows.withColumn("stratum", F.concat(F.when(F.col("source").isNull(), "0").otherwise("1"), F.coalesce("source", F.lit(""))))
    rows = scratch.save(rows, "rows")
    sizes = rows.groupBy("stratum").agg(F.count("*").alias("n"))
    total = rows.count()
    b = bucket_count(total)
    # h is uniform: its top part cuts every source, the hot one too, into even pieces of the seeded order
    ranked = in_buckets(rows, ["stratum"], F.floor(F.shiftrightunsigned("h", 1) * F.lit(b * 2.0**-63)), ["h", "doc_id", "size", "text_crc32"], "rank")
    ranked = scratch.save(ranked, "ranked")
    placed = ranked.join(checked_broadcast(sizes, limit=100_000), "stratum").withColumn("fraction", (F.col("rank") + 0.5) / F.col("n"))
    placed = in_buckets(placed, [], F.least(F.floor(F.col("fraction") * b), F.lit(b - 1)), ["fraction", F.xxhash64(F.lit(seed), "stratum"), "stratum", "rank"], "at")
    return placed, total


def shard_places(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law ('rows'), shard, slot and grown_shard (null under this law) of every row of docs.

    size: UTF-8 bytes of the text and 1 more; a null text counts as empty. Shards' row counts differ by one at most, and every shard holds
    each source in proportion, to within rounding. A null source is a stratum of its own. Equal rows are placed one after another in an
    order that doesn't matter. Fewer rows than shards: the first shards have none or one. Empty input: no rows.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "size", "text_crc32"))
    placed, n = _spread(scratch, rows, seed)
    shard = F.expr(f"(at * {shards}) div {max(n, 1)}L")
    first = F.expr(f"(shard * {max(n, 1)}L + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("at") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_places(documents(spark, sf_dir))
