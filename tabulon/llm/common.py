"""Helpers shared by the training-data operators: scratch tables, ranks, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: White space of the word rule: space and 09 to 0D.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: A table may be broadcast up to so many rows of two longs (about 16 MB); beyond it joins shuffle.
BROADCAST_ROWS = 1_000_000


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where unset, one is made for a local session and kept in its settings."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            root = tempfile.mkdtemp(prefix="spark-scratch-")
        else:
            root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        spark.conf.set("spark.checkpoint.dir", root)
    return root


class Scratch:
    """Intermediate tables of one operator call, written to the shared folder so that a lost executor costs no recomputation."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, f"{scratch_root(spark).rstrip('/')}/t-{uuid.uuid4().hex}", 0

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        """df, written as Parquet and read again: its lineage ends here."""
        self.n += 1
        path = f"{self.root}/{self.n}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Removes tables that nothing reads any more."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            path.getFileSystem(conf).delete(path, True)


def checked_broadcast(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `limit` rows (counted unless given); else df as it is, for a shuffled join."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= limit else df


def in_buckets(df: DataFrame, strata: list[str], bucket: Column, order: list, out: str) -> DataFrame:
    """Adds the 0-based rank of each row within its stratum, ordered by bucket and then `order`.

    The window runs within (stratum, bucket), so no task holds a stratum; offsets come from the counts.
    Strata must not be null. `bucket` must not decrease along the wanted order.
    """
    df = df.withColumn("_b", bucket)
    keys = [*strata, "_b"]
    before = W.partitionBy(*strata) if strata else W.partitionBy(F.lit(0))
    offsets = df.groupBy(*keys).agg(F.count("*").alias("_n")).select(*keys, F.coalesce(F.sum("_n").over(before.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    ranked = df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.join(offsets, keys).withColumn(out, F.col("_o") + F.col("_r") - 1).drop("_b", "_o", "_r")


def bucket_count(rows: int, per: int = 1000, most: int = 65_536) -> int:
    return max(1, min(most, rows // per))


def hash_bucket(n: int, *cols) -> Column:
    """Even buckets from a hash; xxhash64's sign bit is dropped."""
    return F.pmod(F.shiftrightunsigned(F.xxhash64(*cols), 1), F.lit(n).cast("long"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession, rows: int, per: int) -> int:
    """Shuffle partitions for `rows` at `per` rows a task, never fewer than the session's setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per))
