"""Audit of five filters in all orders: what each one removes first, in vain, alone, and on average over all orders.

A document's verdicts are a mask of five bits, so counts by part and mask tell all: whatever a filter does at a place depends on the set of filters
before it only, and there are 80 pairs of a set and a filter.

Exact duplicates are found by partition refinement: texts are split by length in code points, then by the hashes of successive blocks, each
eight times as long as the one before, and classes of one row leave after each step. What is left is compared as full texts. Hashes only ever
split a class, so equal texts stay together to the end, and texts that share all their hashes without being equal are told apart by the comparison.
"""

from __future__ import annotations

import itertools

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.common import BLANK, Scratch, checked_broadcast, documents

FILTERS = "ABCDE"
#: A: fewest words. B: least percentage of distinct words. C: highest percentage of capitals.
FEWEST, DISTINCT, CAPITALS = 50, 65, 5
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: D: marks that a text must not have.
MARKS = b"#$%&*|"
#: Bytes of the first block, and how many times longer each block is than the one before.
BLOCK, GROWTH = 64, 8


def failed(text: bytes, length: int) -> int:
    """The mask of A to D of a text in UTF-8 of so many code points: bit k is set if the filter of that place in FILTERS fails."""
    words = text.split()  # bytes are split at 20 and 09 to 0D, as the rule for words has it
    mask = (len(words) < FEWEST) | (100 * len(set(words)) < DISTINCT * len(words)) << 1
    mask |= (100 * (len(text) - len(text.translate(None, UPPER))) > CAPITALS * length) << 2
    return mask | (len(text) != len(text.translate(None, MARKS))) << 3


def block_hashes(text: bytes) -> list[int]:
    """64-bit hashes of the successive blocks of a text; none of an empty one."""
    found, at, size = [], 0, BLOCK
    while at < len(text):
        found.append(xxhash.xxh3_64_intdigest(text[at : at + size]) - (1 << 63))
        at, size = at + size, size * GROWTH
    return found


def text_key(text: Column) -> Column:
    """A hash by which rows of equal text are found again."""
    return F.xxhash64(text)


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, part, key, text of every row of docs."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text_key(text).alias("key"), text.alias("text"))


def _verdicts(rows: DataFrame) -> DataFrame:
    """rows (doc_id, part, key, least, text) with mask (A to D), length in code points and blocks instead of text."""

    def run(batches):
        for batch in batches:
            texts = batch.column(4)
            lengths = pc.utf8_length(texts)
            masks, blocks = [], []
            for text, length in zip(texts, lengths.to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes()
                masks.append(failed(raw, length))
                blocks.append(block_hashes(raw))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(masks, pa.int32()), lengths.cast(pa.int64()), pa.array(blocks, pa.list_(pa.int64()))], ["doc_id", "part", "key", "least", "mask", "length", "blocks"])

    return rows.select("doc_id", "part", "key", "least", "text").mapInArrow(run, "doc_id long, part string, key long, least long, mask int, length long, blocks array<long>")


def refine(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """The keys (key) of the rows whose class still has at least two when all blocks are compared; rows: key, length, blocks.

    Rows that share all these are one row with a count once the lengths are settled, so that a text of which there are many copies is no hot key.
    """
    lengths = scratch.save(rows.groupBy("length").agg(F.count("*").alias("n")).where("n > 1").select("length"), "lengths")
    left = rows.join(checked_broadcast(lengths), "length", "left_semi").groupBy("length", "blocks", "key").agg(F.count("*").alias("n"))
    left = scratch.save(left.select(F.col("length").alias("class"), "blocks", "key", "n"), "classes")
    done, step = None, 0
    while True:
        ended = left.where(F.size("blocks") == step)
        ended = ended.join(ended.groupBy("class").agg(F.sum("n").alias("rows")).where("rows > 1").select("class"), "class", "left_semi").select("key")
        done = ended if done is None else done.unionByName(ended)
        going = left.where(F.size("blocks") > step).withColumn("block", F.get("blocks", F.lit(step)))
        shared = going.groupBy("class", "block").agg(F.sum("n").alias("rows")).where("rows > 1").select("class", "block")
        left = scratch.save(going.join(shared, ["class", "block"], "left_semi").select(F.xxhash64("class", "block").alias("class"), "blocks", "key", "n"), "classes")
        if left.isEmpty():
            return done.distinct()
        step += 1


def mark_duplicates(docs: DataFrame) -> tuple[DataFrame, Scratch]:
    """doc_id, part and mask (all five filters) of every row of docs; E fails if a row with a smaller doc_id has the same text.

    Rows without doc_id are no duplicates and make none; rows that repeat a doc_id aren't duplicates of each other.
    """
    scratch, rows = Scratch(docs.sparkSession), _rows(docs)
    seen = scratch.save(_verdicts(rows.withColumn("least", F.lit(None).cast("long"))).drop("least"), "verdicts")
    survivors = scratch.save(refine(scratch, seen.select("key", "length", "blocks")), "survivors")
    n = survivors.count()
    # the full texts of the surviving classes meet, one copy of each from a task
    texts = rows.select("doc_id", "key", "text").join(checked_broadcast(survivors, n), "key", "left_semi")
    full = scratch.save(texts.groupBy("key", "text").agg(F.min("doc_id").alias("least")), "texts")
    per_key = scratch.save(full.groupBy("key").agg(F.min("least").alias("least"), F.count("*").alias("texts")), "least")
    late = F.coalesce((F.col("doc_id") > F.col("least")).cast("int"), F.lit(0))
    marks = lambda df: df.select("doc_id", "part", (F.col("mask") + 16 * late).alias("mask"))
    out = marks(seen.join(checked_broadcast(per_key, n), "key", "left").where("texts IS NULL OR texts = 1"))
    mixed = per_key.where("texts > 1").select("key")
    if not mixed.isEmpty():  # different texts of one key: each row looks its text up
        out = out.unionByName(marks(_verdicts(rows.join(checked_broadcast(mixed), "key", "left_semi").join(full, ["key", "text"]))))
    return out, scratch


def _label_flags(labels: DataFrame) -> DataFrame:
    """doc_id, good, toxic (0 or 1); of several rows for one document any counts."""
    flag = lambda c: F.max((F.coalesce(F.col(c) == 1, F.lit(False))).cast("long"))
    return labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))


def _places() -> list[tuple[int, int, list[tuple[str, int]]]]:
    """(mask of the filters before, number of the filter, [(order, step)]) of all 80 pairs."""
    found: dict[tuple[int, int], list] = {}
    for order in itertools.permutations(range(len(FILTERS))):
        for step, k in enumerate(order):
            found.setdefault((sum(1 << j for j in order[:step]), k), []).append(("".join(FILTERS[j] for j in order), step + 1))
    return [(before, k, places) for (before, k), places in sorted(found.items())]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row per part, order and step, zeros included.

    docs: doc_id, text (null: empty), source (null: the empty string, as one part with it). Further columns of either table are not read. A label counts for
    every row of its doc_id; labels of no document and nulls count for none. Empty docs: no rows.
    """
    marked, scratch = mark_duplicates(docs)
    rows = marked.join(_label_flags(labels), "doc_id", "left")
    by_mask = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    by_mask = scratch.save(by_mask, "masks")
    per_part = by_mask.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # 32 at most
    place = lambda before, k, at: F.struct(F.lit(before).alias("before"), F.lit(1 << k).alias("bit"), F.array(*(F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step")) for o, s in at)).alias("at"))
    cells = per_part.withColumn("p", F.explode(F.array(*(place(*x) for x in _places()))))
    before, bit = F.col("p.before"), F.col("p.bit")

    def total(count, when):
        return F.aggregate("masks", F.lit(0).cast("long"), lambda a, m: a + F.when(when(m["mask"]), count(m)).otherwise(0))

    n = lambda m: m["n"]
    first = lambda m: (m.bitwiseAND(before) == 0) & (m.bitwiseAND(bit) != 0)
    counts = {
        "kept": total(n, lambda m: m.bitwiseAND(before.bitwiseOR(bit)) == 0),
        "removed": total(n, first),
        "redundant": total(n, lambda m: (m.bitwiseAND(before) != 0) & (m.bitwiseAND(bit) != 0)),
        "unique_fails": total(n, lambda m: m == bit),
        "good_lost": total(lambda m: m["good"], first),
        "toxic_lost": total(lambda m: m["toxic"], first),
        # of k filters that fail a document each comes first in one k-th of the 120 orders
        "shapley": total(lambda m: m["n"] * F.floor(F.lit(120) / F.greatest(F.bit_count(m["mask"]), F.lit(1))), lambda m: m.bitwiseAND(bit) != 0),
    }
    rows = cells.select("part", "p.at", *(c.alias(name) for name, c in counts.items()))
    return rows.select("part", F.explode("at").alias("o"), *counts).select("part", "o.filter_order", "o.step", *counts)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


_WORDS = f"list_filter(string_split_regex(text, '{BLANK}+'), lambda w: w <> '')"
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, {_WORDS} AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    list_value(len(words) < {FEWEST}, 100 * len(list_distinct(words)) < {DISTINCT} * len(words), 100 * len(regexp_extract_all(text, '[A-Z]')) > {CAPITALS} * length(text),
      regexp_matches(text, '[{MARKS.decode()}]'), coalesce(w.doc_id > least, false)) AS fails
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
m AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic, len(list_filter(fails, lambda x: x)) AS k FROM f GROUP BY part, fails),
s AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM s a, s b, s c, s d, s e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
p AS (SELECT o, s.i AS step, o[s.i] AS f, o[1:s.i - 1] AS before, list_aggregate(list_transform(o, lambda x: substr('ABCDE', x, 1)), 'string_agg', '') AS filter_order FROM o, s),
c AS (
  SELECT part, filter_order, step, n, good, toxic, k, fails[f] AS fail, len(list_filter(before, lambda x: fails[x])) > 0 AS gone FROM m, p)
SELECT part, filter_order, CAST(step AS INTEGER) AS step,
  CAST(sum(CASE WHEN NOT gone AND NOT fail THEN n ELSE 0 END) AS BIGINT) AS kept,
  CAST(sum(CASE WHEN NOT gone AND fail THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN gone AND fail THEN n ELSE 0 END) AS BIGINT) AS redundant,
  CAST(sum(CASE WHEN fail AND k = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN NOT gone AND fail THEN good ELSE 0 END) AS BIGINT) AS good_lost,
  CAST(sum(CASE WHEN NOT gone AND fail THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
  CAST(sum(CASE WHEN fail THEN n * (120 // k) ELSE 0 END) AS BIGINT) AS shapley
FROM c GROUP BY part, filter_order, step
"""
