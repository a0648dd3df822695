"""Secrets: base patterns, and corpus-wide ownership of every candidate.

Candidates are the base matches and further credential forms. Each candidate's hash is aggregated over the corpus by distinct owners (source)
and documents (repositories): a value that many owners or many documents hold is a copied example, any other one that looks random is live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import spans
from tabulon.llm.common import Scratch, documents

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"[0-9a-f]{32,}+"
KINDS = ("assign", "access", "hex")
# Public prefixes of credential formats.
FORMATS = r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}+|github_pat_[A-Za-z0-9_]{22,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|glpat-[A-Za-z0-9_-]{20,}+|sk_live_[A-Za-z0-9]{16,}+|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+)"
#: A value that so many owners hold, or so many documents of however few owners, is an example.
OWNERS, DOCUMENTS = 3, 10
#: Distinct characters that a live-looking value has, and the words that only examples hold.
DISTINCT, EXAMPLE = 6, r"(?i)example|sample|dummy|changeme|placeholder|your|xxxx|1234567|abcdef"


def candidates(text: Column) -> list[tuple[str, Column]]:
    """Spans by kind in `text` (not null); the first three are the base, with the value as `part`."""
    always = lambda hit, part: F.lit(True)
    return [
        ("assign", spans.matches(text, ASSIGN, lambda hit, part: F.length(part) >= 8, part=1, gate=r"(?i)passw|secret|token|api_?key")),
        ("access", spans.matches(text, ACCESS, always)),
        ("hex", spans.matches(text, HEX, always)),
        ("format", spans.matches(text, FORMATS, always, gate=r"gh[pousr]_|github_pat_|xox|glpat-|sk_live_|AIza|eyJ")),
    ]


def live_looking(value: Column) -> Column:
    return (F.size(F.array_distinct(F.split(value, ""))) >= DISTINCT) & value.rlike("[0-9]") & ~value.rlike(EXAMPLE)


def scan_secrets(docs: DataFrame, owner: str = "source") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example of every row of docs.

    spans: the base spans, those of other credential formats (format), and one `live` span per value that looks random and is no example.
    n_example counts values held by OWNERS owners or DOCUMENTS documents or more. Null text: empty. A null owner counts as an owner of its own.
    Rows with equal doc_id and text count once per owner and get equal results. Empty input: no rows. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col(owner).cast("string"), F.lit("\x00")).alias("owner"))
    found = candidates(F.col("text"))
    slim = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.xxhash64(s["part"]).alias("value"), live_looking(s["part"]).alias("random")))
    marked = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "owner", *(c.alias(k) for k, c in found))
    marked = scratch.save(marked.select("doc_id", "key", "owner", *(slim(F.col(k)).alias(k) for k, _ in found)), "marked")
    each = marked.select("key", "owner", F.explode(F.concat(*(k for k, _ in found))).alias("s")).select("key", "owner", "s.*").distinct()
    # first by (value, owner), so that a value that all rows hold is never one task's
    owned = each.select("value", "owner", "key").distinct().groupBy("value", "owner").agg(F.count("*").alias("n"))
    held = owned.groupBy("value").agg(F.count("*").alias("owners"), F.sum("n").alias("documents"))
    example = (F.col("owners") >= OWNERS) | (F.col("documents") >= DOCUMENTS)
    judged = each.join(held, "value").groupBy("key").agg(
        F.collect_set(F.when(~example & F.col("random"), F.struct("start", F.lit(4).alias("rank"), F.lit("live").alias("kind"), "stop"))).alias("live"),
        F.countDistinct(F.when(example, F.col("value"))).alias("n_example"),
    )
    base = spans.in_order([(k, F.col(k)) for k in KINDS])
    first = spans.in_order([(k, F.col(k)) for k, _ in found])
    out = marked.select("doc_id", "key", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), base.alias("base"), first.alias("first")).join(judged, "key", "left")
    every = F.sort_array(F.concat("first", F.coalesce("live", F.slice("first", F.lit(1), F.lit(0)))))
    return out.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(spans.listed(F.col("base")), 256).alias("base_sha256"), spans.listed(every).alias("spans"), F.coalesce(F.size("live"), F.lit(0)).cast("long").alias("n_live"), F.coalesce("n_example", F.lit(0)).cast("long").alias("n_example"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir))
