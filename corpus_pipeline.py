"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabulon.llm import line_dedup, mixing, ngram_join, packing, quality
from tabulon.llm.common import Scratch, documents


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that fail."""
    return quality.clean(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier one has, exactly or nearly."""
    return line_dedup.remove_lines(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by n-gram similarity, that of least doc_id; documents without words stay."""
    return ngram_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", clean_lines),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Hashing, linking and packing can't be expressed in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each one's result written as Parquet and read again for the next."""
    scratch = Scratch(spark)
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        done = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            scratch.drop(before)
        docs = before = done
    return docs
