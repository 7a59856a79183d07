"""The corpus pipeline: quality rules, near-dedup, decontamination, secret scans, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. Where a stage has to find rows
again, each gets a number of its own in a stored copy, under a name that no column has: ids may be null or repeat.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import contamination, near_dup, packing, quality, secret_scan
from tidemark.llm.common import scratch, stored
from tidemark.llm.subwords import tokenizer_path


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """A stored copy with a number for each row, and the number's name."""
    name, taken = "row", {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return stored(docs.withColumn(name, F.monotonically_increasing_id()), "pipeline-rows"), name


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality.keep(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id, null the largest."""
    rows, row = _numbered(docs)
    found = near_dup.near_duplicates(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), "component_id")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(row))
    first = rows.select(row, "doc_id").join(found, row).groupBy("component_id").agg(F.min_by(row, order).alias(row))
    return rows.join(first.select(row), row, "left_semi").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    rows, row = _numbered(docs)
    found = contamination.decontaminate(rows.select(F.col(row).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.join(found.filter("contaminated").select(F.col("doc_id").alias(row)), row, "left_anti").select(*docs.columns)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; every document stays."""
    path = tokenizer_path("word_bpe_49k.json")
    return secret_scan.redact(docs, secret_scan.train(secret_scan.word_list(path)), path)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 ids."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("packing", pack),
]

#: The quality and secret models can't be put in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark):  # the stages' tables go when the last is written
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        for name, stage in STAGES[:-1]:
            docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        return stored(STAGES[-1][1](spark, docs, sf_dir), "pipeline", keep=True)
