"""Sinks: results as CSV, aggregates, provenance and head statistics as JSON, vectors as partitioned Parquet."""

from __future__ import annotations

import json
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns of the results file, in order.
RESULT = ("task", "layer", "head", "example_id", "query_pos", "method", "method_kind", "budget", "actual_budget", "rel_l2_error", "seed")


def write_vectors(vectors: DataFrame, path: str) -> None:
    vectors.write.partitionBy("task", "layer").mode("overwrite").parquet(path)


def write_results(results: DataFrame, path: str) -> bool:
    """CSV with a header; nothing is written for no rows."""
    if results.isEmpty():
        return False
    results.select(*[F.col(c) for c in RESULT]).write.mode("overwrite").option("header", True).csv(path)
    return True


def provenance(examples: DataFrame) -> DataFrame:
    """Examples without their context: its length and first 200 characters instead."""
    return examples.withColumn("context_chars", F.length("context").cast("long")).withColumn("context_preview", F.substring("context", 1, 200)).drop("context")


def sidecars(examples: DataFrame, heads: str, backend: str | None = None, raw: bool = True, rope: bool = True) -> DataFrame:
    """(id, json): what is kept of each example beside its vectors; question and answer are cut to 200 characters.

    examples: id, seq_len, question, answer, context. An answer that is no text is put down as JSON.
    """
    text = {f.name for f in examples.schema.fields if isinstance(f.dataType, T.StringType)}
    answer = F.col("answer") if "answer" in text else F.to_json("answer")
    fields = [
        F.col("id").alias("example_id"), F.col("seq_len").alias("sequence_length"), F.substring("question", 1, 200).alias("question"),
        F.substring(answer, 1, 200).alias("answer"), F.coalesce(F.length("context"), F.lit(0)).cast("long").alias("context_chars"),
        F.lit(heads).alias("heads_extracted"), F.lit(rope).alias("rope_included"), F.lit(raw).alias("raw_included"),
        *([F.lit(backend).alias("backend")] if backend else []),
    ]
    return examples.select("id", F.to_json(F.struct(*fields)).alias("json"))


def save_examples(examples: DataFrame, vectors: DataFrame, path: str, task: str, heads: str = "all", **about) -> DataFrame:
    """Saves the vectors of examples and their sidecars; returns (id, seq_len, folder), longest first.

    examples as in sidecars(); vectors: id, layer, tensor, head, pos, vec. Folders are ex_000, ex_001, ... in that order.
    """
    nth = F.row_number().over(Window.partitionBy(F.lit(task)).orderBy(F.desc("seq_len"), "id")) - 1  # examples of a task: a few
    named = examples.withColumn("folder", F.format_string("ex_%03d", nth))
    rows = vectors.join(named.select("id", "folder"), "id").select(F.lit(task).alias("task"), F.col("folder").alias("example_id"), "layer", "tensor", "head", "pos", "vec")
    write_vectors(rows, f"{path}/vectors")
    sidecars(named, heads, **about).join(named.select("id", "folder"), "id").select("folder", F.col("json").alias("value")).write.mode("overwrite").partitionBy("folder").text(f"{path}/examples/{task}")
    return named.select("id", "seq_len", "folder")


def head_statistics(stats: DataFrame) -> DataFrame:
    """(task, json) from (task, layer, head, metric, value): nested maps by layer and head."""
    heads = stats.groupBy("task", "layer", "head").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("stats"))
    layers = heads.groupBy("task", "layer").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat(F.lit("head_"), "head").alias("k"), "stats")), lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0))).alias("heads"))
    entry = F.struct(F.concat(F.lit("layer_"), "layer").alias("k"), "heads")
    return layers.groupBy("task").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("json"))


def write_json(path: str, data) -> None:
    """A small driver-side document."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(data, indent=2, default=str))


def run_spec(path: str, config: dict, methods: list[str], heads: int, details: dict) -> None:
    """What was run: the configuration, its methods, and for each task its heads, sequence lengths and rows."""
    same = {"algorithms": "algorithms", "tasks": "tasks", "head_mode": "head_mode", "n_examples_per_task": "n_examples", "n_queries_per_example": "n_queries", "budgets": "budgets", "seed": "seed"}
    spec = {"date": datetime.now().isoformat(timespec="seconds")} | {k: config[v] for k, v in same.items()}
    write_json(path, spec | {"methods": methods, "n_heads": heads, "task_details": details, "resolved_config": config})


def task_metadata(path: str, **fields) -> None:
    """A task's metadata; fields that are None are left out."""
    write_json(path, {k: v for k, v in fields.items() if v is not None})
