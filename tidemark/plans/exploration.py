"""An exploration as one plan: panels and pairs of the chosen heads of all tasks, summed up over heads, rotated against raw."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import aggregate, approximation, explore, report
from tidemark.sources import tables

KEYS = ("task", "layer", "q_head", "kv_head")
HEADS = ("layer", "q_head", "kv_head")


@dataclass
class Config:
    """What to explore: the first example of each task, and the heads its metadata list or the one head given."""

    vectors: str
    out: str
    dim: int
    tasks: Sequence[str] = ()
    metadata: str | None = None
    head_mode: str = "custom"
    layer: int = 17
    q_head: int = 0
    kv_head: int = 0
    n_queries: int = 50
    n_sink: int = 1
    local_window: int = 1024
    budgets: Sequence[int] = approximation.BUDGETS
    bins: int = 15
    most_targets: int | None = 20_000
    n_fit: int = 50_000
    seed: int = 42


def load(path: str) -> Config:
    return Config(**json.loads(Path(path).read_text()))


def heads(spark: SparkSession, c: Config) -> list[tuple]:
    """(task, layer, q_head, kv_head, label, effective_entropy): as the metadata list them, else the one head given."""
    out = []
    for task in c.tasks:
        listed = []
        if c.head_mode == "selected_heads" and c.metadata:
            listed = tables.task_metadata(spark, f"{tables.task_dir(spark, c.metadata, task)}/metadata.json").get("selected_heads", [])
        for h in listed or [{"layer": c.layer, "q_head": c.q_head, "kv_head": c.kv_head}]:
            out.append((task, h["layer"], h["q_head"], h["kv_head"], h.get("selection_label"), h.get("effective_entropy")))
    return out


def sequences(vectors: DataFrame, wanted: DataFrame, kind: str) -> DataFrame:
    """(KEYS, pos, q, k, v) of the wanted heads in each task's first example that has all three tensors."""

    def part(tensor: str, head: str, name: str) -> DataFrame:
        rows = vectors.filter(F.col("tensor") == tensor)
        return rows.select("task", "example_id", "layer", F.col("head").alias(head), "pos", F.col("vec").cast("array<double>").alias(name))

    at = ["task", "example_id", "layer", "kv_head", "pos"]
    q = part(f"Q_{kind}", "q_head", "q").join(wanted, ["task", "layer", "q_head"])
    rows = q.join(part(f"K_{kind}", "kv_head", "k"), at).join(part("V", "kv_head", "v"), at)
    first = rows.groupBy(*KEYS).agg(F.min("example_id").alias("example_id"))
    return rows.join(first, [*KEYS, "example_id"]).select(*KEYS, "pos", "q", "k", "v")


def explored(spark: SparkSession, c: Config) -> dict[str, DataFrame]:
    """All results. Heads without data are left out, as are comparisons where there are no raw vectors."""
    chosen = spark.createDataFrame(heads(spark, c), "task string, layer int, q_head int, kv_head int, label string, effective_entropy double")
    vectors = tables.read_vectors(spark, c.vectors)
    parts = {}
    for kind in ("rope", "raw"):
        seq = sequences(vectors, chosen.select(*KEYS), kind).persist()
        parts[kind] = report.variant_panels(seq, c.dim, c.n_queries, c.n_sink, c.local_window, c.budgets, c.bins, c.most_targets, c.n_fit, c.seed, KEYS)
    own = parts["rope"]
    two = {k: report.variants(own[k], parts["raw"][k]) for k in own}
    lengths = own["global"].filter("panel = 'entropy' and series = 'full_entropy'").groupBy(*KEYS).agg(F.count("*").alias("n_queries"))
    out = {
        "heads": chosen, "head_table": report.info(chosen.join(lengths, list(KEYS), "left")),
        "global": own["global"], "pairs": own["pairs"], "projection": own["projection"],
        "separation": explore.kind_separation(own["projection"].withColumn("xy", F.array("x", "y")), "xy", seed=c.seed, keys=KEYS),
        "task_global": aggregate.global_over_heads(own["global"], HEADS, ("task",)), "task_pairs": aggregate.pairs_over_heads(own["pairs"], HEADS, ("task",)),
    }
    if len(c.tasks) > 1:
        out["all_global"] = aggregate.global_over_heads(own["global"], KEYS)
        out["all_pairs"] = aggregate.pairs_over_heads(own["pairs"], KEYS)
    return out | {f"variants_{k}": v for k, v in two.items()}


def run(spark: SparkSession, c: Config) -> dict[str, int]:
    """Writes all results as Parquet; returns how many rows each has."""
    out = {}
    try:
        for name, rows in explored(spark, c).items():
            rows.write.mode("overwrite").parquet(f"{c.out}/{name}")
            out[name] = spark.read.parquet(f"{c.out}/{name}").count()
    finally:
        spark.catalog.clearCache()
    return out
