"""An evaluation as one plan: heads, queries, methods times budgets, errors, aggregates, files; and its replay."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import aggregate, methods, stats
from tidemark.plans import attention as A
from tidemark.sources import sinks, tables

IDEALIZED = tuple(n for n, m in methods.METHODS.items() if m.kind == "idealized")


@dataclass
class Config:
    """What to evaluate. Nothing about keys that are always kept is hidden: n_sink and local_window are given."""

    vectors: str
    out: str
    dim: int
    algorithms: Sequence[str] = ()
    tasks: Sequence[str] = ()
    budgets: Sequence[int] = (16, 32, 64, 128, 256, 512, 1024, 2048)
    n_queries: int = 10
    n_examples: int = 1
    n_sink: int = 1
    local_window: int = 0
    seed: int = 42
    head_mode: str = "all_heads"
    custom_heads: Sequence[dict] = ()
    gqa: int = 1
    options: dict = field(default_factory=dict)
    compute_statistics: bool = False
    metadata: str | None = None  # the folder of the tasks' metadata.json files, which list the selected heads
    layers: str | Sequence[int] = "all"
    n_layers: int = 0  # needed where a list of layers is asked for by "all" and the vectors hold more


def load(path: str) -> Config:
    """A configuration file, JSON or (where the library is there) YAML."""
    text = Path(path).read_text()
    try:
        raw = json.loads(text)
    except ValueError:
        import yaml

        raw = yaml.safe_load(text)
    return Config(**raw)


def expand(options: dict) -> list[dict]:
    """One set of options for each number of query clusters; modes and top_k are swept inside a method."""
    n = options.get("n_query_clusters")
    return [{**options, "n_query_clusters": k} for k in n] if isinstance(n, (list, tuple)) else [options]


def heads(spark: SparkSession, c: Config, vectors: DataFrame) -> DataFrame:
    """(layer, q_head, kv_head, percentile) by mode: custom, all_heads, or selected_heads by percentile of entropy."""
    if c.head_mode == "custom":
        if not c.custom_heads:
            raise ValueError("custom heads are asked for, and none is given")
        return spark.createDataFrame([(h["layer"], h["q_head"], h["kv_head"], h.get("percentile")) for h in c.custom_heads], "layer int, q_head int, kv_head int, percentile int")
    every = vectors.filter("tensor = 'Q_rope'").select("layer", F.col("head").alias("q_head")).distinct().withColumn("kv_head", F.floor(F.col("q_head") / c.gqa).cast("int"))
    if c.head_mode == "all_heads":
        return every.withColumn("percentile", F.lit(None).cast("int"))
    if c.head_mode == "selected_heads":
        listed = listed_heads(spark, c)
        if listed:
            return spark.createDataFrame(listed, "layer int, q_head int, kv_head int, percentile int")
        keys = ("layer", "q_head", "kv_head")
        seq = sequences(vectors, every).withColumns({k: F.col(k) for k in keys})
        logits = A.causal_logits(A.last_queries(seq, c.n_queries, KEYS), seq, c.dim, c.n_sink, c.local_window, keys=KEYS)
        rows = stats.head_statistics(logits, keys=KEYS).groupBy(*keys).agg(F.avg("effective_entropy").alias("effective_entropy"))
        return stats.select_heads(rows, keys=keys).select(*keys, "percentile")
    raise ValueError(f"unknown head mode: {c.head_mode}")


def listed_heads(spark: SparkSession, c: Config) -> list[tuple]:
    """The heads that the tasks' metadata list, whichever layout their folders have; none where none does."""
    if not c.metadata:
        return []
    found = [h for t in c.tasks for h in tables.task_metadata(spark, f"{tables.task_dir(spark, c.metadata, t)}/metadata.json").get("selected_heads", [])]
    return sorted({(h["layer"], h["q_head"], h["kv_head"], h.get("percentile")) for h in found}, key=str)


def count_heads(chosen: DataFrame) -> int:
    """How many heads are evaluated."""
    return chosen.select("layer", "q_head").distinct().count()


KEYS = ("task", "example_id", "layer", "q_head", "kv_head")


def sequences(vectors: DataFrame, wanted: DataFrame) -> DataFrame:
    """(KEYS, pos, q, k, v) of the heads wanted; sequences that lack a tensor are left out."""
    small = wanted.select("layer", "q_head", "kv_head")
    part = lambda t, head, name: vectors.filter(F.col("tensor") == t).select("task", "example_id", "layer", F.col("head").alias(head), "pos", F.col("vec").cast("array<double>").alias(name))
    kv = part("K_rope", "kv_head", "k").join(part("V", "kv_head", "v"), ["task", "example_id", "layer", "kv_head", "pos"])
    q = part("Q_rope", "q_head", "q").join(small, ["layer", "q_head"])
    return q.join(kv, ["task", "example_id", "layer", "kv_head", "pos"]).select(*KEYS, "pos", "q", "k", "v")


def results(spark: SparkSession, c: Config) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(result rows, heads, logits)."""
    vectors = tables.read_vectors(spark, c.vectors)
    if c.tasks:
        vectors = vectors.filter(F.col("task").isin(*c.tasks))
    tables.check_examples(vectors, c.n_examples)
    if c.layers != "all" or c.n_layers:
        vectors = vectors.filter(F.col("layer").isin(*tables.layers(c.layers, c.n_layers)))
    first = vectors.select("task", "example_id").distinct().groupBy("task").agg(F.slice(F.array_sort(F.collect_list("example_id")), 1, c.n_examples).alias("ids"))
    vectors = vectors.join(first, "task").filter(F.array_contains("ids", F.col("example_id"))).drop("ids")
    chosen = heads(spark, c, vectors).persist()
    seq = sequences(vectors, chosen)
    seq = seq.persist()  # every method starts from these
    queries = A.last_queries(seq, c.n_queries, KEYS).persist()
    logits = A.causal_logits(queries, seq, c.dim, c.n_sink, c.local_window, keys=KEYS).persist()
    truth, rows = A.full_attention(logits, KEYS).persist(), None
    for names, options in [(IDEALIZED, {}), *(((a,), o) for a in c.algorithms for o in expand(c.options.get(a, {})))]:
        more = methods.evaluate(methods.Context(seq, queries, logits, c.dim, c.budgets, KEYS, c.seed, options), names, truth)
        rows = more if rows is None else rows.unionByName(more)
    method = F.when(F.col("requested_budget") > 0, F.concat_ws("-", "method", "requested_budget")).otherwise(F.col("method"))
    rows = rows.select("task", "layer", F.col("q_head").alias("head"), "example_id", F.col("qpos").alias("query_pos"), method.alias("method"), "method_kind", F.col("budget").alias("budget"), F.col("budget").alias("actual_budget"), "requested_budget", "rel_l2_error", F.lit(c.seed).alias("seed"))
    return rows, chosen, logits


def run(spark: SparkSession, c: Config) -> dict:
    """Evaluates and writes results, aggregates by task (weighted by the heads' percentiles where known) and the run's spec."""
    rows, chosen, logits = results(spark, c)
    try:
        return _written(spark, c, rows, chosen, logits)
    finally:
        spark.catalog.clearCache()


def _written(spark: SparkSession, c: Config, rows: DataFrame, chosen: DataFrame, logits: DataFrame) -> dict:
    rows.write.mode("overwrite").parquet(f"{c.out}/results")
    kept = spark.read.parquet(f"{c.out}/results")
    sinks.write_results(kept, f"{c.out}/results.csv")
    per_head = aggregate.by_method(kept, ["task", "layer", "head"])
    if c.head_mode == "selected_heads":
        picks = chosen.select("layer", F.col("q_head").alias("head"), "percentile")
        summary = aggregate.weighted_heads(per_head, picks, ("layer", "head"), ("task",))
    else:
        summary = aggregate.by_method(kept, ["task"])
    summary.write.mode("overwrite").json(f"{c.out}/aggregates")
    per_head.write.mode("overwrite").json(f"{c.out}/aggregates_by_head")
    if c.compute_statistics:
        stats.head_statistics(logits, keys=KEYS).write.mode("overwrite").json(f"{c.out}/statistics")
    names = sorted(r["method"] for r in kept.select("method").distinct().collect())
    lengths = logits.groupBy("task", "example_id").agg((F.max("qpos") + 1).alias("n")).groupBy("task").agg(F.array_sort(F.collect_list("n")).alias("seq_lens"))
    counts = kept.groupBy("task").agg(F.count("*").alias("rows"), F.array_sort(F.collect_set(F.format_string("L%dH%d", "layer", "head"))).alias("heads"))
    details = {r["task"]: {"seq_lens": list(r["seq_lens"]), "rows": r["rows"], "heads": list(r["heads"])} for r in counts.join(lengths, "task").collect()}
    sinks.run_spec(f"{c.out}/spec.json", dict(vars(c)), names, count_heads(chosen), details)
    return {"rows": kept.count(), "methods": names}


def replay(spark: SparkSession, out: str) -> DataFrame:
    """Aggregates of an earlier run, read back."""
    return spark.read.json(f"{out}/aggregates")
