"""Queries, causal logits and attention as relational plans.

A sequence is a set of rows (head keys, pos, q, k, v). Every plan is keyed by `KEYS`, so heads are spread over
the cluster; a query meets the keys up to its own position by an equi-join on the head with a range condition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.vectors import dot, relative_error, vector_mean

KEYS = ("head",)


def last_queries(vectors: DataFrame, n: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """The last n positions of each head, as (keys, qpos, q)."""
    ends = vectors.groupBy(*keys).agg(F.max("pos").alias("last"))
    return vectors.join(ends, list(keys)).filter(F.col("pos") > F.col("last") - n).select(*keys, F.col("pos").alias("qpos"), "q")


def is_special(pos: Column, n_causal: Column, n_sink: int, local_window: int) -> Column:
    """The first n_sink keys and the last local_window before the query are always kept."""
    return (pos < n_sink) | (pos >= F.greatest(F.lit(n_sink), n_causal - local_window))


def causal_logits(queries: DataFrame, vectors: DataFrame, dim: int, n_sink: int = 1, local_window: int = 0, scale: float | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, qpos, pos, logit, special, v) of each query and the keys up to its position.

    No hint is given: Spark broadcasts the queries where their size allows it, and joins by the head elsewhere.
    """
    scale = dim**-0.5 if scale is None else scale
    pairs = vectors.drop("q").join(queries, list(keys)).filter(F.col("pos") <= F.col("qpos"))
    return pairs.select(*keys, "qpos", "pos", (dot("q", "k") * F.lit(scale)).alias("logit"), is_special(F.col("pos"), F.col("qpos") + 1, n_sink, local_window).alias("special"), "v")


def by_query(keys: Sequence[str] = KEYS, *more: str) -> Window:
    return Window.partitionBy(*keys, "qpos", *more)


def weights(logits: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """logits with w: the softmax over each query's keys."""
    w = by_query(keys)
    e = F.exp(F.col("logit") - F.max("logit").over(w))
    return logits.withColumn("e", e).withColumn("w", F.col("e") / F.sum("e").over(w)).drop("e")


def attend(items: DataFrame, group: Sequence[str], score: str = "logit", value: str = "v") -> DataFrame:
    """(group, output, budget): softmax-weighted mean of the values, and how many items there are."""
    top = items.withColumn("e", F.exp(F.col(score) - F.max(score).over(Window.partitionBy(*group))))
    return top.groupBy(*group).agg(vector_mean(value, F.col("e")).alias("output"), F.count("*").alias("budget"))


def full_attention(logits: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, qpos, truth) over all causal keys."""
    return attend(logits, [*keys, "qpos"]).select(*keys, "qpos", F.col("output").alias("truth"))


def errors(outputs: DataFrame, truth: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """outputs with rel_l2_error against the truth."""
    return outputs.join(truth, [*keys, "qpos"]).withColumn("rel_l2_error", relative_error("output", "truth")).drop("truth", "output")


def ranked(logits: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Candidates (not special) with p, their 0-based rank by descending logit (ties by position), and n, their number."""
    w = by_query(keys)
    return logits.filter(~F.col("special")).withColumn("p", F.row_number().over(w.orderBy(F.desc("logit"), "pos")) - 1).withColumn("n", F.count("*").over(w))


def equal_group(p: Column, n: Column, groups: Column) -> Column:
    """The group of rank p of n in equal sizes; the last group takes the remainder."""
    g = F.least(groups, n)
    return F.least(F.floor(p / F.greatest(F.lit(1), F.floor(n / g))), g - 1).cast("long")


def doubling_group(p: Column) -> Column:
    """Groups of 1, 1, 2, 4, 8, ... ranks."""
    return F.when(p == 0, 0).otherwise(F.floor(F.log2(F.greatest(p, F.lit(1)))) + 1).cast("long")
