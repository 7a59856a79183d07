"""Aggregates of results over queries, heads and tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Weight of a head by the percentile it was chosen at; others weigh 1.
HEAD_WEIGHTS = {0: 1.0, 25: 2.0, 50: 3.0, 75: 2.0, 100: 1.0}


def by_method(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean and deviation of error and budget of each method."""
    return results.groupBy(*by, "method", "requested_budget").agg(
        F.avg("rel_l2_error").alias("error_mean"), F.stddev_pop("rel_l2_error").alias("error_std"),
        F.avg(F.col("budget").cast("double")).alias("budget_mean"), F.stddev_pop("budget").alias("budget_std"), F.count("*").alias("n_queries"))


def weighted_heads(aggregates: DataFrame, heads: DataFrame, keys: Sequence[str] = ("head",), by: Sequence[str] = ()) -> DataFrame:
    """Means over heads weighted by percentile; the deviation is the weighted mean of deviations. heads: keys, percentile."""
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p, w in HEAD_WEIGHTS.items() for x in (p, w)]), F.col("percentile").cast("int")), F.lit(1.0))
    rows = aggregates.join(heads.select(*keys, weight.alias("hw")), list(keys))
    mean = lambda c: (F.sum(F.col(c) * F.col("hw")) / F.sum("hw")).alias(c)
    return rows.groupBy(*by, "method", "requested_budget").agg(*map(mean, ("error_mean", "error_std", "budget_mean", "budget_std")), F.sum("n_queries").cast("long").alias("n_queries"))


def query_stats(stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and deviation of per-query statistics."""
    return stats.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


#: Ways of summing up heads.
SUMMARIES = {"mean": F.avg, "median": lambda c: F.percentile(c, 0.5), "p25": lambda c: F.percentile(c, 0.25), "p75": lambda c: F.percentile(c, 0.75), "p90": lambda c: F.percentile(c, 0.9)}


def across_heads(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean, median, quartiles, 90th percentile, deviation, and spread of the quartiles of a value at each point, over heads."""
    out = rows.groupBy(*by).agg(*[f(value).alias(n) for n, f in SUMMARIES.items()], F.stddev_pop(value).alias("std"), F.count("*").alias("n_heads"))
    return out.withColumn("spread", F.col("p75") - F.col("p25"))


def global_over_heads(panels: DataFrame, heads: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """All panels summed up over heads, in one plan; groups (by) of a single head are left out."""
    many = panels.groupBy(*by).agg(F.countDistinct(F.struct(*heads)).alias("heads")).filter("heads > 1") if by else None
    if by:
        panels = panels.join(many.select(*by), list(by))
    elif panels.agg(F.countDistinct(F.struct(*heads))).first()[0] < 2:
        panels = panels.limit(0)
    return across_heads(panels, [*by, "panel", "series", "x"], "value")


def pairs_over_heads(bins: DataFrame, heads: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Similarity by distance, over heads: means of bins and their standard error over heads, centres of the first head.

    Heads count whose number of bins is that of the first head (in order of `heads`). bins as of pair_panels.
    """
    group = [*by, "pair_type", "metric"]
    head = F.struct(*heads)
    n = bins.groupBy(*group, *heads).agg(F.count("*").alias("n_bins"))
    first = n.groupBy(*group).agg(F.min_by("n_bins", head).alias("n_bins"), F.min(head).alias("first"))
    same = bins.join(n, [*group, *heads]).join(first, [*group, "n_bins"])
    centre = F.max(F.when(head == F.col("first"), F.col("centre")))
    return same.groupBy(*group, "bin").agg(centre.alias("centre"), F.avg("mean").alias("mean"), (F.stddev_pop("mean") / F.sqrt(F.count("*"))).alias("sem"), F.count("*").alias("n_heads"))


def pooled_categories(pairs: DataFrame, local_window: int, by: Sequence[str] = ()) -> DataFrame:
    """Pairs of all heads together by sink, local and global: how many, and mean similarities."""
    kind = F.when(F.col("is_sink"), "sink").when(F.col("dist") <= local_window, "local").otherwise("global")
    return pairs.groupBy(*by, kind.alias("category")).agg(F.count("*").alias("n"), F.avg("cos").alias("cos"), F.avg("dot").alias("dot"))


def levels(results: DataFrame, value: str = "rel_l2_error") -> DataFrame:
    """The same mean for each task and for all of them, in one pass."""
    return results.rollup("task").agg(F.avg(value).alias("mean"), F.count("*").alias("n")).withColumn("task", F.coalesce("task", F.lit("all")))


def describe(results: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles."""
    return results.groupBy(*by).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), *[F.percentile(value, q).alias(n) for n, q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))], F.max(value).alias("max"))
