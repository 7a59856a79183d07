"""What the figures are drawn from: pooled statistics, box plots, panels of a head, comparisons of heads and variants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import approximation, explore, stats
from tidemark.plans import attention as A


def pooled(per_example: DataFrame, scout: DataFrame) -> DataFrame:
    """Statistics of each example where a task has them, else the scout's. Both: task, layer, head, metric, value."""
    lone = scout.join(per_example.select("task").distinct(), "task", "left_anti")
    return per_example.select("task", "layer", "head", "metric", "value").unionByName(lone.select("task", "layer", "head", "metric", "value"))


def heads_per_task(rows: DataFrame, metric: str = "full_entropy") -> DataFrame:
    """How many values tasks have: the number where all have as many, else about their mean. rows as in pooled."""
    n = rows.filter(F.col("metric") == metric).groupBy("task").agg(F.count("*").alias("n"))
    same, mean = F.min("n").cast("string"), F.floor(F.avg("n")).cast("string")
    label = F.when(F.min("n") == F.max("n"), same).otherwise(F.concat(F.lit("~"), mean))
    return n.agg(F.concat(label, F.lit(" heads/task")).alias("label"))


def values(rows: DataFrame, metric: str, by: Sequence[str] = ("task",)) -> DataFrame:
    """(by, value): all values of a metric, of a task or of its examples."""
    return rows.filter(F.col("metric") == metric).select(*by, "value")


# What metrics are called in titles; on an axis, entropies have their unit.
TITLES = {"entropy": "Entropy", "top1pct_mass": "Top 1% Mass", "top5pct_mass": "Top 5% Mass"}


def title(metric: Column, axis: bool = False) -> Column:
    """A metric's name in a title, or on an axis; unknown ones keep theirs without full_ and effective_."""
    plain = F.regexp_replace(metric, "full_|effective_", "")
    names = F.create_map(*[F.lit(x) for k, v in TITLES.items() for x in (k, f"{v} (nats)" if axis and k == "entropy" else v)])
    return F.coalesce(F.element_at(names, plain), plain)


def info(heads: DataFrame) -> DataFrame:
    """(layer, q_head, line): the head table beside the figures. heads: layer, q_head, label, effective_entropy, n_queries."""
    entropy = F.when(F.col("effective_entropy").isNotNull(), F.format_string("ent=%.2f", "effective_entropy"))
    tag = F.format_string("L%dH%d", "layer", "q_head")
    return heads.select("layer", "q_head", F.concat_ws("  ", tag, F.nullif("label", F.lit("")), entropy, F.format_string("n=%d", "n_queries")).alias("line"))


def families(methods: DataFrame) -> DataFrame:
    """(prefix, label, modes, sweep): the curves of methods, one for each prefix. methods: method."""
    prefix, mode, k = explore.family(F.col("method"))
    rows = methods.select(prefix.alias("prefix"), mode.alias("mode"), k.alias("k")).filter("mode is not null")
    return rows.groupBy("prefix").agg(F.array_sort(F.collect_set("mode")).alias("modes"), F.array_sort(F.collect_set("k")).alias("sweep")).withColumn("label", F.replace("prefix", F.lit("-"), F.lit(" ")))


def box(rows: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Quartiles, and the outermost values within 1.5 of their distance."""
    q = rows.groupBy(*by).agg(F.percentile(value, 0.25).alias("q1"), F.percentile(value, 0.5).alias("median"), F.percentile(value, 0.75).alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = rows.join(q, list(by)).filter(F.col(value).between(F.col("q1") - reach, F.col("q3") + reach))
    return inside.groupBy(*by).agg(*[F.first(c).alias(c) for c in ("q1", "median", "q3")], F.min(value).alias("low"), F.max(value).alias("high"))


def labelled_heads(chosen: DataFrame, keys: Sequence[str] = A.KEYS) -> DataFrame:
    """Chosen heads with the label of their percentile."""
    return chosen.select(*keys, F.concat(F.lit("P"), F.col("percentile").cast("string")).alias("selection_label"), "percentile")


def across_tasks(chosen: DataFrame, rows: DataFrame, metric: str) -> DataFrame:
    """Every chosen head's metric in every task; null where a task lacks the head. chosen: layer, head; rows as in pooled."""
    every = rows.select("task").distinct().crossJoin(F.broadcast(chosen.select("layer", "head")))  # tasks times chosen heads
    return every.join(rows.filter(F.col("metric") == metric).select("task", "layer", "head", "value"), ["task", "layer", "head"], "left")


def plot_sample(rows: DataFrame, is_sink: str, n: int, order: Sequence[str], seed: int = 42, by: Sequence[str] = ()) -> DataFrame:
    """At most n rows of each group, the sinks always among them: a sample for drawing."""
    w = Window.partitionBy(*by).orderBy(F.desc(is_sink), F.xxhash64(*order, F.lit(seed)), *order)
    return rows.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n).drop("r")


def head_bars(chosen: DataFrame, rows: DataFrame, metric: str) -> DataFrame:
    """Full and effective values of a metric for each chosen head. chosen: layer, head, label; rows as in pooled."""
    pick = lambda k: F.max(F.when(F.col("metric") == f"{k}_{metric}", F.col("value"))).alias(k)
    each = rows.groupBy("task", "layer", "head").agg(pick("full"), pick("effective"))
    return across(chosen, rows.select("task").distinct(), each, ("full", "effective"))


def across(chosen: DataFrame, groups: DataFrame, values_: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every chosen head in every group, null where the group lacks it. Groups times chosen heads: both are few."""
    by = groups.columns
    every = groups.crossJoin(F.broadcast(chosen.select("layer", "head", "label")))
    return every.join(values_, [*by, "layer", "head"], "left").select(*by, "layer", "head", "label", *columns)


def across_examples(chosen: DataFrame, rows: DataFrame, metric: str) -> DataFrame:
    """A metric of each chosen head in each example, with the example's length. rows: task, example, seq_len and as in pooled."""
    own = rows.filter(F.col("metric") == metric).select("task", "example", "seq_len", "layer", "head", "value")
    return across(chosen, rows.select("task", "example", "seq_len").distinct(), own, ("value",))


def selected_heads(chosen: DataFrame, rows: DataFrame, examples: DataFrame, metrics: Sequence[str] = ("entropy", "top1pct_mass", "top5pct_mass")) -> dict[str, DataFrame]:
    """All plot data about chosen heads: bars, lines over examples, and lines over tasks, with the metric's name."""
    out: dict[str, DataFrame] = {}
    for m in metrics:
        parts = {"bars": head_bars(chosen, rows, m)}
        for kind in ("full", "effective"):
            parts[f"examples_{kind}"] = across_examples(chosen, examples, f"{kind}_{m}")
            parts[f"tasks_{kind}"] = across_tasks(chosen, rows, f"{kind}_{m}")
        for k, part in parts.items():
            part = part.withColumn("metric", F.lit(m))
            out[k] = out[k].unionByName(part) if k in out else part
    return out


def global_panels(logits: DataFrame, queries: DataFrame, vectors: DataFrame, dim: int, ks: Sequence[int] = (10, 50, 100, 200, 500), budgets: Sequence[int] = approximation.BUDGETS, seed: int = 42, keys: Sequence[str] = A.KEYS) -> DataFrame:
    """(keys, panel, series, x, value): all panels of the overview of a head. logits: of the last queries; queries: all.

    x is the ordinal of a query or budget; panels of one number have x 0.
    """
    nth = logits.select(*keys, "qpos").distinct().withColumn("x", (F.row_number().over(Window.partitionBy(*keys).orderBy("qpos")) - 1).cast("long"))
    place = lambda rows: rows.join(nth, [*keys, "qpos"])
    row = lambda rows, panel, series, x, value: rows.select(*keys, F.lit(panel).alias("panel"), series.alias("series"), x.alias("x"), value.cast("double").alias("value"))
    zero = F.lit(0).cast("long")
    entropy = place(stats.query_stats(logits, (), keys))
    bias = approximation.curves(approximation.comparison(logits, budgets, seed, keys), logits, budgets, keys)
    order = F.array_position(F.array(*[F.lit(int(b)).cast("long") for b in budgets]), F.col("requested_budget")) - 1
    scores = logits.select(*keys, "qpos", "pos", "logit")
    parts = [
        row(place(stats.top_k_mass(logits, ks, keys)), "topk_mass", F.col("k").cast("string"), F.col("x"), F.col("mass")),
        *[row(entropy, "entropy", F.lit(c), F.col("x"), F.col(c)) for c in ("full_entropy", "effective_entropy")],
        row(bias, "bias", F.col("method"), order, F.col("mean")),
        row(explore.mean_query(scores, queries, vectors, dim, keys), "mean_query", F.lit("correlation"), zero, F.col("corr")),
        row(stats.mean_query_norm(queries, keys), "deviation", F.lit("mean_q_norm"), zero, F.col("mean_q_norm")),
        row(stats.query_deviation(queries, keys).groupBy(*keys).agg(F.avg("relative_deviation").alias("v")), "deviation", F.lit("relative"), zero, F.col("v")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pair_panels(anchors: DataFrame, vectors: DataFrame, dim: int, bins: int = 15, local_window: int = 1024, most: int | None = 20_000, keys: Sequence[str] = A.KEYS) -> DataFrame:
    """Similarity by distance for queries and keys, queries, and keys: pair_type, metric, bin, centre, mean, sem, n."""
    out = None
    for kind in ("qk", "qq", "kk"):
        rows = explore.pairs(anchors, vectors, kind, dim, most=most, keys=keys)
        for metric in ("cos", "dot"):
            part = explore.by_distance(rows, metric, bins, keys).withColumn("pair_type", F.lit(kind)).withColumn("metric", F.lit(metric))
            out = part if out is None else out.unionByName(part)
    return out


def variants(rotated: DataFrame, raw: DataFrame) -> DataFrame:
    """Rows of the rotated and the raw vectors, side by side."""
    return rotated.withColumn("variant", F.lit("rope")).unionByName(raw.withColumn("variant", F.lit("raw")))


def variant_panels(vectors: DataFrame, dim: int, n_queries: int, n_sink: int = 1, local_window: int = 1024, budgets: Sequence[int] = approximation.BUDGETS, bins: int = 15, most: int | None = 20_000, n_fit: int = 50_000, seed: int = 42, keys: Sequence[str] = A.KEYS) -> dict[str, DataFrame]:
    """What is compared between rotated and raw vectors: panels, similarity by distance, and the projected sample."""
    queries = A.last_queries(vectors, n_queries, keys)
    logits = A.causal_logits(queries, vectors, dim, n_sink, local_window, keys=keys)
    anchors = queries.select(*keys, F.col("qpos").alias("pos"))
    every = vectors.select(*keys, F.col("pos").alias("qpos"), "q")
    return {
        "global": global_panels(logits, every, vectors, dim, budgets=budgets, seed=seed, keys=keys),
        "pairs": pair_panels(anchors, vectors, dim, bins, local_window, most, keys),
        "projection": explore.projected(explore.fit_sample(vectors, n_fit, seed, keys=keys), keys),
    }
