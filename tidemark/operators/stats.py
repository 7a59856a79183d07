"""Statistics of attention weights, norms and heads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.vectors import minus, norm, vector_mean
from tidemark.plans.attention import KEYS, by_query, weights

PERCENTS = (1, 5, 10, 20, 50)


def entropy(w: Column) -> Column:
    """Aggregate: Shannon entropy in nats; weights up to 1e-30 don't count."""
    return F.sum(F.when(w > 1e-30, -w * F.log(w)).otherwise(0.0))


def percent_rank(n: Column, pct: float) -> Column:
    """How many keys the top pct per cent are, one at least."""
    return F.greatest(F.lit(1), F.floor(n * pct / 100))


def ranked_weights(logits: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Full and effective weights of every key with their ranks: `w`, `rn`, `n`; `ew`, `ern`, `en` without special keys."""
    q = by_query(keys)
    rows = weights(logits, keys).withColumn("open", F.when(~F.col("special"), F.col("w")).otherwise(0.0)).withColumn("left", F.sum("open").over(q))
    rows = rows.withColumn("ew", F.when((~F.col("special")) & (F.col("left") > 1e-10), F.col("w") / F.col("left")).otherwise(0.0))
    return rows.select(*keys, "qpos", "pos", "special", "w", "ew", "left", F.row_number().over(q.orderBy(F.desc("w"), "pos")).alias("rn"), F.count("*").over(q).alias("n"), F.row_number().over(q.orderBy("special", F.desc("w"), "pos")).alias("ern"), F.count(F.when(~F.col("special"), 1)).over(q).alias("en"))


def query_stats(logits: DataFrame, percents: Sequence[int] = (1, 5), keys: Sequence[str] = KEYS) -> DataFrame:
    """Entropy and top mass of each query, full and effective."""
    rows = ranked_weights(logits, keys)
    left = F.max("left") > 1e-10
    cols = [entropy(F.col("w")).alias("full_entropy"), F.when(left, entropy(F.col("ew"))).otherwise(0.0).alias("effective_entropy")]
    for p in percents:
        cols.append(F.sum(F.when(F.col("rn") <= percent_rank(F.col("n"), p), F.col("w")).otherwise(0.0)).alias(f"full_top{p}pct_mass"))
        cols.append(F.when(left, F.sum(F.when((~F.col("special")) & (F.col("ern") <= percent_rank(F.col("en"), p)), F.col("ew")).otherwise(0.0))).otherwise(1.0).alias(f"effective_top{p}pct_mass"))
    return rows.groupBy(*keys, "qpos").agg(*cols)


def head_statistics(logits: DataFrame, percents: Sequence[int] = (1, 5), keys: Sequence[str] = KEYS) -> DataFrame:
    """Means of the query statistics of each head."""
    rows = query_stats(logits, percents, keys)
    names = [c for c in rows.columns if c not in (*keys, "qpos")]
    return rows.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in names])


def top_k_mass(logits: DataFrame, ks: Sequence[int], keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, qpos, k, mass) of the k largest weights; 1 where there are no more than k."""
    q = by_query(keys)
    rows = weights(logits, keys).withColumn("rn", F.row_number().over(q.orderBy(F.desc("w"), "pos")))
    sums = rows.groupBy(*keys, "qpos").agg(F.count("*").alias("n"), *[F.sum(F.when(F.col("rn") <= k, F.col("w"))).alias(f"m{k}") for k in ks])
    return sums.select(*keys, "qpos", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.when(F.col("n") <= k, 1.0).otherwise(F.col(f"m{k}")).alias("mass")) for k in ks])).alias("x")).select(*keys, "qpos", "x.k", "x.mass")


def concentration(logits: DataFrame, percents: Sequence[int] = PERCENTS, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, qpos, pct, mass) of the top pct per cent."""
    q = by_query(keys)
    rows = weights(logits, keys).withColumn("rn", F.row_number().over(q.orderBy(F.desc("w"), "pos"))).withColumn("n", F.count("*").over(q))
    sums = rows.groupBy(*keys, "qpos").agg(*[F.sum(F.when(F.col("rn") <= percent_rank(F.col("n"), p), F.col("w"))).alias(f"m{p}") for p in percents])
    return sums.select(*keys, "qpos", F.explode(F.array(*[F.struct(F.lit(p).alias("pct"), F.col(f"m{p}").alias("mass")) for p in percents])).alias("x")).select(*keys, "qpos", "x.pct", "x.mass")


def correlation(a: Column, b: Column) -> Column:
    """Aggregate: Pearson's r; 0 for fewer than two rows, null where a side is constant."""
    return F.when(F.count("*") < 2, 0.0).otherwise(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def norm_statistics(vectors: DataFrame, column: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean, deviation and coefficient of variation of the vectors' lengths."""
    n = norm(column)
    return vectors.groupBy(*keys).agg(F.avg(n).alias("norm_mean"), F.stddev_pop(n).alias("norm_std"), (F.stddev_pop(n) / F.greatest(F.avg(n), F.lit(1e-10))).alias("norm_cv"))


def norm_correlation(vectors: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Correlation of the lengths of keys and values."""
    return vectors.groupBy(*keys).agg(correlation(norm("k"), norm("v")).alias("corr"))


def top_norm_correlation(logits: DataFrame, vectors: DataFrame, pct: float = 10.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """The same over the top pct per cent of keys of every query, put together with their repeats."""
    q = by_query(keys)
    top = logits.withColumn("rn", F.row_number().over(q.orderBy(F.desc("logit"), "pos"))).withColumn("n", F.count("*").over(q)).filter(F.col("rn") <= percent_rank(F.col("n"), pct))
    sizes = vectors.select(*keys, "pos", norm("k").alias("kn"), norm("v").alias("vn"))
    return top.select(*keys, "pos").join(sizes, [*keys, "pos"]).groupBy(*keys).agg(correlation(F.col("kn"), F.col("vn")).alias("corr"), F.count("*").alias("n_pairs"))


def query_deviation(queries: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Distance of each query to its head's mean query, plain and relative to the query's length."""
    mean = queries.groupBy(*keys).agg(vector_mean("q").alias("m"))
    rows = queries.join(mean, list(keys))
    d = norm(minus("q", "m"))
    return rows.select(*keys, "qpos", norm("q").alias("q_norm"), d.alias("deviation"), (d / F.greatest(norm("q"), F.lit(1e-10))).alias("relative_deviation"))


def select_heads(stats: DataFrame, metric: str = "effective_entropy", percentiles: Sequence[int] = (0, 25, 50, 75, 100), keys: Sequence[str] = KEYS, ties: Sequence[str] = ()) -> DataFrame:
    """The heads at the percentiles of a metric (half-even rounding); of equal picks the smallest percentile stays."""
    w = Window.orderBy(metric, *(ties or keys))  # heads of a model: a small, bounded table
    ranks = stats.select(*keys, metric, (F.row_number().over(w) - 1).alias("r"), F.count("*").over(Window.partitionBy()).alias("n"))
    asked = ranks.withColumn("percentile", F.explode(F.array(*map(F.lit, percentiles))))
    picked = asked.filter(F.col("r") == F.bround(F.col("percentile") / 100 * (F.col("n") - 1)))
    return picked.groupBy(*keys).agg(F.min("percentile").alias("percentile"), F.first(metric).alias(metric))


def layer_averages(stats: DataFrame) -> DataFrame:
    """(task, layer, metric, value): mean over the heads of a layer."""
    return stats.groupBy("task", "layer", "metric").agg(F.avg("value").alias("value"))


def quantiles(stats: DataFrame, by: Sequence[str], value: str = "value", at: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Interpolated quantiles of a value."""
    return stats.groupBy(*by).agg(*[F.percentile(value, q).alias(f"q{round(100 * q):02d}") for q in at])


def concentration_at(logits: DataFrame, shares: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9), percents: Sequence[int] = PERCENTS, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, share, qpos, pct, mass): the concentration of the queries at some shares of the queries' order."""
    rows = concentration(logits, percents, keys)
    nth = rows.select(*keys, "qpos").distinct().withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("qpos")) - 1)
    nth = nth.withColumn("n", F.count("*").over(Window.partitionBy(*keys))).withColumn("share", F.explode(F.array(*map(F.lit, shares))))
    return nth.filter(F.col("r") == F.floor(F.col("n") * F.col("share"))).join(rows, [*keys, "qpos"]).select(*keys, "share", "qpos", "pct", "mass")


def mean_query_norm(queries: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, mean_q_norm): the length of a head's mean query."""
    return queries.groupBy(*keys).agg(vector_mean("q").alias("m")).select(*keys, norm("m").alias("mean_q_norm"))
