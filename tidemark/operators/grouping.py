"""Groupings of keys: clusters, equal mass, routes and hash buckets."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.vectors import dot, minus, vector_mean, vertex
from tidemark.plans.attention import KEYS, by_query


def distances(data: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows and centres."""
    return np.maximum((data**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * data @ centres.T, 0)


def kmeans(data: np.ndarray, clusters: int, seed: int = 42, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """k-means with seeds drawn by squared distance; ends when no label changes; an empty cluster keeps its centre.

    Labels start at 0, so a single cluster ends before its first update and keeps the drawn point.
    """
    rng = np.random.default_rng(seed)
    centres = data[rng.choice(len(data), 1)].astype(float)
    near = distances(data, centres)[:, 0]
    for _ in range(1, min(clusters, len(data))):
        share = near / near.sum() if near.any() else None
        centres = np.vstack([centres, data[rng.choice(len(data), 1, p=share)]])
        near = np.minimum(near, distances(data, centres[-1:])[:, 0])
    labels = np.zeros(len(data), np.int64)
    for _ in range(rounds):
        now = distances(data, centres).argmin(axis=1)
        if np.array_equal(now, labels):
            break
        labels = now
        member = np.eye(len(centres))[labels]
        size = member.sum(axis=0)[:, None]
        centres = np.where(size > 0, member.T @ data / np.maximum(size, 1), centres)
    return centres, labels


def cluster(vectors: DataFrame, clusters: int, column: str = "k", seed: int = 42, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, pos, cid): k-means of each head's vectors, one Arrow group a head."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        _, labels = kmeans(np.array(pdf["x"].tolist(), float), clusters, seed)
        return pdf[[*keys, "pos"]].assign(cid=labels)

    rows = vectors.select(*keys, "pos", F.col(column).alias("x"))
    return rows.groupBy(*keys).applyInPandas(fit, rows.drop("x").withColumn("cid", F.lit(0).cast("long")).schema)


def cluster_stats(vectors: DataFrame, labels: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, cid, mean_k, mean_v, size) of the labelled keys."""
    return vectors.join(labels, [*keys, "pos"]).groupBy(*keys, "cid").agg(vector_mean("k").alias("mean_k"), vector_mean("v").alias("mean_v"), F.count("*").alias("size"))


def nearest(points: DataFrame, centres: DataFrame, x: str, c: str, keys: Sequence[str] = KEYS, by: str = "dot") -> DataFrame:
    """points with the cid of the centre of their head that has the largest dot product, or the least distance."""
    score = dot(x, c) if by == "dot" else -dot(minus(x, c), minus(x, c))
    pairs = points.join(centres.select(*keys, "cid", c), list(keys)).withColumn("score", score)
    rest = [n for n in points.columns]
    w = Window.partitionBy(*[n for n in rest if n in (*keys, "pos", "qpos")]).orderBy(F.desc("score"), "cid")
    return pairs.withColumn("r", F.row_number().over(w)).filter("r = 1").select(*rest, "cid")


def equal_weight_boundaries(ranked: DataFrame, budgets: Sequence[int], keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, qpos, b, n, total, cuts): for each budget b, the first ranks whose running weight reaches j/b of the whole,
    distinct and in order. One pass for all budgets: how many targets a rank has passed follows from its running weight.

    ranked: keys, qpos, p, n, w with p the 0-based rank by descending weight.
    """
    w = by_query(keys)
    run = F.round(F.sum("w").over(w.orderBy("p").rowsBetween(Window.unboundedPreceding, 0)), 12)
    rows = ranked.select(*keys, "qpos", "p", "n", run.alias("run"), F.sum("w").over(w).alias("total"))
    rows = rows.withColumn("b", F.explode(_budgets(budgets))).withColumn("g", F.least("b", "n"))
    near = F.floor(F.coalesce(F.try_divide(F.col("run") * F.col("g"), F.col("total")), F.lit(0.0)))  # right, or one off by rounding
    reached = lambda j: F.round(F.col("total") * j / F.col("g"), 12) <= F.col("run")
    passed = F.when(reached(near + 1), near + 1).when(reached(near), near).otherwise(near - 1)
    rows = rows.withColumn("passed", F.least(F.greatest(passed, F.lit(0)), F.col("g") - 1))
    before = F.coalesce(F.lag("passed").over(by_query(keys, "b").orderBy("p")), F.lit(0))
    cut = F.when(F.col("passed") > F.col("before"), F.least(F.greatest(F.col("p"), F.lit(1)), F.col("n") - 1).cast("long"))
    rows = rows.withColumn("before", before)
    return rows.groupBy(*keys, "qpos", "b").agg(F.max("n").alias("n"), F.max("total").alias("total"), F.array_sort(F.collect_set(cut)).alias("cuts"))


def _budgets(budgets: Sequence[int]):
    return F.array(*[F.lit(int(b)).cast("long") for b in budgets])


def refilled(cuts: list[int], n: int, groups: int) -> list[int]:
    """Cuts of exactly `groups` segments: the first longest one is halved until there are enough."""
    if groups >= n:
        return list(range(1, n))
    edges = [0, *cuts, n]
    while len(edges) - 1 < groups:
        sizes = np.diff(edges)
        at = int(np.argmax(sizes))
        if sizes[at] < 2:
            break
        edges.insert(at + 1, (edges[at] + edges[at + 1]) // 2)
    return [int(e) for e in edges[1:-1]]


def equal_weight_groups(ranked: DataFrame, budgets: Sequence[int], refill: bool = True, keys: Sequence[str] = KEYS) -> DataFrame:
    """ranked for each budget b with gid: groups of about equal weight, filled up to exactly b (or n) if asked.

    Only the cuts, at most b a query, go through Arrow; a rank's group is the number of cuts up to it.
    """
    cuts = equal_weight_boundaries(ranked, budgets, keys)
    if refill:

        @F.pandas_udf("array<long>")
        def fill(cut: pd.Series, n: pd.Series, total: pd.Series, b: pd.Series) -> pd.Series:
            out = []
            for c, m, t, g in zip(cut, n.astype(int), total, np.minimum(b, n).astype(int), strict=True):
                out.append(refilled(list(c), m, g) if t >= 1e-12 or g >= m else [i * max(1, m // g) for i in range(1, g)])
            return pd.Series(out)

        cuts = cuts.withColumn("cuts", fill("cuts", "n", "total", "b"))
    marks = cuts.select(*keys, "qpos", "b", F.explode("cuts").alias("p"), F.lit(1).cast("long").alias("mark"))
    rows = ranked.withColumn("p", F.col("p").cast("long")).withColumn("b", F.explode(_budgets(budgets)))
    upto = by_query(keys, "b").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(marks, [*keys, "qpos", "b", "p"], "left").withColumn("gid", F.coalesce(F.sum("mark").over(upto), F.lit(0)).cast("long")).drop("mark")


def hash_buckets(vectors: DataFrame, r1: list[list[float]] | None, r2: list[list[float]] | None, dim: int, keys: Sequence[str] = KEYS, sink: int = 1) -> DataFrame:
    """(keys, pos, k, v, bucket): pairs of cross-polytope vertices of two rotations of the centred keys.

    A rotation of None is the identity. The first `sink` keys have a bucket of their own, (2 dim)^2.
    """
    mean = vectors.groupBy(*keys).agg(vector_mean("k").alias("mean_k"))
    rows = vectors.join(mean, list(keys)).withColumn("c", minus("k", "mean_k"))
    rows = rows.withColumn("z1", rotated(F.col("c"), r1)).withColumn("z2", rotated(F.col("c"), r2))
    label = vertex("z1") * (2 * dim) + vertex("z2")
    return rows.select(*keys, "pos", "k", "v", F.when(F.col("pos") < sink, F.lit((2 * dim) ** 2).cast("long")).otherwise(label).alias("bucket"))


def rotated(x, rotation: list[list[float]] | None):
    """x times the rotation, many rows at a time in numpy; None is the identity."""
    if rotation is None:
        return x

    @F.pandas_udf("array<double>")
    def turn(col: pd.Series) -> pd.Series:
        return pd.Series(list(np.array(col.tolist(), float).reshape(len(col), -1) @ np.array(rotation).T))

    return turn(x)


def random_rotation(dim: int, seed: int) -> list[list[float]]:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).tolist()


def bucket_stats(buckets: DataFrame, queries: DataFrame, dim: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, bucket, mean_k, mean_v, mass, size): values weighted by exp(mean query . k / sqrt(dim))."""
    mean_q = queries.groupBy(*keys).agg(vector_mean("q").alias("mean_q"))
    rows = buckets.join(mean_q, list(keys)).withColumn("corr", F.exp(dot("mean_q", "k") * dim**-0.5))
    return rows.groupBy(*keys, "bucket").agg(vector_mean("k").alias("mean_k"), vector_mean("v", F.col("corr")).alias("mean_v"), F.sum("corr").alias("mass"), F.count("*").alias("size"))
