"""Exploration: pairs by distance, smoothing, separation of queries and keys, approximation curves, projections."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.vectors import cosine, dot, draw, minus, norm, numbers, vector_mean
from tidemark.operators.stats import correlation
from tidemark.plans.attention import KEYS


def pairs(anchors: DataFrame, vectors: DataFrame, kind: str, dim: int, n_sink: int = 1, most: int | None = None, seed: int = 42, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, pos_a, pos_b, dist, is_sink, cos, dot) of anchor positions and their targets.

    qk: keys up to the query; qq, kk: all other positions of the same kind. most: targets kept per anchor, by hash;
    position 0 always stays. anchors: keys, pos.
    """
    left, right = {"qk": ("q", "k"), "qq": ("q", "q"), "kk": ("k", "k")}[kind]
    a = anchors.join(vectors, [*keys, "pos"]).select(*keys, F.col("pos").alias("pos_a"), F.col(left).alias("a"))
    b = vectors.select(*keys, F.col("pos").alias("pos_b"), F.col(right).alias("b"))
    rows = a.join(b, list(keys)).filter(F.col("pos_b") <= F.col("pos_a") if kind == "qk" else F.col("pos_b") != F.col("pos_a"))
    if most is not None:
        w = Window.partitionBy(*keys, "pos_a").orderBy(F.desc(F.col("pos_b") == 0), draw(F.col("pos_b"), seed=seed), "pos_b")
        rows = rows.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most).drop("r")
    sink = F.col("pos_b") < n_sink if kind == "qk" else (F.col("pos_b") < n_sink) | (F.col("pos_a") < n_sink)
    return rows.select(*keys, "pos_a", "pos_b", F.abs(F.col("pos_a") - F.col("pos_b")).alias("dist"), sink.alias("is_sink"), cosine("a", "b").alias("cos"), (dot("a", "b") * dim**-0.5).alias("dot"))


def category(is_sink: Column, dist: Column, local_window: int) -> Column:
    return F.when(is_sink, "sink").when(dist <= local_window, "local").otherwise("global")


def pair_weights(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """rows with w: the softmax of dot over the targets of an anchor."""
    at = Window.partitionBy(*keys, "pos_a")
    e = F.exp(F.col("dot") - F.max("dot").over(at))
    return rows.withColumn("e", e).withColumn("w", F.col("e") / F.sum("e").over(at)).drop("e")


def by_distance(rows: DataFrame, value: str, bins: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean and standard error of a value in bins of equally many distances; a bin's centre is geometric."""
    cuts = F.percentile("dist", F.array(*[F.lit(i / bins) for i in range(bins + 1)]))
    edges = rows.groupBy(*keys).agg(F.array_distinct(F.transform(cuts, lambda e: F.round(e, 9))).alias("edges"))
    at = F.greatest(F.lit(1), F.least(F.size(F.filter("edges", lambda e: e <= F.col("dist"))), F.size("edges") - 1))
    binned = rows.join(edges, list(keys)).withColumn("bin", at.cast("long"))
    lo, hi = F.get("edges", (F.col("bin") - 1).cast("int")), F.get("edges", F.col("bin").cast("int"))
    centre = F.sqrt(F.greatest(lo, F.lit(1.0)) * F.greatest(hi, F.lit(1.0)))
    return binned.groupBy(*keys, "bin").agg(F.first(centre).alias("centre"), F.avg(value).alias("mean"), (F.stddev_pop(value) / F.sqrt(F.count("*"))).alias("sem"), F.count("*").alias("n"))


def smoothed(rows: DataFrame, order: Sequence[str], value: str, span: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """rows with ema: s = a x + (1 - a) s, a = 2 / (span + 1), from the first value on; one Arrow group a head."""
    plain = rows.select(*keys, *order, value)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order))
        return pdf.assign(ema=pdf[value].ewm(span=span, adjust=False).mean())

    return plain.groupBy(*keys).applyInPandas(run, plain.withColumn("ema", F.lit(0.0)).schema)


def position_group(kind: Column, pos: Column, is_sink: Column, length: Column, edge: int = 1024) -> Column:
    """First, middle and last positions of queries and keys; the sink is its own, and last wins over first."""
    part = F.when(pos >= length - edge, "last").when(pos < edge, "first").otherwise("mid")
    return F.when(is_sink, "sink").otherwise(F.concat(kind, F.lit("_"), part))


#: Sums over the pairs of two blocks of positions.
SUMS = "iq double, ik double, ix double"


def separation(vectors: DataFrame, keys: Sequence[str] = KEYS, sample: int | None = None, seed: int = 42, block: int = 512) -> DataFrame:
    """Distance of the centroids of queries and keys, mean distances inside and between, and their ratio.

    All pairs: positions are dealt into blocks, and each pair of blocks is one row, whose distances are products of two
    matrices. With `sample`, that many drawn partners a position. Inside a kind equal positions are left out; between
    kinds they count.
    """
    rows = _sampled_distances(vectors, keys, sample, seed) if sample else _all_distances(vectors, keys, block)
    centre = vectors.groupBy(*keys).agg(vector_mean("q").alias("cq"), vector_mean("k").alias("ck")).select(*keys, norm(minus("cq", "ck")).alias("centroid_distance"))
    return rows.join(centre, list(keys)).withColumn("ratio", F.col("inter") / F.greatest((F.col("intra_q") + F.col("intra_k")) / 2, F.lit(1e-10)))


def _all_distances(vectors: DataFrame, keys: Sequence[str], block: int) -> DataFrame:
    blocks = vectors.groupBy(*keys, F.floor(F.col("pos") / block).alias("part")).agg(F.count("*").alias("n"), F.collect_list(F.struct("q", "k")).alias("rows"))
    a = blocks.select(*keys, F.col("part").alias("a"), F.col("rows.q").alias("qa"), F.col("rows.k").alias("ka"))
    b = blocks.select(*keys, F.col("part").alias("b"), F.col("rows.q").alias("qb"), F.col("rows.k").alias("kb"))

    def total(x: np.ndarray, y: np.ndarray) -> float:
        square = (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T)
        return float(np.sqrt(np.maximum(square, 0)).sum())

    @F.pandas_udf(SUMS)
    def sums(qa: pd.Series, ka: pd.Series, qb: pd.Series, kb: pd.Series, same: pd.Series) -> pd.DataFrame:
        out = []
        for *four, one in zip(qa, ka, qb, kb, same, strict=True):
            q, k, p, r = (np.array(list(x), float) for x in four)
            if one:  # the diagonal is 0, but for rounding
                own = [np.sqrt(np.maximum((m * m).sum(1) * 2 - 2 * np.einsum("ij,ij->i", m, m), 0)).sum() for m in (q, k)]
                out.append((total(q, p) - own[0], total(k, r) - own[1], total(q, r)))
            else:  # both ways round
                out.append((2 * total(q, p), 2 * total(k, r), total(q, r) + total(p, k)))
        return pd.DataFrame(out, columns=["iq", "ik", "ix"])

    each = a.join(b, list(keys)).filter("a <= b").select(*keys, sums("qa", "ka", "qb", "kb", F.col("a") == F.col("b")).alias("s"))
    n = blocks.groupBy(*keys).agg(F.sum("n").alias("n"))
    all_ = each.groupBy(*keys).agg(*[F.sum(f"s.{c}").alias(c) for c in ("iq", "ik", "ix")]).join(n, list(keys))
    others = F.col("n") * (F.col("n") - 1)
    return all_.filter("n > 1").select(*keys, (F.col("iq") / others).alias("intra_q"), (F.col("ik") / others).alias("intra_k"), (F.col("ix") / (F.col("n") * F.col("n"))).alias("inter"))


def _sampled_distances(vectors: DataFrame, keys: Sequence[str], sample: int, seed: int) -> DataFrame:
    a = vectors.select(*keys, F.col("pos").alias("i"), F.col("q").alias("qi"), F.col("k").alias("ki"))
    b = vectors.select(*keys, F.col("pos").alias("j"), F.col("q").alias("qj"), F.col("k").alias("kj"))
    ends = vectors.groupBy(*keys).agg(F.count("*").alias("n"))
    drawn = a.join(ends, list(keys)).withColumn("o", F.explode(F.sequence(F.lit(1), F.lit(sample))))
    drawn = drawn.withColumn("j", F.floor(draw(F.col("i"), F.col("o"), seed=seed) * F.col("n")))
    d = lambda x, y: norm(minus(x, y))
    apart = F.col("i") != F.col("j")
    p = drawn.drop("o", "n").join(b, [*keys, "j"])
    return p.groupBy(*keys).agg(F.avg(F.when(apart, d("qi", "qj"))).alias("intra_q"), F.avg(F.when(apart, d("ki", "kj"))).alias("intra_k"), F.avg(d("qi", "kj")).alias("inter"))


def mean_query(logits: DataFrame, queries: DataFrame, vectors: DataFrame, dim: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Correlation of the logits with those of the head's mean query."""
    mean = queries.groupBy(*keys).agg(vector_mean("q").alias("m"))
    flat = vectors.join(mean, list(keys)).select(*keys, "pos", (dot("m", "k") * dim**-0.5).alias("mean_logit"))
    rows = logits.select(*keys, "qpos", "pos", "logit").join(flat, [*keys, "pos"])
    return rows.groupBy(*keys).agg(correlation(F.col("logit"), F.col("mean_logit")).alias("corr"), F.count("*").alias("n_pairs"))


def principal(vectors: DataFrame, column: str, k: int = 2) -> tuple[DataFrame, list[float]]:
    """Rows with their first k principal coordinates (centred), and the shares of variance."""
    mean = vectors.agg(vector_mean(column).alias("m"))
    rows = vectors.crossJoin(F.broadcast(mean)).withColumn("features", array_to_vector(minus(column, "m"))).drop("m")  # one row
    model = PCA(k=k, inputCol="features", outputCol="pc").fit(rows)
    return model.transform(rows).withColumn("pc", vector_to_array("pc")).drop("features"), list(model.explainedVariance)


def histogram(rows: DataFrame, value: str, lo: float, hi: float, bins: int, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Density of a value in equal bins, weighted if asked: plot data of the histograms."""
    w = F.col(weight) if weight else F.lit(1.0)
    at = F.least(F.floor((F.col(value) - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("long")
    sums = rows.filter(F.col(value).between(lo, hi)).withColumn("bin", at).groupBy(*by, "bin").agg(F.sum(w).alias("s"))
    return sums.withColumn("density", F.col("s") / F.sum("s").over(Window.partitionBy(*by)) / ((hi - lo) / bins)).drop("s")


def family(method: Column) -> tuple[Column, Column, Column]:
    """Family, mode and k of a method's name: plot data of the curves."""
    pattern = r"^(.*?)(?:-(topk|hybrid)-k(\d+))?$"
    empty = lambda c: F.nullif(c, F.lit(""))
    return F.regexp_extract(method, pattern, 1), empty(F.regexp_extract(method, pattern, 2)), empty(F.regexp_extract(method, pattern, 3)).cast("int")


def sampled_cosines(vectors: DataFrame, n: int = 1000, seed: int = 42, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, i, pos_q, pos_k, cos) of n query-key pairs a head, drawn with repeats; never more than there are."""
    ends = vectors.groupBy(*keys).agg(F.count("*").alias("m"))
    at = ends.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(n).cast("long"), F.col("m") * F.col("m")))))
    pick = lambda s: F.floor(draw(*numbers(vectors, keys), F.col("i"), seed=s) * F.col("m"))
    at = at.select(*keys, "i", pick(seed).alias("pos_q"), pick(seed + 1).alias("pos_k"))
    q = vectors.select(*keys, F.col("pos").alias("pos_q"), "q")
    k = vectors.select(*keys, F.col("pos").alias("pos_k"), "k")
    return at.join(q, [*keys, "pos_q"]).join(k, [*keys, "pos_k"]).select(*keys, "i", "pos_q", "pos_k", cosine("q", "k").alias("cos"))


def histogram2d(rows: DataFrame, x: str, y: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, x_bin, y_bin, n): counts in equal bins between the extremes of both: plot data of a density of pairs."""
    ends = rows.groupBy(*by).agg(*[f(c).alias(f"{n}_{c}") for c in (x, y) for n, f in (("lo", F.min), ("hi", F.max))])
    wide = rows.join(ends, list(by)) if by else rows.crossJoin(F.broadcast(ends))  # one row
    place = lambda c: F.least(F.floor((F.col(c) - F.col(f"lo_{c}")) / F.greatest(F.col(f"hi_{c}") - F.col(f"lo_{c}"), F.lit(1e-300)) * bins), F.lit(bins - 1))
    return wide.groupBy(*by, place(x).cast("long").alias("x_bin"), place(y).cast("long").alias("y_bin")).agg(F.count("*").alias("n"))


def fit_sample(vectors: DataFrame, n_fit: int = 50_000, seed: int = 42, edge: int = 1024, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, kind, pos, is_sink, grp, vec): at most half of n_fit queries and keys of each head, key 0 among them."""
    length = vectors.groupBy(*keys).agg(F.count("*").alias("length"))
    rows = vectors.join(length, list(keys))
    q = rows.select(*keys, F.lit("Q").alias("kind"), "pos", "length", F.lit(False).alias("is_sink"), F.col("q").alias("vec"))
    k = rows.select(*keys, F.lit("K").alias("kind"), "pos", "length", (F.col("pos") == 0).alias("is_sink"), F.col("k").alias("vec"))
    w = Window.partitionBy(*keys, "kind").orderBy(F.desc("is_sink"), draw(F.col("pos"), F.when(F.col("kind") == "Q", 1).otherwise(2), seed=seed), "pos")
    few = q.unionByName(k).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n_fit // 2)
    return few.select(*keys, "kind", "pos", "is_sink", position_group(F.col("kind"), F.col("pos"), F.col("is_sink"), F.col("length"), edge).alias("grp"), "vec")


def projected(sample: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The sample with its first two principal coordinates (x, y; the sign makes the largest loading positive) and their
    shares of variance. One Arrow group a head, of at most the sample's size."""
    plain = sample.select(*keys, "kind", "pos", "is_sink", "grp", "vec")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.array(pdf["vec"].tolist(), float)
        m -= m.mean(axis=0)
        value, axes = np.linalg.eigh(m.T @ m)
        value, axes = np.maximum(value[::-1], 0), axes[:, ::-1][:, :2]
        axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), [0, 1]])
        x = m @ axes
        share = value[:2] / max(value.sum(), 1e-300)
        return pdf.drop(columns="vec").assign(x=x[:, 0], y=x[:, 1], share_x=share[0], share_y=share[1])

    out = plain.drop("vec").withColumns({c: F.lit(0.0) for c in ("x", "y", "share_x", "share_y")})
    return plain.groupBy(*keys).applyInPandas(fit, out.schema)


def kind_separation(points: DataFrame, column: str, sample: int = 20, seed: int = 42, keys: Sequence[str] = KEYS) -> DataFrame:
    """Separation of the queries and keys of a sample, in any space: centroids, drawn pairs inside and between, ratio.

    points: keys, kind, pos, and the vector `column`.
    """
    w = Window.partitionBy(*keys, "kind").orderBy("pos")
    rows = points.select(*keys, "kind", F.col(column).alias("u"), (F.row_number().over(w) - 1).cast("long").alias("i"))
    ends = rows.groupBy(*keys).agg(*[F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).alias(f"n{k}") for k in "QK"])
    other = rows.select(*keys, F.col("kind").alias("kind2"), F.col("u").alias("u2"), F.col("i").alias("j"))
    drawn = rows.join(ends, list(keys)).withColumn("o", F.explode(F.sequence(F.lit(1), F.lit(sample))))
    pick = lambda k, s: F.struct(F.lit(k).alias("kind2"), F.floor(draw(F.col("i"), F.col("o"), seed=s) * F.col(f"n{k}")).alias("j"))
    both = F.when(F.col("kind") == "Q", F.array(pick("Q", seed), pick("K", seed + 1))).otherwise(F.array(pick("K", seed)))
    p = drawn.select(*keys, "kind", "u", "i", F.explode(both).alias("t")).select(*keys, "kind", "u", "i", "t.*").join(other, [*keys, "kind2", "j"])
    d, one = norm(minus("u", "u2")), F.col("kind") == F.col("kind2")
    means = p.groupBy(*keys).agg(
        F.avg(F.when(one & (F.col("kind") == "Q") & (F.col("i") != F.col("j")), d)).alias("intra_q"),
        F.avg(F.when(one & (F.col("kind") == "K") & (F.col("i") != F.col("j")), d)).alias("intra_k"), F.avg(F.when(~one, d)).alias("inter"))
    pairs = [vector_mean(F.col("u"), F.when(F.col("kind") == k, 1.0).otherwise(0.0)).alias(f"c{k}") for k in "QK"]
    centre = rows.groupBy(*keys).agg(*pairs).select(*keys, norm(minus("cQ", "cK")).alias("centroid_distance"))
    return means.join(centre, list(keys)).withColumn("ratio", F.col("inter") / F.greatest((F.col("intra_q") + F.col("intra_k")) / 2, F.lit(1e-10)))
