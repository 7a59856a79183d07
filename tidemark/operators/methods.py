"""Attention under a limited budget.

Every method turns the logits into items (a kept key, or a group with avg(logit) + ln(size) and its mean value); one
softmax-weighted mean over the items is the output, and their number the budget used. New methods are registered
with `register`; a method is a function (context) -> DataFrame of `OUTPUT` columns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.vectors import dot, draw, minus, normalised, numbers, vector_mean, vertex_scores
from tidemark.operators.grouping import bucket_stats, cluster, cluster_stats, equal_weight_groups, hash_buckets, nearest, random_rotation, rotated
from tidemark.plans.attention import KEYS, by_query, equal_group, ranked

OUTPUT = ("qpos", "method", "requested_budget", "output", "budget")


@dataclass
class Context:
    """What a method may use: the vectors, the queries, their logits, and the budgets asked."""

    vectors: DataFrame
    queries: DataFrame
    logits: DataFrame
    dim: int
    budgets: Sequence[int] = (16,)
    keys: Sequence[str] = KEYS
    seed: int = 42
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Method:
    name: str
    kind: str
    run: Callable[[Context], DataFrame]
    sweeps_budget: bool = True


METHODS: dict[str, Method] = {}


def register(name: str, kind: str, sweeps_budget: bool = True):
    def add(run: Callable[[Context], DataFrame]):
        METHODS[name] = Method(name, kind, run, sweeps_budget)
        return run

    return add


def combine(items: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """items: keys, qpos, method, requested_budget, item, logit, v. Rows of one item are its members."""
    by = [*keys, "qpos", "method", "requested_budget"]
    one = items.groupBy(*by, "item").agg((F.avg("logit") + F.log(F.count("*"))).alias("score"), vector_mean("v").alias("v"))
    e = F.exp(F.col("score") - F.max("score").over(Window.partitionBy(*by)))
    return one.withColumn("e", e).groupBy(*by).agg(vector_mean("v", F.col("e")).alias("output"), F.count("*").alias("budget"))


def kept(items: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """As combine, where every row is an item of its own: one aggregate."""
    by = [*keys, "qpos", "method", "requested_budget"]
    e = F.exp(F.col("logit") - F.max("logit").over(Window.partitionBy(*by)))
    return items.withColumn("e", e).groupBy(*by).agg(vector_mean("v", F.col("e")).alias("output"), F.count("*").alias("budget"))


def named(rows: DataFrame, name: str, budget: Column) -> DataFrame:
    return rows.withColumn("method", F.lit(name)).withColumn("requested_budget", budget.cast("long"))


def _swept(c: Context, rows: DataFrame) -> DataFrame:
    return rows.withColumn("b", F.explode(F.array(*[F.lit(int(b)) for b in c.budgets])))


def _special(c: Context, rows: DataFrame, name: str) -> DataFrame:
    special = _swept(c, rows.filter("special"))
    return named(special, name, F.col("b")).withColumn("item", F.concat(F.lit("s"), F.col("pos").cast("string")))


def _columns(c: Context) -> list[str]:
    return [*c.keys, "qpos", "method", "requested_budget", "item", "logit", "v"]


@register("IdealTopK", "idealized")
def ideal_topk(c: Context) -> DataFrame:
    """Special keys and the candidates of the largest logits."""
    top = max(c.budgets)
    best = _swept(c, ranked(c.logits, c.keys).filter(F.col("p") < top)).filter(F.col("p") < F.col("b"))
    best = named(best, "IdealTopK", F.col("b")).withColumn("item", F.concat(F.lit("c"), F.col("pos").cast("string")))
    return kept(_special(c, c.logits, "IdealTopK").select(*_columns(c)).unionByName(best.select(*_columns(c))), c.keys)


def draw_key(c: Context) -> Column:
    """A uniform number for each (query, key)."""
    return draw(*numbers(c.logits, c.keys), F.col("qpos"), F.col("pos"), seed=c.seed)


@register("IdealSampling", "idealized")
def ideal_sampling(c: Context) -> DataFrame:
    """Special keys and distinct candidates drawn with chances by weight: the smallest -ln(u)/w, as many as the budget."""
    w = by_query(c.keys)
    rows = c.logits.filter(~F.col("special")).withColumn("e", F.exp(F.col("logit") - F.max("logit").over(w)))
    rows = rows.withColumn("t", -F.log(draw_key(c)) / F.col("e")).withColumn("p", F.row_number().over(w.orderBy("t", "pos")) - 1).filter(F.col("p") < max(c.budgets))
    drawn = named(_swept(c, rows).filter(F.col("p") < F.col("b")), "IdealSampling", F.col("b")).withColumn("item", F.concat(F.lit("c"), F.col("pos").cast("string")))
    return kept(_special(c, c.logits, "IdealSampling").select(*_columns(c)).unionByName(drawn.select(*_columns(c))), c.keys)


@register("IdealEqualSplits", "idealized")
def ideal_equal_splits(c: Context) -> DataFrame:
    """Special keys and as many groups of equal size, in order of logit, as the budget."""
    rows = _swept(c, ranked(c.logits, c.keys))
    rows = named(rows, "IdealEqualSplits", F.col("b")).withColumn("item", F.concat(F.lit("g"), equal_group(F.col("p"), F.col("n"), F.col("b")).cast("string")))
    return combine(_special(c, c.logits, "IdealEqualSplits").select(*_columns(c)).unionByName(rows.select(*_columns(c))), c.keys)


@register("IdealEqualWeightSplits", "idealized")
def ideal_equal_weight_splits(c: Context) -> DataFrame:
    """Special keys and groups of equal weight; `refill` (the default) makes exactly as many as the budget."""
    w = by_query(c.keys)
    rows = ranked(c.logits, c.keys).withColumn("w", F.exp(F.col("logit") - F.max("logit").over(w)))
    rows = rows.withColumn("w", F.col("w") / F.sum("w").over(w))
    groups = equal_weight_groups(rows, c.budgets, c.options.get("refill", True), c.keys)
    groups = named(groups, "IdealEqualWeightSplits", F.col("b")).withColumn("item", F.concat(F.lit("g"), F.col("gid").cast("string")))
    return combine(_special(c, c.logits, "IdealEqualWeightSplits").select(*_columns(c)).unionByName(groups.select(*_columns(c))), c.keys)


def hybrid(c: Context, grouped: DataFrame, name: str) -> DataFrame:
    """Attention over ranked groups, for all `modes` and `top_k_sweep` in one plan. grouped: logits of candidates with gid, 0 the best.

    topk: special keys and the members of the first k groups. hybrid: the other groups too, one item each.
    Queries without candidates have no row: their output is zero.
    """
    swept = [(m, k) for m in c.options.get("modes", ["hybrid"]) for k in c.options.get("top_k_sweep", [5])]
    settings = [F.struct(F.lit(f"{name}-{m}-k{k}").alias("method"), F.lit(m == "hybrid").alias("rest"), F.lit(k).alias("top")) for m, k in swept]
    cols = [*c.keys, "qpos", "pos", "gid", "logit", "v"]
    special = c.logits.filter("special").withColumn("gid", F.lit(-1).cast("long"))
    rows = special.select(*cols).unionByName(grouped.select(*cols)).withColumn("last", F.max("gid").over(by_query(c.keys))).filter("last >= 0")
    rows = rows.withColumn("s", F.explode(F.array(*settings))).select(*cols, "s.*").filter("rest OR gid < top")
    item = F.when(F.col("gid") < 0, F.concat(F.lit("s"), F.col("pos").cast("string"))).when(F.col("gid") < F.col("top"), F.concat(F.lit("c"), F.col("pos").cast("string")))
    item = F.coalesce(item, F.concat(F.lit("g"), F.col("gid").cast("string")))
    return combine(rows.withColumn("item", item).withColumn("requested_budget", F.lit(0).cast("long")), c.keys)


def kmeans_groups(c: Context, labels: DataFrame) -> DataFrame:
    """Candidates with gid: their cluster's rank by q . mean key / sqrt(dim) + ln(causal members).

    The mean is over the whole cluster, later keys too; the count is of the query's own candidates.
    """
    stats = cluster_stats(c.vectors, labels, c.keys).select(*c.keys, "cid", "mean_k")
    rows = c.logits.filter(~F.col("special")).join(labels, [*c.keys, "pos"])
    counts = rows.groupBy(*c.keys, "qpos", "cid").agg(F.count("*").alias("m"))
    scored = counts.join(stats, [*c.keys, "cid"]).join(c.queries, [*c.keys, "qpos"]).withColumn("s", dot("q", "mean_k") * c.dim**-0.5 + F.log("m"))
    order = scored.select(*c.keys, "qpos", "cid", (F.row_number().over(by_query(c.keys).orderBy(F.desc("s"), "cid")) - 1).cast("long").alias("gid"))
    return rows.join(order, [*c.keys, "qpos", "cid"])


@register("KMeans", "algorithm", sweeps_budget=False)
def kmeans_attention(c: Context) -> DataFrame:
    """Clusters of keys, ranked for each query; options: n_clusters, modes, top_k_sweep, labels."""
    n = c.options.get("n_clusters", 256)
    labels = c.options.get("labels")
    grouped = kmeans_groups(c, cluster(c.vectors, n, "k", c.seed, c.keys) if labels is None else labels)
    return hybrid(c, grouped, f"KMeans-C{n}")


def multiq_groups(c: Context, centres: DataFrame, n_groups: int) -> DataFrame:
    """Candidates with gid: equal groups in the order of the keys for the query's nearest centre (largest dot product)."""
    routed = nearest(c.queries, centres, "q", "centre", c.keys)
    order = c.vectors.select(*c.keys, "pos", "k").join(centres, list(c.keys)).select(*c.keys, "pos", "cid", dot("k", "centre").alias("d"))
    rows = c.logits.filter(~F.col("special")).join(routed.select(*c.keys, "qpos", "cid"), [*c.keys, "qpos"]).join(order, [*c.keys, "cid", "pos"])
    w = by_query(c.keys)
    p = F.row_number().over(w.orderBy(F.desc("d"), "pos")) - 1
    return rows.withColumn("p", p).withColumn("n", F.count("*").over(w)).withColumn("gid", equal_group(F.col("p"), F.col("n"), F.lit(n_groups).cast("long")))


@register("MultiQ", "algorithm", sweeps_budget=False)
def multiq_attention(c: Context) -> DataFrame:
    """Key orders by query centres; options: n_query_clusters, n_groups, modes, top_k_sweep, centres."""
    q, g = c.options.get("n_query_clusters", 32), c.options.get("n_groups", 32)
    centres = c.options.get("centres")
    if centres is None:
        if c.queries is None:
            raise ValueError("MultiQ needs queries")
        every = c.vectors.select(*c.keys, "pos", "q")
        labels = cluster(every, q, "q", c.seed, c.keys)
        centres = every.join(labels, [*c.keys, "pos"]).groupBy(*c.keys, "cid").agg(vector_mean("q").alias("centre"))
    grouped = multiq_groups(c, centres, g)
    return hybrid(c, grouped, f"MultiQ-Q{q}-G{g}")


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@register("LSH-CrossPoly", "algorithm")
def lsh_attention(c: Context) -> DataFrame:
    """Buckets probed by the product of the query's vertex chances; the first key's bucket comes first.

    A bucket's weight is exp(q' . mean key / sqrt(dim)) * mass / chance with q' the query less the mean query.
    options: rotations, a pair of matrices or None for the identity.
    """
    r1, r2 = c.options.get("rotations", (random_rotation(c.dim, c.seed), random_rotation(c.dim, c.seed + 1)))
    width, sink = 2 * c.dim, (2 * c.dim) ** 2
    every = c.vectors.select(*c.keys, F.col("pos").alias("qpos"), "q")
    stats = bucket_stats(hash_buckets(c.vectors, r1, r2, c.dim, c.keys), every, c.dim, c.keys)
    means = c.vectors.groupBy(*c.keys).agg(vector_mean("q").alias("mean_q"), vector_mean("k").alias("mean_key"))
    q = c.queries.join(means, list(c.keys)).withColumn("qc", minus("q", "mean_q")).withColumn("z", minus("qc", "mean_key"))
    q = q.withColumn("z1", rotated(F.col("z"), r1)).withColumn("z2", rotated(F.col("z"), r2))
    q = q.select(*c.keys, "qpos", "qc", normalised(vertex_scores("z1")).alias("pi1"), normalised(vertex_scores("z2")).alias("pi2"))
    pairs = q.join(stats, list(c.keys))
    chance = F.when(F.col("bucket") == sink, 1.0).otherwise(F.get("pi1", F.floor(F.col("bucket") / width).cast("int")) * F.get("pi2", (F.col("bucket") % width).cast("int")))
    first = (F.col("bucket") == sink).cast("int")
    rows = pairs.withColumn("pi", chance).withColumn("p", F.row_number().over(by_query(c.keys).orderBy(F.desc(first), F.desc("pi"), "bucket")) - 1)
    logit = dot("qc", "mean_k") * c.dim**-0.5 + F.log(F.greatest("mass", F.lit(1e-30))) - F.log(F.greatest("pi", F.lit(1e-30)))
    has = F.max(first).over(by_query(c.keys))
    rows = _swept(c, rows.withColumn("logit", logit).withColumn("has", has)).filter(F.col("p") < F.greatest(F.col("b"), F.col("has")))
    return kept(named(rows, "LSH-CrossPoly", F.col("b")).withColumnRenamed("mean_v", "v"), c.keys)


def evaluate(c: Context, names: Sequence[str], truth: DataFrame) -> DataFrame:
    """Result rows of the methods named, with their error against the truth; a query a method has no row for has error 1."""
    from tidemark.plans.attention import errors

    rows = _all([METHODS[n].run(c).select(*c.keys, *OUTPUT) for n in names])
    kinds = F.create_map(*[F.lit(x) for n in names for x in (n, METHODS[n].kind)])
    family = F.regexp_replace("method", r"^(KMeans|MultiQ)-.*$", "$1")
    return errors(rows, truth, c.keys).withColumn("method_kind", F.element_at(kinds, family))
