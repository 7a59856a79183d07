"""Five ways to attend to a part of the keys, compared over budgets; no key is kept beside the budget.

topk: the largest logits. uniform: any keys, without repeats. ideal_sampling: as many draws as the budget with chances
by weight, repeats counted once. ideal_equal_splits and ideal_equal_weight_splits: all keys as groups of equal size or
of about equal weight. Budgets that a query has no more keys than are left out for it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.vectors import draw, norm, numbers
from tidemark.operators.grouping import equal_weight_groups
from tidemark.operators.methods import combine
from tidemark.plans import attention as A

COMPARED = ("topk", "uniform", "ideal_sampling", "ideal_equal_splits", "ideal_equal_weight_splits")
BUDGETS = (16, 32, 64, 128, 512, 1024, 2048, 4096, 8192, 16384)


def ranked_keys(logits: DataFrame, seed: int, keys: Sequence[str] = A.KEYS) -> DataFrame:
    """All keys of each query: p (rank by logit), n, w (weight), run (weight up to p) and u (rank by a draw)."""
    q = A.by_query(keys)
    rows = A.ranked(A.weights(logits, keys).withColumn("special", F.lit(False)), keys)
    run = F.sum("w").over(q.orderBy("p").rowsBetween(Window.unboundedPreceding, 0))
    chance = draw(*numbers(logits, keys), F.col("qpos"), F.col("pos"), seed=seed)
    return rows.withColumn("run", run).withColumn("u", F.row_number().over(q.orderBy(chance, "pos")) - 1)


def with_budgets(rows: DataFrame, budgets: Sequence[int]) -> DataFrame:
    return rows.withColumn("b", F.explode(F.array(*[F.lit(int(b)).cast("long") for b in budgets]))).filter("b < n")


def drawn_keys(rows: DataFrame, budgets: Sequence[int], seed: int, keys: Sequence[str] = A.KEYS) -> DataFrame:
    """(keys, qpos, b, p) of the keys hit by b draws: draws and keys are put in order of running weight together, and a
    draw takes the first key that reaches it."""
    some = with_budgets(rows.groupBy(*keys, "qpos").agg(F.max("n").alias("n")), budgets)
    tries = some.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("b"))))
    chance = draw(*numbers(rows, keys), F.col("qpos"), F.col("b"), F.col("i"), seed=seed)
    tries = tries.select(*keys, "qpos", "b", chance.alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("int").alias("p"))
    marks = with_budgets(rows.select(*keys, "qpos", "p", "n", "run"), budgets)
    marks = marks.select(*keys, "qpos", "b", F.col("run").alias("at"), F.lit(1).alias("kind"), "p")
    down = A.by_query(keys, "b").orderBy(F.desc("at"), F.desc("kind"), F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    hit = tries.unionByName(marks).withColumn("p", F.last("p", ignorenulls=True).over(down))
    return hit.filter("kind = 0 and p is not null").select(*keys, "qpos", "b", "p").distinct()


def grouping_error(items: DataFrame, truth: DataFrame, keys: Sequence[str] = A.KEYS) -> DataFrame:
    """(keys, qpos, method, requested_budget, rel_l2_error) of groups of keys, each standing for its members by their
    mean key and value. items: keys, qpos, method, requested_budget, item, logit, v."""
    return A.errors(combine(items, keys), truth, keys).select(*keys, "qpos", "method", "requested_budget", "rel_l2_error")


def comparison(logits: DataFrame, budgets: Sequence[int] = BUDGETS, seed: int = 42, keys: Sequence[str] = A.KEYS) -> DataFrame:
    """The error of every method, query and budget."""
    rows = ranked_keys(logits, seed, keys)
    every = with_budgets(rows, budgets)
    hit = drawn_keys(rows, budgets, seed, keys).withColumn("hit", F.lit(True))
    every = every.join(hit, [*keys, "qpos", "b", "p"], "left")
    one = F.col("pos")
    lone = F.array(*[
        F.when(F.col("p") < F.col("b"), F.struct(F.lit("topk").alias("method"), one.alias("item"))),
        F.when(F.col("u") < F.col("b"), F.struct(F.lit("uniform").alias("method"), one.alias("item"))),
        F.when(F.col("hit"), F.struct(F.lit("ideal_sampling").alias("method"), one.alias("item"))),
        F.struct(F.lit("ideal_equal_splits").alias("method"), A.equal_group(F.col("p"), F.col("n"), F.col("b")).alias("item")),
    ])
    cols = [*keys, "qpos", "method", "requested_budget", "item", "logit", "v"]
    most = every.select("*", F.explode(F.filter(lone, lambda x: x.isNotNull())).alias("m"))
    most = most.select(*keys, "qpos", "m.method", F.col("b").alias("requested_budget"), F.col("m.item").cast("long").alias("item"), "logit", "v")
    split = equal_weight_groups(rows, budgets, False, keys).filter("b < n").withColumn("method", F.lit("ideal_equal_weight_splits"))
    split = split.withColumn("requested_budget", F.col("b")).withColumn("item", F.col("gid"))
    truth = A.full_attention(logits, keys).filter(norm("truth") >= 1e-10)
    return grouping_error(most.select(*cols).unionByName(split.select(*cols)), truth, keys)


def curves(errors: DataFrame, heads: DataFrame, budgets: Sequence[int] = BUDGETS, keys: Sequence[str] = A.KEYS) -> DataFrame:
    """(keys, method, requested_budget, mean, std, n_queries) for every head, method and budget; 0 where no query counts."""
    spark = heads.sparkSession
    grid = spark.createDataFrame([(m, int(b)) for m in COMPARED for b in budgets], "method string, requested_budget long")
    found = errors.groupBy(*keys, "method", "requested_budget").agg(F.avg("rel_l2_error").alias("mean"), F.stddev_pop("rel_l2_error").alias("std"), F.count("*").alias("n_queries"))
    out = heads.select(*keys).distinct().crossJoin(F.broadcast(grid)).join(found, [*keys, "method", "requested_budget"], "left")  # five times the budgets
    return out.select(*keys, "method", "requested_budget", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("mean", "std", "n_queries")])
