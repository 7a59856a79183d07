"""The engine's queries over the driver's tables, each with the SQL that another engine can check it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import vectors as V
from tidemark.operators import aggregate, explore, grouping, methods, report, stats
from tidemark.plans import attention as A
from tidemark.sources import sinks, tables

DIM, N, WINDOW = 64, 10, 4
BUDGETS = (4, 8, 16)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return tables.from_embeddings(spark.read.parquet(f"{sf}/embeddings.parquet"))


def logits(v: DataFrame, window: int = WINDOW) -> DataFrame:
    return A.causal_logits(A.last_queries(v, N), v, DIM, 1, window)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) + 0.0 for c in columns})


# ---- SQL the oracles share

BASE = f"""
vec AS (SELECT CAST(label AS BIGINT) AS head, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
vecs AS (SELECT head, pos, e AS q, list_transform(e, lambda x: x * (1 + (pos % 7) / 10.0)) AS k, list_transform(list_reverse(e), lambda x: x * (1 + ((pos * 3) % 11) / 10.0)) AS v FROM vec),
qs AS (SELECT head, pos AS qpos, q FROM (SELECT *, max(pos) OVER (PARTITION BY head) AS mx FROM vecs) WHERE pos > mx - {N}),
lg AS (SELECT head, qpos, pos, list_inner_product(qs.q, k) / 8.0 AS logit, (pos < 1 OR pos >= greatest(1, qpos + 1 - {WINDOW})) AS special, v FROM qs JOIN vecs USING (head) WHERE pos <= qpos),
wt AS (SELECT *, ex / sum(ex) OVER (PARTITION BY head, qpos) AS w FROM (SELECT head, qpos, pos, special, logit, v, exp(logit - max(logit) OVER (PARTITION BY head, qpos)) AS ex FROM lg) t)"""


def vmean(rows: str, group: str, weight: str, value: str = "v") -> str:
    """Weighted mean of vectors of `rows`, as list o."""
    return f"SELECT {group}, list(s ORDER BY i) AS o FROM (SELECT {group}, i, sum({weight} * {value}[i]) / sum({weight}) AS s FROM (SELECT *, unnest(generate_series(1, {DIM})) AS i FROM {rows}) u GROUP BY {group}, i) u2 GROUP BY {group}"


TRUTH = BASE + f", truth AS ({vmean('wt', 'head, qpos', 'w')})"
ERR = "CASE WHEN sqrt(list_inner_product(t.o, t.o)) < 1e-10 THEN 0 ELSE sqrt(list_aggregate(list_transform(list_zip(x.o, t.o), lambda p: (p[1] - p[2]) * (p[1] - p[2])), 'sum')) / sqrt(list_inner_product(t.o, t.o)) END"
RANKED = TRUTH + ", rk AS (SELECT *, row_number() OVER (PARTITION BY head, qpos ORDER BY logit DESC, pos) - 1 AS p, count(*) OVER (PARTITION BY head, qpos) AS n FROM wt WHERE NOT special), bud AS (SELECT unnest([4, 8, 16]) AS b)"


def items_error(items: str, base: str = RANKED, by: str = "head, qpos, b", extra: str = "") -> str:
    """Errors of a method from its rows (head, qpos, b, item, logit, v)."""
    return f"""WITH {base}, it AS ({items}),
one AS (SELECT {by}, item, avg(logit) + ln(count(*)) AS sc FROM it GROUP BY {by}, item),
val AS ({vmean('it', by + ', item', '1.0')}),
ev AS (SELECT one.*, val.o AS v FROM one JOIN val USING ({by}, item)),
ex AS (SELECT *, exp(sc - max(sc) OVER (PARTITION BY {by})) AS e FROM ev),
outp AS ({vmean('ex', by, 'e')}), cnt AS (SELECT {by}, count(*) AS budget FROM one GROUP BY {by})
SELECT x.head, x.qpos, {extra}CAST(x.b AS BIGINT) AS requested_budget, CAST(budget AS BIGINT) AS budget, round({ERR}, 6) AS rel_l2_error FROM outp x JOIN truth t USING (head, qpos) JOIN cnt USING ({by})"""


def context(spark: SparkSession, sf: str, budgets=BUDGETS, window: int = WINDOW, **options) -> methods.Context:
    v = vectors(spark, sf)
    return methods.Context(v, A.last_queries(v, N), logits(v, window), DIM, budgets, options=options)


def method_errors(c: methods.Context, rows: DataFrame) -> DataFrame:
    out = A.errors(rows, A.full_attention(c.logits))
    return rounded(out.select("head", "qpos", "requested_budget", F.col("budget").cast("long"), "rel_l2_error"), "rel_l2_error")


# ---- attention and its statistics


@query(f"WITH {TRUTH} SELECT head, qpos, round(sqrt(list_inner_product(o, o)), 6) AS out_norm, round(o[1], 6) AS first FROM truth")
def full_attention_norm(spark, sf):
    out = A.full_attention(logits(vectors(spark, sf)))
    return rounded(out.select("head", "qpos", V.norm("truth").alias("out_norm"), F.get("truth", F.lit(0)).alias("first")), "out_norm", "first")


_STATS = BASE + """, l AS (SELECT *, sum(CASE WHEN special THEN 0 ELSE w END) OVER (PARTITION BY head, qpos) AS lf FROM wt),
r AS (SELECT *, CASE WHEN NOT special AND lf > 1e-10 THEN w / lf ELSE 0 END AS ew, row_number() OVER (PARTITION BY head, qpos ORDER BY w DESC, pos) AS rn, count(*) OVER (PARTITION BY head, qpos) AS n,
 row_number() OVER (PARTITION BY head, qpos ORDER BY special, w DESC, pos) AS ern, sum(CASE WHEN special THEN 0 ELSE 1 END) OVER (PARTITION BY head, qpos) AS en FROM l),
st AS (SELECT head, qpos, sum(CASE WHEN w > 1e-30 THEN -w * ln(w) ELSE 0 END) AS full_entropy,
 CASE WHEN max(lf) > 1e-10 THEN sum(CASE WHEN ew > 1e-30 THEN -ew * ln(ew) ELSE 0 END) ELSE 0 END AS effective_entropy, """ + ", ".join(
    f"sum(CASE WHEN rn <= greatest(1, floor(n * {p} / 100)) THEN w ELSE 0 END) AS full_top{p}pct_mass, CASE WHEN max(lf) > 1e-10 THEN sum(CASE WHEN NOT special AND ern <= greatest(1, floor(en * {p} / 100)) THEN ew ELSE 0 END) ELSE 1 END AS effective_top{p}pct_mass" for p in (1, 5)) + " FROM r GROUP BY head, qpos)"
_NAMES = ("full_entropy", "effective_entropy", "full_top1pct_mass", "effective_top1pct_mass", "full_top5pct_mass", "effective_top5pct_mass")


@query(f"WITH {_STATS} SELECT head, qpos, {', '.join(f'round({c}, 6) AS {c}' for c in _NAMES)} FROM st")
def query_statistics(spark, sf):
    return rounded(stats.query_stats(logits(vectors(spark, sf))), *_NAMES)


@query(f"WITH {_STATS} SELECT head, qpos, round(full_entropy, 6) AS full_entropy, round(effective_entropy, 6) AS effective_entropy, round(ln(greatest(qpos, 1)), 6) AS uniform FROM st")
def entropy_by_position(spark, sf):
    rows = stats.query_stats(logits(vectors(spark, sf))).select("head", "qpos", "full_entropy", "effective_entropy", F.log(F.greatest("qpos", F.lit(1))).alias("uniform"))
    return rounded(rows, "full_entropy", "effective_entropy", "uniform")


_HEADS = _STATS + ", hs AS (SELECT head, " + ", ".join(f"avg({c}) AS {c}" for c in _NAMES) + " FROM st GROUP BY head)"


@query(f"WITH {_HEADS} SELECT head, {', '.join(f'round({c}, 6) AS {c}' for c in _NAMES)} FROM hs")
def head_statistics(spark, sf):
    return rounded(stats.head_statistics(logits(vectors(spark, sf))), *_NAMES)


@query(f"WITH {_HEADS}, rr AS (SELECT head, round(effective_entropy, 9) AS m, row_number() OVER (ORDER BY round(effective_entropy, 9), head) - 1 AS r, count(*) OVER () AS n FROM hs), pc AS (SELECT unnest([0, 25, 50, 75, 100]) AS pct) SELECT head, min(pct) AS percentile, round(any_value(m), 6) AS effective_entropy FROM rr, pc WHERE r = round_even(pct / 100.0 * (n - 1), 0) GROUP BY head")
def select_heads(spark, sf):
    rows = stats.head_statistics(logits(vectors(spark, sf))).withColumn("effective_entropy", F.round("effective_entropy", 9))
    return rounded(stats.select_heads(rows), "effective_entropy")


_LONG = "lng AS (" + " UNION ALL ".join(f"SELECT CAST(head % 3 AS INTEGER) AS layer, head, '{c}' AS metric, {c} AS value FROM hs" for c in _NAMES) + ")"


def _long(spark, sf, window: int = WINDOW) -> DataFrame:
    rows = stats.head_statistics(logits(vectors(spark, sf), window))
    return rows.select(F.lit("t").alias("task"), (F.col("head") % 3).cast("int").alias("layer"), "head", F.explode(F.create_map(*[x for c in _NAMES for x in (F.lit(c), F.col(c))])).alias("metric", "value"))


@query(f"WITH {_HEADS}, {_LONG} SELECT layer, metric, round(avg(value), 6) AS value FROM lng GROUP BY layer, metric")
def layer_averages(spark, sf):
    return rounded(stats.layer_averages(_long(spark, sf)).drop("task"), "value")


@query(f"WITH {_HEADS}, {_LONG} SELECT metric, " + ", ".join(f"round(quantile_cont(value, {q}), 6) AS q{round(100 * q):02d}" for q in (0.05, 0.25, 0.5, 0.75, 0.95)) + " FROM lng GROUP BY metric")
def stability_quantiles(spark, sf):
    return rounded(stats.quantiles(_long(spark, sf), ["metric"]), "q05", "q25", "q50", "q75", "q95")


@query(f"WITH {_HEADS}, {_LONG} SELECT layer, CAST(head AS INTEGER) AS head, metric, round(value, 6) AS value FROM lng")
def head_stats_json_roundtrip(spark, sf):
    import uuid

    path = f"{tables.shared_folder(spark)}/headstats-{uuid.uuid4().hex}"
    sinks.head_statistics(_long(spark, sf)).select(F.concat(F.regexp_replace("json", r"^\{", '{"metadata":{"n":1},')).alias("value")).coalesce(1).write.text(path, compression="none")
    rows = tables.head_statistics_json(spark, path, "*.txt")
    return rounded(rows.select("layer", "head", "metric", "value"), "value")


@query(f"WITH {BASE}, r AS (SELECT *, row_number() OVER (PARTITION BY head, qpos ORDER BY w DESC, pos) AS rn, count(*) OVER (PARTITION BY head, qpos) AS n FROM wt), ks AS (SELECT unnest([10, 50, 100, 200, 500]) AS k) SELECT head, qpos, k, round(CASE WHEN max(n) <= k THEN 1 ELSE sum(CASE WHEN rn <= k THEN w ELSE 0 END) END, 6) AS mass FROM r, ks GROUP BY head, qpos, k")
def topk_mass(spark, sf):
    return rounded(stats.top_k_mass(logits(vectors(spark, sf)), (10, 50, 100, 200, 500)), "mass")


@query(f"WITH {BASE}, r AS (SELECT *, row_number() OVER (PARTITION BY head, qpos ORDER BY w DESC, pos) AS rn, count(*) OVER (PARTITION BY head, qpos) AS n FROM wt), ps AS (SELECT unnest([1, 5, 10, 20, 50]) AS pct) SELECT head, qpos, pct, round(sum(CASE WHEN rn <= greatest(1, floor(n * pct / 100)) THEN w ELSE 0 END), 6) AS mass FROM r, ps GROUP BY head, qpos, pct")
def concentration_curve(spark, sf):
    return rounded(stats.concentration(logits(vectors(spark, sf))), "mass")


@query(f"WITH {BASE}, r AS (SELECT *, row_number() OVER (PARTITION BY head, qpos ORDER BY w DESC, pos) AS rn, count(*) OVER (PARTITION BY head, qpos) AS n FROM wt) SELECT head, qpos, round(sum(CASE WHEN rn <= greatest(1, floor(n * 10 / 100)) THEN w ELSE 0 END), 6) AS mass FROM r GROUP BY head, qpos")
def toppct_mass(spark, sf):
    return rounded(stats.concentration(logits(vectors(spark, sf)), (10,)).drop("pct"), "mass")


@query(f"WITH {BASE} SELECT head, qpos, special, count(*) AS n FROM lg GROUP BY head, qpos, special")
def special_candidate_split(spark, sf):
    return logits(vectors(spark, sf)).groupBy("head", "qpos", "special").agg(F.count("*").alias("n"))


@query(f"WITH {BASE}, n AS (SELECT head, sqrt(list_inner_product(k, k)) AS kn FROM vecs) SELECT head, round(avg(kn), 6) AS norm_mean, round(stddev_pop(kn), 6) AS norm_std, round(stddev_pop(kn) / greatest(avg(kn), 1e-10), 6) AS norm_cv FROM n GROUP BY head")
def norm_statistics(spark, sf):
    return rounded(stats.norm_statistics(vectors(spark, sf), "k"), "norm_mean", "norm_std", "norm_cv")


@query(f"WITH {BASE}, n AS (SELECT head, sqrt(list_inner_product(k, k)) AS kn, sqrt(list_inner_product(v, v)) AS vn FROM vecs) SELECT head, round(corr(kn, vn), 6) AS corr FROM n GROUP BY head")
def kv_norm_correlation(spark, sf):
    return rounded(stats.norm_correlation(vectors(spark, sf)), "corr")


@query(f"WITH {BASE}, r AS (SELECT head, qpos, pos, row_number() OVER (PARTITION BY head, qpos ORDER BY logit DESC, pos) AS rn, count(*) OVER (PARTITION BY head, qpos) AS n FROM lg), m AS (SELECT head, sqrt(list_inner_product(k, k)) AS kn, sqrt(list_inner_product(vecs.v, vecs.v)) AS vn FROM r JOIN vecs USING (head, pos) WHERE rn <= greatest(1, floor(n * 10 / 100))) SELECT head, round(corr(kn, vn), 6) AS corr, count(*) AS n_pairs FROM m GROUP BY head")
def kv_norm_top_keys(spark, sf):
    v = vectors(spark, sf)
    return rounded(stats.top_norm_correlation(logits(v), v), "corr")


# ---- methods

_TOP = "SELECT head, qpos, b, pos AS item, logit, v FROM wt, bud WHERE special UNION ALL SELECT head, qpos, b, pos AS item, logit, v FROM rk, bud WHERE p < b"


@query(items_error(_TOP))
def ideal_topk_budget_sweep(spark, sf):
    c = context(spark, sf)
    return method_errors(c, methods.ideal_topk(c))


@query(items_error(_TOP.replace("FROM wt, bud", "FROM wt, (SELECT 16 AS b) bud").replace("FROM rk, bud", "FROM rk, (SELECT 16 AS b) bud")))
def ideal_topk_error(spark, sf):
    c = context(spark, sf, (16,))
    return method_errors(c, methods.ideal_topk(c))


_DRAWN = f"""SELECT *, row_number() OVER (PARTITION BY head, qpos ORDER BY -ln({V.draw_sql('head', 'qpos', 'pos', seed=42)}) / exp(logit - mxl), pos) - 1 AS dr
FROM (SELECT *, max(logit) OVER (PARTITION BY head, qpos) AS mxl FROM rk) a"""


@query(items_error(f"SELECT head, qpos, b, pos AS item, logit, v FROM wt, bud WHERE special UNION ALL SELECT head, qpos, b, pos, logit, v FROM ({_DRAWN}) z, bud WHERE dr < b"))
def ideal_sampling(spark, sf):
    c = context(spark, sf)
    return method_errors(c, methods.ideal_sampling(c))


_EQ = "least(floor(p / greatest(1, floor(n / least(b, n)))), least(b, n) - 1)"


@query(items_error(f"SELECT head, qpos, b, 's' || pos AS item, logit, v FROM wt, bud WHERE special UNION ALL SELECT head, qpos, b, 'g' || CAST({_EQ} AS BIGINT) AS item, logit, v FROM rk, bud"))
def ideal_equal_splits(spark, sf):
    c = context(spark, sf)
    return method_errors(c, methods.ideal_equal_splits(c))


_CUTS = """, rw AS (SELECT head, qpos, p, n, logit, v, ex / sum(ex) OVER (PARTITION BY head, qpos) AS cw FROM (SELECT *, exp(logit - max(logit) OVER (PARTITION BY head, qpos)) AS ex2 FROM rk) a),
cu AS (SELECT *, round(sum(cw) OVER (PARTITION BY head, qpos ORDER BY p), 12) AS run, sum(cw) OVER (PARTITION BY head, qpos) AS total FROM rw),
tg AS (SELECT head, qpos, b, j FROM (SELECT DISTINCT head, qpos, n FROM rk) h, bud, (SELECT unnest(generate_series(1, 15)) AS j) s WHERE j < least(b, n)),
bo AS (SELECT DISTINCT tg.head, tg.qpos, tg.b, least(greatest(min(p), 1), max(n) - 1) AS cut FROM tg JOIN cu ON cu.head = tg.head AND cu.qpos = tg.qpos AND cu.run >= round(total * j / least(tg.b, n), 12) GROUP BY tg.head, tg.qpos, tg.b, tg.j),
gr AS (SELECT cu.head, cu.qpos, bud.b, cu.p, cu.logit, cu.v, count(bo.cut) AS gid FROM cu CROSS JOIN bud LEFT JOIN bo ON bo.head = cu.head AND bo.qpos = cu.qpos AND bo.b = bud.b AND bo.cut <= cu.p GROUP BY cu.head, cu.qpos, bud.b, cu.p, cu.logit, cu.v)"""


@query(items_error("SELECT head, qpos, b, 's' || pos AS item, logit, v FROM wt, bud WHERE special UNION ALL SELECT head, qpos, b, 'g' || gid AS item, logit, v FROM gr", RANKED + _CUTS))
def ideal_equal_weight_splits_no_refill(spark, sf):
    c = context(spark, sf, refill=False)
    return method_errors(c, methods.ideal_equal_weight_splits(c))


_SIZES = "list_transform(range(1, len(ed)), lambda i: ed[i + 1] - ed[i])"
# the first longest group is halved, again and again
_REFILLED = _CUTS + f""", hn AS (SELECT DISTINCT head, qpos, n FROM rk),
e0 AS (SELECT head, qpos, b, n, least(b, n) AS g, CASE WHEN b >= n THEN range(0, n + 1) ELSE list_concat(list_concat([0], coalesce(cuts, [])), [n]) END AS ed
 FROM (SELECT hn.*, CAST(bud.b AS BIGINT) AS b FROM hn, bud) h LEFT JOIN (SELECT head, qpos, b, list(cut ORDER BY cut) AS cuts FROM bo GROUP BY head, qpos, b) c USING (head, qpos, b)),
er AS (SELECT * FROM e0 UNION ALL SELECT head, qpos, b, n, g, list_concat(list_concat(list_slice(ed, 1, big), [(ed[big] + ed[big + 1]) // 2]), list_slice(ed, big + 1, len(ed)))
 FROM (SELECT *, list_position(sz, list_max(sz)) AS big FROM (SELECT *, {_SIZES} AS sz FROM er) s) s2 WHERE len(ed) - 1 < g AND sz[big] >= 2),
ef AS (SELECT head, qpos, b, arg_max(ed, len(ed)) AS ed FROM er GROUP BY head, qpos, b),
gf AS (SELECT head, qpos, b, p, logit, v, len(list_filter(ed, lambda e: e > 0 AND e <= p)) AS gid FROM cu JOIN ef USING (head, qpos))"""


@query(items_error("SELECT head, qpos, b, 's' || pos AS item, logit, v FROM wt, bud WHERE special UNION ALL SELECT head, qpos, b, 'g' || gid AS item, logit, v FROM gf", RANKED + _REFILLED).replace("WITH ", "WITH RECURSIVE ", 1))
def ideal_equal_weight_splits(spark, sf):
    c = context(spark, sf)
    return method_errors(c, methods.ideal_equal_weight_splits(c))


@query(f"WITH {RANKED} SELECT head, qpos, pos, CAST(p AS BIGINT) AS p, CAST({_EQ} AS BIGINT) AS gid FROM rk, (SELECT 8 AS b) bb")
def equal_groups_assignment(spark, sf):
    rows = A.ranked(logits(vectors(spark, sf)))
    return rows.select("head", "qpos", "pos", F.col("p").cast("long"), A.equal_group(F.col("p"), F.col("n"), F.lit(8).cast("long")).alias("gid"))


@query(f"WITH {RANKED} SELECT head, qpos, CAST(CASE WHEN p = 0 THEN 0 ELSE floor(log2(p)) + 1 END AS BIGINT) AS gid, min(p) AS first, count(*) AS size FROM rk GROUP BY ALL")
def doubling_boundaries(spark, sf):
    rows = A.ranked(logits(vectors(spark, sf)))
    return rows.withColumn("gid", A.doubling_group(F.col("p"))).groupBy("head", "qpos", "gid").agg(F.min("p").cast("long").alias("first"), F.count("*").alias("size"))


def _labels(v: DataFrame) -> DataFrame:
    return v.select("head", "pos", (F.col("pos") * 7 % 5).cast("long").alias("cid"))


_LAB = f", lab AS (SELECT head, pos, pos * 7 % 5 AS cid FROM vecs), cl AS (SELECT head, pos, cid, k FROM vecs JOIN lab USING (head, pos)), cm AS ({vmean('cl', 'head, cid', '1.0', 'k')}), cn AS (SELECT head, cid, count(*) AS size FROM lab GROUP BY head, cid)"


@query(f"WITH {BASE}{_LAB} SELECT head, cid, size, round(o[1], 6) AS k1, round(sqrt(list_inner_product(o, o)), 6) AS k_norm FROM cm JOIN cn USING (head, cid)")
def cluster_stats_by_label(spark, sf):
    v = vectors(spark, sf)
    rows = grouping.cluster_stats(v, _labels(v))
    return rounded(rows.select("head", "cid", "size", F.get("mean_k", F.lit(0)).alias("k1"), V.norm("mean_k").alias("k_norm")), "k1", "k_norm")


_KM = _LAB + """, ca AS (SELECT head, qpos, pos, logit, v, cid FROM wt JOIN lab USING (head, pos) WHERE NOT special), cc AS (SELECT head, qpos, cid, count(*) AS m FROM ca GROUP BY head, qpos, cid),
so AS (SELECT head, qpos, cid, row_number() OVER (PARTITION BY head, qpos ORDER BY list_inner_product(q, o) / 8.0 + ln(m) DESC, cid) - 1 AS gid FROM cc JOIN cm USING (head, cid) JOIN qs USING (head, qpos)), km AS (SELECT ca.*, gid FROM ca JOIN so USING (head, qpos, cid))"""


@query(items_error("SELECT head, qpos, 0 AS b, 's' || pos AS item, logit, v FROM wt WHERE special UNION ALL SELECT head, qpos, 0 AS b, CASE WHEN gid < 2 THEN 'c' || pos ELSE 'g' || gid END AS item, logit, v FROM km", RANKED + _KM))
def kmeans_attention_hybrid(spark, sf):
    c = context(spark, sf, top_k_sweep=[2], modes=["hybrid"])
    c.options["labels"] = _labels(c.vectors)
    return method_errors(c, methods.kmeans_attention(c))


@query(items_error("SELECT head, qpos, 0 AS b, 's' || pos AS item, logit, v FROM wt WHERE special UNION ALL SELECT head, qpos, 0 AS b, 'c' || pos AS item, logit, v FROM km WHERE gid < 2", RANKED + _KM))
def kmeans_attention_topk(spark, sf):
    c = context(spark, sf, top_k_sweep=[2], modes=["topk"])
    c.options["labels"] = _labels(c.vectors)
    return method_errors(c, methods.kmeans_attention(c))


@query()
def flat_kmeans(spark, sf):
    return grouping.cluster(vectors(spark, sf), 8).groupBy("head", "cid").agg(F.count("*").alias("size"))


@query()
def kmeans_attention(spark, sf):
    c = context(spark, sf, n_clusters=8, modes=["topk", "hybrid"], top_k_sweep=[0, 1, 3])
    rows = methods.evaluate(c, ["KMeans"], A.full_attention(c.logits))
    return rounded(rows.select("head", "qpos", "method", "method_kind", F.col("budget").cast("long"), "rel_l2_error"), "rel_l2_error")


_CEN = f", qc AS (SELECT head, pos, pos % 3 AS cid, q FROM vecs), ce AS ({vmean('qc', 'head, cid', '1.0', 'q')}), ro AS (SELECT head, qpos, cid FROM (SELECT head, qpos, cid, row_number() OVER (PARTITION BY head, qpos ORDER BY list_inner_product(q, o) DESC, cid) AS r FROM qs JOIN ce USING (head)) z WHERE r = 1)"


def _centres(v: DataFrame) -> DataFrame:
    return v.withColumn("cid", (F.col("pos") % 3).cast("long")).groupBy("head", "cid").agg(V.vector_mean("q").alias("centre"))


@query(f"WITH {BASE}{_CEN} SELECT head, qpos, cid FROM ro")
def multiq_route(spark, sf):
    v = vectors(spark, sf)
    return grouping.nearest(A.last_queries(v, N), _centres(v), "q", "centre").select("head", "qpos", "cid")


@query(items_error("""SELECT head, qpos, 0 AS b, 's' || pos AS item, logit, v FROM wt WHERE special UNION ALL SELECT head, qpos, 0 AS b, CASE WHEN gid < 2 THEN 'c' || pos ELSE 'g' || gid END AS item, logit, v FROM
 (SELECT *, CAST(least(floor(mp / greatest(1, floor(mn / least(6, mn)))), least(6, mn) - 1) AS BIGINT) AS gid FROM (SELECT head, qpos, wt.pos, wt.logit, wt.v, row_number() OVER (PARTITION BY head, qpos ORDER BY list_inner_product(vecs.k, o) DESC, wt.pos) - 1 AS mp, count(*) OVER (PARTITION BY head, qpos) AS mn FROM wt JOIN ro USING (head, qpos) JOIN ce USING (head, cid) JOIN vecs USING (head, pos) WHERE NOT special) y) y2""", RANKED + _CEN))
def multiq_attention(spark, sf):
    c = context(spark, sf, n_query_clusters=3, n_groups=6, modes=["hybrid"], top_k_sweep=[2])
    c.options["centres"] = _centres(c.vectors)
    return method_errors(c, methods.multiq_attention(c))


_ARG = "(list_position(list_transform({z}, lambda x: abs(x)), list_aggregate(list_transform({z}, lambda x: abs(x)), 'max')) - 1)"


def _vertex_sql(z: str) -> str:
    i = _ARG.format(z=z)
    return f"(2 * {i} + CASE WHEN {z}[{i} + 1] < 0 THEN 1 ELSE 0 END)"


def _lsh(r1: list | None, r2: list | None) -> str:
    """Buckets and their statistics under two rotations; None is the identity."""
    turn = lambda r: "c" if r is None else f"list_transform({r}, lambda r: list_inner_product(r, c))"
    return f""", mk AS ({vmean('vecs', 'head', '1.0', 'k')}), mq AS ({vmean('vecs', 'head', '1.0', 'q')}),
c0 AS (SELECT head, pos, k, v, list_transform(list_zip(k, mk.o), lambda p: p[1] - p[2]) AS c, exp(list_inner_product(mq.o, k) / 8.0) AS corr FROM vecs JOIN mk USING (head) JOIN mq USING (head)),
ck AS (SELECT head, pos, k, v, corr, {turn(r1)} AS z1, {turn(r2)} AS z2 FROM c0),
bk AS (SELECT head, pos, k, v, corr, CASE WHEN pos < 1 THEN 16384 ELSE {_vertex_sql('z1')} * 128 + {_vertex_sql('z2')} END AS bucket FROM ck),
bm AS (SELECT head, bucket, sum(corr) AS mass, count(*) AS size FROM bk GROUP BY head, bucket), bkm AS ({vmean('bk', 'head, bucket', '1.0', 'k')}), bvm AS ({vmean('bk', 'head, bucket', 'corr')})"""


_LSH = _lsh(None, None)


def _buckets(v: DataFrame) -> DataFrame:
    return grouping.hash_buckets(v, None, None, DIM)


@query(f"WITH {BASE}{_LSH} SELECT head, pos, CAST(bucket AS BIGINT) AS bucket FROM bk")
def lsh_bucket_labels(spark, sf):
    return _buckets(vectors(spark, sf)).select("head", "pos", "bucket")


@query(f"WITH {BASE}{_LSH} SELECT head, CAST(bucket AS BIGINT) AS bucket, size, round(mass, 6) AS mass, round(bkm.o[1], 6) AS k1, round(bvm.o[1], 6) AS v1 FROM bm JOIN bkm USING (head, bucket) JOIN bvm USING (head, bucket)")
def lsh_bucket_stats(spark, sf):
    v = vectors(spark, sf)
    rows = grouping.bucket_stats(_buckets(v), v, DIM)
    return rounded(rows.select("head", "bucket", "size", "mass", F.get("mean_k", F.lit(0)).alias("k1"), F.get("mean_v", F.lit(0)).alias("v1")), "mass", "k1", "v1")


def _lsh_errors(r1: list | None, r2: list | None, budgets: list[int]) -> str:
    turn = lambda r: "c" if r is None else f"list_transform({r}, lambda r: list_inner_product(r, c))"
    share = lambda z: f"list_transform(flatten(list_transform({z}, lambda x: [x, -x])), lambda s: exp(s - list_aggregate(list_transform({z}, lambda y: abs(y)), 'max')))"
    return f"""WITH {TRUTH}{_lsh(r1, r2)}, qc AS (SELECT head, qpos, list_transform(list_zip(q, mq.o), lambda p: p[1] - p[2]) AS qc, mk.o AS mko FROM qs JOIN mq USING (head) JOIN mk USING (head)),
qd AS (SELECT head, qpos, qc, list_transform(list_zip(qc, mko), lambda p: p[1] - p[2]) AS c FROM qc),
qz AS (SELECT head, qpos, qc, {turn(r1)} AS z1, {turn(r2)} AS z2 FROM qd), qe AS (SELECT head, qpos, qc, {share('z1')} AS e1, {share('z2')} AS e2 FROM qz),
qp AS (SELECT head, qpos, qc, list_transform(e1, lambda x: x / list_aggregate(e1, 'sum')) AS p1, list_transform(e2, lambda x: x / list_aggregate(e2, 'sum')) AS p2 FROM qe),
pr AS (SELECT head, qpos, bucket, bkm.o AS mk, bvm.o AS v, mass, qc, CASE WHEN bucket = 16384 THEN 1 ELSE p1[bucket // 128 + 1] * p2[bucket % 128 + 1] END AS pi FROM qp JOIN bm USING (head) JOIN bkm USING (head, bucket) JOIN bvm USING (head, bucket)),
od AS (SELECT *, row_number() OVER (PARTITION BY head, qpos ORDER BY bucket = 16384 DESC, pi DESC, bucket) - 1 AS p, max(CASE WHEN bucket = 16384 THEN 1 ELSE 0 END) OVER (PARTITION BY head, qpos) AS has FROM pr),
sl AS (SELECT head, qpos, b, v, list_inner_product(qc, mk) / 8.0 + ln(greatest(mass, 1e-30)) - ln(greatest(pi, 1e-30)) AS lo FROM od, (SELECT unnest({budgets}) AS b) bud WHERE p < greatest(b, has)),
ex AS (SELECT *, exp(lo - max(lo) OVER (PARTITION BY head, qpos, b)) AS e FROM sl), outp AS ({vmean('ex', 'head, qpos, b', 'e')}), cnt AS (SELECT head, qpos, b, count(*) AS budget FROM sl GROUP BY head, qpos, b)
SELECT x.head, x.qpos, CAST(x.b AS BIGINT) AS requested_budget, budget, round({ERR}, 6) AS rel_l2_error FROM outp x JOIN truth t USING (head, qpos) JOIN cnt USING (head, qpos, b)"""


@query(_lsh_errors(None, None, [4, 8, 16]))
def lsh_attention(spark, sf):
    c = context(spark, sf, rotations=(None, None))
    return method_errors(c, methods.lsh_attention(c))


@query(_lsh_errors(grouping.random_rotation(DIM, 42), grouping.random_rotation(DIM, 43), [16]))
def lsh_attention_rotated(spark, sf):
    c = context(spark, sf, (16,))
    return method_errors(c, methods.lsh_attention(c))


# ---- aggregates

_EQ_ITEMS = f"SELECT head, qpos, b, 's' || pos AS item, logit, v FROM wt, bud WHERE special UNION ALL SELECT head, qpos, b, 'g' || CAST({_EQ} AS BIGINT) AS item, logit, v FROM rk, bud"
_RES = f"SELECT 'IdealTopK' AS method, a.* FROM ({items_error(_TOP).replace('round(' + ERR + ', 6)', ERR)}) a UNION ALL SELECT 'IdealEqualSplits' AS method, b.* FROM ({items_error(_EQ_ITEMS).replace('round(' + ERR + ', 6)', ERR)}) b"
_AGG = "avg(rel_l2_error) AS error_mean, stddev_pop(rel_l2_error) AS error_std, avg(budget) AS budget_mean, stddev_pop(budget) AS budget_std, count(*) AS n_queries"


def _results(spark, sf) -> DataFrame:
    c = context(spark, sf)
    return methods.evaluate(c, ["IdealTopK", "IdealEqualSplits"], A.full_attention(c.logits))


_AGGS = ("error_mean", "error_std", "budget_mean", "budget_std")


@query(f"SELECT method, requested_budget, n_queries, {', '.join(f'round({c}, 6) AS {c}' for c in _AGGS)} FROM (SELECT method, requested_budget, {_AGG} FROM ({_RES}) r GROUP BY method, requested_budget) z")
def aggregate_methods(spark, sf):
    return rounded(aggregate.by_method(_results(spark, sf)), *_AGGS)


@query(f"SELECT method, requested_budget, CAST(sum(n_queries) AS BIGINT) AS n_queries, {', '.join(f'round(sum({c} * hw) / sum(hw), 6) AS {c}' for c in _AGGS)} FROM (SELECT *, CASE WHEN head % 5 = 2 THEN 3.0 WHEN head % 5 IN (1, 3) THEN 2.0 ELSE 1.0 END AS hw FROM (SELECT head, method, requested_budget, {_AGG} FROM ({_RES}) r GROUP BY head, method, requested_budget) z) y GROUP BY method, requested_budget")
def weighted_heads(spark, sf):
    rows = aggregate.by_method(_results(spark, sf), ["head"])
    heads = rows.select("head").distinct().withColumn("percentile", F.col("head") % 5 * 25)
    return rounded(aggregate.weighted_heads(rows, heads), *_AGGS)


@query(f"WITH {_STATS} SELECT " + ", ".join(f"round({f}({c}), 6) AS {c}_{n}" for c in _NAMES for n, f in (("mean", "avg"), ("std", "stddev_pop"))) + " FROM st")
def aggregate_query_stats(spark, sf):
    rows = aggregate.query_stats(stats.query_stats(logits(vectors(spark, sf))), _NAMES)
    return rounded(rows, *rows.columns)


_ACROSS = "round(avg({v}), 6) AS mean, round(quantile_cont({v}, 0.5), 6) AS median, round(quantile_cont({v}, 0.25), 6) AS p25, round(quantile_cont({v}, 0.75), 6) AS p75, round(quantile_cont({v}, 0.9), 6) AS p90, round(stddev_pop({v}), 6) AS std, count(*) AS n_heads, round(quantile_cont({v}, 0.75) - quantile_cont({v}, 0.25), 6) AS spread"


@query(f"WITH {_STATS}, o AS (SELECT *, row_number() OVER (PARTITION BY head ORDER BY qpos) - 1 AS nth FROM st) SELECT nth, {_ACROSS.format(v='full_entropy')} FROM o GROUP BY nth")
def aggregate_across_heads(spark, sf):
    rows = stats.query_stats(logits(vectors(spark, sf))).withColumn("nth", (F.row_number().over(Window.partitionBy("head").orderBy("qpos")) - 1).cast("long"))
    return rounded(aggregate.across_heads(rows, ["nth"], "full_entropy"), "mean", "median", "p25", "p75", "p90", "std", "spread")


@query(f"SELECT method, count(*) AS count, round(avg(rel_l2_error), 6) AS mean, round(stddev_samp(rel_l2_error), 6) AS std, round(min(rel_l2_error), 6) AS min, round(quantile_cont(rel_l2_error, 0.25), 6) AS p25, round(quantile_cont(rel_l2_error, 0.5), 6) AS p50, round(quantile_cont(rel_l2_error, 0.75), 6) AS p75, round(max(rel_l2_error), 6) AS max FROM ({_RES}) r GROUP BY method")
def result_describe(spark, sf):
    return rounded(aggregate.describe(_results(spark, sf), "rel_l2_error", ["method"]), "mean", "std", "min", "p25", "p50", "p75", "max")


@query(f"SELECT coalesce(task, 'all') AS task, round(avg(rel_l2_error), 6) AS mean, count(*) AS n FROM (SELECT 't' || (head % 2) AS task, rel_l2_error FROM ({_RES}) r) z GROUP BY ROLLUP (task)")
def task_levels(spark, sf):
    return rounded(aggregate.levels(_results(spark, sf).withColumn("task", F.concat(F.lit("t"), (F.col("head") % 2).cast("string")))), "mean")


_BIAS = RANKED.replace("FROM wt WHERE NOT special", "FROM wt").replace("[4, 8, 16]", "[4, 16]")


@query(f"SELECT b AS requested_budget, round(avg(rel_l2_error), 6) AS mean, round(stddev_pop(rel_l2_error), 6) AS std, count(*) AS n_queries FROM (SELECT requested_budget AS b, rel_l2_error FROM ({items_error('SELECT head, qpos, b, pos AS item, logit, v FROM rk, bud WHERE p < b AND b < n', _BIAS).replace('round(' + ERR + ', 6)', ERR)}) r) z GROUP BY b")
def bias_topk_curve(spark, sf):
    c = context(spark, sf, (4, 16))
    rows = c.logits.withColumn("special", F.lit(False)).withColumn("m", F.count("*").over(A.by_query())).filter(F.col("m") > 16).drop("m")
    out = A.errors(methods.ideal_topk(methods.Context(c.vectors, c.queries, rows, DIM, (4, 16))), A.full_attention(c.logits))
    return rounded(out.groupBy("requested_budget").agg(F.avg("rel_l2_error").alias("mean"), F.stddev_pop("rel_l2_error").alias("std"), F.count("*").alias("n_queries")), "mean", "std")


@query(f"WITH {_HEADS} SELECT round(avg(full_entropy), 6) AS mean, round(quantile_cont(full_entropy, 0.75) - quantile_cont(full_entropy, 0.25), 6) AS spread, count(*) AS n_heads FROM hs")
def variance_spread(spark, sf):
    rows = stats.head_statistics(logits(vectors(spark, sf)))
    return rounded(rows.agg(F.avg("full_entropy").alias("mean"), (F.percentile("full_entropy", 0.75) - F.percentile("full_entropy", 0.25)).alias("spread"), F.count("*").alias("n_heads")), "mean", "spread")


@query(f"SELECT regexp_extract(method, '^(.*?)-([0-9]+)$', 1) AS family, requested_budget, round(greatest(avg(rel_l2_error) - stddev_pop(rel_l2_error), 1e-10), 6) AS low, round(avg(rel_l2_error) + stddev_pop(rel_l2_error), 6) AS high FROM (SELECT method || '-' || requested_budget AS method, requested_budget, rel_l2_error FROM ({_RES}) r) z GROUP BY ALL")
def curve_bands(spark, sf):
    rows = aggregate.by_method(_results(spark, sf))
    return rounded(rows.select(F.col("method").alias("family"), "requested_budget", F.greatest(F.col("error_mean") - F.col("error_std"), F.lit(1e-10)).alias("low"), (F.col("error_mean") + F.col("error_std")).alias("high")), "low", "high")


# ---- exploration

_PAIR = "list_inner_product(a.{x}, b.{y}) / greatest(sqrt(list_inner_product(a.{x}, a.{x})) * sqrt(list_inner_product(b.{y}, b.{y})), 1e-10) AS cos, list_inner_product(a.{x}, b.{y}) / 8.0 AS dot"
_LAST = f"anc AS (SELECT v.* FROM vecs v JOIN qs ON v.head = qs.head AND v.pos = qs.qpos)"


def _pair_sql(kind: str) -> str:
    x, y = {"qk": ("q", "k"), "qq": ("q", "q"), "kk": ("k", "k")}[kind]
    where, sink = ("b.pos <= a.pos", "b.pos < 1") if kind == "qk" else ("b.pos <> a.pos", "(b.pos < 1 OR a.pos < 1)")
    return f"{BASE}, {_LAST}, pr AS (SELECT a.head, a.pos AS pos_a, b.pos AS pos_b, abs(a.pos - b.pos) AS dist, {sink} AS is_sink, {_PAIR.format(x=x, y=y)} FROM anc a JOIN vecs b ON a.head = b.head AND {where})"


def _pairs(spark, sf, kind: str, most: int | None = None) -> DataFrame:
    v = vectors(spark, sf)
    return explore.pairs(A.last_queries(v, N).select("head", F.col("qpos").alias("pos")), v, kind, DIM, most=most)


def _pair_query(kind: str):
    @query(f"WITH {_pair_sql(kind)} SELECT head, pos_a, pos_b, dist, is_sink, round(cos, 6) AS cos, round(dot, 6) AS dot FROM pr")
    def run(spark, sf):
        return rounded(_pairs(spark, sf, kind), "cos", "dot")

    QUERIES[f"pair_{kind}"], SQL[f"pair_{kind}"] = QUERIES.pop("run"), SQL.pop("run")


for _kind in ("qk", "qq", "kk"):
    _pair_query(_kind)


_FEW = f"SELECT *, row_number() OVER (PARTITION BY head, pos_a ORDER BY pos_b = 0 DESC, {V.draw_sql('pos_b', seed=42)}, pos_b) AS r FROM pr"


@query(f"WITH {_pair_sql('kk')} SELECT head, pos_a, pos_b, dist, is_sink, round(cos, 6) AS cos, round(dot, 6) AS dot FROM ({_FEW}) z WHERE r <= 20")
def pair_kk_sampled(spark, sf):
    return rounded(_pairs(spark, sf, "kk", most=20), "cos", "dot")


_BINS = 5


def _edges(bins: int) -> str:
    at = ", ".join(str(i / bins) for i in range(bins + 1))
    return f""", ed AS (SELECT head, list_sort(list_distinct(list(round(q, 9)))) AS edges FROM (SELECT head, unnest(quantile_cont(dist, [{at}])) AS q FROM pr GROUP BY head) z GROUP BY head),
bn AS (SELECT pr.*, edges, greatest(1, least(len(list_filter(edges, lambda e: e <= dist)), len(edges) - 1)) AS bin FROM pr JOIN ed USING (head))"""


_EDGE = _edges(_BINS)


@query(f"WITH {_pair_sql('qk')}{_EDGE} SELECT head, CAST(bin AS BIGINT) AS bin, round(sqrt(greatest(any_value(edges[bin]), 1) * greatest(any_value(edges[bin + 1]), 1)), 6) AS centre, round(avg(cos), 6) AS mean, round(stddev_pop(cos) / sqrt(count(*)), 6) AS sem, count(*) AS n FROM bn GROUP BY head, bin")
def distance_bins(spark, sf):
    return rounded(explore.by_distance(_pairs(spark, sf, "qk"), "cos", _BINS), "centre", "mean", "sem")


_CAT = "CASE WHEN is_sink THEN 'sink' WHEN dist <= 10 THEN 'local' ELSE 'global' END"


@query(f"WITH {_pair_sql('qk')} SELECT head, {_CAT} AS category, count(*) AS n, round(avg(cos), 6) AS mean FROM pr GROUP BY ALL")
def pair_categories(spark, sf):
    rows = _pairs(spark, sf, "qk").withColumn("category", explore.category(F.col("is_sink"), F.col("dist"), 10))
    return rounded(rows.groupBy("head", "category").agg(F.count("*").alias("n"), F.avg("cos").alias("mean")), "mean")


_PW = ", pw AS (SELECT *, ex / sum(ex) OVER (PARTITION BY head, pos_a) AS w FROM (SELECT *, exp(dot - max(dot) OVER (PARTITION BY head, pos_a)) AS ex FROM pr) z)"


@query(f"WITH {_pair_sql('qk')}{_PW} SELECT head, {_CAT} AS category, round(sum(w), 6) AS mass FROM pw GROUP BY ALL")
def pair_softmax(spark, sf):
    rows = explore.pair_weights(_pairs(spark, sf, "qk")).withColumn("category", explore.category(F.col("is_sink"), F.col("dist"), 10))
    return rounded(rows.groupBy("head", "category").agg(F.sum("w").alias("mass")), "mass")


@query(f"WITH {_pair_sql('qk')}{_PW}, hb AS (SELECT least(floor((round(cos, 9) + 1) / 0.1), 19) AS bin, w FROM pw) SELECT CAST(bin AS BIGINT) AS bin, round(sum(w) / (SELECT sum(w) FROM hb) / 0.1, 6) AS density FROM hb GROUP BY bin")
def pair_histogram(spark, sf):
    return rounded(explore.histogram(explore.pair_weights(_pairs(spark, sf, "qk")).withColumn("cos", F.round("cos", 9)), "cos", -1.0, 1.0, 20, weight="w"), "density")


@query(f"WITH RECURSIVE {_pair_sql('qk')}, od AS (SELECT head, dist, pos_a, pos_b, cos, row_number() OVER (PARTITION BY head ORDER BY dist, pos_a, pos_b) AS r FROM pr), em AS (SELECT head, dist, pos_a, pos_b, r, cos AS ema FROM od WHERE r = 1 UNION ALL SELECT od.head, od.dist, od.pos_a, od.pos_b, od.r, 2.0 / 21 * od.cos + (1 - 2.0 / 21) * em.ema FROM em JOIN od ON od.head = em.head AND od.r = em.r + 1) SELECT head, dist, pos_a, pos_b, round(ema, 6) AS ema FROM em")
def ema_smooth(spark, sf):
    return rounded(explore.smoothed(_pairs(spark, sf, "qk"), ["dist", "pos_a", "pos_b"], "cos", 20).drop("cos"), "ema")


@query(f"WITH {BASE}, mq AS ({vmean('qs', 'head', '1.0', 'q')}), d AS (SELECT head, qpos, sqrt(list_inner_product(q, q)) AS qn, sqrt(list_aggregate(list_transform(list_zip(q, o), lambda p: (p[1] - p[2]) * (p[1] - p[2])), 'sum')) AS dv FROM qs JOIN mq USING (head)) SELECT head, qpos, round(qn, 6) AS q_norm, round(dv, 6) AS deviation, round(dv / greatest(qn, 1e-10), 6) AS relative_deviation FROM d")
def query_deviation(spark, sf):
    return rounded(stats.query_deviation(A.last_queries(vectors(spark, sf), N)), "q_norm", "deviation", "relative_deviation")


@query(f"WITH {BASE}, mq AS ({vmean('qs', 'head', '1.0', 'q')}), fl AS (SELECT head, pos, list_inner_product(o, k) / 8.0 AS ml FROM vecs JOIN mq USING (head)) SELECT head, round(corr(logit, ml), 6) AS corr, count(*) AS n_pairs FROM lg JOIN fl USING (head, pos) GROUP BY head")
def meanquery_correlation(spark, sf):
    v = vectors(spark, sf)
    return rounded(explore.mean_query(logits(v), A.last_queries(v, N), v, DIM), "corr")


_DIST = "sqrt(list_aggregate(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])), 'sum'))"


def _separation_sql(pairs: str) -> str:
    """Separation from pairs: rows (head, i, j, qi, ki, qj, kj)."""
    return f"""WITH {BASE}, cq AS ({vmean('vecs', 'head', '1.0', 'q')}), ck AS ({vmean('vecs', 'head', '1.0', 'k')}),
ii AS (SELECT head, avg(CASE WHEN i <> j THEN {_DIST.format(a='qi', b='qj')} END) AS iq, avg(CASE WHEN i <> j THEN {_DIST.format(a='ki', b='kj')} END) AS ik, avg({_DIST.format(a='qi', b='kj')}) AS ix FROM ({pairs}) z GROUP BY head)
SELECT head, round(iq, 6) AS intra_q, round(ik, 6) AS intra_k, round(ix, 6) AS inter, round({_DIST.format(a='cq.o', b='ck.o')}, 6) AS centroid_distance, round(ix / greatest((iq + ik) / 2, 1e-10), 6) AS ratio
FROM ii JOIN cq USING (head) JOIN ck USING (head)"""


_TWO = "a.head, a.pos AS i, b.pos AS j, a.q AS qi, a.k AS ki, b.q AS qj, b.k AS kj"


@query(_separation_sql(f"SELECT {_TWO} FROM vecs a JOIN vecs b ON a.head = b.head"))
def cluster_separation(spark, sf):
    return rounded(explore.separation(vectors(spark, sf)), "intra_q", "intra_k", "inter", "centroid_distance", "ratio")


_SIZED = "(SELECT *, count(*) OVER (PARTITION BY head) AS n FROM vecs)"


@query(_separation_sql(f"SELECT {_TWO} FROM (SELECT s.*, o FROM {_SIZED} s, (SELECT unnest(generate_series(1, 20)) AS o) t) a JOIN vecs b ON a.head = b.head AND b.pos = floor({V.draw_sql('a.pos', 'a.o', seed=42)} * a.n)"))
def cluster_separation_sampled(spark, sf):
    return rounded(explore.separation(vectors(spark, sf), sample=20), "intra_q", "intra_k", "inter", "centroid_distance", "ratio")


_PICKED = f"""pk AS (SELECT head, i, CAST(floor({V.draw_sql('head', 'i', seed=42)} * n) AS BIGINT) AS pos_q, CAST(floor({V.draw_sql('head', 'i', seed=43)} * n) AS BIGINT) AS pos_k
FROM (SELECT head, count(*) AS n FROM vecs GROUP BY head) h, (SELECT unnest(generate_series(1, 500)) AS i) s WHERE i <= n * n)"""


@query(f"WITH {BASE}, {_PICKED} SELECT pk.head, i, pos_q, pos_k, round(list_inner_product(a.q, b.k) / greatest(sqrt(list_inner_product(a.q, a.q)) * sqrt(list_inner_product(b.k, b.k)), 1e-10), 6) AS cos FROM pk JOIN vecs a ON a.head = pk.head AND a.pos = pos_q JOIN vecs b ON b.head = pk.head AND b.pos = pos_k")
def sampled_cosines(spark, sf):
    return rounded(explore.sampled_cosines(vectors(spark, sf), 500), "cos")


@query()
def pca_explained(spark, sf):
    _, share = explore.principal(vectors(spark, sf), "k", 2)
    return spark.createDataFrame([(i, round(float(s), 6)) for i, s in enumerate(share)], "component int, share double")


@query(f"WITH {BASE} SELECT CASE WHEN pos < 1 THEN 'sink' WHEN pos >= n - 10 THEN 'K_last' WHEN pos < 10 THEN 'K_first' ELSE 'K_mid' END AS grp, count(*) AS n_keys FROM (SELECT *, count(*) OVER (PARTITION BY head) AS n FROM vecs) z GROUP BY ALL")
def position_groups(spark, sf):
    v = vectors(spark, sf)
    rows = v.join(v.groupBy("head").agg(F.count("*").alias("n")), "head")
    return rows.groupBy(explore.position_group(F.lit("K"), F.col("pos"), F.col("pos") < 1, F.col("n"), 10).alias("grp")).agg(F.count("*").alias("n_keys"))


@query(f"WITH {BASE}, rt AS (SELECT head, pos, list_transform(generate_series(1, 64), lambda i: CASE WHEN i <= 32 THEN k[i] * cos(pos * pow(10000.0, -2.0 * (i - 1) / 64)) - k[i + 32] * sin(pos * pow(10000.0, -2.0 * (i - 1) / 64)) ELSE k[i] * cos(pos * pow(10000.0, -2.0 * (i - 33) / 64)) + k[i - 32] * sin(pos * pow(10000.0, -2.0 * (i - 33) / 64)) END) AS r FROM vecs) SELECT head, pos, round(r[1], 6) AS r1, round(r[33], 6) AS r33, round(r[64], 6) AS r64, round(sqrt(list_inner_product(r, r)), 6) AS r_norm FROM rt")
def rope_rotation(spark, sf):
    rows = vectors(spark, sf).select("head", "pos", V.rotate("k", "pos", DIM, 10000.0).alias("r"))
    return rounded(rows.select("head", "pos", *[F.get("r", F.lit(i)).alias(f"r{i + 1}") for i in (0, 32, 63)], V.norm("r").alias("r_norm")), "r1", "r33", "r64", "r_norm")


@query(f"WITH {BASE}, hd AS (SELECT CAST(layer AS INTEGER) AS layer, q_head, q_head // 4 AS kv_head FROM (SELECT unnest([0, 1]) AS layer) l, (SELECT unnest(generate_series(0, 7)) AS q_head) h) SELECT layer, q_head, kv_head, count(*) AS n_keys FROM hd JOIN vecs ON head = kv_head GROUP BY ALL")
def gqa_join(spark, sf):
    heads = tables.gqa_heads([0, 1], 8, 2, spark)
    return heads.join(vectors(spark, sf), F.col("head") == F.col("kv_head")).groupBy("layer", "q_head", "kv_head").agg(F.count("*").alias("n_keys"))


# ---- plot data


@query(f"WITH {_HEADS}, {_LONG}, q AS (SELECT metric, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM lng GROUP BY metric) SELECT metric, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3, round(min(value), 6) AS low, round(max(value), 6) AS high FROM lng JOIN q USING (metric) WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY metric")
def box_plots(spark, sf):
    return rounded(report.box(_long(spark, sf), ["metric"]), "q1", "median", "q3", "low", "high")


_WIDE = 10  # the window of the second task
_SECOND = f"SELECT * FROM (WITH {_HEADS}, {_LONG} SELECT * FROM lng)".replace(f"qpos + 1 - {WINDOW}", f"qpos + 1 - {_WIDE}")
_CHOSEN = """rr AS (SELECT head, row_number() OVER (ORDER BY round(effective_entropy, 9), head) - 1 AS r, count(*) OVER () AS n FROM hs),
ch AS (SELECT CAST(head % 3 AS INTEGER) AS layer, head, 'P' || min(pct) AS label FROM rr, (SELECT unnest([0, 25, 50, 75, 100]) AS pct) pc WHERE r = round_even(pct / 100.0 * (n - 1), 0) GROUP BY head)"""
_TASKS = f"al AS (SELECT 'a' AS task, * FROM lng UNION ALL SELECT 'b' AS task, * FROM ({_SECOND}) s)"


def _two_tasks(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Statistics of two tasks, whose windows differ, and the heads chosen by the first's."""
    rows = _long(spark, sf).withColumn("task", F.lit("a")).unionByName(_long(spark, sf, _WIDE).withColumn("task", F.lit("b")))
    entropy = rows.filter("task = 'a' and metric = 'effective_entropy'").select("layer", "head", F.round("value", 9).alias("effective_entropy"))
    picked = stats.select_heads(entropy, keys=("layer", "head"), ties=("head",))
    return rows, picked.select("layer", "head", F.concat(F.lit("P"), F.col("percentile").cast("string")).alias("label"))


@query(f"WITH {_HEADS}, {_LONG}, {_CHOSEN}, {_TASKS}, tk AS (SELECT unnest(['a', 'b']) AS task) SELECT task, layer, head, round(value, 6) AS value FROM tk CROSS JOIN ch LEFT JOIN (SELECT * FROM al WHERE metric = 'full_entropy') x USING (task, layer, head)")
def heads_across_tasks(spark, sf):
    rows, chosen = _two_tasks(spark, sf)
    return rounded(report.across_tasks(chosen, rows, "full_entropy"), "value")


@query(f"WITH {_HEADS}, {_LONG} SELECT 'ex' AS task, layer, head, metric, round(value * 2, 6) AS value FROM lng UNION ALL SELECT 'scout', layer, head, metric, round(value, 6) FROM lng")
def pooled_statistics(spark, sf):
    rows = _long(spark, sf).drop("task")
    per_example = rows.withColumn("task", F.lit("ex")).withColumn("value", F.col("value") * 2)
    return rounded(report.pooled(per_example, rows.withColumn("task", F.explode(F.array(F.lit("ex"), F.lit("scout"))))), "value")


_ROPE = "list_transform(generate_series(1, 64), lambda i: CASE WHEN i <= 32 THEN {x}[i] * cos(pos * pow(10000.0, -2.0 * (i - 1) / 64)) - {x}[i + 32] * sin(pos * pow(10000.0, -2.0 * (i - 1) / 64)) ELSE {x}[i] * cos(pos * pow(10000.0, -2.0 * (i - 33) / 64)) + {x}[i - 32] * sin(pos * pow(10000.0, -2.0 * (i - 33) / 64)) END)"


@query(f"WITH {_STATS} SELECT 'raw' AS variant, head, round(avg(full_entropy), 6) AS full_entropy FROM st GROUP BY head UNION ALL SELECT 'rope', head, round(avg(full_entropy), 6) FROM (WITH {_STATS.replace('list_transform(e, lambda x: x * (1 + (pos % 7) / 10.0)) AS k', _ROPE.format(x='kk') + ' AS k').replace('SELECT head, pos, e AS q', 'SELECT head, pos, ' + _ROPE.format(x='e') + ' AS q').replace('AS v FROM vec)', 'AS v FROM (SELECT *, list_transform(e, lambda x: x * (1 + (pos % 7) / 10.0)) AS kk FROM vec) z)')} SELECT * FROM st) r GROUP BY head")
def rope_raw_comparison(spark, sf):
    raw = vectors(spark, sf)
    turned = raw.withColumn("q", V.rotate("q", "pos", DIM, 10000.0)).withColumn("k", V.rotate("k", "pos", DIM, 10000.0))
    each = lambda v: stats.head_statistics(logits(v)).select("head", "full_entropy")
    return rounded(report.variants(each(turned), each(raw)), "full_entropy")


def _dashboard_sql(bins: int = 15) -> str:
    part = """SELECT '{kind}' AS pair_type, '{metric}' AS metric, head, CAST(bin AS BIGINT) AS bin, sqrt(greatest(any_value(edges[bin]), 1) * greatest(any_value(edges[bin + 1]), 1)) AS centre,
avg({metric}) AS mean, stddev_pop({metric}) / sqrt(count(*)) AS sem, count(*) AS n FROM bn GROUP BY head, bin"""
    return " UNION ALL ".join(f"SELECT * FROM (WITH {_pair_sql(kind)}{_edges(bins)} {part.format(kind=kind, metric=metric)}) {kind}_{metric}" for kind in ("qk", "qq", "kk") for metric in ("cos", "dot"))


@query(f"SELECT head, pair_type, metric, bin, round(centre, 6) AS centre, round(mean, 6) AS mean, round(sem, 6) AS sem, n FROM ({_dashboard_sql()}) z")
def pair_dashboard(spark, sf):
    v = vectors(spark, sf)
    return rounded(report.pair_panels(A.last_queries(v, N).select("head", F.col("qpos").alias("pos")), v, DIM, most=None), "centre", "mean", "sem")


# ---- benchmark examples


_ASKED = "chr(10) || chr(10) || 'Question: What is ' || doc_id || '?' || chr(10) || chr(10) || 'Answer:'"


@query(f"SELECT doc_id, md5('Context: ' || coalesce(text, '') || {_ASKED}) AS digest FROM documents")
def prompt_format(spark, sf):
    rows = tables.benchmark_examples(spark.read.parquet(f"{sf}/documents.parquet"))
    return rows.select("doc_id", F.md5(tables.prompt(F.col("context"), F.col("question")).cast("binary")).alias("digest"))


_TOK = "string_split(coalesce(text, ''), ' ')"


@query(f"SELECT doc_id, CAST(least(len({_TOK}), 50) AS INTEGER) AS n_tok, array_to_string({_TOK}[greatest(len({_TOK}) - 49, 1):], ' ') AS kept FROM documents")
def tail_truncate(spark, sf):
    kept = tables.tail(F.split(F.coalesce("text", F.lit("")), " "), 50)
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.size(kept).alias("n_tok"), F.array_join(kept, " ").alias("kept"))


@query(f"SELECT lang, doc_id, CAST(n AS INTEGER) AS n_tok FROM (SELECT lang, doc_id, len({_TOK}) AS n, row_number() OVER (PARTITION BY lang ORDER BY len({_TOK}) DESC, doc_id) AS r FROM documents) z WHERE r <= 3")
def longest_examples(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("lang", "doc_id", F.size(F.split(F.coalesce("text", F.lit("")), " ")).alias("n_tok"))
    return tables.longest(rows, "n_tok", ["lang"], 3, ["doc_id"])


@query("SELECT lower(lang) || '_' || (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) AS id, lower(lang) AS task, lang AS domain, source, doc_id, 'What is ' || doc_id || '?' AS question, length(text) AS context_chars, substring(text, 1, 200) AS context_preview FROM documents")
def benchmark_provenance(spark, sf):
    return sinks.provenance(tables.benchmark_examples(spark.read.parquet(f"{sf}/documents.parquet")))


@query("SELECT 'de_' || (row_number() OVER (ORDER BY doc_id) - 1) AS id, doc_id, source FROM documents WHERE lang = 'de'")
def domain_filter_loader(spark, sf):
    return tables.benchmark_examples(spark.read.parquet(f"{sf}/documents.parquet"), "de").select("id", "doc_id", "source")


from tidemark import catalog_panels  # noqa: E402, F401  (adds its queries)


def entry(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: errors of the best keys under every budget, next to exact attention."""
    return ideal_topk_budget_sweep(spark, sf)
