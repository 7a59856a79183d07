"""Queries behind the figures: approximations compared, panels over heads, chosen heads, projections, and their files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import catalog as C
from tidemark.catalog import BASE, DIM, ERR, N, RANKED, items_error, query, rounded, vectors, vmean
from tidemark.functions import vectors as V
from tidemark.operators import aggregate, approximation, explore, grouping, report, stats
from tidemark.plans import attention as A
from tidemark.sources import sinks, tables, tensor_files

FEW = (4, 16)
KS = (10, 50, 100, 200, 500)


def turned(sql: str) -> str:
    """SQL over BASE, for rotated queries and keys."""
    sql = sql.replace("list_transform(e, lambda x: x * (1 + (pos % 7) / 10.0)) AS k", C._ROPE.format(x="kk") + " AS k")
    sql = sql.replace("SELECT head, pos, e AS q", "SELECT head, pos, " + C._ROPE.format(x="e") + " AS q")
    return sql.replace("AS v FROM vec)", "AS v FROM (SELECT *, list_transform(e, lambda x: x * (1 + (pos % 7) / 10.0)) AS kk FROM vec) z)")


def rotated(v: DataFrame) -> DataFrame:
    return v.withColumn("q", V.rotate("q", "pos", DIM, 10000.0)).withColumn("k", V.rotate("k", "pos", DIM, 10000.0))


def scratch(spark, name: str) -> str:
    return f"{tables.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# ---- approximations compared

_ALL = RANKED.replace("FROM wt WHERE NOT special", "FROM wt").replace("[4, 8, 16]", str(list(FEW)))
_EQ = C._EQ
_KEYED = f""", ku AS (SELECT *, sum(w) OVER (PARTITION BY head, qpos ORDER BY p) AS upto, row_number() OVER (PARTITION BY head, qpos ORDER BY {V.draw_sql('head', 'qpos', 'pos', seed=42)}, pos) - 1 AS u FROM rk),
tr AS (SELECT head, qpos, b, i, {V.draw_sql('head', 'qpos', 'b', 'i', seed=42)} AS at FROM (SELECT DISTINCT head, qpos, n FROM rk) h, bud, (SELECT unnest(generate_series(1, {max(FEW)})) AS i) s WHERE i <= b AND b < n),
dr AS (SELECT DISTINCT head, qpos, b, p FROM (SELECT tr.head, tr.qpos, tr.b, tr.i, min(p) AS p FROM tr JOIN ku ON ku.head = tr.head AND ku.qpos = tr.qpos AND ku.upto >= tr.at GROUP BY ALL) z)"""
_ITEMS = f"""SELECT head, qpos, 'topk' AS m, b, p AS item, logit, v FROM ku, bud WHERE p < b AND b < n
UNION ALL SELECT head, qpos, 'uniform', b, p, logit, v FROM ku, bud WHERE u < b AND b < n
UNION ALL SELECT head, qpos, 'ideal_sampling', b, p, logit, v FROM ku JOIN dr USING (head, qpos, p)
UNION ALL SELECT head, qpos, 'ideal_equal_splits', b, CAST({_EQ} AS BIGINT), logit, v FROM ku, bud WHERE b < n
UNION ALL SELECT head, qpos, 'ideal_equal_weight_splits', gr.b, gid, logit, v FROM gr JOIN (SELECT DISTINCT head, qpos, n FROM rk) h USING (head, qpos) WHERE gr.b < n"""
_COMPARED = items_error(_ITEMS, _ALL + C._CUTS + _KEYED, "head, qpos, m, b", "x.m AS method, ").replace("round(" + ERR + ", 6)", ERR)


def _bias_sql(by: str = "head") -> str:
    return f"SELECT {by}, method, requested_budget, avg(rel_l2_error) AS mean, stddev_pop(rel_l2_error) AS std, count(*) AS n_queries FROM ({_COMPARED}) e GROUP BY ALL"


@query(f"SELECT head, qpos, method, requested_budget, round(rel_l2_error, 6) AS rel_l2_error FROM ({_COMPARED}) e")
def approximation_errors(spark, sf):
    return rounded(approximation.comparison(C.logits(vectors(spark, sf)), FEW), "rel_l2_error")


@query(f"SELECT head, method, requested_budget, round(mean, 6) AS mean, round(std, 6) AS std, n_queries FROM ({_bias_sql()}) z")
def approximation_curves(spark, sf):
    logits = C.logits(vectors(spark, sf))
    return rounded(approximation.curves(approximation.comparison(logits, FEW), logits, FEW), "mean", "std")


# ---- panels, and panels over heads

_MASS = "SELECT head, qpos, k, CASE WHEN max(n) <= k THEN 1 ELSE sum(CASE WHEN rn <= k THEN w ELSE 0 END) END AS mass FROM (SELECT *, row_number() OVER (PARTITION BY head, qpos ORDER BY w DESC, pos) AS rn, count(*) OVER (PARTITION BY head, qpos) AS n FROM wt) r, (SELECT unnest([10, 50, 100, 200, 500]) AS k) ks GROUP BY head, qpos, k"
_NORMS = "sqrt(list_inner_product(q, q))"
_PANELS = f"""SELECT p.head, panel, series, CAST(coalesce(nth.x, p.x) AS BIGINT) AS x, CAST(value AS DOUBLE) AS value FROM (
SELECT head, qpos, NULL AS x, 'topk_mass' AS panel, CAST(k AS VARCHAR) AS series, mass AS value FROM (WITH {BASE} {_MASS}) a
UNION ALL SELECT head, qpos, NULL, 'entropy', 'full_entropy', full_entropy FROM (WITH {C._STATS} SELECT * FROM st) b
UNION ALL SELECT head, qpos, NULL, 'entropy', 'effective_entropy', effective_entropy FROM (WITH {C._STATS} SELECT * FROM st) c
UNION ALL SELECT head, NULL, list_position({list(FEW)}, requested_budget) - 1, 'bias', method, mean FROM ({_bias_sql()}) d
UNION ALL SELECT head, NULL, 0, 'mean_query', 'correlation', c FROM (WITH {BASE}, mq AS ({vmean('vecs', 'head', '1.0', 'q')}) SELECT lg.head, corr(logit, list_inner_product(o, vecs.k) / 8.0) AS c FROM lg JOIN vecs USING (head, pos) JOIN mq USING (head) GROUP BY lg.head) e
UNION ALL SELECT head, NULL, 0, 'deviation', 'mean_q_norm', sqrt(list_inner_product(o, o)) FROM (WITH {BASE} {vmean('vecs', 'head', '1.0', 'q')}) f
UNION ALL SELECT head, NULL, 0, 'deviation', 'relative', avg(d / greatest(qn, 1e-10)) FROM (WITH {BASE}, mq AS ({vmean('vecs', 'head', '1.0', 'q')}) SELECT head, {_NORMS} AS qn, {C._DIST.format(a='q', b='o')} AS d FROM vecs JOIN mq USING (head)) g GROUP BY head
) p LEFT JOIN (WITH {BASE} SELECT head, qpos, row_number() OVER (PARTITION BY head ORDER BY qpos) - 1 AS x FROM qs) nth ON nth.head = p.head AND nth.qpos = p.qpos"""


def _panels(v: DataFrame) -> DataFrame:
    return report.global_panels(C.logits(v), v.select("head", F.col("pos").alias("qpos"), "q"), v, DIM, KS, FEW)


@query(f"SELECT head, panel, series, x, round(value, 6) AS value FROM ({_PANELS}) z")
def global_panels(spark, sf):
    return rounded(_panels(vectors(spark, sf)), "value")


@query(f"SELECT panel, series, x, {C._ACROSS.format(v='value')} FROM ({_PANELS}) z GROUP BY panel, series, x")
def global_over_heads(spark, sf):
    return rounded(aggregate.global_over_heads(_panels(vectors(spark, sf)), ["head"]), "mean", "median", "p25", "p75", "p90", "std", "spread")


@query(f"SELECT 'raw' AS variant, panel, series, x, round(avg(value), 6) AS mean FROM ({_PANELS}) z GROUP BY ALL UNION ALL SELECT 'rope', panel, series, x, round(avg(value), 6) FROM ({turned(_PANELS)}) z GROUP BY ALL")
def rope_raw_panels(spark, sf):
    raw = vectors(spark, sf)
    both = report.variants(_panels(rotated(raw)), _panels(raw))
    return rounded(aggregate.global_over_heads(both, ["head"], ["variant"]).select("variant", "panel", "series", "x", "mean"), "mean")


_DASH = C._dashboard_sql()


@query(f"""WITH bins AS ({_DASH}), n AS (SELECT pair_type, metric, head, count(*) AS n_bins FROM bins GROUP BY ALL),
f AS (SELECT pair_type, metric, arg_min(n_bins, head) AS n_bins, min(head) AS first FROM n GROUP BY ALL)
SELECT bins.pair_type, bins.metric, bin, round(max(CASE WHEN bins.head = first THEN centre END), 6) AS centre, round(avg(mean), 6) AS mean, round(stddev_pop(mean) / sqrt(count(*)), 6) AS sem, count(*) AS n_heads
FROM bins JOIN n USING (pair_type, metric, head) JOIN f ON f.pair_type = n.pair_type AND f.metric = n.metric AND f.n_bins = n.n_bins GROUP BY ALL""")
def pairs_over_heads(spark, sf):
    v = vectors(spark, sf)
    bins = report.pair_panels(A.last_queries(v, N).select("head", F.col("qpos").alias("pos")), v, DIM, most=None)
    return rounded(aggregate.pairs_over_heads(bins, ["head"]), "centre", "mean", "sem")


_POOLED = "SELECT '{k}' AS pair_type, * FROM (WITH {sql} SELECT " + C._CAT + " AS category, count(*) AS n, round(avg(cos), 6) AS cos, round(avg(dot), 6) AS dot FROM pr GROUP BY ALL) {k}"


@query(" UNION ALL ".join(_POOLED.format(k=k, sql=C._pair_sql(k)) for k in ("qk", "qq", "kk")))
def pooled_categories(spark, sf):
    out = None
    for kind in ("qk", "qq", "kk"):
        part = C._pairs(spark, sf, kind).withColumn("pair_type", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return rounded(aggregate.pooled_categories(out, 10, ["pair_type"]), "cos", "dot")


@query(f"""WITH {BASE}, r AS (SELECT *, row_number() OVER (PARTITION BY head, qpos ORDER BY w DESC, pos) AS rn, count(*) OVER (PARTITION BY head, qpos) AS n FROM wt),
cc AS (SELECT head, qpos, pct, sum(CASE WHEN rn <= greatest(1, floor(n * pct / 100)) THEN w ELSE 0 END) AS mass FROM r, (SELECT unnest([1, 5, 10, 20, 50]) AS pct) ps GROUP BY head, qpos, pct),
nt AS (SELECT head, qpos, row_number() OVER (PARTITION BY head ORDER BY qpos) - 1 AS i, count(*) OVER (PARTITION BY head) AS m FROM qs)
SELECT head, CAST(share AS DOUBLE) AS share, qpos, pct, round(mass, 6) AS mass FROM nt JOIN (SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9]) AS share) sh ON i = floor(m * share) JOIN cc USING (head, qpos)""")
def concentration_at_positions(spark, sf):
    return rounded(stats.concentration_at(C.logits(vectors(spark, sf))), "mass")


@query(f"""WITH {BASE}, nm AS (SELECT sqrt(list_inner_product(k, k)) AS kn, sqrt(list_inner_product(v, v)) AS vn FROM vecs), e AS (SELECT min(kn) AS k0, max(kn) AS k1, min(vn) AS v0, max(vn) AS v1 FROM (SELECT round(kn, 9) AS kn, round(vn, 9) AS vn FROM nm))
SELECT CAST(least(floor((round(kn, 9) - k0) / greatest(k1 - k0, 1e-300) * 9), 8) AS BIGINT) AS x_bin, CAST(least(floor((round(vn, 9) - v0) / greatest(v1 - v0, 1e-300) * 9), 8) AS BIGINT) AS y_bin, count(*) AS n FROM nm, e GROUP BY ALL""")
def kv_norm_density(spark, sf):
    rows = vectors(spark, sf).select(F.round(V.norm("k"), 9).alias("kn"), F.round(V.norm("v"), 9).alias("vn"))
    return explore.histogram2d(rows, "kn", "vn", 9)


# ---- projections and distances

_DRAW_Q, _DRAW_K = (V.draw_sql("pos", str(i), seed=42) for i in (1, 2))


@query(f"""WITH {BASE}, s AS (SELECT head, pos, count(*) OVER (PARTITION BY head) AS length FROM vecs),
f AS (SELECT head, 'Q' AS kind, pos, length, false AS sink, row_number() OVER (PARTITION BY head ORDER BY {_DRAW_Q}, pos) AS r FROM s
UNION ALL SELECT head, 'K', pos, length, pos = 0, row_number() OVER (PARTITION BY head ORDER BY pos = 0 DESC, {_DRAW_K}, pos) FROM s)
SELECT head, kind, pos, CASE WHEN sink THEN 'sink' ELSE kind || '_' || CASE WHEN pos >= length - 10 THEN 'last' WHEN pos < 10 THEN 'first' ELSE 'mid' END END AS grp FROM f WHERE r <= 20""")
def projection_sample(spark, sf):
    return explore.fit_sample(vectors(spark, sf), 40, edge=10).select("head", "kind", "pos", "grp")


@query()
def projection_coordinates(spark, sf):
    rows = explore.projected(explore.fit_sample(vectors(spark, sf), 80, edge=10))
    return rounded(rows, "x", "y", "share_x", "share_y")


@query()
def projection_separation(spark, sf):
    rows = explore.projected(explore.fit_sample(vectors(spark, sf), 80, edge=10)).withColumn("xy", F.array("x", "y"))
    return rounded(explore.kind_separation(rows, "xy"), "intra_q", "intra_k", "inter", "centroid_distance", "ratio")


_I, _O = "a.i", "a.o"
_KIND = f"""WITH {BASE}, s AS (SELECT head, 'Q' AS kind, q AS u, pos FROM vecs UNION ALL SELECT head, 'K', k, pos FROM vecs),
r AS (SELECT head, kind, u, row_number() OVER (PARTITION BY head, kind ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY head, kind) AS n FROM s),
a AS (SELECT * FROM r, (SELECT unnest(generate_series(1, 5)) AS o) t),
d AS (SELECT a.head, a.kind AS x, b.kind AS y, a.i AS i, b.i AS j, {C._DIST.format(a='a.u', b='b.u')} AS dist FROM a JOIN r b ON a.head = b.head AND (
 (b.kind = a.kind AND b.i = floor({V.draw_sql(_I, _O, seed=42)} * b.n)) OR (a.kind = 'Q' AND b.kind = 'K' AND b.i = floor({V.draw_sql(_I, _O, seed=43)} * b.n)))),
m AS (SELECT head, avg(CASE WHEN x = 'Q' AND y = 'Q' AND i <> j THEN dist END) AS iq, avg(CASE WHEN x = 'K' AND y = 'K' AND i <> j THEN dist END) AS ik, avg(CASE WHEN x <> y THEN dist END) AS ix FROM d GROUP BY head),
cq AS ({vmean('vecs', 'head', '1.0', 'q')}), ck AS ({vmean('vecs', 'head', '1.0', 'k')})
SELECT head, round(iq, 6) AS intra_q, round(ik, 6) AS intra_k, round(ix, 6) AS inter, round({C._DIST.format(a='cq.o', b='ck.o')}, 6) AS centroid_distance, round(ix / greatest((iq + ik) / 2, 1e-10), 6) AS ratio FROM m JOIN cq USING (head) JOIN ck USING (head)"""


@query(_KIND)
def kind_separation(spark, sf):
    rows = explore.fit_sample(vectors(spark, sf), 1 << 30)
    return rounded(explore.kind_separation(rows, "vec", 5), "intra_q", "intra_k", "inter", "centroid_distance", "ratio")


@query(f"WITH {BASE}{C._CEN} SELECT head, pos, arg_min(cid, round(list_aggregate(list_transform(list_zip(k, o), lambda p: (p[1] - p[2]) * (p[1] - p[2])), 'sum'), 9) * 1000 + cid / 1e6) AS cid FROM vecs JOIN ce USING (head) GROUP BY head, pos")
def nearest_by_distance(spark, sf):
    v = vectors(spark, sf)
    return grouping.nearest(v.select("head", "pos", "k"), C._centres(v), "k", "centre", by="l2").select("head", "pos", "cid")


# ---- chosen heads and labels

_BARS = "SELECT {t} AS task, layer, head, max(CASE WHEN metric = 'full_entropy' THEN value END) AS full_, max(CASE WHEN metric = 'effective_entropy' THEN value END) AS effective FROM al GROUP BY ALL"


@query(f"WITH {C._HEADS}, {C._LONG}, {C._CHOSEN}, {C._TASKS}, e AS ({_BARS.format(t='task')}), tk AS (SELECT unnest(['a', 'b']) AS task) SELECT task, layer, head, label, round(full_, 6) AS \"full\", round(effective, 6) AS effective FROM tk CROSS JOIN ch LEFT JOIN e USING (task, layer, head)")
def selected_head_bars(spark, sf):
    rows, chosen = C._two_tasks(spark, sf)
    return rounded(report.head_bars(chosen, rows, "entropy"), "full", "effective")


def _examples(rows: DataFrame) -> DataFrame:
    """The two tasks as two examples of one."""
    length = F.when(F.col("task") == "a", 100).otherwise(200).cast("long")
    return rows.select(F.lit("t").alias("task"), F.concat(F.lit("ex_"), "task").alias("example"), length.alias("seq_len"), "layer", "head", "metric", "value")


@query(f"WITH {C._HEADS}, {C._LONG}, {C._CHOSEN}, {C._TASKS}, tk AS (SELECT unnest(['a', 'b']) AS task) SELECT 't' AS task, 'ex_' || task AS example, CAST(CASE WHEN task = 'a' THEN 100 ELSE 200 END AS BIGINT) AS seq_len, layer, head, label, round(value, 6) AS value FROM tk CROSS JOIN ch LEFT JOIN (SELECT * FROM al WHERE metric = 'effective_entropy') x USING (task, layer, head)")
def selected_heads_across_examples(spark, sf):
    rows, chosen = C._two_tasks(spark, sf)
    return rounded(report.across_examples(chosen, _examples(rows), "effective_entropy"), "value")


@query(f"WITH {C._HEADS}, {C._LONG}, {C._CHOSEN} SELECT part, metric, n FROM (SELECT unnest(['bars', 'tasks_full', 'tasks_effective', 'examples_full', 'examples_effective']) AS part) p, (SELECT unnest(['entropy', 'top1pct_mass', 'top5pct_mass']) AS metric) m, (SELECT 2 * count(*) AS n FROM ch) c")
def selected_heads_plots(spark, sf):
    rows, chosen = C._two_tasks(spark, sf)
    out = None
    for part, df in report.selected_heads(chosen, rows, _examples(rows)).items():
        n = df.groupBy("metric").agg(F.count("*").alias("n")).withColumn("part", F.lit(part))
        out = n if out is None else out.unionByName(n)
    return out


@query(f"WITH {C._HEADS}, {C._LONG}, {C._TASKS}, n AS (SELECT task, count(*) AS n FROM al WHERE metric = 'full_entropy' GROUP BY task) SELECT CASE WHEN min(n) = max(n) THEN CAST(min(n) AS VARCHAR) ELSE '~' || CAST(floor(avg(n)) AS BIGINT) END || ' heads/task' AS label FROM n")
def heads_per_task(spark, sf):
    return report.heads_per_task(C._two_tasks(spark, sf)[0])


@query(f"WITH {C._HEADS}, {C._LONG}, {C._TASKS} SELECT task, round(value, 6) AS value FROM al WHERE metric = 'full_top1pct_mass'")
def metric_values(spark, sf):
    return rounded(report.values(C._two_tasks(spark, sf)[0], "full_top1pct_mass"), "value")


_PLAIN = "replace(replace(m, 'full_', ''), 'effective_', '')"


@query(f"SELECT m AS metric, coalesce(map(['entropy', 'top1pct_mass', 'top5pct_mass'], ['Entropy', 'Top 1% Mass', 'Top 5% Mass'])[{_PLAIN}], {_PLAIN}) AS title, coalesce(map(['entropy', 'top1pct_mass', 'top5pct_mass'], ['Entropy (nats)', 'Top 1% Mass', 'Top 5% Mass'])[{_PLAIN}], {_PLAIN}) AS axis FROM (SELECT unnest({[*C._NAMES, 'full_other']}) AS m) z")
def metric_titles(spark, sf):
    rows = spark.createDataFrame([(m,) for m in (*C._NAMES, "full_other")], "metric string")
    return rows.select("metric", report.title(F.col("metric")).alias("title"), report.title(F.col("metric"), True).alias("axis"))


@query(f"WITH {C._HEADS}, {C._LONG}, {C._CHOSEN} SELECT ch.layer, CAST(ch.head AS INTEGER) AS q_head, 'L' || ch.layer || 'H' || ch.head || '  ' || label || '  ent=' || printf('%.2f', round(effective_entropy, 9)) || '  n={N}' AS line FROM ch JOIN hs USING (head)")
def head_table(spark, sf):
    rows, chosen = C._two_tasks(spark, sf)
    entropy = rows.filter("task = 'a' and metric = 'effective_entropy'").select("layer", "head", F.round("value", 9).alias("effective_entropy"))
    return report.info(chosen.join(entropy, ["layer", "head"]).select("layer", F.col("head").cast("int").alias("q_head"), "label", "effective_entropy", F.lit(N).alias("n_queries")))


_NAMED = ["KMeans-C8-topk-k0", "KMeans-C8-topk-k3", "KMeans-C8-hybrid-k3", "MultiQ-Q2-G6-hybrid-k1", "IdealTopK"]


@query(f"SELECT prefix, array_to_string(list_sort(list(DISTINCT mode)), ',') AS modes, array_to_string(list_sort(list(DISTINCT k)), ',') AS sweep, replace(prefix, '-', ' ') AS label FROM (SELECT regexp_extract(m, '^(.*)-(topk|hybrid)-k([0-9]+)$', 1) AS prefix, regexp_extract(m, '^(.*)-(topk|hybrid)-k([0-9]+)$', 2) AS mode, CAST(nullif(regexp_extract(m, '^(.*)-(topk|hybrid)-k([0-9]+)$', 3), '') AS INTEGER) AS k FROM (SELECT unnest({_NAMED}) AS m)) z WHERE mode <> '' GROUP BY prefix")
def method_families(spark, sf):
    rows = report.families(spark.createDataFrame([(m,) for m in _NAMED], "method string"))
    return rows.select("prefix", F.array_join("modes", ",").alias("modes"), F.array_join(F.transform("sweep", lambda k: k.cast("string")), ",").alias("sweep"), "label")


# ---- files


def _statistics_files(spark, sf) -> str:
    """Head statistics of two tasks as JSON files with metadata, under older metric names in one, and of two examples."""
    rows, chosen = C._two_tasks(spark, sf)
    root = scratch(spark, "head-statistics")
    heads = chosen.select("layer", F.col("head").cast("int").alias("q_head"), F.col("head").cast("int").alias("kv_head"), F.lit(1.5).alias("effective_entropy"), F.regexp_replace("label", "P", "").cast("int").alias("percentile"))
    listed = F.to_json(F.array_sort(F.collect_list(F.struct("percentile", "layer", "q_head", "kv_head", "effective_entropy")))).alias("listed")
    listed = heads.agg(listed)
    for task, folder, meta in (("a", "a", '"example_id":"one","sequence_length":100'), ("b", "b", '"scout_examples":["two"],"sequence_lengths":[200,3]'), ("a", "per_example/t/ex_000", '"sequence_length":100'), ("b", "per_example/t/ex_001", '"sequence_length":0')):
        own = rows.filter(F.col("task") == task)
        if task == "a":
            old = {v: k for k, v in tables.METRIC_ALIASES.items()}
            own = own.withColumn("metric", F.element_at(F.create_map(*[F.lit(x) for p in old.items() for x in p]), F.col("metric")))
        json = sinks.head_statistics(own).crossJoin(F.broadcast(listed))  # one row each
        text = F.concat(F.lit('{"metadata":{' + meta + ',"selected_heads":'), "listed", F.lit("},"), F.substring("json", 2, 1 << 30))
        at = tables.shared_folder(spark) + "/" + uuid.uuid4().hex
        json.select(text.alias("value")).coalesce(1).write.text(at, compression="none")
        _move(spark, at, f"{root}/{folder}.json")
    return root


def _move(spark, folder: str, to: str) -> None:
    """The one file of a folder, under another name."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(s.getPath() for s in fs.listStatus(path(folder)) if s.getPath().getName().startswith("part-"))
    fs.mkdirs(path(to).getParent())
    fs.rename(part, path(to))


@query("SELECT * FROM (VALUES ('a', 'one', CAST(100 AS BIGINT)), ('b', 'two', CAST(200 AS BIGINT))) t(task, example_id, seq_len)")
def head_stats_examples(spark, sf):
    return tables.head_statistics_meta(spark, _statistics_files(spark, sf))


@query(f"WITH {C._HEADS}, {C._LONG}, {C._TASKS} SELECT 't' AS task, CASE WHEN task = 'a' THEN 'ex_000' ELSE 'ex_001' END AS example, CAST(CASE WHEN task = 'a' THEN 100 ELSE 0 END AS BIGINT) AS seq_len, layer, CAST(head AS INTEGER) AS head, metric, round(value, 6) AS value FROM al")
def per_example_stats(spark, sf):
    return rounded(tables.per_example_statistics(spark, _statistics_files(spark, sf), "t"), "value")


@query(f"WITH {C._HEADS}, {C._LONG}, {C._CHOSEN}, s AS (SELECT layer, CAST(head AS INTEGER) AS q_head, CAST(substr(label, 2) AS INTEGER) AS percentile FROM ch), o AS (SELECT *, CAST(row_number() OVER (ORDER BY percentile, layer, q_head) - 1 AS INTEGER) AS ord FROM s) SELECT task, layer, q_head, q_head AS kv_head, CAST(1.5 AS DOUBLE) AS effective_entropy, percentile, ord, ['P0', 'P25', 'P50', 'P75', 'P100'][ord + 1] AS label FROM o, (SELECT unnest(['a', 'b']) AS task) t")
def selected_heads_listed(spark, sf):
    return tables.selected_heads(spark, _statistics_files(spark, sf))


def _steps(spark, sf) -> DataFrame:
    """Vectors in steps of 1/128, which two-byte tensors hold exactly."""
    v = vectors(spark, sf).select(F.lit("t").alias("task"), F.concat(F.lit("ex_"), (F.col("head") % 2).cast("string")).alias("example_id"), (F.col("head") % 3).cast("int").alias("layer"), F.col("head").cast("int").alias("head"), F.col("pos").cast("int").alias("pos"), "q", "v")
    part = lambda t, c: v.select("task", "example_id", "layer", F.lit(t).alias("tensor"), "head", "pos", F.transform(c, lambda x: (F.round(x * 128) / 128).cast("float")).alias("vec"))
    return part("Q_rope", "q").unionByName(part("V", "q"))


@query(f"WITH {BASE} SELECT 't' AS task, 'ex_' || (head % 2) AS example_id, CAST(head % 3 AS INTEGER) AS layer, tensor, CAST(head AS INTEGER) AS head, CAST(pos AS INTEGER) AS pos, list_aggregate(list_transform(q, lambda x: round(x * 128) / 128.0), 'sum') AS total, round(q[1] * 128) / 128.0 AS first FROM vecs, (SELECT unnest(['Q_rope', 'V']) AS tensor) z")
def tensor_files_roundtrip(spark, sf):
    path = scratch(spark, "tensors")
    tensor_files.write(_steps(spark, sf), path)
    rows = tensor_files.read(spark, path)
    return rows.select("task", "example_id", "layer", "tensor", "head", "pos", F.aggregate("vec", F.lit(0.0), lambda s, x: s + x).alias("total"), F.get("vec", F.lit(0)).cast("double").alias("first"))


def _asked(spark, sf) -> DataFrame:
    rows = tables.benchmark_examples(spark.read.parquet(f"{sf}/documents.parquet"))
    return rows.select("id", F.col("doc_id").alias("seq_len"), "question", F.array(F.lit("a"), F.col("source")).alias("answer"), "context")


_IDS = "lower(lang) || '_' || (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1)"


@query(f"SELECT {_IDS} AS id, CAST(doc_id AS BIGINT) AS sequence_length, 'What is ' || doc_id || '?' AS question, CAST(length(coalesce(text, '')) AS BIGINT) AS context_chars, 'all' AS heads_extracted, 'true' AS raw_included, 'x' AS backend FROM documents")
def example_sidecars(spark, sf):
    rows = sinks.sidecars(_asked(spark, sf), "all", "x")
    field = lambda c: F.get_json_object("json", f"$.{c}")
    return rows.select("id", field("sequence_length").cast("long").alias("sequence_length"), field("question").alias("question"), field("context_chars").cast("long").alias("context_chars"), field("heads_extracted").alias("heads_extracted"), field("raw_included").alias("raw_included"), field("backend").alias("backend"))


@query(f"SELECT id, seq_len, 'ex_' || lpad(CAST(row_number() OVER (ORDER BY seq_len DESC, id) - 1 AS VARCHAR), 3, '0') AS folder, n FROM (SELECT 'h' || head AS id, count(*) AS seq_len, count(*) AS n FROM (WITH {BASE} SELECT * FROM vecs) v GROUP BY head) z")
def saved_examples(spark, sf):
    path, v = scratch(spark, "saved"), vectors(spark, sf).withColumn("id", F.concat(F.lit("h"), F.col("head").cast("string")))
    examples = v.groupBy("id").agg(F.count("*").alias("seq_len")).select("id", "seq_len", F.lit("?").alias("question"), F.lit("!").alias("answer"), F.lit(None).cast("string").alias("context"))
    rows = v.select("id", F.lit(0).alias("layer"), F.lit("Q_rope").alias("tensor"), F.col("head").cast("int").alias("head"), F.col("pos").cast("int").alias("pos"), F.col("q").cast("array<float>").alias("vec"))
    saved = sinks.save_examples(examples, rows, path, "t")
    n = tables.read_vectors(spark, f"{path}/vectors").groupBy(F.col("example_id").alias("folder")).agg(F.count("*").alias("n"))
    kept = spark.read.text(f"{path}/examples/t").select("folder", F.get_json_object("value", "$.example_id").alias("id"))
    return saved.join(n, "folder").join(kept, ["folder", "id"]).select("id", "seq_len", "folder", "n")


@query("SELECT 'bench_' || (row_number() OVER (ORDER BY item_id, md5(coalesce(text, ''))) - 1) AS id, item_id FROM benchmark")
def jsonl_loader(spark, sf):
    path = scratch(spark, "jsonl")
    rows = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    rows.coalesce(1).sortWithinPartitions("item_id", F.md5(F.coalesce("text", F.lit("")).cast("binary"))).write.json(path)
    return tables.load_task(spark, "bench", {"benchmark": "jsonl", "path": path}).select("id", "item_id")



