"""Invariants, and plain NumPy versions on small random sequences."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import vectors as V
from tidemark.operators import explore, grouping, methods, stats
from tidemark.plans import attention as A
from tidemark.sources import sinks, tables

D, LEN = 8, 60


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(42)
    return rng.standard_normal((3, LEN, D))


@pytest.fixture(scope="module")
def context(spark, data):
    q, k, v = data
    rows = [(0, i, q[i].tolist(), k[i].tolist(), v[i].tolist()) for i in range(LEN)]
    vec = spark.createDataFrame(rows, "head long, pos long, q array<double>, k array<double>, v array<double>").cache()
    qs = A.last_queries(vec, 3)
    return methods.Context(vec, qs, A.causal_logits(qs, vec, D, 1, 10).cache(), D, (5, 200))


def soft(x):
    e = np.exp(x - x.max())
    return e / e.sum()


def exact(data, at):
    q, k, v = data
    return soft(q[at] @ k[: at + 1].T / math.sqrt(D)) @ v[: at + 1]


def test_full_attention(context, data):
    rows = A.full_attention(context.logits).collect()
    assert len(rows) == 3
    for r in rows:
        assert np.allclose(r.truth, exact(data, r.qpos), atol=1e-10)


def test_weights_sum_to_one(context):
    assert all(abs(r[0] - 1) < 1e-9 for r in A.weights(context.logits).groupBy("qpos").agg(F.sum("w")).select("sum(w)").collect())


@pytest.mark.parametrize("name", [n for n, m in methods.METHODS.items() if m.kind == "idealized"])
def test_enough_budget_is_exact(context, name):
    rows = A.errors(methods.METHODS[name].run(context), A.full_attention(context.logits)).collect()
    assert len(rows) == 6
    for r in rows:
        assert r.budget <= r.requested_budget + 11
        if r.requested_budget == 200:
            assert r.rel_l2_error < 1e-6


def test_topk_is_the_plain_one(context, data):
    q, k, v = data
    for r in methods.ideal_topk(context).filter("requested_budget = 5").collect():
        n = r.qpos + 1
        logit = q[r.qpos] @ k[:n].T / math.sqrt(D)
        special = [i for i in range(n) if i < 1 or i >= max(1, n - 10)]
        rest = sorted((i for i in range(n) if i not in special), key=lambda i: -logit[i])[:5]
        at = special + rest
        assert r.budget == len(at) and np.allclose(r.output, soft(logit[at]) @ v[at])


def test_all_methods_run(context):
    c = methods.Context(context.vectors, context.queries, context.logits, D, (5,), options={"n_clusters": 4, "n_query_clusters": 2, "n_groups": 6, "modes": ["topk", "hybrid"], "top_k_sweep": [0, 2, 99]})
    rows = methods.evaluate(c, list(methods.METHODS), A.full_attention(c.logits)).collect()
    assert {m for m in methods.METHODS} == {r.method.split("-C4")[0].split("-Q2")[0] for r in rows}
    for r in rows:
        assert r.budget > 0 and math.isfinite(r.rel_l2_error)
        assert r.method_kind == ("idealized" if r.method.startswith("Ideal") else "algorithm")
        if r.method.endswith("-k99"):
            assert r.rel_l2_error < 1e-6


def test_own_method(context):
    @methods.register("Nothing", "algorithm")
    def nothing(c):
        return methods.ideal_topk(c)

    assert methods.METHODS.pop("Nothing").run(context).count() == 6


@pytest.mark.parametrize("n,g", [(500, 256), (10, 3), (100, 7), (5, 9), (1, 1)])
def test_equal_groups(spark, n, g):
    rows = spark.range(n).select(F.col("id").alias("p"), A.equal_group(F.col("id"), F.lit(n), F.lit(g).cast("long")).alias("g")).orderBy("p").collect()
    m = min(g, n)
    size = max(1, n // m)
    assert [r.g for r in rows] == [min(p // size, m - 1) for p in range(n)]


def test_doubling(spark):
    rows = spark.range(100).select(A.doubling_group(F.col("id")).alias("g")).collect()
    sizes = np.bincount([r.g for r in rows])
    assert sizes.tolist() == [1, 1, 2, 4, 8, 16, 32, 36]


def test_refill():
    assert grouping.refilled([2], 10, 3) == [2, 6]
    assert grouping.refilled([], 4, 4) == [1, 2, 3]
    assert grouping.refilled([1, 2], 3, 9) == [1, 2]


def test_kmeans():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(m, 0.1, (50, 2)) for m in (0, 5, 10)])
    _, labels = grouping.kmeans(x, 3)
    assert sorted(np.bincount(labels).tolist()) == [50, 50, 50]
    assert len(grouping.kmeans(x[:2], 5)[0]) == 2


def test_closed_forms(spark):
    rows = spark.range(100).select(F.lit(0).alias("head"), F.lit(0).alias("qpos"), F.col("id").alias("pos"), F.lit(1.0).alias("logit"), F.lit(False).alias("special"))
    r = stats.query_stats(rows, (50,)).first()
    assert abs(r.full_entropy - math.log(100)) < 1e-5 and abs(r.full_top50pct_mass - 0.5) < 1e-9
    assert abs(r.effective_entropy - r.full_entropy) < 1e-9
    none = stats.query_stats(rows.withColumn("special", F.lit(True)), (1,)).first()
    assert none.effective_entropy == 0 and none.effective_top1pct_mass == 1
    mass = [x.mass for x in stats.concentration(rows).orderBy("pct").collect()]
    assert mass == sorted(mass)


def test_constant_correlation_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert df.agg(stats.correlation(F.col("a"), F.col("b"))).first()[0] is None


def test_select_heads_rounds_half_even(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(3)], "head long, effective_entropy double")
    got = {r.head: r.percentile for r in stats.select_heads(df).collect()}
    assert got == {0: 0, 1: 50, 2: 75}


def test_rotation_keeps_length_and_is_relative(spark):
    x = np.random.default_rng(1).standard_normal((2, D))
    df = spark.createDataFrame([(x[0].tolist(), x[1].tolist())], "a array<double>, b array<double>")
    turn = lambda c, p: V.rotate(c, F.lit(p), D, 100.0)
    r = df.select(V.dot(turn("a", 3), turn("b", 7)).alias("x"), V.dot(turn("a", 13), turn("b", 17)).alias("y"), V.norm(turn("a", 5)).alias("n")).first()
    assert abs(r.x - r.y) < 1e-9 and abs(r.n - np.linalg.norm(x[0])) < 1e-9


def test_vertex(spark):
    df = spark.createDataFrame([([1.0, -3.0, 3.0],), ([0.5, 0.1, 0.2],)], "z array<double>")
    assert [r[0] for r in df.select(V.vertex("z")).collect()] == [3, 0]
    assert np.allclose(df.select(V.normalised("z")).collect()[1][0], soft(np.array([0.5, 0.1, 0.2])))


def test_projection_shares(spark, context, data):
    _, share = explore.principal(context.vectors, "k", 2)
    s = np.linalg.svd(data[1] - data[1].mean(0), compute_uv=False) ** 2
    assert np.allclose(share, (s / s.sum())[:2])


def test_family(spark):
    f, mode, k = explore.family(F.col("m"))
    rows = spark.createDataFrame([("KMeans-C8-hybrid-k3",), ("IdealTopK",)], "m string").select(f, mode, k).collect()
    assert [tuple(r) for r in rows] == [("KMeans-C8", "hybrid", 3), ("IdealTopK", None, None)]


def test_vector_store(spark, tmp_path):
    rows = [("t", f"ex_{e}", 17, t, 0, p, [float(p)] * D) for e in range(3) for t in ("Q_rope", "K_rope", "V") for p in range(4) if not (e == 2 and t == "V")]
    sinks.write_vectors(spark.createDataFrame(rows, tables.VECTORS), str(tmp_path / "v"))
    v = tables.read_vectors(spark, str(tmp_path / "v"))
    assert tables.count_examples(v) == 3
    got = tables.heads_of(v, 17, 0, 0)
    assert got.select("example_id").distinct().count() == 2 and got.count() == 8
    assert tables.heads_of(v, 17, 0, 0, max_examples=1).count() == 4
    with pytest.raises(FileNotFoundError):
        tables.check_examples(v, 4)
    with pytest.raises(ValueError):
        tables.load_task(spark, "x", {"benchmark": "other"})


def test_sinks(spark, tmp_path):
    cols = ", ".join(f"{c} string" for c in sinks.RESULT)
    assert not sinks.write_results(spark.createDataFrame([], cols), str(tmp_path / "r"))
    assert sinks.write_results(spark.createDataFrame([tuple("abcdefghijk")], cols), str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r"), header=True).columns == list(sinks.RESULT)
    config = {"algorithms": [], "tasks": ["t"], "head_mode": "custom", "n_examples": 1, "n_queries": 10, "budgets": [16], "seed": 42}
    sinks.run_spec(str(tmp_path / "spec.json"), config, ["m"], 1, {"t": {"rows": 3}})
    assert json.loads((tmp_path / "spec.json").read_text())["budgets"] == [16]


def test_metadata(spark, tmp_path):
    path = str(tmp_path / "metadata.json")
    assert tables.task_metadata(spark, path) == {}
    sinks.task_metadata(path, task="t", layers_extracted=[17], backend=None)
    assert tables.task_metadata(spark, path) == {"task": "t", "layers_extracted": [17]}


def test_tensor_names():
    from tidemark.sources.tensor_files import parsed

    assert parsed("file:/x/all_heads/math/ex_001/layer_17.pt", "K_rope_kvhead3") == ("math", "ex_001", 17, "K_rope", 3)
    assert parsed("m/e/layer_02.pt", "V_kvhead0")[3:] == ("V", 0)
    with pytest.raises(ValueError):
        parsed("m/e/layer_02.pt", "other")


def test_plot_sample(context):
    from tidemark.operators import report

    rows = report.plot_sample(context.vectors.withColumn("sink", F.col("pos") < 1), "sink", 5, ["pos"]).collect()
    assert len(rows) == 5 and any(r.pos == 0 for r in rows)


def test_sampled_cosines(context, data):
    q, k, _ = data
    rows = explore.sampled_cosines(context.vectors, 50).collect()
    assert len(rows) == 50
    for r in rows:
        assert math.isclose(r.cos, q[r.pos_q] @ k[r.pos_k] / np.linalg.norm(q[r.pos_q]) / np.linalg.norm(k[r.pos_k]), abs_tol=1e-9)


def test_draws(spark):
    import duckdb

    u = spark.range(5000).select(V.draw(F.col("id"), F.lit(3), seed=42).alias("u")).orderBy("id").collect()
    x = np.array([r.u for r in u])
    assert 0 < x.min() and x.max() < 1 and abs(x.mean() - 0.5) < 0.02 and abs(np.corrcoef(x[:-1], x[1:])[0, 1]) < 0.05 and len(set(x)) > 4990
    sql = [r[0] for r in duckdb.sql(f"SELECT {V.draw_sql('i', '3', seed=42)} FROM range(5000) t(i)").fetchall()]
    assert np.allclose(x, sql, atol=1e-15)


def test_separation_is_the_plain_one(context, data):
    q, k, _ = data
    for block in (7, 512):
        r = explore.separation(context.vectors, block=block).first()
        d = lambda a, b: np.linalg.norm(a[:, None] - b[None], axis=2)
        off = ~np.eye(LEN, dtype=bool)
        assert math.isclose(r.intra_q, d(q, q)[off].mean(), rel_tol=1e-9) and math.isclose(r.intra_k, d(k, k)[off].mean(), rel_tol=1e-9) and math.isclose(r.inter, d(q, k).mean(), rel_tol=1e-9)


def test_projection_is_the_plain_one(context, data):
    q, k, _ = data
    rows = explore.projected(explore.fit_sample(context.vectors, 1000)).collect()
    assert len(rows) == 2 * LEN
    m = np.concatenate([q, k])
    value = np.linalg.svd(m - m.mean(axis=0))[1] ** 2
    assert math.isclose(rows[0].share_x, value[0] / value.sum(), rel_tol=1e-9) and math.isclose(rows[0].share_y, value[1] / value.sum(), rel_tol=1e-9)
    xy = np.array([[r.x, r.y] for r in rows])
    assert np.allclose((xy**2).sum(axis=0), value[:2])


def test_approximation_is_the_plain_one(context, data):
    from tidemark.operators import approximation

    q, k, v = data
    rows = approximation.comparison(context.logits, (5, 200)).collect()
    assert {r.requested_budget for r in rows} == {5} and len(rows) == 3 * len(approximation.COMPARED)
    for r in rows:
        if r.method == "topk":
            n = r.qpos + 1
            logit = q[r.qpos] @ k[:n].T / math.sqrt(D)
            at = np.argsort(-logit)[:5]
            true = exact(data, r.qpos)
            assert math.isclose(r.rel_l2_error, np.linalg.norm(soft(logit[at]) @ v[at] - true) / np.linalg.norm(true), rel_tol=1e-9)
    heads = approximation.curves(context.vectors.sparkSession.createDataFrame(rows), context.vectors, (5, 200)).collect()
    assert {(r.n_queries > 0, r.requested_budget) for r in heads} == {(True, 5), (False, 200)} and all(r["mean"] == 0 for r in heads if r.requested_budget == 200)


def test_tensor_file_is_plain(tmp_path):
    import zipfile

    from tidemark.sources import tensor_files

    x = np.array([[1.0, -2.5, 3.14159], [0.0, 1e-3, 65504.0]], "f4")
    raw = tensor_files.dump({"Q_rope_head0": x, "V_kvhead1": x[:1]})
    (tmp_path / "a.pt").write_bytes(raw)
    assert set(zipfile.ZipFile(tmp_path / "a.pt").namelist()) == {"archive/data.pkl", "archive/data/0", "archive/data/1", "archive/byteorder", "archive/version"}
    got = tensor_files.load(raw)
    assert list(got) == ["Q_rope_head0", "V_kvhead1"] and np.allclose(got["Q_rope_head0"], x, rtol=2**-8)
    import pickle

    bad = tmp_path / "b.pt"
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr("archive/data.pkl", pickle.dumps(print, 2))
    with pytest.raises(ValueError):
        tensor_files.load(bad.read_bytes())


def test_layouts_and_layers(spark, tmp_path):
    (tmp_path / "all_heads/old").mkdir(parents=True)
    (tmp_path / "new").mkdir()
    root = str(tmp_path)
    assert tables.phase_of(spark, root, "old") == "all_heads" and tables.phase_of(spark, root, "new") is None and tables.phase_of(spark, root, "none") is None
    assert tables.task_dir(spark, root, "old") == f"{root}/all_heads/old" and tables.task_dir(spark, root, "new") == f"{root}/new"
    assert tables.task_metadata(spark, f"{root}/none.json") == {} and tables.layers("all", 3) == [0, 1, 2] and tables.layers([5], 9) == [5]


def test_ordinals(spark):
    rows = tables.ordinals(spark.range(0, 100, 1, 7), "n").collect()
    assert [(r.id, r.n) for r in sorted(rows, key=lambda r: r.id)] == [(i, i) for i in range(100)]
    assert tables.ordinals(spark.range(0), "n").count() == 0


def test_entry_stands_without_the_text_operators(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{here}/tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{here}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, cwd=tmp_path)
