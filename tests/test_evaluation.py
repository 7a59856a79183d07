"""A whole evaluation on a small store, its files and its replay."""

import json

import numpy as np
import pytest

from tidemark import cli
from tidemark.plans import evaluation, exploration
from tidemark.sources import sinks, tables
from tidemark.streaming import live_aggregates


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store"))
    rng = np.random.default_rng(0)
    rows = [("task_a", f"ex_{e:03d}", 17, t, h, p, rng.standard_normal(8).astype("f4").tolist()) for e in range(2) for t, hs in (("Q_rope", (0, 1)), ("K_rope", (0,)), ("V", (0,))) for h in hs for p in range(40)]
    sinks.write_vectors(spark.createDataFrame(rows, tables.VECTORS), path)
    return path


@pytest.mark.parametrize("mode", ["custom", "selected_heads"])
def test_run(spark, store, tmp_path, mode):
    c = evaluation.Config(store, str(tmp_path / "out"), 8, algorithms=["KMeans"], budgets=[8], n_queries=5, local_window=10, head_mode=mode, gqa=2,
                          custom_heads=[{"layer": 17, "q_head": 0, "kv_head": 0}], options={"KMeans": {"n_clusters": 4, "modes": ["hybrid"], "top_k_sweep": [0, 3]}}, compute_statistics=True)
    got = evaluation.run(spark, c)
    assert got["rows"] == (1 if mode == "custom" else 2) * 5 * (4 + 2)
    assert json.loads((tmp_path / "out/spec.json").read_text())["seed"] == 42
    csv = spark.read.csv(str(tmp_path / "out/results.csv"), header=True)
    assert csv.columns == list(sinks.RESULT) and csv.count() == got["rows"]
    assert {r.method_kind for r in csv.filter("method like 'KMeans%'").collect()} == {"algorithm"}
    assert evaluation.replay(spark, c.out).count() == 6


def test_errors(spark, store, tmp_path):
    for kind, change in ((ValueError, {"head_mode": "none"}), (ValueError, {"head_mode": "custom"}), (FileNotFoundError, {"n_examples": 9})):
        with pytest.raises(kind):
            evaluation.results(spark, evaluation.Config(store, "x", 8, gqa=2, **change))


def test_expand_and_load(tmp_path):
    assert [o["n_query_clusters"] for o in evaluation.expand({"n_query_clusters": [2, 4], "n_groups": 3})] == [2, 4]
    (tmp_path / "c.json").write_text(json.dumps({"vectors": "v", "out": "o", "dim": 8}))
    assert evaluation.load(str(tmp_path / "c.json")).dim == 8
    with pytest.raises(SystemExit):
        cli.main(["nothing"])


def test_live_aggregates(spark, tmp_path):
    schema = "method string, requested_budget long, rel_l2_error double, budget long"
    spark.createDataFrame([("m", 1, 0.5, 2), ("m", 1, 1.5, 4)], schema).write.parquet(str(tmp_path / "r"))
    q = live_aggregates(spark, str(tmp_path / "r"), schema).writeStream.outputMode("complete").format("memory").queryName("live").start()
    q.processAllAvailable()
    q.stop()
    r = spark.table("live").first()
    assert (r.error_mean, r.budget_mean, r.n_queries) == (1.0, 3.0, 2)


def test_heads_listed_in_metadata(spark, store, tmp_path):
    listed = [{"layer": 17, "q_head": 1, "kv_head": 0, "percentile": 50, "selection_label": "P50", "effective_entropy": 1.25}]
    (tmp_path / "selected_heads/task_a").mkdir(parents=True)
    (tmp_path / "selected_heads/task_a/metadata.json").write_text(json.dumps({"selected_heads": listed}))
    c = evaluation.Config(store, str(tmp_path / "out"), 8, tasks=["task_a"], budgets=[8], n_queries=3, local_window=10, head_mode="selected_heads", metadata=str(tmp_path), layers=[17])
    chosen = evaluation.heads(spark, c, tables.read_vectors(spark, store))
    assert [tuple(r) for r in chosen.collect()] == [(17, 1, 0, 50)] and evaluation.count_heads(chosen) == 1
    assert evaluation.run(spark, c)["rows"] == 3 * 4
    spec = json.loads((tmp_path / "out/spec.json").read_text())
    assert spec["n_heads"] == 1 and spec["task_details"] == {"task_a": {"seq_lens": [40], "rows": 12, "heads": ["L17H1"]}} and spec["n_queries_per_example"] == 3
    e = exploration.Config(store, "x", 8, ["task_a", "task_b"], str(tmp_path), "selected_heads", 17, 0, 0)
    assert exploration.heads(spark, e) == [("task_a", 17, 1, 0, "P50", 1.25), ("task_b", 17, 0, 0, None, None)]


def test_exploration(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(t, "ex_000", 17, f"{k}_{v}" if k != "V" else "V", h, p, rng.standard_normal(8).astype("f4").tolist())
            for t in ("task_a", "task_b") for k, hs in (("Q", (0, 1)), ("K", (0,)), ("V", (0,))) for v in (("rope", "raw") if k != "V" else ("",)) for h in hs for p in range(40)]
    sinks.write_vectors(spark.createDataFrame(rows, tables.VECTORS), str(tmp_path / "v"))
    listed = [{"layer": 17, "q_head": h, "kv_head": 0, "selection_label": f"P{h}"} for h in (0, 1)]
    for t in ("task_a", "task_b"):
        (tmp_path / t).mkdir()
        (tmp_path / t / "metadata.json").write_text(json.dumps({"selected_heads": listed}))
    c = {"vectors": str(tmp_path / "v"), "out": str(tmp_path / "out"), "dim": 8, "tasks": ["task_a", "task_b"], "metadata": str(tmp_path), "head_mode": "selected_heads", "n_queries": 5, "local_window": 10, "budgets": [4, 16, 64], "bins": 4, "n_fit": 20}
    (tmp_path / "c.json").write_text(json.dumps(c))
    got = exploration.run(spark, exploration.load(str(tmp_path / "c.json")))
    # panels: five top masses and two entropies of five queries, five methods of three budgets, one correlation, two deviations
    panels = 5 * 7 + 5 * 3 + 3
    assert got["heads"] == got["head_table"] == got["separation"] == 4 and got["global"] == 4 * panels and got["variants_global"] == 8 * panels
    assert got["task_global"] == 2 * panels and got["all_global"] == panels
    assert got["projection"] == 4 * 20 and got["variants_projection"] == 2 * got["projection"] and got["all_pairs"] > 0 and got["task_pairs"] > 0
    none = spark.read.parquet(str(tmp_path / "out/global")).filter("panel = 'bias' and x = 2").collect()
    assert len(none) == 4 * 5 and all(r.value == 0 for r in none)  # more than there are keys
