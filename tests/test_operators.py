"""Literal cases and edge cases of the operators."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.columns import folded, keyed_draw, normalized, row_hash, row_hash_128, winsorized_minmax
from tidemark.operators import cohort, federated, integrity, metrics, selection, stats, vectors
from tidemark.sources import files

FIELDS = "round int, client_id int, utility double, wire_bytes long, n_fit long, n_utility long, utility_benign long, utility_attack long, predicted_airtime_us double, local_training_seconds double"


def candidates(spark, *rows):
    base = {"utility": 0.5, "wire_bytes": 100, "n_fit": 180, "n_utility": 20, "utility_benign": 10, "utility_attack": 10, "predicted_airtime_us": None, "local_training_seconds": None}
    return spark.createDataFrame([(0, i, *(base | r).values()) for i, r in enumerate(rows)], FIELDS)


def chosen(df, method, budget, **options):
    total = df.agg(F.sum("wire_bytes")).first()[0]
    row = selection.select_clients(df, method, ["round"], budget / total, **options).first()
    assert row.used_bytes <= row.budget_bytes
    return list(row.selected), row


def test_marginal_utility(spark):
    df = spark.range(1).select(
        selection.marginal_utility(*(F.lit(x) for x in (0.8, 0.1, 0.9, 0.2))).alias("a"), selection.marginal_utility(F.lit(float("nan")), F.lit(0.1), F.lit(0.9), F.lit(0.2)).alias("b")
    )
    row = df.first()
    assert row.a == pytest.approx(0.075) and math.isnan(row.b)


def test_eligibility_edges(spark):
    rows = ({}, {"n_utility": 19}, {"utility_benign": 4, "utility_attack": 16}, {"wire_bytes": 201}, {"utility": float("nan")}, {"utility": None}, {"wire_bytes": 0}, {"n_fit": 179})
    df = candidates(spark, *rows).withColumn("ok", selection.static_eligible(F.lit(200)))
    assert [r.ok for r in df.orderBy("client_id").collect()] == [True] + [False] * 7


def test_selection_cases(spark):
    full = selection.select_clients(candidates(spark, {"utility": float("nan")}, {"utility": -1.0}), "Full-Contextual", ["round"], None).first()
    assert list(full.selected) == [0, 1] and full.used_bytes == 200
    none, row = chosen(candidates(spark, {"utility": -0.1}, {"utility": 0.0}), "Utility-Only", 200)
    assert none == [] and row.empty_round and row.used_bytes == 0
    assert chosen(candidates(spark, *({"wire_bytes": 80, "utility": u} for u in (0.4, 0.3, 0.2))), "Utility-Only", 160)[0] == [0, 1]
    assert chosen(candidates(spark, *({"wire_bytes": b, "utility": u} for b, u in ((80, 0.4), (100, 0.3), (80, 0.2)))), "Utility-Only", 160)[0] == [0, 2]
    assert chosen(candidates(spark, *({"wire_bytes": 80} for _ in range(3))), "Utility-Only", 160)[0] == [0, 1]
    df = candidates(spark, *({"wire_bytes": b, "utility": u} for b, u in ((100, 0.4), (50, 0.2), (200, 0.1))))
    score = {r.client_id: r.priority for r in selection.with_priority(df, "CB-Score", ["round"]).collect()}
    double = {r.client_id: r.priority for r in selection.with_priority(df, "Historical-DoubleCost", ["round"]).collect()}
    assert score != double and double[0] == pytest.approx(score[0] / 100)
    best, row = chosen(candidates(spark, *({"wire_bytes": b, "utility": u} for b, u in ((70, 0.9), (60, 0.8), (40, 0.7)))), "Oracle-Score-Exact", 100)
    assert best == sorted(best) and row.used_bytes <= 100
    five = candidates(spark, *({"wire_bytes": 40} for _ in range(5)))
    assert chosen(five, "Random-Budget", 120, seed=42)[0] == chosen(five, "Random-Budget", 120, seed=42)[0]
    poisoned = selection.with_priority(candidates(spark, {}, {"utility": float("nan")}), "CB-Score", ["round"]).collect()
    assert all(math.isnan(r.priority) for r in poisoned)
    with pytest.raises(ValueError):
        selection.select_clients(five, "Novelty", ["round"], 0.4)
    with pytest.raises(ValueError):
        selection.select_clients(five, "CB-Score", ["round"], -0.1)


def test_winsorized_minmax_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, 37)
    got = [r.s for r in winsorized_minmax(spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "g int, i int, x double"), "x", "s", ["g"]).orderBy("i").collect()]
    y = np.clip(x, *np.quantile(x, [0.05, 0.95]))
    assert np.allclose(got, (y - y.min()) / (y.max() - y.min()), atol=1e-12)
    same = winsorized_minmax(spark.createDataFrame([(0, 1.0), (0, 1.0)], "g int, x double"), "x", "s", ["g"]).collect()
    assert [r.s for r in same] == [0.0, 0.0]


def test_metrics_edges(spark):
    rows = [("a", 1, 0.5), ("a", 0, 0.5), ("a", 1, 0.9), ("a", 0, 0.1), ("one", 1, 0.3), ("one", 1, 0.7)]
    df = spark.createDataFrame(rows, "cell_id string, y int, p double")
    auc = {r.cell_id: r for r in metrics.aucs(df).collect()}
    assert auc["a"].roc_auc == pytest.approx(0.875) and math.isnan(auc["one"].roc_auc) and math.isnan(auc["one"].pr_auc)
    at = {r.cell_id: r for r in metrics.confusion_at(df, 0.5).collect()}
    assert (at["a"].tp, at["a"].fp, at["a"].fn, at["a"].tn) == (2, 1, 0, 1) and at["one"].fpr == 0 and at["one"].balanced_accuracy == 0.5
    hopeless = spark.createDataFrame([("z", 0, 0.99)] * 5 + [("z", 1, 0.2)], "cell_id string, y int, p double")
    assert metrics.choose_threshold(metrics.threshold_grid(hopeless)).first().selection_rule == "MIN_FPR"


def test_inference_cases(spark):
    ones = spark.createDataFrame([("h", i, 1.0) for i in range(10)], "h string, seed int, d double")
    assert stats.sign_flip(ones, ["h"], "d", "seed").first().raw_p == pytest.approx(1 / 1024)
    bounds = stats.bootstrap_bounds(ones, ["h"], "d", "seed", 50).first()
    assert bounds.two_sided_low == bounds.two_sided_high == 1.0
    p = spark.createDataFrame([("f", i, v) for i, v in enumerate([0.01, 0.04, 0.03, 0.5])], "f string, i int, p double")
    got = {r.i: r.holm_adjusted_p for r in stats.holm(p, ["f"], "p", ["i"]).collect()}
    assert got == {0: pytest.approx(0.04), 2: pytest.approx(0.09), 1: pytest.approx(0.09), 3: pytest.approx(0.5)}
    assert stats._t_p(0.5, 30) == pytest.approx(0.0049, abs=2e-4) and math.isnan(stats._t_p(0.5, 2)) and stats._t_p(1.0, 9) == 0.0


def test_vectors(spark):
    df = spark.createDataFrame([(0, i, 100, [v, 0.0, 0.0]) for i, v in enumerate((1.0, 1.0, 100.0))], "k int, client int, n int, v array<float>")
    assert vectors.weighted_mean(df, ["k"], "v", "n").first()["mean"][0] == pytest.approx(34)
    assert vectors.clipped_mean(df, ["k"], "v", "n").first()["mean"][0] == pytest.approx(1)


def test_integrity_helpers():
    assert normalized("  Flow   ID ") == "Flow ID" and folded(" Src-IP ") == "src_ip"
    assert integrity.label_column(["x", " Label "], ["class", "label"]) == " Label " and integrity.label_column(["x"], ["y"]) is None
    assert integrity.auto_drop(["Flow ID", "Dst MAC", "rate", "Date of"], {"rate"}, {"flow id"}, ["mac", "date"]) == {"Flow ID": "exact", "Dst MAC": "keyword:mac", "Date of": "keyword:date"}
    assert integrity.auto_drop(["Flow-ID", "flow_id", " Src-Port", "time-stamp", "label"], {"src_port"}, {"flow_id"}, ["time-", "label"], "label") == {"Flow-ID": "exact", "flow_id": "exact", "time-stamp": "keyword:time-"}
    groups = [(f"g{i}", 100 + 10 * i, 50 + 5 * i) for i in range(8)]
    split = cohort.greedy_split(groups, {"train": 0.7, "validation": 0.15, "test": 0.15}, starts=50)
    assert set(split.values()) == {"train", "validation", "test"} and set(split) == {g[0] for g in groups}


def test_hashes(spark):
    df = spark.createDataFrame([(1, None), (None, 1), (1, 1)], "a int, b int")
    assert df.select(row_hash(["a", "b"])).distinct().count() == 3 and df.select(row_hash_128(["a", "b"])).distinct().count() == 3
    assert 0 <= df.select(keyed_draw("a", F.lit("b"))).first()[0] < 2**32


def test_federated_rounds_respect_the_budget(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (400, 4))
    y = (x[:, 0] + 0.1 * rng.normal(0, 1, 400) > 0).astype(int)
    rows = spark.createDataFrame([(int(i % 4), "utility" if i % 5 == 0 else "fit", int(y[i]), *map(float, x[i])) for i in range(400)], "client_id int, part string, label int, a double, b double, c double, d double")
    start = federated.initial_vector(4, 0, (8, 4))
    kept = start.copy()
    low = {"n_utility": 1, "utility_benign": 1, "utility_attack": 1, "n_fit": 1}
    vector, log = federated.run_rounds(rows, ["a", "b", "c", "d"], "Cost-Only", 2, 0.6, 0, (8, 4), 40, low)
    assert log.count() == 2 and all(r.used_bytes <= r.budget_bytes and r.selected for r in log.collect())
    assert np.array_equal(start, kept) and not np.array_equal(vector, start)
    held, _ = federated.run_rounds(rows, ["a", "b", "c", "d"], "Cost-Only", 1, 0.0, 0, (8, 4), 1, low)
    assert np.array_equal(held, start)


def test_sources(spark, tmp_path):
    root = tmp_path / "in"
    for name, text in (("benign/a.csv", "﻿ x ,Label\n1,BENIGN\n2,NA\n"), ("dos/b.csv", "x,Label\n3,DoS\n")):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
    found = files.discover(spark, str(root), ["*.csv", "a*"]).orderBy("file_no").collect()
    assert [os.path.basename(r.path) for r in found] == ["a.csv", "b.csv"] and [r.file_no for r in found] == [0, 1]
    df = files.with_source(files.read_csv(spark, str(root)), "source_file", 2, ["benign"])
    assert {(r.x, r.Label, r.source_class) for r in df.collect()} == {("1", "BENIGN", "benign"), ("2", None, "benign"), ("3", "DoS", "attack")}
    manifest = files.file_manifest(spark, str(root))
    assert manifest.count() == 2 and len(files.tree_hash(manifest, str(root)).first().tree_sha256) == 64 and files.same_parts(manifest, manifest)
    out = str(tmp_path / "out")
    files.write_splits(spark.createDataFrame([("train", 1), ("test", 0), ("train", 0)], "split string, label int"), out)
    assert {(r.split, r.rows, r.attack) for r in files.part_manifest(spark, out).collect()} == {("train", 2, 1), ("test", 1, 0)}
    for seed in (1, 2):
        files.append_rows(spark.range(2), str(tmp_path / f"runs/seed{seed}"))
    assert files.read_seeds(spark, str(tmp_path / "runs"), 2).where("training_seed = 2").count() == 2
    with pytest.raises(ValueError):
        files.read_seeds(spark, str(tmp_path / "runs"), 3)
    (tmp_path / "m.csv").write_text("﻿cell_id,beta\na,NA\nb,0.2\n", encoding="utf-8")
    assert files.unique_manifest(spark, str(tmp_path / "m.csv")).where("beta is null").count() == 1
    (tmp_path / "d.csv").write_text("cell_id\na\na\n")
    with pytest.raises(ValueError):
        files.unique_manifest(spark, str(tmp_path / "d.csv"))


def test_streaming_log_equals_batch(spark, tmp_path):
    from tidemark.streaming.selection_log import write_selection_log

    df = candidates(spark, *({"wire_bytes": b, "utility": u} for b, u in ((80, 0.4), (100, 0.3), (80, 0.2))))
    df.write.parquet(str(tmp_path / "in/1"))
    df.withColumn("round", F.lit(1)).write.parquet(str(tmp_path / "in/2"))
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = write_selection_log(stream, str(tmp_path / "log"), str(tmp_path / "cp"), "Utility-Only", beta=0.7)
    assert query.awaitTermination(120)
    got = {(r.round, tuple(r.selected)) for r in spark.read.parquet(str(tmp_path / "log")).collect()}
    assert got == {(0, (0, 2)), (1, (0, 2))} or got == {(0, (0, 1)), (1, (0, 1))}
