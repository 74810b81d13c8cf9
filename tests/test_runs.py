"""Stored predictions, resumed sweeps, and the values of linear fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemo.plans import runs as RU
from mnemo.plans.learners import fit_predict, scale_arrays

WIDTHS = {"a": 3, "b": 2}
COMBOS = {"a": ["a"], "b": ["b"], "a+b": ["a", "b"]}


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 5))
    x[:, 4] = 1.5  # a constant column
    y = x @ np.array([1.0, -2.0, 0.5, 0.3, 0.0]) + 0.1 * rng.normal(size=60)
    return x, y


@pytest.fixture(scope="module")
def study(spark, data):
    x, y = data
    rows = [(i, s, [float(v) for v in x[i, at]]) for i in range(60) for s, at in (("a", slice(0, 3)), ("b", slice(3, 5)))
            if not (s == "b" and i % 10 == 0)]
    vecs = spark.createDataFrame(rows, "item_id long, feature_set string, values array<double>").repartition(4)
    labels = spark.createDataFrame([(i, float(y[i])) for i in range(45)], "item_id long, y double")
    return RU.Study(vecs.where("item_id < 45"), labels, COMBOS, WIDTHS, others=vecs.where("item_id >= 45"), k=3)


def test_linear_fits_match_their_closed_forms(spark, data):
    x, y = data
    rows = [(f, "test" if i % 3 == f else "train", i, float(y[i]), [float(v) for v in x[i]]) for i in range(60) for f in range(3)]
    df = spark.createDataFrame(rows, "fold long, role string, item_id long, y double, features array<double>").repartition(4)
    z = scale_arrays(df, ["fold"])
    for model, alpha in (("LinearRegression", 0.0), ("Ridge", 1.0)):
        got = {(r["fold"], r["item_id"]): r["pred"] for r in fit_predict(z, model).collect()}
        for f in range(3):
            train = np.array([i for i in range(60) if i % 3 != f])
            mean, sd = x[train].mean(0), x[train].std(0)
            s = (x - mean) / np.where(sd < 1e-12, 1.0, sd)
            s, used = s[:, :4], y[train].mean()
            w = np.linalg.solve(s[train].T @ s[train] + alpha * np.eye(4), s[train].T @ (y[train] - used))
            for i in range(60):
                if i % 3 == f:
                    assert abs(got[f, i] - (used + s[i] @ w)) < 1e-6, (model, f, i)


def rounded(rows):
    return sorted(tuple(round(v, 9) + 0.0 if isinstance(v, float) else v for v in r) for r in rows)


CONFIGS = [{"combo": "a", "model": "Ridge", "selector": "none", "preprocessing": "concat"},
           {"combo": "a+b", "model": "LinearRegression", "selector": "none", "preprocessing": "concat"},
           {"combo": "zzz", "model": "Ridge", "selector": "none", "preprocessing": "concat"}]


def test_runs_share_fits(spark, study, tmp_dir, monkeypatch):
    store = RU.Store(spark, f"{tmp_dir}/store")
    runs = {1: CONFIGS, 2: [CONFIGS[1], CONFIGS[0]], 3: CONFIGS[:2]}
    first = rounded(RU.ensemble_cv_runs(study, store, runs).collect())
    fits = [r for r in spark.read.parquet(f"{store.path}/ledger").collect() if r["state"] == "ok"]
    assert len(fits) == 2  # two configurations, three runs over equal items
    assert {r[1] for r in first if r[0] == 1} == {"a/Ridge/none/concat", "a+b/LinearRegression/none/concat", "zzz/Ridge/none/concat",
                                                 "Ensemble (rank average)"}
    zeros = [r for r in first if r[1].startswith("zzz") and r[2] == "spearman"]
    assert [r[3:] for r in zeros] == [(0.0, 0.0, 0.0, 0.0)]
    assert [r[1:] for r in first if r[0] == 2] == [r[1:] for r in first if r[0] == 3]

    def fail(*a, **k):
        raise AssertionError("fitted again")
    monkeypatch.setattr(RU, "fit_predict", fail)
    again = rounded(RU.ensemble_cv_runs(study, store, {1: CONFIGS, 2: runs[2], 3: runs[3]}).collect())
    assert again == first
    # other items, other fits: the run without a+b has 45 items, not 40
    _, status = RU.fold_predictions(study, store, CONFIGS[:1])
    assert [r["status"] for r in status.collect()] == ["failed"]


def test_predictions_of_the_other_split(spark, study, tmp_dir):
    store = RU.Store(spark, f"{tmp_dir}/store")
    scores, status = RU.full_predictions(study, store, CONFIGS)
    assert {r["item_id"] for r in scores.collect()} == {i for i in range(45, 60) if i % 10}  # those that have all fused sets
    rows = status.orderBy("cfg_id").collect()
    assert [r["status"] for r in rows] == ["ok", "ok", "failed"] and "zzz" in rows[2]["message"]
    assert rows[0]["train_rho"] > 0.9 and rows[1]["train_rho"] > 0.9 and rows[2]["train_rho"] is None
    assert [r["n_train"] for r in rows] == [45, 40, None]
    nothing, status = RU.full_predictions(study, store, CONFIGS[2:])
    assert nothing.count() == 0 and nothing.columns == ["item_id", "score"] and status.count() == 1


def test_a_stopped_sweep_resumes(spark, study, tmp_dir, monkeypatch):
    store = RU.Store(spark, f"{tmp_dir}/sweep")
    part = RU.sweep_cells(study, store, ["a", "nope", "a+b"], ["Ridge", "LinearRegression", "no_model"], ["none"], "both", stop_after=1)
    assert part.where("status = 'ok'").count() == 2
    tries = []
    real = RU.cell_row
    monkeypatch.setattr(RU, "cell_row", lambda *a: tries.append(a[1:5]) or real(*a))
    later = RU.Store(spark, f"{tmp_dir}/sweep")
    key = RU.key_of("cell", ["Ridge", "LinearRegression", "no_model"], 100, "concat", "a", "none")
    assert later.claim(key)                                     # another driver is at work on one entry
    rows = RU.sweep_cells(study, later, ["b"], ["MLP"], ["pca_30"]).collect()   # the stopped run's parameters count
    assert {(t[0], t[3]) for t in tries} == {("a+b", "kernel"), ("a+b", "concat")}
    later.take_over()
    rows = RU.sweep_cells(study, later, ["b"], ["MLP"], ["pca_30"]).collect()
    assert len(tries) == 9
    ok = {(r["combination"], r["model"]): r for r in rows if r["status"] == "ok"}
    assert ok.keys() == {(c, p + m) for c in ("a", "a+b") for p in ("", "KF_") for m in ("Ridge", "LinearRegression")}
    assert ok["a", "Ridge"]["n_samples"] == 45 and ok["a+b", "Ridge"]["n_samples"] == 40 and ok["a+b", "Ridge"]["n_features"] == 5
    assert [r["combination"] for r in rows if r["status"] == "skipped"] == ["nope"]
    failed = [r for r in rows if r["status"] == "failed"]
    assert len(failed) == 4 and all("no_model" in r["message"] for r in failed)


def test_a_failed_entry_is_tried_again(spark, tmp_dir):
    store = RU.Store(spark, f"{tmp_dir}/s")

    def broken():
        raise RuntimeError("no luck")
    assert store.fill("k", broken) == ("failed", "no luck")
    assert store.fill("k", lambda: spark.range(3).withColumn("x", F.lit(1))) == ("ok", None)
    assert store.read("k").count() == 3 and store.fill("k", broken) == ("ok", None)
