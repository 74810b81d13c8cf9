"""Ranks, folds, selection, scaling and kernels: closed forms, properties
and leakage."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemo.operators import kernels as K
from mnemo.operators.ensemble import fuse_rank_average
from mnemo.operators.folds import assign_folds, explode_train
from mnemo.operators.ranks import average_rank, spearman, top_n_spearman
from mnemo.operators.scaling import fold_feature_stats


def test_average_rank_ties_and_blocks(spark):
    vals = [3.0, 1.0, 3.0, 2.0, 3.0, 5.0, 1.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id long, v double")
    plain = {r["id"]: r["r"] for r in average_rank(df, [], "v", "r").collect()}
    blocked = {r["id"]: r["r"] for r in average_rank(df, [], "v", "r", blocks=3).collect()}
    assert plain == blocked
    assert plain[1] == plain[6] == 1.5 and plain[3] == 3.0 and plain[0] == 5.0 and plain[5] == 7.0
    assert sum(plain.values()) == len(vals) * (len(vals) + 1) / 2


def test_spearman_constant_is_zero(spark):
    df = spark.createDataFrame([(0, 1.0, 5.0), (0, 2.0, 5.0), (0, 3.0, 5.0)], "g int, y double, p double")
    assert spearman(df, ["g"], "y", "p").first()["spearman"] == 0.0


def test_fold_sizes_match_ntile(spark):
    for n in (12, 13, 4, 1):
        items = spark.range(n).withColumnRenamed("id", "item_id")
        f = assign_folds(items)
        sizes = sorted((r["count"] for r in f.groupBy("fold").count().collect()), reverse=True)
        q, r = divmod(n, 5)
        assert sizes == [q + 1] * r + [q] * (min(5, n) - r)
        assert f.select("item_id").distinct().count() == n


def _toy(spark, n=40, d=6, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    y = x[:, 0] * 2 + rng.normal(scale=0.1, size=n)
    x[:, 3] = 1.0   # constant column
    long = spark.createDataFrame([(i, "s", j, float(x[i, j])) for i in range(n) for j in range(d)],
                                 "item_id long, feature_set string, idx long, value double")
    lab = spark.createDataFrame([(i, float(y[i])) for i in range(n)], "item_id long, y double")
    return long, lab


def test_top_n_spearman_constant_last_and_all_kept(spark):
    long, lab = _toy(spark)
    folded = assign_folds(lab)
    sel = top_n_spearman(long, folded, 30, ["s"])
    rows = sel.where("fold = 1").orderBy("sel_rank").collect()
    assert len(rows) == 6                          # fewer features than n: all kept
    assert rows[0]["idx"] == 0                     # the informative column first
    assert rows[-1]["idx"] == 3 and rows[-1]["rho"] == 0.0   # constant ranked last


def test_leakage_test_rows_do_not_move_fits(spark):
    long, lab = _toy(spark)
    folded = assign_folds(lab).cache()
    test_ids = [r["item_id"] for r in folded.where("fold = 1").collect()]
    noisy = long.withColumn("value", F.when(F.col("item_id").isin(test_ids), F.col("value") * 100 + 7)
                            .otherwise(F.col("value")))
    train = explode_train(folded, 5).select(F.col("tf").alias("fold"), "item_id", "y")
    a = {(r["feature_set"], r["idx"]): (r["rho"], r["mean"], r["sd"])
         for r in fold_feature_stats(long, train).where("fold = 1").collect()}
    b = {(r["feature_set"], r["idx"]): (r["rho"], r["mean"], r["sd"])
         for r in fold_feature_stats(noisy, train).where("fold = 1").collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert np.allclose(a[k], b[k], equal_nan=True)


def _vecs(spark, x, fold=1):
    return spark.createDataFrame([(fold, "s", i, [float(v) for v in row]) for i, row in enumerate(x)],
                                 "fold long, feature_set string, item_id long, vec array<double>")


def test_kernel_symmetric_unit_diagonal(spark):
    rng = np.random.default_rng(1)
    v = _vecs(spark, rng.normal(size=(25, 4)))
    g = K.median_gamma(v, ["fold", "feature_set"])
    kr = K.kernel_rows(v, v, g, ["fold", "feature_set"], ids=True).collect()
    m = np.zeros((25, 25))
    for r in kr:
        m[r["item_id"], r["lm_ids"]] = r["k"]
    assert np.allclose(m, m.T) and np.allclose(np.diag(m), 1.0)


def test_gamma_matches_numpy_and_degenerate(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 3))
    g = K.median_gamma(_vecs(spark, x), ["fold", "feature_set"]).first()["gamma"]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))[np.triu_indices(30, 1)]
    assert abs(g - 1 / (2 * np.median(d) ** 2)) < 1e-12
    same = K.median_gamma(_vecs(spark, np.ones((5, 3))), ["fold", "feature_set"]).first()["gamma"]
    assert same == 1.0


def test_combine_kernels_weights_and_errors(spark):
    rows = spark.createDataFrame([(1, "a", [1.0, 2.0]), (1, "b", [3.0, 4.0])], "i long, feature_set string, k array<double>")
    out = K.combine_kernels(rows, ["i"], {"a": 1.0, "b": 0.5}).first()["k"]
    assert out == [2.5, 4.0]
    with pytest.raises(ValueError):
        K.combine_kernels(rows, ["i"], {})
    with pytest.raises(Exception):
        K.combine_kernels(rows, ["i"], {"a": 1.0, "b": 1.0, "c": 1.0}).collect()


def test_fusion_constant_config_contributes_constant(spark):
    rows = [(0, 1, i, float(i)) for i in range(4)] + [(0, 2, i, 0.0) for i in range(4)]
    p = spark.createDataFrame(rows, "fold long, cfg_id long, item_id long, p double")
    f = {r["item_id"]: r["fused"] for r in fuse_rank_average(p, ["fold"]).collect()}
    const = (4 + 1) / (2 * 4)
    for i in range(4):
        assert abs(f[i] - ((i + 1) / 4 + const) / 2) < 1e-9


def test_blocks_do_not_change_ranks(spark):
    from mnemo.operators import ranks as R
    values = [float(i % 7) for i in range(60)] + [None] * 5 + [3.0] * 90
    df = spark.createDataFrame([(i % 2, v) for i, v in enumerate(values)], "g int, v double")
    plain = {(r["g"], r["v"]): r["r"] for r in R.average_rank(df, ["g"], "v", "r").collect()}
    for blocks in (2, 5):
        assert plain == {(r["g"], r["v"]): r["r"] for r in R.average_rank(df, ["g"], "v", "r", blocks=blocks).collect()}


def test_equal_rank_averages_tie_exactly(spark):
    # three configs whose ranks are permutations of each other for items 0, 1, 2
    rows = [(c, i, float((i + c) % 3)) for c in range(3) for i in range(3)] + [(c, i, 3.0 + i) for c in range(3) for i in range(3, 50)]
    p = spark.createDataFrame(rows, "cfg_id long, item_id long, p double")
    f = {r["item_id"]: r["fused"] for r in fuse_rank_average(p, []).collect()}
    assert f[0] == f[1] == f[2] and abs(f[0] - 2 / 50) < 1e-12


def test_welch_of_equal_scores_is_null(spark):
    from pyspark.sql import functions as F
    from mnemo.functions.stats import t_two_sided_p, welch_df, welch_t
    v, n, m = F.lit(0.0), F.lit(3.0), F.lit(0.5)
    t, df = welch_t(m, v, n, m, v, n), welch_df(v, n, v, n)
    assert tuple(spark.range(1).select(t, df, t_two_sided_p(t, df)).first()) == (None, None, None)


def test_failed_configuration_is_visible(spark, monkeypatch):
    from mnemo.plans import evaluate as EV
    items = [("dev" if i < 30 else "test", i, "a", 0, float(i % 5)) for i in range(40)]
    long = spark.createDataFrame(items, "split string, item_id long, feature_set string, idx int, value double")
    labels = spark.createDataFrame([(i, float(i % 5)) for i in range(30)], "item_id long, y double")
    configs = [{"cfg_id": 1, "combo": "a", "model": "LinearRegression", "selector": "none", "preprocessing": "concat"},
               {"cfg_id": 2, "combo": "missing", "model": "LinearRegression", "selector": "none", "preprocessing": "concat"}]
    got = EV.predict_configs(spark, long, labels, configs, {"a": ["a"]}).collect()
    assert {(r["cfg_id"], r["status"]) for r in got} == {(1, "ok"), (2, "failed")}
    assert [r["message"] for r in got if r["cfg_id"] == 2] == ["'missing'"]
    monkeypatch.setattr(EV, "evaluate_model", lambda *a: 1 / 0)
    cells = EV.sweep(spark, long, {"a": ["a"]}, {"a": 1}, ["Ridge"], ["none"], "concat").collect()
    assert [(r["status"], r["mean_spearman"], r["message"]) for r in cells] == [("failed", None, "division by zero")]


def test_pca_keeps_as_many_columns_as_rows(spark):
    from mnemo.plans.learners import pca_project
    rows = [(1, "train" if i < 4 else "test", i, [float(i * j % 3 + j) for j in range(6)]) for i in range(6)]
    df = spark.createDataFrame(rows, "fold long, role string, item_id long, features array<double>")
    assert {len(r["features"]) for r in pca_project(df, 5).collect()} == {4}


def test_pca_wide_matches_numpy_up_to_sign(spark):
    from mnemo.plans.learners import pca_project
    rng = np.random.default_rng(3)
    x = rng.normal(size=(30, 120)) * np.linspace(5, 0.1, 120)
    rows = [(1, "train" if i < 24 else "test", i, None, [float(v) for v in x[i]]) for i in range(30)]
    df = spark.createDataFrame(rows, "fold long, role string, item_id long, y double, features array<double>")
    got = {r["item_id"]: r["features"] for r in pca_project(df, 3).collect()}
    mu = x[:24].mean(0)
    _, _, vt = np.linalg.svd(x[:24] - mu, full_matrices=False)
    want = (x - mu) @ vt[:3].T
    g = np.array([got[i] for i in range(30)])
    for c in range(3):
        assert min(np.abs(g[:, c] - want[:, c]).max(), np.abs(g[:, c] + want[:, c]).max()) < 1e-6


def test_kernels_against_landmarks(spark):
    """Rows meet the first m training rows by keyed hash; with m of all rows that is the whole kernel."""
    import hashlib
    rng = np.random.default_rng(3)
    rows = [(1 + i % 2, s, i, [float(x) for x in rng.normal(size=3)]) for i in range(60) for s in ("a", "b")]
    v = spark.createDataFrame(rows, "fold int, feature_set string, item_id long, vec array<double>").repartition(5)
    g = K.median_gamma(v, ["fold", "feature_set"])
    gamma = {(r["fold"], r["feature_set"]): r["gamma"] for r in g.collect()}
    vec = {(f, s, i): np.array(x) for f, s, i, x in rows}
    for m in (7, 30, 1000):
        ids = {f: sorted(sorted((i for i in range(60) if 1 + i % 2 == f), key=lambda i: hashlib.md5(f"{i}:42".encode()).hexdigest())[:m])
               for f in (1, 2)}

        def kernel(f, s, i):
            return np.array([np.exp(-gamma[f, s] * ((vec[f, s, i] - vec[f, s, j]) ** 2).sum()) for j in ids[f]])

        for r in K.kernel_rows(v, v, g, ["fold", "feature_set"], n_landmarks=m, ids=True).collect():
            assert r["lm_ids"] == ids[r["fold"]] and np.allclose(r["k"], kernel(r["fold"], r["feature_set"], r["item_id"]))
        for r in K.pairwise_distances(v, v, ["fold", "feature_set"], n_landmarks=m).collect():
            f, s, i = r["fold"], r["feature_set"], r["item_id"]
            assert np.allclose(r["dist"], [np.sqrt(((vec[f, s, i] - vec[f, s, j]) ** 2).sum()) for j in ids[f]])
        fused = K.fused_kernel_rows(v, v, g, ["fold"], {"a": 1.0, "b": 0.5}, n_landmarks=m, ids=True).collect()
        assert len(fused) == 60
        for r in fused:
            f, i = r["fold"], r["item_id"]
            assert r["lm_ids"] == ids[f] and np.allclose(r["k"], kernel(f, "a", i) + 0.5 * kernel(f, "b", i))
    with pytest.raises(ValueError):  # item 0 lacks set b
        K.fused_kernel_rows(v, v.where("NOT (item_id = 0 AND feature_set = 'b')"), g, ["fold"], {"a": 1.0, "b": 1.0})
    with pytest.raises(Exception):
        K.fused_kernel_rows(v.where("NOT (item_id = 0 AND feature_set = 'b')"), v, g, ["fold"], {"a": 1.0, "b": 1.0}).collect()


def test_nystroem_map_approximates_the_kernel(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(60, 4)), rng.normal(size=(2, 4)).repeat(10, axis=0)])  # repeated rows: eigenvalues 0
    v = _vecs(spark, x)
    g = K.median_gamma(v, ["fold", "feature_set"])
    full = np.exp(-g.first()["gamma"] * ((x[:, None] - x[None]) ** 2).sum(-1))

    def error(m):
        got = K.nystroem_map(v, v, g, ["fold", "feature_set"], n_landmarks=m).orderBy("item_id").collect()
        phi = np.array([r["phi"] for r in got])
        assert phi.shape == (80, min(m, 80))
        return np.abs(phi @ phi.T - full).max()

    assert error(80) < 1e-6 and error(200) < 1e-6
    assert error(40) < error(10) < 1.0


def test_no_kernel_query_pairs_rows(spark):
    """Rows are mapped where they are: no exchange of kernel rows, and the width does not grow with the data."""
    rng = np.random.default_rng(6)
    v = _vecs(spark, rng.normal(size=(600, 4)))
    g = K.median_gamma(v, ["fold", "feature_set"])
    k = K.kernel_rows(v, v, g, ["fold", "feature_set"])
    assert "Exchange" not in k._jdf.queryExecution().executedPlan().toString()
    assert {len(r["k"]) for r in k.collect()} == {K.N_LANDMARKS}


def test_fitted_ensemble_tells_failed_configs(spark):
    from mnemo.plans.catalog import q_ensemble_fit_predict
    got = q_ensemble_fit_predict(spark, "/root/testdata/sf0.001").collect()
    failed = [r for r in got if r["status"] == "failed"]
    assert [r["cfg_id"] for r in failed] == [4] and "no_such_combo" in failed[0]["message"] and failed[0]["item_id"] is None
    assert all(r["status"] == "ok" and r["score"] is not None for r in got if r not in failed) and len(got) > 1


def test_whole_kernels_meet_every_training_row(spark, monkeypatch):
    """Sums over all training rows, more than the landmarks; blocks and tiles of any size, repeated vectors, null ids."""
    rng = np.random.default_rng(7)
    n = 300
    x = {s: rng.normal(size=(n, w)) for s, w in (("a", 3), ("b", 5))}
    x["a"][5] = x["a"][4]
    rows = [(1, s, "train" if i % 10 else "test", None if i == 9 else i, [float(v) for v in x[s][i]]) for s in x for i in range(n)]
    v = spark.createDataFrame(rows, "fold int, feature_set string, role string, item_id long, vec array<double>").repartition(3)
    tr = np.array([i for i in range(n) if i % 10])
    train = v.where("role = 'train'")
    g = K.median_gamma(train, ["fold", "feature_set"])
    gamma = {r["feature_set"]: r["gamma"] for r in g.collect()}
    dist = {s: np.sqrt(((x[s][:, None] - x[s][tr][None]) ** 2).sum(-1)) for s in x}
    kern = {s: np.exp(-gamma[s] * dist[s] ** 2) for s in x}
    monkeypatch.setattr(K, "ROW_BLOCK", 70)
    monkeypatch.setattr(K, "TRAIN_BLOCK", 90)
    monkeypatch.setattr(K, "TILE", (16, 11))
    at = {None: 9}
    for r in K.distance_sums(v, train, ["fold", "feature_set"]).collect():
        assert r["n"] == len(tr) == 270 and abs(r["total"] - dist[r["feature_set"]][at.get(r["item_id"], r["item_id"])].sum()) < 1e-9
    got = K.kernel_sums(v, train, g, ["fold", "feature_set"], keep=["role"], off_diagonal=True).collect()
    assert len(got) == 2 * n
    for r in got:
        i, s = at.get(r["item_id"], r["item_id"]), r["feature_set"]
        other = kern[s][i][(tr != i) & (tr != 9)]  # a null id is neither equal to another nor different
        assert abs(r["total"] - kern[s][i].sum()) < 1e-9
        assert r["largest"] is None if i == 9 else abs(r["largest"] - other.max()) < 1e-12
    fused = K.fused_kernel_sums(v, train, g, ["fold"], {"a": 1.0, "b": 0.5}, keep=["role"]).collect()
    assert len(fused) == n and {r["n"] for r in fused} == {270}
    for r in fused:
        i = at.get(r["item_id"], r["item_id"])
        assert abs(r["total"] - (kern["a"][i] + 0.5 * kern["b"][i]).sum()) < 1e-9
    with pytest.raises(Exception):
        K.fused_kernel_sums(v.where("NOT (item_id = 0 AND feature_set = 'b')"), train, g, ["fold"], {"a": 1.0, "b": 1.0}).collect()
    with pytest.raises(Exception):
        K.distance_sums(v, train.where("feature_set = 'a'"), ["fold", "feature_set"]).collect()


def test_kernel_queries_are_whole(spark):
    from mnemo.checks.oracle_sql import SQL
    from mnemo.plans.catalog import QUERIES
    sf = "/root/testdata/sf0.01"
    got = QUERIES["kernel_as_features"](spark, sf).groupBy("fold").agg({"n_cols": "min", "role": "count"}).collect()
    train = {r["fold"]: r["n"] for r in QUERIES["rbf_kernel_train"](spark, sf).where("feature_set = 'emb_a'").groupBy("fold").count()
             .withColumnRenamed("count", "n").collect()}
    assert all(r["min(n_cols)"] == train[r["fold"]] > K.N_LANDMARKS for r in got) and len(got) == 5
    assert not any("rn <= 256" in SQL[q] for q in ("pairwise_distance", "rbf", "fold_kernels"))


def test_models_of_a_sweep_share_one_design(spark, monkeypatch):
    from mnemo.plans import evaluate as EV
    rng = np.random.default_rng(2)
    rows = [(f, "test" if i % 5 == f - 1 else "train", i, float(i % 7), "a", j, float(rng.normal()))
            for f in range(1, 6) for i in range(40) for j in range(3)]
    rows = spark.createDataFrame(rows, "fold long, role string, item_id long, y double, feature_set string, idx long, value double")
    made, real = [], EV.concat_design
    monkeypatch.setattr(EV, "concat_design", lambda *a: made.append(a[2]) or real(*a))
    cells = EV.sweep(spark, rows, {"a": ["a"]}, {"a": 3}, ["Ridge", "LinearRegression"], ["none"], "concat").collect()
    assert made == ["none"] and [(r["status"], r["n_samples"]) for r in cells] == [("ok", 40)] * 2


def test_array_maps_hold_a_bounded_number_of_rows(spark):
    """Batches are cut: groups mixed in a batch, more rows than a cut, order kept."""
    from mnemo.plans import learners as L
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 4))
    rows = [(1 + i % 3, "train", i, [float(v) for v in x[i]]) for i in range(3000)]
    df = spark.createDataFrame(rows, "fold long, role string, item_id long, features array<double>").coalesce(1)
    got = {r["item_id"]: r["features"] for r in L.scale_arrays(df, ["fold"]).collect()}
    for f in range(3):
        at = np.arange(f, 3000, 3)
        assert np.allclose([got[i] for i in at], (x[at] - x[at].mean(0)) / x[at].std(0))
    seen = []
    L._array_map(type("B", (), {"value": {1: ()}}), lambda m: seen.append(len(m)) or m).func(
        __import__("pyarrow").array([1] * 3000), __import__("pyarrow").array(x.tolist()))
    assert max(seen) <= 1024 and sum(seen) == 3000


def test_training_rows_meet_once_for_both(spark, monkeypatch):
    """Blocks of training rows meet in pairs: half of the tiles, the sums and largest values of every row; copies, null ids."""
    rng = np.random.default_rng(9)
    n = 200
    x = rng.normal(size=(n, 3))
    x[7] = x[3]
    ids = [None if i == 9 else 20 if i == 21 else i for i in range(n)]  # a null id, a repeated one
    rows = [(1, "a", "train" if i % 10 else "test", ids[i], i, [float(v) for v in x[i]]) for i in range(n)]
    v = spark.createDataFrame(rows, "fold int, feature_set string, role string, item_id long, at long, vec array<double>").repartition(3)
    train, g = v.where("role = 'train'"), None
    g = K.median_gamma(train, ["fold", "feature_set"])
    tr = [i for i in range(n) if i % 10]
    d2 = ((x[:, None] - x[None]) ** 2).sum(-1)
    kern = np.exp(-g.first()["gamma"] * d2)
    monkeypatch.setattr(K, "ROW_BLOCK", 40)
    monkeypatch.setattr(K, "TRAIN_BLOCK", 50)
    monkeypatch.setattr(K, "TILE", (16, 11))
    among = v.role == "train"
    got = K.kernel_sums(v, train, g, ["fold", "feature_set"], keep=["role", "at"], off_diagonal=True, among=among).collect()
    assert sorted(r["at"] for r in got) == list(range(n))
    for r in got:
        i = r["at"]
        others = [j for j in tr if ids[j] is not None and ids[i] is not None and ids[j] != ids[i]]
        assert r["n"] == len(tr) and abs(r["total"] - kern[i, tr].sum()) < 1e-9
        assert r["largest"] is None if ids[i] is None else abs(r["largest"] - kern[i, others].max()) < 1e-12
    both = K.fused_kernel_sums(v.drop("at"), train.drop("at"), g, ["fold"], {"a": 2.0}, keep=["role"], among=among)
    apart = K.fused_kernel_sums(v.drop("at"), train.drop("at"), g, ["fold"], {"a": 2.0}, keep=["role"])
    at = {(r["role"], r["item_id"]): (r["total"], r["n"]) for r in apart.collect()}
    assert {(r["role"], r["item_id"]) for r in both.collect()} == set(at) and None in {i for _, i in at}
    assert all(r["n"] == at[r["role"], r["item_id"]][1] and abs(r["total"] - at[r["role"], r["item_id"]][0]) < 1e-9 for r in both.collect())
    made = []
    tiles = lambda *_: lambda i, j: made.append(1) or np.zeros((len(range(40)[i]), len(range(40)[j])))
    one = __import__("pyarrow").table({"item_id": list(range(40)), "vec": [[0.0]] * 40, "fold": [1] * 40})
    K._meet(one, one, ("item_id", "item_id"), (["vec"], ["vec"]), ["fold"], tiles, False, True)
    assert len(made) == 3 * 4  # tiles of one direction only
    plan = K.distance_sums(train, train, ["fold", "feature_set"])._jdf.queryExecution().toString()
    assert "FlatMapGroupsInArrow" in plan and "CoGroups" not in plan


def test_designs_from_item_vectors_match_long_rows(spark, monkeypatch):
    """every selector gives the rows it gave on a row per fold and value, and copies items into folds without them."""
    from mnemo.plans import evaluate as EV
    from mnemo.registry import SELECTORS, selector
    rng = np.random.default_rng(4)
    widths = {"a": 20, "b": 35}
    vecs = [(i, s, [float(v) for v in rng.normal(size=w)]) for i in range(70) for s, w in widths.items()]
    vecs = spark.createDataFrame(vecs + [(99, "a", None)], "item_id long, feature_set string, values array<double>")
    folded = spark.createDataFrame([(i, float(i % 7), 1 + i % 5) for i in range(70)], "item_id long, y double, fold long")
    long_df = vecs.selectExpr("item_id", "feature_set", "posexplode(values) as (idx, value)")
    rows = EV.role_rows(long_df, folded)
    items = EV.folded_vectors(vecs, folded, (1, 2, 3, 4, 5))
    names = []
    monkeypatch.setattr(EV, "assemble", lambda *a: names.append(a))  # only long rows need it
    made = {n: selector(n)(items, ["b", "a"]).collect() for n in SELECTORS}
    assert not names
    monkeypatch.undo()
    for n in SELECTORS:
        want = {(r["fold"], r["role"], r["item_id"], r["y"]): r["features"] for r in selector(n)(rows, ["b", "a"]).collect()}
        got = {(r["fold"], r["role"], r["item_id"], r["y"]): r["features"] for r in made[n]}
        assert got.keys() == want.keys() and len(made[n]) == 350
        fix = np.abs if n.startswith("pca") else np.asarray
        assert all(np.allclose(fix(got[x]), fix(want[x]), atol=1e-6) for x in want), n


def test_item_vectors_with_copies_and_short_vectors(spark):
    """Copies of an item and vectors of other lengths give what `assemble` gives."""
    from mnemo.plans import evaluate as EV
    vecs = spark.createDataFrame([(1, "a", [1.0, 2.0]), (1, "a", [0.5, 3.0]), (1, "b", [9.0]), (2, "b", [4.0, 5.0]), (3, "a", []), (4, "b", [7.0, 1.0])],
                                 "item_id long, feature_set string, values array<double>")
    folded = spark.createDataFrame([(1, 0.1, 1), (2, 0.2, 2), (3, 0.3, 1), (4, 0.4, 1), (4, None, 2)], "item_id long, y double, fold long")
    rows = EV.role_rows(vecs.selectExpr("item_id", "feature_set", "posexplode(values) as (idx, value)"), folded, 2)
    items = EV.folded_vectors(vecs, folded, (1, 2))
    for sel in ("none", "spearman_2"):
        want = sorted(map(str, EV.assemble(EV._select_rows(rows, ["b", "a"], sel, None), ["b", "a"]).collect()))
        assert sorted(map(str, EV.assemble_vectors(items, ["b", "a"], sel).collect())) == want
