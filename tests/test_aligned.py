"""Alignment: masks, plans per combination, and evaluation on the items a combination has."""

import pytest
from pyspark.sql import functions as F

from mnemo.plans import aligned as A
from mnemo.plans import evaluate as EV

SETS = ["a", "b", "c"]
COMBOS = {"a": ["a"], "b": ["b"], "a+b": ["a", "b"], "c": ["c"], "a+c": ["a", "c"], "none": ["a", "b", "c"]}


@pytest.fixture(scope="module")
def vecs(spark):
    rows = []
    for i in range(60):
        rows.append((i, "a", [float(i), 1.0]))
        if i % 3:
            rows.append((i, "b", [float(-i), None if i % 5 == 0 else 2.0]))
        if i < 4:
            rows.append((i, "c", [] if i == 0 else None if i == 1 else [float("nan")] if i == 2 else [1.0]))
    return spark.createDataFrame(rows, "item_id long, feature_set string, values array<double>").repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i / 60) for i in range(2, 70)], "item_id long, y double")


def test_masks(vecs):
    m = {r["item_id"]: (r["has"], r["whole"]) for r in A.presence(vecs, SETS).collect()}
    assert m[0] == (1, 1)          # c is empty
    assert m[1] == (3, 3)          # c is null
    assert m[2] == (7, 3)          # c holds NaN
    assert m[3] == (5, 5) and m[5] == (3, 1) and m[6] == (1, 1)


def test_plans_hold_the_items_of_a_combination(vecs, labels):
    labelled = set(range(2, 60))
    b_whole = {i for i in range(60) if i % 3 and i % 5}
    want = {True: {"a": labelled, "b": labelled & b_whole, "a+b": labelled & b_whole, "c": {3}, "a+c": {3}},
            False: {"a": labelled, "b": {i for i in labelled if i % 3}, "a+b": {i for i in labelled if i % 3}, "c": {2, 3}, "a+c": {2, 3},
                    "none": {2}}}
    for complete in (True, False):
        p = A.make_plans(vecs, labels, COMBOS, SETS, complete)
        rows = p.members.collect()
        assert p.of.keys() == want[complete].keys()       # a combination without items has no plan
        for c, items in want[complete].items():
            part = [r for r in rows if r["plan"] == p.of[c]]
            assert {r["item_id"] for r in part} == items and len(part) == len(items) == p.n_samples[c]
            sizes = [sum(r["fold"] == f for r in part) for f in range(1, 6)]
            assert max(sizes) - min(sizes) <= 1
        assert p.of["b"] == p.of["a+b"] and p.of["c"] == p.of["a+c"]   # equal items, one plan
        assert {r["item_id"] for r in A.aligned_items(vecs, SETS, ["a", "b"], labels, complete).collect()} == want[complete]["a+b"]


def test_evaluation_counts_the_aligned_items(spark, vecs, labels):
    res = {(r["combination"], r["model"]): r for r in EV.evaluate_aligned(
        vecs, labels, {c: COMBOS[c] for c in ("a", "b", "a+b", "none")}, {"a": 2, "b": 2, "c": 1}).collect()}
    assert {c for c, _ in res} == {"a", "b", "a+b"}
    assert res["a", "rho_sign"]["n_samples"] == 58 and res["a+b", "rho_sign"]["n_samples"] == 31
    # the first value of every set orders the items as the label does
    assert all(r["mean_spearman"] == 1.0 for (_, m), r in res.items() if m == "rho_sign")
    empty = EV.evaluate_aligned(vecs.limit(0), labels, COMBOS, {"a": 2, "b": 2, "c": 1})
    assert empty.count() == 0


def test_complete_data_gives_the_plain_evaluation(spark, vecs, labels):
    from mnemo.operators.folds import assign_folds
    a = vecs.where("feature_set = 'a'")
    long = a.select("item_id", "feature_set", F.posexplode("values").alias("idx", "value")).withColumn("idx", F.col("idx").cast("long"))
    lab = labels.where("item_id < 60")
    plain = EV.evaluate_scored(long, assign_folds(lab), {"a": ["a"]}, {"a": 2})
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, EV.evaluate_aligned(a, lab, {"a": ["a"]}, {"a": 2}).collect()))


def test_aligned_tasks_follow_the_data(spark, monkeypatch):
    """F16: shuffles are cut by the number of values, so a task's share does not grow; rows and the session's setting stay."""
    import mnemo.plans.evaluate as E
    rows = [(i, s, [float((i * p + j) % 11) for j in range(2)]) for i in range(40) for p, s in ((3, "a"), (7, "b")) if (i + p) % 5]
    vecs = spark.createDataFrame(rows, "item_id long, feature_set string, values array<double>")
    labels = spark.createDataFrame([(i, float(i % 4)) for i in range(40)], "item_id long, y double")
    combos, widths = {"a": ["a"], "b": ["b"], "ab": ["a", "b"]}, {"a": 2, "b": 2}
    want = sorted(map(tuple, E.evaluate_aligned(vecs, labels, combos, widths).collect()))
    seen, real, before = [], E.ranked_rho, spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(E, "TASK_CELLS", 5)
    monkeypatch.setattr(E, "ranked_rho", lambda *a: seen.append((int(spark.conf.get("spark.sql.shuffle.partitions")), a[3])) or real(*a))
    got = sorted(map(tuple, E.evaluate_aligned(vecs, labels, combos, widths).collect()))
    assert got == want and len(got) == 6
    assert seen[0][0] >= seen[0][1] > 40 and spark.conf.get("spark.sql.shuffle.partitions") == before
