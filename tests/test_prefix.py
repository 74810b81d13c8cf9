"""Running sums and ranks over range partitions, against plain versions."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from mnemo.operators import ranks as R
from mnemo.operators.prefix import running_sums


@pytest.mark.parametrize("ranges", [None, 1, 4, 9])
def test_running_sums(spark, ranges):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 8 + ["a", None, ""]), i, rng.choice([None, *range(5)]), 1) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, t long, v long, one long").repartition(3)
    got = {r["t"]: (r["v_before"], r["one_before"]) for r in running_sums(df, ["g"], ["t"], ["v", "one"], ranges).collect()}
    want, v, n = {}, {}, {}
    for g, t, x, _ in rows:
        want[t] = (v.get(g, 0), n.get(g, 0))
        v[g], n[g] = v.get(g, 0) + (x or 0), n.get(g, 0) + 1
    assert got == want
    whole = running_sums(df, [], ["t"], ["one"], ranges)
    assert {r["t"]: r["one_before"] for r in whole.collect()} == {i: i for i in range(400)}
    assert running_sums(df.limit(0), ["g"], ["t"], ["v"], ranges).count() == 0


def table(spark):
    """One value in 90 % of the rows, NaN, nulls and a zero of either sign."""
    rng = random.Random(2)
    odd = [None, float("nan"), 0.0, -0.0, 3.5, -1.0, float("inf")]
    rows = [(i, i % 2 if i % 10 else None, 7.0 if rng.random() < 0.9 else rng.choice(odd)) for i in range(1000)]
    return rows, spark.createDataFrame(rows, "id long, g long, v double").repartition(4)


@pytest.mark.parametrize("ranges", [None, 2, 16])
def test_average_rank_of_a_hot_value(spark, ranges):
    rows, df = table(spark)
    got = {r["id"]: r["r"] for r in R.average_rank(df, ["g"], "v", "r", blocks=ranges).collect()}
    p = pd.DataFrame(rows, columns=["id", "g", "v"])
    # NaN is above all numbers, a null after it
    p["key"] = [(1, 1) if r[2] is None else (1, 0) if r[2] != r[2] else (0, r[2] + 0.0) for r in rows]
    want = {}
    for _, part in p.groupby(p["g"].fillna(-1)):
        order = sorted(part["key"])
        for i, k in zip(part["id"], part["key"]):
            low = order.index(k)
            want[i] = low + (order.count(k) + 1) / 2
    assert got == want


def test_no_window_holds_a_group(spark):
    _, df = table(spark)
    plans = [R.average_rank(df, ["g"], "v"), R.spearman(df.withColumn("y", F.col("id") % 5), ["g"], "v", "y")]
    for plan in plans:
        for line in plan._jdf.queryExecution().executedPlan().toString().splitlines():
            assert "Window" not in line or "_range" in line, line


def test_fold_rho_matches_ranks_of_the_training_rows(spark):
    rng = random.Random(3)
    items = [(i, rng.choice([0.1, 0.2, 0.2, 0.9, 0.5]), 1 + i % 3) for i in range(60)]
    long = [(i, s, d, rng.choice([0.0, 1.0, rng.random()]) if d else 4.0) for i, *_ in items for s in ("a", "b") for d in range(3)
            if not (s == "b" and i % 7 == 0)]
    labelled = spark.createDataFrame(items, "item_id long, y double, fold long")
    features = spark.createDataFrame(long, "item_id long, feature_set string, idx int, value double")
    p = pd.DataFrame(long, columns=["item_id", "feature_set", "idx", "value"]).merge(
        pd.DataFrame(items, columns=["item_id", "y", "fold"]), on="item_id")
    all_items = pd.DataFrame(items, columns=["item_id", "y", "fold"])
    want = {}
    for f in (1, 2, 3):
        ry = all_items[all_items.fold != f].assign(ry=lambda t: t.y.rank())[["item_id", "ry"]]
        for (s, d), part in p[p.fold != f].merge(ry, on="item_id").groupby(["feature_set", "idx"]):
            rho = part["value"].rank().corr(part["ry"]) if part["value"].nunique() > 1 else 0.0
            want[f, s, d] = rho
    got = {(r["fold"], r["feature_set"], r["idx"]): r["rho"] for r in R.fold_rho(features, labelled, 3).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[x] - want[x]) < 1e-9 for x in want)
    rows = features.join(labelled, "item_id").crossJoin(spark.range(1, 4).toDF("f")).select(
        F.col("f").alias("fold"), F.when(F.col("fold") == F.col("f"), "test").otherwise("train").alias("role"),
        "item_id", "y", "feature_set", "idx", "value")
    again = {(r["fold"], r["feature_set"], r["idx"]): r["rho"] for r in R.role_rho(rows).collect()}
    assert all(abs(again[x] - want[x]) < 1e-9 for x in want)
