"""PCA of wide and of tall data against numpy."""

import numpy as np
import pytest

from mnemo.plans.learners import pca_krylov


@pytest.mark.parametrize("n,d,k", [(30, 200, 5), (30, 200, 40), (300, 12, 4), (90, 90, 6)])
def test_scores_match_the_full_decomposition(spark, n, d, k):
    rng = np.random.default_rng(n + d)
    x = rng.normal(size=(n, d)) * np.linspace(3, 0.5, d) + 5.0
    rows = [(f, "test" if i % 5 == f else "train", i, 0.0, [float(v) for v in x[i]]) for i in range(n) for f in (0, 1)]
    df = spark.createDataFrame(rows, "fold long, role string, item_id long, y double, features array<double>").repartition(5)
    got = {(r["fold"], r["item_id"]): r["features"] for r in pca_krylov(df, k).collect()}
    for f in (0, 1):
        train = [i for i in range(n) if i % 5 != f]
        mean = x[train].mean(0)
        _, s, vt = np.linalg.svd(x[train] - mean, full_matrices=False)
        want = (x - mean) @ vt[:k].T
        mine = np.array([got[f, i] for i in range(n)])
        assert mine.shape == (n, min(k, d))
        rank = min(k, len(train) - 1, d)
        # components past the rank have no variance: zeros in training
        assert np.abs(mine[train, rank:]).max(initial=0.0) < 1e-5
        if (n, d) != (90, 90):  # the space holds all of the data's rank
            assert np.abs(np.abs(mine[:, :rank]) - np.abs(want[:, :rank])).max() < 1e-5
        else:
            kept = (mine[train] ** 2).sum() / (want[train][:, :k] ** 2).sum()
            assert kept > 0.999


def test_constant_columns_and_one_row(spark):
    rows = [(0, "train", 0, 0.0, [1.0, 2.0]), (0, "test", 1, 0.0, [3.0, 2.0])]
    df = spark.createDataFrame(rows, "fold long, role string, item_id long, y double, features array<double>")
    assert [r["features"] for r in pca_krylov(df, 2).collect()] == [[0.0, 0.0], [0.0, 0.0]]
