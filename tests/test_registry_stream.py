"""Registries (D3, U4, E9, E10, P11) and the incremental stream."""

import os

import pytest
from pyspark.ml.regression import GBTRegressor, LinearRegression

from mnemo import registry as R
from mnemo.sources.lexicons import emotion_lexicon
from mnemo.streaming.incremental import run_incremental_emotion


def test_registry_counts_and_override():
    combos = R.all_combinations()
    assert len(R.ALL_FEATURE_SETS) == 14 and len(R.FEATURE_GROUPS) == 19 and len(combos) == 33
    assert combos["Temporal"] == combos["R3D"] == ["R3D"]
    assert sum(R.FEATURE_WIDTHS[s] for s in combos["All"]) == 42190


def test_selector_and_model_registry(spark):
    assert callable(R.selector("spearman_30"))
    with pytest.raises(ValueError):
        R.selector("nope")
    assert isinstance(R.model("Ridge", 10, 100, 1.0), LinearRegression)
    assert isinstance(R.model("GradientBoosting", 10, 100, 1.0), GBTRegressor)
    ridge = R.model("Ridge", 10, 200, 0.5)
    assert abs(ridge.getRegParam() - 0.5 / 200) < 1e-15
    with pytest.raises(ValueError):
        R.model("nope", 1, 1, 1.0)


def test_incremental_stream_skips_processed(spark, tmp_dir):
    src = os.path.join(tmp_dir, "stt")
    os.makedirs(src)
    for i, t in enumerate(["happy joyful day", "the road"]):
        with open(os.path.join(src, f"v{i}.txt"), "w") as f:
            f.write(t)
    lex = emotion_lexicon(spark, [("happy", "joy"), ("joyful", "joy")])
    store, ck = os.path.join(tmp_dir, "store"), os.path.join(tmp_dir, "ck")
    assert run_incremental_emotion(spark, src, lex, store, ck) >= 1
    assert spark.read.parquet(store).count() == 2
    with open(os.path.join(src, "v9.txt"), "w") as f:
        f.write("joyful")
    run_incremental_emotion(spark, src, lex, store, ck)
    ids = sorted(r["item_id"] for r in spark.read.parquet(store).collect())
    assert ids == ["v0", "v1", "v9"]                 # nothing processed twice
    assert run_incremental_emotion(spark, src, lex, store, ck) == 0
