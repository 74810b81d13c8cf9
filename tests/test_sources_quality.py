"""File sources / sinks and the quality rules on hand-made vectors."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemo.functions.arrays import flatten_frames, nan_to_num
from mnemo.operators import quality as QA
from mnemo.operators.align import validate_names
from mnemo.sources import files as FS


def test_npy_ingest_store_and_scan(spark, tmp_dir):
    src = os.path.join(tmp_dir, "npy")
    os.makedirs(src)
    np.save(os.path.join(src, "v1.npy"), np.array([1.0, np.nan, np.inf], dtype=np.float32))
    np.save(os.path.join(src, "v2.npy"), np.array([[1, 2], [3, 4]], dtype=np.float32))
    np.save(os.path.join(src, "v3.npy"), np.arange(10, dtype=np.float32).reshape(5, 2))
    raw = FS.ingest_arrays(spark, src, "devset", "toy")
    store = os.path.join(tmp_dir, "store")
    FS.write_feature_store(raw, store)
    got = {r["item_id"]: r["values"] for r in
           FS.scan_feature_set(FS.read_feature_store(spark, store), "toy", "devset").collect()}
    assert got["v1"] == [1.0, 0.0, 0.0]                       # NaN / Inf -> 0
    assert got["v2"] == [1.0, 2.0, 3.0, 4.0, 0.0, 0.0]          # padded to 3 rows
    assert got["v3"] == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]          # truncated to 3 rows
    with pytest.raises(FileNotFoundError):
        FS.scan_feature_set(FS.read_feature_store(spark, store), "missing", "devset")


def test_csv_and_text_sources(spark, tmp_dir):
    p = os.path.join(tmp_dir, "gt.csv")
    with open(p, "w") as f:
        f.write("id,memorability_score,other\nv1,0.5,x\nv2,0.75,y\n")
    lab = {r["item_id"]: r["y"] for r in FS.scan_labels(spark, p).collect()}
    assert lab == {"v1": 0.5, "v2": 0.75}
    assert sorted(r[0] for r in FS.scan_item_list(spark, p).collect()) == ["v1", "v2"]
    td = os.path.join(tmp_dir, "stt")
    os.makedirs(td)
    with open(os.path.join(td, "v1.txt"), "w", encoding="utf-8") as f:
        f.write("hello\nworld")
    t = FS.scan_transcripts(spark, td).collect()
    assert t[0]["item_id"] == "v1" and t[0]["text"] == "hello\nworld"


def test_resolve_asset(spark):
    listing = spark.createDataFrame([("a", ".webm"), ("a", ".mp4"), ("b", ".mkv"), ("c", ".avi")],
                                    "item_id string, ext string")
    items = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "item_id string")
    r = {x["item_id"]: x["asset"] for x in FS.resolve_asset(items, listing, [".mp4", ".mkv", ".webm"]).collect()}
    assert r == {"a": ".mp4", "b": ".mkv", "c": None, "d": None}


def test_validate_names(spark):
    reg = spark.createDataFrame([("a", 1)], "name string, v int")
    req = spark.createDataFrame([("a",), ("zz",)], "name string")
    with pytest.raises(ValueError):
        validate_names(req, reg, "name")
    assert validate_names(req, reg, "name", strict=False).count() == 1


def _vec(spark, rows):
    return spark.createDataFrame(rows, "dir string, kind string, item_id long, shape array<int>, values array<double>")


def test_quality_rules(spark):
    nan, inf = float("nan"), float("inf")
    v = _vec(spark, [
        ("d/o", "audio_o", 1, [9], [1.0] * 7 + [nan, nan]),            # optional NaN -> ok
        ("d/o", "audio_o", 2, [9], [nan] + [1.0] * 8),                 # unexpected NaN
        ("d/c", "audio_c", 3, [3, 9], [0.0] * 27),                     # zero audio, quiet -> BENIGN
        ("d/c", "audio_c", 4, [3, 9], [0.0] * 27),                     # zero audio, loud -> FAIL
        ("d/c", "audio_c", 5, [2, 9], [1.0] * 18),                     # wrong shape
        ("d/s", "semantic", 6, [7], [0.0] * 7),                        # zero text, empty transcript
        ("d/s", "semantic", 7, [7], [0.0] * 7),                        # zero text, transcript content
        ("d/s", "semantic", 8, [7], [nan] * 7),                        # all NaN -> FAIL
        ("d/e", "emotion", 9, [19], [inf] + [1.0] * 18),               # Inf
    ])
    tr = spark.createDataFrame([(6, True), (7, False), (8, True)], "item_id long, empty boolean")
    lv = spark.createDataFrame([(3, -60.0), (4, -10.0)], "item_id long, peak_db double")
    out = {r["item_id"]: (r["level"], r["issues"]) for r in QA.item_level(QA.issues(v, tr, lv)).collect()}
    assert out[1] == ("ok", [])
    assert out[2][0] == "FAIL" and out[3] == ("BENIGN", ["BENIGN silent audio"])
    assert out[4][0] == "FAIL" and out[5] == ("FAIL", ["FAIL wrong shape"])
    assert out[6] == ("BENIGN", ["BENIGN empty transcript"])
    assert out[7] == ("FAIL", ["FAIL all-zero valid elements (transcript has content)"])
    assert out[8] == ("FAIL", ["FAIL all NaN"]) and out[9][1] == ["FAIL Inf"]
    s = {r["dir"]: r for r in QA.qa_summary(QA.item_level(QA.issues(v, tr, lv))).collect()}
    assert s["total"]["files"] == 9 and s["total"]["fail"] == 6 and s["d/o"]["status"] == "FAIL"
    assert QA.gate(QA.qa_summary(QA.item_level(QA.issues(v, tr, lv)))).first()["publish"] is False


def test_projection_edge_cases(spark):
    df = spark.createDataFrame([([[1.0, float("nan")]], True), ([[1.0, 2.0], [3.0, 4.0]], False)],
                               "frames array<array<double>>, g boolean")
    got = [r[0] for r in df.select(nan_to_num(flatten_frames(F.col("frames"), F.col("g")))).collect()]
    assert got == [[1.0, 0.0], [1.0, 2.0, 3.0, 4.0, 0.0, 0.0]]
