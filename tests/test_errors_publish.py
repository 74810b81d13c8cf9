"""Files that can't be decoded, folders that are missing, and publishing in versions."""

import io
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemo.operators import quality as Q
from mnemo.sources import files as FS


def npy(a):
    b = io.BytesIO()
    np.save(b, a)
    return b.getvalue()


@pytest.fixture
def folder(tmp_dir):
    os.makedirs(f"{tmp_dir}/features/audio_o")
    os.makedirs(f"{tmp_dir}/features/none_here")
    good = npy(np.arange(9, dtype=np.float32))
    for name, data in {"good": good, "cut": good[:-4], "text": b"not an array", "empty": b"", "deep": npy(np.zeros((2, 2, 2))),
                       "object": npy(np.zeros(9)).replace(b"<f8", b"|O "), "frames": npy(np.ones((1, 9)))}.items():
        with open(f"{tmp_dir}/features/audio_o/{name}.npy", "wb") as f:
            f.write(data)
    return f"{tmp_dir}/features"


def test_a_corrupt_file_is_one_failed_row(spark, folder):
    rows = {r["item_id"]: r for r in FS.ingest_arrays(spark, f"{folder}/audio_o", "dev", "audio_o", failed=True).collect()}
    assert len(rows) == 6  # Spark's file sources leave out a file of no bytes
    assert {i for i, r in rows.items() if r["status"] == "ok"} == {"good", "frames"}
    assert all(r["message"] and r["frames"] is None for i, r in rows.items() if r["status"] == "fail")
    assert {r["item_id"] for r in FS.ingest_arrays(spark, f"{folder}/audio_o", "dev", "audio_o").collect()} == {"good", "frames"}
    null = spark.createDataFrame([("x/y.npy", None)], "path string, content binary")
    assert FS.decode_arrays(null).first()["status"] == "fail"


def test_the_error_reaches_the_quality_report(spark, folder):
    d = FS.ingest_arrays(spark, f"{folder}/audio_o", "dev", "audio_o", failed=True)
    vectors = d.select(F.lit("audio_o").alias("dir"), F.lit("audio_o").alias("kind"), "item_id", F.array(F.size(F.flatten("frames"))).alias("shape"),
                       F.flatten("frames").cast("array<double>").alias("values"), F.col("message").alias("load_error"))
    none = spark.createDataFrame([], "item_id string, empty boolean"), spark.createDataFrame([], "item_id string, peak_db double")
    levels = Q.item_level(Q.issues(vectors, *none))
    found = {r["item_id"]: (r["level"], r["issues"]) for r in levels.collect()}
    assert found["good"] == ("ok", [])
    assert found["cut"][0] == "FAIL" and found["cut"][1][0].startswith("FAIL not readable: ValueError") and len(found["cut"][1]) == 1
    states = FS.folder_states(spark, folder, ["audio_o", "none_here", "not_there"])
    assert {r["dir"]: (r["state"], r["files"]) for r in states.collect()} == {
        "audio_o": ("present", 6), "none_here": ("empty", 0), "not_there": ("missing", 0)}
    s = {r["dir"]: r for r in Q.qa_summary(levels, states).collect()}
    assert s["not_there"]["status"] == "missing" and s["none_here"]["status"] == "empty"
    assert (s["total"]["files"], s["total"]["fail"], s["total"]["status"]) == (6, 4 + 2, "FAIL")
    assert not Q.gate(Q.qa_summary(levels, states)).first()["publish"]


def summary(spark, fail):
    return spark.createDataFrame([("total", 3, 3 - fail, 0, fail, "ok")], "dir string, files long, ok long, warn long, fail long, status string")


def test_publish_in_versions(spark, tmp_dir, monkeypatch):
    root = f"{tmp_dir}/out"
    with pytest.raises(FileNotFoundError):
        Q.read_published(spark, root, "a")
    assert not Q.gated_publish(summary(spark, 1), {"a": spark.range(3)}, root) and Q.published_version(spark, root) is None
    assert Q.gated_publish(summary(spark, 0), {"a": spark.range(3), "b": spark.range(1)}, root, report=summary(spark, 0))
    assert Q.read_published(spark, root, "a").count() == 3 and Q.read_published(spark, root, "check_report").count() == 1
    first = Q.published_version(spark, root)
    manifest = {r["name"]: r["rows"] for r in spark.read.json(f"{root}/{first}/_manifest").collect()}
    assert manifest == {"a": 3, "b": 1, "check_report": 1}
    # the gate stops, a write breaks half-way: the old version stays
    assert not Q.gated_publish(summary(spark, 2), {"a": spark.range(9)}, root)
    broken = spark.range(5).select(F.raise_error(F.lit("disk")).cast("long").alias("id"))
    with pytest.raises(Exception):
        Q.gated_publish(summary(spark, 0), {"a": spark.range(9), "b": broken}, root)
    assert Q.published_version(spark, root) == first and Q.read_published(spark, root, "a").count() == 3
    assert Q.gated_publish(summary(spark, 0), {"a": spark.range(9)}, root)
    assert Q.read_published(spark, root, "a").count() == 9 and Q.published_version(spark, root) != first
