"""Frames and word counts are made once, whatever reads them."""

from mnemo.operators import text_features as TF
from mnemo.plans.extract import extract_all
from mnemo.sources.lexicons import emotion_lexicon, pos_lexicon
from pyspark.sql import functions as F


def test_extract_all_makes_frames_and_counts_once(spark):
    texts = spark.createDataFrame([("dev", 1, "a joy of words. words"), ("dev", 2, None), ("test", 3, "words and rain")],
                                  "split string, item_id long, text string")
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(x):
        made.add(1)
        return x

    rows = [("dev", c, i, float(i % 5 + 1), 80.0 + i, i % 2 == 0) for c in (1, 3) for i in range(30)]
    frames = spark.createDataFrame(rows, "split string, clip_id long, frame long, rms double, f0 double, voiced boolean")
    turns = spark.createDataFrame([(1, 0, "user", "hello")], "clip_id long, turn long, role string, text string")
    levels = spark.createDataFrame([(1, -3.0)], "item_id long, peak_db double")
    out = extract_all(texts, frames.withColumn("rms", seen("rms")), turns, levels, emotion_lexicon(spark), pos_lexicon(spark), ["dev", "test"])
    assert out["audio_c"].count() == 2 and out["audio_o"].count() == 2 and made.value == len(rows)
    assert {r["dir"]: r["files"] for r in out["summary"].collect()}["total"] == 3 + 3 + 2 + 2 and made.value == len(rows)
    got = {r["item_id"]: r["rarity"] for r in out["semantic"].collect()}
    for names, split in ((["dev"], "dev"), (["dev", "test"], "test")):
        vocab = TF.word_frequency(texts.where(F.col("split").isin(*names)))
        want = TF.semantic_features(texts.where(F.col("split") == split).select("item_id", "text"), "item_id", vocab, pos_lexicon(spark))
        assert all(abs(got[r["item_id"]] - r["rarity"]) < 1e-12 for r in want.collect())


def test_extract_all_lets_shuffle_files_of_a_step_go(spark, monkeypatch):
    """When the last extractor is written, most shuffles of the steps before are gone."""
    import time

    from mnemo.plans import extract as X
    texts = spark.createDataFrame([("dev", 1, "a joy of words. words"), ("test", 3, "words and rain")], "split string, item_id long, text string")
    rows = [("dev", c, i, float(i % 5 + 1), 80.0 + i, i % 2 == 0) for c in (1, 3) for i in range(30)]
    turns = spark.createDataFrame([(1, 0, "user", "hello")], "clip_id long, turn long, role string, text string")
    levels = spark.createDataFrame([(1, -3.0)], "item_id long, peak_db double")
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()

    def held():
        return {int(x) for x in str(tracker.shuffleStatuses().keySet().mkString(",")).split(",") if x}
    before, made, real = held(), set(), X.release_shuffles

    def released(session):
        made.update(held() - before)
        real(session)
    monkeypatch.setattr("mnemo.session.release_shuffles", released)
    monkeypatch.setattr(X, "release_shuffles", released)

    def frames():
        return spark.createDataFrame(rows, "split string, clip_id long, frame long, rms double, f0 double, voiced boolean").repartition(3)
    X.extract_all(texts, frames(), turns, levels, emotion_lexicon(spark), pos_lexicon(spark), ["dev", "test"])
    end = time.time() + 20
    while len(made & held()) > len(made) // 3 and time.time() < end:
        time.sleep(0.2)
    assert len(made) > 20 and len(made & held()) <= len(made) // 3
