"""Golden values of the reference's self-tests and derived edge cases."""

import math

import pytest
from pyspark.sql import functions as F

from mnemo.functions import text as T
from mnemo.functions.stats import t_two_sided_p
from mnemo.operators import text_features as TF
from mnemo.sources.lexicons import emotion_lexicon


def one(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_clean_text(spark):
    df = one(spark, [("[music] hello world",), ("hello, world!",), ("HELLO World",)], "t string")
    assert [r[0] for r in df.select(T.clean_text(F.col("t"))).collect()] == ["hello world"] * 3


def test_count_syllables(spark):
    df = one(spark, [("hello world",), ("rhythm",), ("",), ("hel\nlo",)], "t string")
    got = [r[0] for r in df.select(T.count_syllables(F.col("t"))).collect()]
    # newline is removed, not turned into a space: 'hello' -> 2
    assert got == [3, 1, 0, 2]


def test_language_complexity(spark):
    df = one(spark, [(1, "hello world hello"), (2, "")], "id long, text string")
    r = {x["id"]: x for x in TF.language_complexity(df, "id").collect()}
    assert (r[1]["word_count"], r[1]["vocab_size"]) == (3, 2)
    assert abs(r[1]["unique_word_ratio"] - 2 / 3) < 1e-12 and abs(r[1]["avg_word_length"] - 5.0) < 1e-12
    assert r[2]["word_count"] == 0 and math.isnan(r[2]["unique_word_ratio"])


def test_dominant_emotion(spark):
    lex = emotion_lexicon(spark, [("happy", "joy"), ("joyful", "joy"), ("love", "joy"), ("love", "positive")])
    df = one(spark, [(1, "I am so happy and joyful today love everything"),
                     (2, "the building stood quietly beside the road"), (3, "")], "id long, text string")
    r = {x["doc_id"] if "doc_id" in x else x["id"]: x for x in
         TF.emotion_features(df, "id", lex).collect()}
    assert r[1]["joy_score"] > 0 and r[1]["dominant_emotion"] == "joy"
    assert [r[1][f"dom_{e}"] for e in ("joy", "anger", "fear", "sadness")] == [1, 0, 0, 0]
    assert r[2]["dominant_emotion"] == "none" and r[2]["emotion_intensity"] == 0
    assert len(r[3]["vector"]) == 19


def test_semantic_features(spark):
    corpus = one(spark, [("The quick brown fox jumps over the lazy dog.",),
                         ("She sells seashells by the seashore on a sunny afternoon.",),
                         ("Scientists discovered a beautiful new species deep in the rainforest.",)], "text string")
    vocab = TF.word_frequency(corpus)
    assert {r["word"]: r["n"] for r in vocab.collect()}["the"] >= 3
    pos = spark.createDataFrame([("scientist", "NOUN"), ("examined", "VERB"), ("rare", "ADJ")], "word string, pos string")
    docs = one(spark, [(1, "The curious scientist carefully examined the rare ancient artifact."), (2, "")],
               "id long, text string")
    r = {x["id"]: x for x in TF.semantic_features(docs, "id", vocab, pos).collect()}
    v = r[1]["vector"]
    assert len(v) == 7 and all(x >= 0 for x in v[:3]) and 0 < v[3] <= 1 and v[4] > 0 and v[5] > 0
    assert math.isfinite(v[6])
    assert r[2]["vector"] == [0.0] * 7


def test_welch_p_value(spark):
    df = one(spark, [(-2.0, 10.0), (0.0, 5.0), (3.0, 1.0)], "t double, df double")
    p = [r[0] for r in df.select(t_two_sided_p(F.col("t"), F.col("df"))).collect()]
    assert abs(p[0] - 0.0733880) < 1e-6
    assert abs(p[1] - 1.0) < 1e-9
    assert abs(p[2] - (1 - 2 * math.atan(3.0) / math.pi)) < 1e-6   # Cauchy


def test_p_matches_jvm_reference(spark):
    jvm = spark.sparkContext._jvm
    try:
        dist = jvm.org.apache.commons.math3.distribution.TDistribution(7.3)
    except Exception:
        pytest.skip("commons-math3 not on the classpath")
    expect = 2 * dist.cumulativeProbability(-1.7)
    df = one(spark, [(1.7, 7.3)], "t double, df double")
    got = df.select(t_two_sided_p(F.col("t"), F.col("df"))).first()[0]
    assert abs(got - expect) < 1e-6


def test_frequent_and_rare_words_give_one_rarity(spark, monkeypatch):
    """Words looked up in the broadcast table and shuffled ones give the same values; repeated rows, null ids and texts."""
    from mnemo.operators import text_features as TF
    rows = [(1, "the cat. the dog"), (2, "the owl"), (2, "the owl"), (2, "a bee sees the owl"), (None, "cat"), (3, None), (4, "...")]
    docs = spark.createDataFrame(rows, "id long, text string")
    pos = spark.createDataFrame([("cat", "NOUN"), ("sees", "VERB")], "word string, pos string")
    n = {}
    for _, t in rows:
        for w in __import__("re").findall("[a-z]+", t or ""):
            n[w] = n.get(w, 0) + 1
    total, got = sum(n.values()), []
    for share in (0.0, 0.2, 1.0):
        monkeypatch.setattr(TF, "FREQUENT_SHARE", share)
        got.append(sorted((str(r["id"]), round(r["rarity"], 9), round(r["noun_ratio"], 9), round(r["lexical_diversity"], 9))
                          for r in TF.semantic_features(docs, "id", None, pos).collect()))
    assert got[0] == got[1] == got[2] and len(got[0]) == 6  # equal rows of one id are one row, as before
    from math import log
    want = -(2 * log(n["the"] / total) + log(n["cat"] / total) + log(n["dog"] / total)) / 4
    assert [r for r in got[0] if r[0] == "1"] == [("1", round(want, 9), 0.25, 0.75)]
