"""Word lexicons as small DataFrames.

Real lexicons (an emotion lexicon with ten affect labels, a part-of-speech
dictionary) load from CSV with `load_lexicon`.  The built-in test lexicons
below cover frequent tokens of the driver's documents so that the lookup,
pivot and ratio operators are exercised; the same rows appear in the SQL
oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The ten affect labels (output order) and the four core ones.
EMOTION_LABELS = ["joy", "anger", "fear", "sadness", "positive", "negative",
                  "anticipation", "disgust", "surprise", "trust"]
CORE_LABELS = ["joy", "anger", "fear", "sadness"]

# Test emotion lexicon (word, emotion).
TEST_EMOTION_LEXICON = [
    ("the", "joy"), ("the", "positive"),
    ("and", "trust"), ("and", "positive"),
    ("of", "anger"), ("of", "negative"),
    ("to", "anticipation"),
    ("in", "sadness"), ("in", "negative"),
    ("is", "surprise"),
    ("that", "disgust"), ("that", "negative"),
    ("it", "fear"),
    ("was", "sadness"),
    ("for", "trust"),
    ("with", "joy"), ("with", "trust"),
    ("as", "anger"),
    ("de", "fear"), ("de", "negative"),
    ("la", "joy"),
    ("der", "anger"),
    ("le", "sadness"),
    ("el", "surprise"), ("el", "positive"),
    ("und", "anticipation"), ("und", "positive"),
]

# Test part-of-speech lexicon (word, pos).
TEST_POS_LEXICON = [
    ("is", "VERB"), ("was", "VERB"), ("are", "VERB"), ("be", "VERB"), ("have", "VERB"),
    ("est", "VERB"), ("ist", "VERB"), ("es", "VERB"),
    ("de", "NOUN"), ("la", "NOUN"), ("der", "NOUN"), ("le", "NOUN"), ("time", "NOUN"),
    ("that", "ADJ"), ("this", "ADJ"), ("new", "ADJ"), ("good", "ADJ"),
]


def emotion_lexicon(spark: SparkSession, rows=None) -> DataFrame:
    return spark.createDataFrame(rows or TEST_EMOTION_LEXICON, "word string, emotion string")


def pos_lexicon(spark: SparkSession, rows=None) -> DataFrame:
    return spark.createDataFrame(rows or TEST_POS_LEXICON, "word string, pos string")


def load_lexicon(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lexicon from a headed CSV, e.g. schema 'word string, emotion string'."""
    return spark.read.schema(schema).option("header", True).csv(path)
