"""Text scalar functions (JVM regex, higher-order array functions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII whitespace spelled out so that every engine agrees on it.
WS = " \t\n\x0b\f\r"


def clean_text(text: Column) -> Column:
    """drop [...] (within a line), non-letters -> space, squeeze, trim,
    lower.  "Non-letters other than whitespace -> space" followed by
    "squeeze whitespace runs" turns every maximal run of non-letters into
    one space, so both steps are a single `[^a-zA-Z]+` pass."""
    t = F.regexp_replace(text, r"\[[^\n]*?\]", " ")
    t = F.regexp_replace(t, "[^a-zA-Z]+", " ")
    return F.lower(F.trim(t))


def tokenize_ws(text: Column) -> Column:
    """whitespace split, empty tokens dropped (split('') has one '')."""
    return F.filter(F.split(text, f"[{WS}]+"), lambda w: w != "")


def tokenize_alpha(text: Column) -> Column:
    """lower-cased alphabetic (Unicode letter) tokens."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), 1)


def is_empty_text(text: Column) -> Column:
    """missing or whitespace-only."""
    return text.isNull() | text.rlike(f"^[{WS}]*$")


def count_syllables(text: Column) -> Column:
    """lower, drop everything but a-z and space (newlines too, so words
    across a line break join), per word max(1, vowel groups)."""
    t = F.regexp_replace(F.lower(text), "[^a-z ]", "")
    words = F.filter(F.split(t, " "), lambda w: w != "")
    groups = F.transform(words, lambda w: F.greatest(
        F.lit(1), F.size(F.regexp_extract_all(w, F.lit("([aeiou]+)"), 1))))
    return F.aggregate(groups, F.lit(0), lambda a, b: a + b).cast("bigint")


def sentence_count(text: Column) -> Column:
    """Sentence splitter used by A16: runs of non-terminators plus trailing
    terminators."""
    return F.size(F.regexp_extract_all(text, F.lit(r"([^.!?]+[.!?]*)"), 1))
