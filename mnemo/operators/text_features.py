"""Text features: A9 word_frequency, U3 union_vocab, A10 complexity,
J7/A11 emotion scores, A12 dominant, A13/X1 emotion vector, A14 POS ratios,
A15 diversity, A16 sentence length, J8/A17 rarity, X2 semantic vector.

Per-document work stays inside rows (arrays + higher-order functions, no
shuffle); corpus work is grouped aggregation (map-side partial counts); the
lexicon lookups are broadcast joins behind a size check; the vocabulary
lookup is a broadcast join for frequent words, a shuffle join for the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text, sentence_count, tokenize_alpha, tokenize_ws
from ..sources.lexicons import CORE_LABELS, EMOTION_LABELS
from ..session import cut_lineage
from .joins import null_safe_join

# A word above this share of a corpus is looked up in a broadcast table: at most 100,000 words.
FREQUENT_SHARE = 1e-5


def _nan():
    return F.lit(float("nan"))


def word_frequency(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over a corpus of lower-cased alphabetic tokens."""
    return (texts.select(F.explode(tokenize_alpha(F.col(text_col))).alias("word"))
                 .groupBy("word").agg(F.count(F.lit(1)).alias("n")))


def union_vocab(*corpora: DataFrame, text_col: str = "text") -> DataFrame:
    """One vocabulary over several corpora, counts added."""
    texts = corpora[0].select(text_col)
    for c in corpora[1:]:
        texts = texts.unionByName(c.select(text_col))
    return word_frequency(texts, text_col)


def language_complexity(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """A10 on cleaned whitespace tokens: word_count, vocab_size,
    unique_word_ratio, avg_word_length (NaN ratios without words)."""
    words = tokenize_ws(clean_text(F.col(text_col)))
    n = F.size("_w")
    return (docs.select(id_col, words.alias("_w"))
                .select(id_col, n.cast("bigint").alias("word_count"),
                        F.size(F.array_distinct("_w")).cast("bigint").alias("vocab_size"),
                        F.when(n > 0, F.size(F.array_distinct("_w")) / n).otherwise(_nan()).alias("unique_word_ratio"),
                        F.when(n > 0, F.aggregate(F.transform("_w", F.length), F.lit(0), lambda a, b: a + b) / n)
                         .otherwise(_nan()).alias("avg_word_length")))


def emotion_scores(docs: DataFrame, id_col: str, lexicon: DataFrame,
                   text_col: str = "text") -> DataFrame:
    """J7 + A11: per document, hits of each affect label / all hits (0 when
    no hit).  Tokens probe a broadcast lexicon (map side, no token shuffle);
    only the (doc, label) hit counts are aggregated."""
    toks = docs.select(id_col, F.explode(tokenize_ws(clean_text(F.col(text_col)))).alias("word"))
    hits = (toks.join(lexicon, "word")
                .groupBy(id_col).pivot("emotion", EMOTION_LABELS).count())
    tot = sum(F.coalesce(F.col(e), F.lit(0)) for e in EMOTION_LABELS)
    scored = hits.select(id_col, *[(F.coalesce(F.col(e), F.lit(0)) / tot).alias(f"{e}_score")
                                   for e in EMOTION_LABELS])
    zeros = [F.coalesce(F.col(f"{e}_score"), F.lit(0.0)).alias(f"{e}_score") for e in EMOTION_LABELS]
    return docs.select(id_col).join(scored, id_col, "left").select(id_col, *zeros)


def dominant_emotion(scores: DataFrame) -> DataFrame:
    """Argmax over the core labels (first wins on ties), 'none' when
    their sum is 0; intensity = sum; one-hot of the four."""
    cols = [F.col(f"{e}_score") for e in CORE_LABELS]
    mx = F.greatest(*cols)
    s = sum(cols)
    dom = F.when(s <= 0, F.lit("none"))
    for e, c in zip(CORE_LABELS, cols):
        dom = dom.when(c == mx, F.lit(e))
    out = scores.withColumn("dominant_emotion", dom).withColumn("emotion_intensity", s)
    for e in CORE_LABELS:
        out = out.withColumn(f"dom_{e}", (F.col("dominant_emotion") == e).cast("bigint"))
    return out


EMOTION_VECTOR = ([f"{e}_score" for e in EMOTION_LABELS]
                  + ["word_count", "vocab_size", "unique_word_ratio", "avg_word_length",
                     "emotion_intensity"] + [f"dom_{e}" for e in CORE_LABELS])


def emotion_features(docs: DataFrame, id_col: str, lexicon: DataFrame,
                     text_col: str = "text") -> DataFrame:
    """The 19 named values (A13 order) plus `dominant_emotion`, and
    `vector` = the 19 values as ARRAY<DOUBLE>.

    One pass over the text: the token array gives the complexity values,
    the same projection explodes the tokens (carrying those values), tokens
    probe the broadcast word -> labels lexicon, and one aggregation per
    document (partial on the map side: a document's tokens never leave their
    task before being reduced to one row) counts the label hits.
    """
    words = tokenize_ws(clean_text(F.col(text_col)))
    n = F.size("_w")
    base = docs.select(id_col, words.alias("_w")).select(
        id_col, n.cast("bigint").alias("word_count"),
        F.size(F.array_distinct("_w")).cast("bigint").alias("vocab_size"),
        F.when(n > 0, F.size(F.array_distinct("_w")) / n).otherwise(_nan()).alias("unique_word_ratio"),
        F.when(n > 0, F.aggregate(F.transform("_w", F.length), F.lit(0), lambda a, b: a + b) / n)
         .otherwise(_nan()).alias("avg_word_length"), "_w")
    keys = [id_col, "word_count", "vocab_size", "unique_word_ratio", "avg_word_length"]
    # per-document values are projected before the explode (else they would
    # be re-evaluated on every token row)
    base = base.select(*keys, F.explode_outer("_w").alias("word"))
    lex = lexicon.groupBy("word").agg(F.collect_set("emotion").alias("_e"))
    hits = (base.join(lex, "word", "left")
                .groupBy(*keys).agg(*[F.sum(F.when(F.array_contains("_e", e), 1).otherwise(0)).alias(e)
                                      for e in EMOTION_LABELS]))
    tot = sum(F.col(e) for e in EMOTION_LABELS)
    scored = hits.select(*keys, *[F.when(tot > 0, F.col(e) / tot).otherwise(F.lit(0.0)).alias(f"{e}_score")
                                  for e in EMOTION_LABELS])
    out = dominant_emotion(scored)
    return out.withColumn("vector", F.array(*[F.col(c).cast("double") for c in EMOTION_VECTOR]))


def semantic_features(docs: DataFrame, id_col: str, vocab: DataFrame | None, pos_lex: DataFrame,
                      text_col: str = "text") -> DataFrame:
    """noun/verb/adj ratios (A14), lexical diversity and mean word length
    (A15), words per sentence (A16), rarity (J8 + A17); seven zeros for a
    text without words.

    rarity = -mean(ln(count(w) / corpus size)), unseen words count 1 and the
    corpus size is not adjusted for them.  Words above `FREQUENT_SHARE` of the
    corpus (at most 1/share, most tokens of a text) are looked up in a
    broadcast table and summed where the text is; only the other words are
    shuffled, as (document, word), to the rest of the vocabulary.  None of them
    is hot.  `vocab=None` means the vocabulary of these same documents.
    """
    vocab = cut_lineage(word_frequency(docs, text_col) if vocab is None else vocab)
    total = vocab.agg(F.sum("n").alias("_tot"))
    frequent = (vocab.join(F.broadcast(total)).where(F.col("n") > F.col("_tot") * FREQUENT_SHARE).select("word", "n"))
    words = tokenize_alpha(F.col(text_col))
    n = F.size("_w")
    values = ["num_words", "lexical_diversity", "avg_word_length", "avg_sentence_length"]
    # `_k` tells apart the texts of one id until their sums meet
    text_key = F.xxhash64(text_col).alias("_k")
    per_doc = docs.select(id_col, text_key, words.alias("_w"), sentence_count(F.col(text_col)).alias("_ns")).select(
        id_col, "_k", n.alias("num_words"),
        F.try_divide(F.size(F.array_distinct("_w")), n).alias("lexical_diversity"),
        F.try_divide(F.aggregate(F.transform("_w", F.length), F.lit(0), lambda a, b: a + b), n)
         .alias("avg_word_length"),
        F.when(F.col("_ns") > 0, F.try_divide(n, F.col("_ns"))).otherwise(F.lit(0.0)).alias("avg_sentence_length"),
        "_w")
    keys = [id_col, "_k", *values]
    pos = pos_lex.groupBy("word").agg(F.first("pos").alias("pos"))
    weight = F.ln(F.coalesce(F.col("n"), F.lit(1)) / F.col("_tot"))
    # per-document values are projected before the explode; sums of a document are partial in its task
    common = (per_doc.select(*keys, F.explode_outer("_w").alias("word"))
              .join(pos, "word", "left").join(F.broadcast(frequent), "word", "left").join(F.broadcast(total))
              .groupBy(*keys).agg(
                  *[F.sum(F.when(F.col("pos") == p, 1).otherwise(0)).alias(p) for p in ("NOUN", "VERB", "ADJ")],
                  F.sum(F.when(F.col("n").isNotNull(), weight)).alias("_ln"), F.count("word").alias("_c")))
    rare = (docs.select(id_col, text_key, F.explode(words).alias("word"))
            .join(F.broadcast(frequent.select("word")), "word", "left_anti")
            .join(vocab, "word", "left").join(F.broadcast(total))
            .groupBy(id_col, "_k").agg(F.sum(weight).alias("_rare")))
    agg = (null_safe_join(common, rare, [id_col, "_k"], "left")
           .withColumn("_ln", F.coalesce(F.col("_ln") + F.col("_rare"), "_ln", "_rare"))
           .groupBy(id_col, *values).agg(*[F.sum(p).alias(p) for p in ("NOUN", "VERB", "ADJ")],
                                         F.try_divide(-F.sum("_ln"), F.sum("_c")).alias("rarity")))
    names = ["noun_ratio", "verb_ratio", "adj_ratio", "lexical_diversity", "avg_word_length",
             "avg_sentence_length", "rarity"]
    out = agg.select(id_col, "num_words",
                     *[F.try_divide(F.col(p), F.col("num_words")).alias(f"{p.lower()}_ratio")
                       for p in ("NOUN", "VERB", "ADJ")],
                     "lexical_diversity", "avg_word_length", "avg_sentence_length", "rarity")
    out = out.select(id_col, *[F.when(F.col("num_words") > 0, F.col(c).cast("double")).otherwise(F.lit(0.0)).alias(c)
                               for c in names])
    return out.withColumn("vector", F.array(*[F.col(c) for c in names]))
