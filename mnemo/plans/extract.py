"""X5 extract_all: the four extractors on both splits, the quality rules on
their outputs, the directory summary and the publish gate.

Text extractors run on transcripts (item_id, text); the vocabulary of the
semantic extractor is built from the first split alone for the first split
and from both splits for the second (`vocab_splits`).  Audio extractors run
on frame tables.  Every output is a vector table shaped like the loaded
arrays, (dir, kind, item_id, shape, values), checked by Q1-Q7.

Every extractor's table (a row per item) is written when it is made, and the
shuffle files of its words or frames go before the next one starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_empty_text, tokenize_alpha
from ..operators import audio as AU
from ..operators import quality as QA
from ..operators import text_features as TF
from ..session import cut_lineage, release_shuffles, step_done


def _vectors(df: DataFrame, kind: str, split_col: str = "split") -> DataFrame:
    return df.select(F.concat_ws("/", split_col, F.lit(kind)).alias("dir"), F.lit(kind).alias("kind"),
                     "item_id", F.array(F.size("vector")).alias("shape"),
                     F.col("vector").cast("array<double>").alias("values"))


def extract_all(transcripts: DataFrame, frames: DataFrame, turns: DataFrame, levels: DataFrame,
                emotion_lex: DataFrame, pos_lex: DataFrame, split_order: list[str]) -> dict[str, DataFrame]:
    """transcripts: (split, item_id, text); frames: (split, clip_id, frame, ...);
    turns: (clip_id, turn, role, text); levels: (item_id, peak_db).
    Returns the feature tables, the issues, the summary and the gate."""
    out = {}
    # both feed many branches: the numbered frames every statistic of a clip, the word counts both vocabularies
    frames = cut_lineage(frames)
    release_shuffles(frames.sparkSession)
    counts = step_done(transcripts.select("split", F.explode(tokenize_alpha(F.col("text"))).alias("word"))
                         .groupBy("split", "word").agg(F.count(F.lit(1)).alias("n")))
    emo = step_done(TF.emotion_features(transcripts.select("item_id", "text"), "item_id", emotion_lex)
                    .join(transcripts.select("item_id", "split"), "item_id"))
    sem_parts = []
    for i, sp in enumerate(split_order):
        vocab = counts.where(F.col("split").isin(*split_order[:i + 1])).groupBy("word").agg(F.sum("n").alias("n"))
        sem_parts.append(step_done(TF.semantic_features(transcripts.where(F.col("split") == sp).select("item_id", "text"),
                                                        "item_id", vocab, pos_lex).withColumn("split", F.lit(sp))))
    sem = sem_parts[0]
    for p in sem_parts[1:]:
        sem = sem.unionByName(p)
    seg = step_done(AU.audio_segment_features(frames.drop("split")))
    clip_split = frames.select("clip_id", "split").distinct()
    audio_c = (seg.groupBy("clip_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seg", "vector"))), lambda s: s["vector"]).alias("_rows"))
        .join(clip_split, "clip_id")
        .select(F.concat_ws("/", "split", F.lit("audio_c")).alias("dir"), F.lit("audio_c").alias("kind"),
                F.col("clip_id").alias("item_id"),
                F.array(F.size("_rows"), F.size(F.element_at("_rows", 1))).alias("shape"),
                F.flatten("_rows").alias("values")))
    audio_o = step_done(AU.audio_global_features(frames.drop("split"), turns).join(clip_split, "clip_id")
                        .withColumnRenamed("clip_id", "item_id"))
    vectors = (_vectors(emo, "emotion").unionByName(_vectors(sem, "semantic"))
               .unionByName(audio_c).unionByName(_vectors(audio_o, "audio_o")))
    empty = transcripts.select("item_id", is_empty_text(F.col("text")).alias("empty"))
    issues = QA.item_level(QA.issues(vectors, empty, levels))
    summary = QA.qa_summary(issues)
    out.update(emotion=emo, semantic=sem, audio_c=audio_c, audio_o=audio_o, vectors=vectors,
               issues=issues, summary=summary, gate=QA.gate(summary))
    return out
