"""Bind the driver's generic tables to the engine's data model.

The engine's inputs are feature vectors, labels, transcripts, clip frames,
predictions and sweep results.  These views derive them from the given
parquet tables (all rows, every time), so every registered query grows with
the data:

* feature sets  <- embeddings.embedding cut into four sets, two of them 2-D
* labels        <- embeddings.label / 9 (ten values: ties are exercised)
* split         <- md5 bucket of the id: 'test' (about 1/4) or 'dev'
* transcripts   <- documents.text
* clip frames   <- events per user ordered by time
* speech turns  <- conversations
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import flatten_frames, nan_to_num
from ..operators.positions import block_row_number
from .tables import table

# Fixed values of the binding: set names in concatenation order and how each
# is cut out of the 64-wide embedding (start is 1-based, rows x cols).
EMB_SETS = ["emb_a", "emb_b", "emb_c", "emb_d"]
EMB_LAYOUT = {
    "emb_a": (1, 1, 16, True),    # 1-D, 16 values
    "emb_b": (17, 1, 16, True),   # 1-D, 16 values
    "emb_c": (33, 2, 8, False),   # 2 frames of 8 -> padded to 3 -> 24
    "emb_d": (49, 4, 4, False),   # 4 frames of 4 -> truncated to 3 -> 12
}
EMB_WIDTHS = {"emb_a": 16, "emb_b": 16, "emb_c": 24, "emb_d": 12}

HOP = 512
SR = 16000
VOICED_TYPES = ["view", "click", "purchase"]


def split_of(id_col: str) -> F.Column:
    return F.when(F.substring(F.md5(F.col(id_col).cast("string")), 1, 1) < "4", "test") \
            .otherwise("dev")


def feature_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(split, feature_set, item_id, is_global, frames ARRAY<ARRAY<FLOAT>>)."""
    e = table(spark, sf_dir, "embeddings")
    structs = []
    for name in EMB_SETS:
        start, rows, cols, is_global = EMB_LAYOUT[name]
        frames = F.array(*[F.slice("embedding", start + r * cols, cols) for r in range(rows)])
        structs.append(F.struct(F.lit(name).alias("feature_set"),
                                F.lit(is_global).alias("is_global"), frames.alias("frames")))
    return (e.select(split_of("vec_id").alias("split"), F.col("vec_id").alias("item_id"),
                     F.inline(F.array(*structs)))
             .select("split", "feature_set", "item_id", "is_global", "frames"))


def feature_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2 vector form: S1 applied to every set (nan_to_num + flatten)."""
    raw = feature_raw(spark, sf_dir)
    return raw.select("split", "feature_set", "item_id",
                      nan_to_num(flatten_frames(F.col("frames"), F.col("is_global"))).alias("values"))


def sparse_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2 vector form where items lack sets and values: (split, feature_set, item_id, values).

    By md5 of `id:set`: an eighth of the (item, set) pairs is absent, and a
    sixteenth has a null first value.
    """
    v = feature_vec(spark, sf_dir)
    h = F.substring(F.md5(F.concat_ws(":", F.col("item_id").cast("string"), "feature_set")), 1, 2)
    holed = F.transform("values", lambda x, i: F.when((i == 0) & (h < "30"), F.lit(None)).otherwise(x))
    return v.where(h >= "20").withColumn("values", holed)


def feature_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2 long form: (split, feature_set, item_id, idx, value)."""
    return (feature_vec(spark, sf_dir)
            .select("split", "feature_set", "item_id", F.posexplode("values").alias("idx", "value"))
            .withColumn("idx", F.col("idx").cast("bigint")))


def item_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D4 for the labelled split: (item_id, y)."""
    e = table(spark, sf_dir, "embeddings")
    return (e.where(split_of("vec_id") == "dev")
             .select(F.col("vec_id").alias("item_id"), (F.col("label") / 9.0).alias("y")))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, text)."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text")


def clip_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D13 frames: (clip_id, frame, rms, f0, voiced) from events per user.

    Frame numbers come from a skew-safe two-phase row number (hour blocks),
    so one very active user does not land in a single task.
    """
    ev = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    ev = ev.withColumn("_hr", F.date_trunc("hour", "ts"))
    numbered = block_row_number(ev, ["user_id"], "_hr", ["ts", "event_id"], out="frame")
    return numbered.select(F.col("user_id").alias("clip_id"), "frame",
                           F.col("value").alias("rms"),
                           (F.lit(80.0) + F.col("value")).alias("f0"),
                           F.col("event_type").isin(*VOICED_TYPES).alias("voiced"))


def clip_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech turns per clip: conversation c is the transcript of clip c,
    turns joined by a space."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("clip_id"), "turn", "role", "text")


def emb_combos() -> dict[str, list[str]]:
    """Every non-empty subset of the four sets, in concatenation order,
    named 'emb_a+emb_c' etc. (15 combinations, built by rule)."""
    from itertools import combinations
    out = {}
    for r in range(1, len(EMB_SETS) + 1):
        for c in combinations(EMB_SETS, r):
            out["+".join(c)] = list(c)
    return out


# Fixed values of the prediction binding: three configurations whose
# predictions are embedding position 1, position 2 rounded to 1 decimal
# (ties), and a failed config (no predictions).
PRED_CONFIGS = [
    (1, "emb_a", "LinearRegression", "none", "concat", None),
    (2, "emb_b", "Ridge", "spearman_30", "kernel", "coarse"),
    (3, "emb_c", "GradientBoosting", "pca_50", "concat", ""),
]


def _pred_structs():
    e = F.col("embedding")
    p = {1: F.element_at(e, 1).cast("double"),
         2: F.round(F.element_at(e, 2).cast("double"), 1),
         3: F.lit(None).cast("double")}
    return F.array(*[F.struct(F.lit(c).cast("bigint").alias("cfg_id"), F.lit(combo).alias("combo"),
                              F.lit(model).alias("model"), F.lit(sel).alias("selector"),
                              F.lit(pre).alias("preprocessing"),
                              F.lit(lab).cast("string").alias("cfg_label"), p[c].alias("p"))
                     for c, combo, model, sel, pre, lab in PRED_CONFIGS])


def cv_predictions(spark: SparkSession, folded: DataFrame, sf_dir: str) -> DataFrame:
    """(fold, cfg_id, combo, model, selector, preprocessing, cfg_label, item_id, y, p)
    for the labelled split: each item is predicted once, in its own fold."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    return folded.join(e, "item_id").select("fold", "item_id", "y", F.inline(_pred_structs()))


def split_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cfg_id, ..., item_id, p) for the unlabelled split."""
    e = table(spark, sf_dir, "embeddings")
    return (e.where(split_of("vec_id") == "test")
             .select(F.col("vec_id").alias("item_id"), F.inline(_pred_structs())))


def clip_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D13 samples: (clip_id, pos, amp) with amp = (value - 50) / 1000."""
    f = clip_frames(spark, sf_dir)
    return f.select("clip_id", F.col("frame").alias("pos"), ((F.col("rms") - 50.0) / 1000.0).alias("amp"))


# Fixed values of the quality binding: where each kind sits in the embedding
# (1-based start, values, rows x cols) and the injected faults, chosen by
# the first two hex digits of md5(id || ':qa').
QA_LAYOUT = [("audio_c", 1, 27, 3, 9), ("audio_o", 28, 9, 1, 9),
             ("semantic", 37, 7, 1, 7), ("emotion", 44, 19, 1, 19)]
QA_FAULTS = [("0a", "nan0"), ("14", "inf1"), ("1e", "zero"), ("28", "short"),
             ("32", "nan78"), ("38", "allnan")]


def qa_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dir, kind, item_id, shape, values) with faults injected by hash."""
    e = table(spark, sf_dir, "embeddings")
    h = F.substring(F.md5(F.concat(F.col("vec_id").cast("string"), F.lit(":qa"))), 1, 2)
    fault = F.lit("none")
    for bound, name in reversed(QA_FAULTS):
        fault = F.when(h < bound, F.lit(name)).otherwise(fault)
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(s).alias("start"), F.lit(n).alias("nv"),
                               F.lit(r).alias("rows"), F.lit(c).alias("cols")) for k, s, n, r, c in QA_LAYOUT])
    base = e.select(split_of("vec_id").alias("split"), F.col("vec_id").alias("item_id"), "embedding",
                    fault.alias("fault"), F.inline(kinds))
    short = F.col("fault") == "short"
    nv = (F.when(short & (F.col("rows") > 1), F.col("nv") - F.col("cols"))
           .when(short, F.col("nv") - 1).otherwise(F.col("nv")))
    flat = F.transform(F.slice("embedding", F.col("start"), nv), lambda x: x.cast("double"))
    fz = F.col("fault")
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    faulted = F.transform(flat, lambda x, i: (
        F.when((fz == "nan0") & (i == 0), nan)
         .when((fz == "inf1") & (i == 1), inf)
         .when(fz == "zero", F.lit(0.0))
         .when((fz == "nan78") & i.isin(7, 8), nan)
         .when(fz == "allnan", nan)
         .otherwise(x)))
    shape = F.when(F.col("rows") > 1, F.array(F.when(short, F.col("rows") - 1).otherwise(F.col("rows")),
                                               F.col("cols"))) \
             .otherwise(F.array(nv))
    return base.select(F.concat_ws("/", "split", "kind").alias("dir"), "kind", "item_id",
                       shape.alias("shape"), faulted.alias("values"))


def qa_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emptiness of item i's transcript = conversation i (turns joined by a
    space): empty iff every turn is blank, a partial aggregate per item."""
    from ..functions.text import is_empty_text
    c = table(spark, sf_dir, "conversations")
    return c.groupBy(F.col("conv_id").alias("item_id")).agg(
        F.bool_and(is_empty_text(F.col("text"))).alias("empty"))


def qa_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peak level of item i's audio = clip i with amp = value / 1e5."""
    # a peak needs no frame numbers; events without a user or a time are no frames
    ev = table(spark, sf_dir, "events").where("user_id IS NOT NULL AND ts IS NOT NULL")
    pk = ev.groupBy(F.col("user_id").alias("item_id")).agg(F.max(F.abs(F.col("value") / 100000.0)).alias("_pk"))
    return pk.select("item_id", F.when(F.col("_pk") > 0, 20 * F.log10("_pk"))
                     .otherwise(F.lit(float("-inf"))).alias("peak_db"))
