"""Audio / time-series features over frame tables.

frames: (clip_id, frame INT, rms DOUBLE, f0 DOUBLE, voiced BOOLEAN), hop
`HOP` samples at `SR` Hz.  Per-clip aggregates are grouped aggregations
(partial, skew-safe).  Order-dependent steps (velocity, islands, gaps, halves)
never sort a whole clip in one task: windows hold one block of `BLOCK_FRAMES`
frames of a clip, each block leaves a border state (its last voiced frame, its
islands at either end, its first interval, its number of frames), and a pass
over these few rows per clip carries the state from block to block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import count_syllables
from ..session import cut_lineage
from .joins import null_safe_join
from .positions import block_row_number

# Signal constants.
HOP = 512
SR = 16000
FRAME_LENGTH = 2048
GLOBAL_MAX_S = 120
SEGMENT_MAX_S = 60
TOP_DB = 30.0
SILENCE_DB = -50.0
SNR_NO_NOISE = 60.0
RMS_QUANTILE = 0.35

#: Frames of one clip that a window may hold (about 17 minutes).
BLOCK_FRAMES = 1 << 15


def frame_time(frame: Column) -> Column:
    return frame * float(HOP) / float(SR)


def _nan():
    return F.lit(float("nan"))


def frame_rms(samples: DataFrame, hop: int = HOP, frame_length: int = FRAME_LENGTH) -> DataFrame:
    """Centred, zero-padded RMS per hop.

    samples (clip_id, pos, amp) -> (clip_id, frame, rms).  Squares are summed
    once per piece of a clip (the largest piece that parts every frame evenly:
    a hop, if it divides the half frame), and only these sums go to the frames
    that cover the piece.
    """
    half = frame_length // 2
    piece = math.gcd(hop, half, frame_length)
    per_hop, per_frame = hop // piece, frame_length // piece
    n_frames = samples.groupBy("clip_id").agg(
        (F.floor((F.max("pos") + 1) / hop) + 1).cast("bigint").alias("_nf"))
    at = F.floor((F.col("pos") + half) / piece).cast("bigint")
    sums = samples.groupBy("clip_id", at.alias("_p")).agg(F.sum(F.col("amp") * F.col("amp")).alias("_s"))
    # frame f covers the pieces from f * per_hop on
    lo = F.greatest(F.ceil((F.col("_p") - per_frame + 1) / per_hop), F.lit(0)).cast("bigint")
    hi = F.floor(F.col("_p") / per_hop).cast("bigint")
    spread = sums.where(lo <= hi).select("clip_id", "_s", F.explode(F.sequence(lo, hi)).alias("frame"))
    sq = spread.groupBy("clip_id", "frame").agg(F.sum("_s").alias("_s"))
    return (sq.join(n_frames, "clip_id").where(F.col("frame") < F.col("_nf"))
              .select("clip_id", "frame", F.sqrt(F.col("_s") / frame_length).alias("rms")))


def with_neighbour(rows: DataFrame, keys: list[str], order: str, columns: list[str], out: str, forward: bool = False,
                   block: int = BLOCK_FRAMES) -> DataFrame:
    """Adds the struct (order, columns) of the row before (`forward`: after) in the clip, null at its end.

    Inside a block of `block` units of `order` a window finds it; the last
    (first) row of each block is carried over to the next row's block.
    """
    rows = rows.withColumn("_blk", F.floor(F.col(order) / block).cast("bigint"))
    state = F.struct(order, *columns)
    step, edge = (F.lead, F.min) if forward else (F.lag, F.max)
    inside = step(state).over(Window.partitionBy(*keys, "_blk").orderBy(order))
    edges = rows.groupBy(*keys, "_blk").agg(edge(state).alias("_edge"))
    carried = edges.select(*keys, "_blk", step("_edge").over(Window.partitionBy(*keys).orderBy("_blk")).alias("_carried"))
    return (null_safe_join(rows.withColumn(out, inside), carried, [*keys, "_blk"])
            .withColumn(out, F.coalesce(out, "_carried")).drop("_blk", "_carried"))


def peak_db(samples: DataFrame) -> DataFrame:
    """F8: 20*log10(max |amp|) per clip (-inf for digital silence)."""
    return samples.groupBy("clip_id").agg(
        F.max(F.abs("amp")).alias("_pk")).select(
        "clip_id", F.when(F.col("_pk") > 0, 20 * F.log10("_pk")).otherwise(F.lit(float("-inf"))).alias("peak_db"))


def clip_prefix(frames: DataFrame, max_seconds: float = GLOBAL_MAX_S) -> DataFrame:
    """Keep the first `max_seconds` of every clip."""
    return frames.where(F.col("frame") * HOP < F.lit(max_seconds * SR))


def energy_stats(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, population variance / std and range of frame RMS."""
    return frames.groupBy(*keys).agg(
        F.avg("rms").alias("energy_mean"), F.var_pop("rms").alias("energy_var"),
        F.stddev_pop("rms").alias("energy_std"),
        (F.max("rms") - F.min("rms")).alias("energy_range"))


def pitch_stats(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Over voiced frames mean, pop. variance / std, range; 0 if none."""
    v = F.when(F.col("voiced"), F.col("f0"))
    return frames.groupBy(*keys).agg(
        F.coalesce(F.avg(v), F.lit(0.0)).alias("pitch_mean"),
        F.coalesce(F.var_pop(v), F.lit(0.0)).alias("pitch_var"),
        F.coalesce(F.stddev_pop(v), F.lit(0.0)).alias("pitch_std"),
        F.coalesce(F.max(v) - F.min(v), F.lit(0.0)).alias("pitch_range"))


def velocity(frames: DataFrame, keys: list[str], block: int = BLOCK_FRAMES) -> DataFrame:
    """Abs mean and pop. variance of d f0 / d t between successive voiced
    frames; 0 with fewer than two voiced frames."""
    voiced = frames.where("voiced").select(*keys, "frame", "f0")
    d = with_neighbour(voiced, keys, "frame", ["f0"], "_p", block=block).where(F.col("_p").isNotNull())
    d = d.withColumn("_v", (F.col("f0") - F.col("_p.f0")) / frame_time(F.col("frame") - F.col("_p.frame")))
    agg = d.groupBy(*keys).agg(F.avg(F.abs("_v")).alias("pitch_vel_mean"),
                               F.var_pop("_v").alias("pitch_vel_var"))
    return (null_safe_join(frames.select(*keys).distinct(), agg, keys, "left")
                  .select(*keys, *[F.coalesce(F.col(c), F.lit(0.0)).alias(c)
                                   for c in ("pitch_vel_mean", "pitch_vel_var")]))


def active_islands(frames: DataFrame, keys: list[str], top_db: float = TOP_DB, block: int = BLOCK_FRAMES) -> DataFrame:
    """Runs of consecutive frames within `top_db` of the group maximum
    (all frames active when the maximum is 0).  -> (*keys, start, end).

    Runs are found inside blocks; those that reach a block's border (two a
    block at most) are joined over the borders.
    """
    mx = frames.groupBy(*keys).agg(F.max("rms").alias("_mx"))
    thr = 10 ** (-top_db / 20.0)
    act = (null_safe_join(frames, mx, keys)
                 .where((F.col("_mx") <= 0) | (F.col("rms") > F.col("_mx") * thr))
                 .select(*keys, "frame", F.floor(F.col("frame") / block).cast("bigint").alias("_blk")))
    w = Window.partitionBy(*keys, "_blk").orderBy("frame")
    runs = (act.withColumn("_isl", F.col("frame") - F.row_number().over(w)).groupBy(*keys, "_blk", "_isl")
            .agg(F.min("frame").alias("start"), F.max("frame").alias("end")))
    at_border = (F.col("start") == F.col("_blk") * block) | (F.col("end") == (F.col("_blk") + 1) * block - 1)
    by_start = Window.partitionBy(*keys).orderBy("start")
    border = (runs.where(at_border)
              .withColumn("_new", F.coalesce(F.col("start") != F.lag("end").over(by_start) + 1, F.lit(True)).cast("long"))
              .withColumn("_isl", F.sum("_new").over(by_start)))
    joined = border.groupBy(*keys, "_isl").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return joined.select(*keys, "start", "end").unionByName(runs.where(~at_border).select(*keys, "start", "end"))


def gaps(islands: DataFrame, keys: list[str], block: int = BLOCK_FRAMES) -> DataFrame:
    """Seconds from the end of an interval to the start of the next."""
    near = with_neighbour(islands, keys, "start", [], "_next", forward=True, block=block)
    return (near.where(F.col("_next").isNotNull())
                .withColumn("gap", frame_time(F.col("_next.start") - F.col("end") - 1)).drop("_next"))


def pause_variance(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Pop. variance of the gaps, 0 when there is none."""
    g = gaps(active_islands(frames, keys), keys).groupBy(*keys).agg(F.var_pop("gap").alias("_pv"))
    return (null_safe_join(frames.select(*keys).distinct(), g, keys, "left")
                  .select(*keys, F.coalesce("_pv", F.lit(0.0)).alias("pause_var")))


def three_segments(frames: DataFrame, max_seconds: float = SEGMENT_MAX_S) -> DataFrame:
    """Start / centre / end windows of `max_seconds` when the clip is at
    least 3x that long, else equal thirds; frames outside every window are
    dropped.  Windows never overlap, so each frame gets at most one segment
    (an equi-join on the clip plus a CASE, no range join).
    -> frames + (seg 0..2)."""
    dur = frames.groupBy("clip_id").agg(frame_time(F.max("frame") + 1).alias("_T"))
    t = frame_time(F.col("frame"))
    T = F.col("_T")
    m = F.lit(float(max_seconds))
    long_clip = T >= 3 * m
    s0, l0 = F.when(long_clip, F.lit(0.0)).otherwise(F.lit(0.0)), F.when(long_clip, m).otherwise(T / 3.0)
    s1 = F.when(long_clip, T / 2.0 - m / 2.0).otherwise(T / 3.0)
    s2 = F.when(long_clip, T - m).otherwise(2.0 * (T / 3.0))
    seg = (F.when((t >= s0) & (t < s0 + l0), 0)
            .when((t >= s1) & (t < s1 + l0), 1)
            .when((t >= s2) & (t < s2 + l0), 2))
    return (frames.join(dur, "clip_id").withColumn("seg", seg).where(F.col("seg").isNotNull())
                  .drop("_T"))


SEGMENT_COLS = ["pitch_mean", "pitch_var", "pitch_range", "pitch_vel_mean", "pitch_vel_var",
                "energy_mean", "energy_var", "energy_range", "pause_var"]


def audio_segment_features(frames: DataFrame, max_seconds: float = SEGMENT_MAX_S) -> DataFrame:
    """Nine values per (clip, segment); `vector` holds them in order."""
    seg = cut_lineage(three_segments(frames, max_seconds))  # read by every statistic
    k = ["clip_id", "seg"]
    every = frames.select("clip_id").distinct().withColumn("seg", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    out = every
    for part in (pitch_stats(seg, k), velocity(seg, k), energy_stats(seg, k), pause_variance(seg, k)):
        out = null_safe_join(out, part, k, "left")
    # a segment without frames (a clip of one or two frames) has nine zeros, like silence
    out = out.select(*k, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in SEGMENT_COLS])
    return out.select("*", F.array(*[F.col(c) for c in SEGMENT_COLS]).alias("vector"))


def half_shift(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of the second half minus mean of the first half of the voiced
    f0 (mid = n div 2): NaN with one voiced frame, 0 with none."""
    v = frames.where("voiced").select(*keys, "frame", "f0", F.floor(F.col("frame") / BLOCK_FRAMES).cast("bigint").alias("_blk"))
    v = block_row_number(v, keys, "_blk", ["frame"], out="_i", total="_count")
    first = F.col("_i") < F.floor(F.col("_count") / 2)
    agg = v.groupBy(*keys).agg(
        F.coalesce(F.avg(F.when(~first, F.col("f0"))), _nan()).alias("_b"),
        F.coalesce(F.avg(F.when(first, F.col("f0"))), _nan()).alias("_a"))
    return (frames.select(*keys).distinct().join(agg, keys, "left")
                  .select(*keys, F.coalesce(F.col("_b") - F.col("_a"), F.lit(0.0)).alias("pitch_variation")))


def speech_activity(frames: DataFrame, keys: list[str], q: float = RMS_QUANTILE) -> DataFrame:
    """A21 + A22: threshold = exact linear q-quantile of RMS, active frames
    strictly above it; speech_ratio, SNR in dB (60 without noise power) and
    the number of active frames."""
    thr = frames.groupBy(*keys).agg(F.percentile("rms", q).alias("threshold"))
    j = frames.join(thr, keys).withColumn("_act", F.col("rms") > F.col("threshold"))
    sq = F.col("rms") * F.col("rms")
    agg = j.groupBy(*keys, "threshold").agg(
        F.avg(F.col("_act").cast("double")).alias("speech_ratio"),
        F.sum(F.col("_act").cast("bigint")).alias("active_frames"),
        F.avg(F.when(F.col("_act"), sq)).alias("_sp"),
        F.avg(F.when(~F.col("_act"), sq)).alias("_np"))
    snr = F.when(F.col("_np") > 0, 10 * F.log10(F.coalesce(F.col("_sp"), _nan()) / F.col("_np"))) \
           .otherwise(F.lit(SNR_NO_NOISE))
    return agg.select(*keys, "threshold", "speech_ratio", "active_frames", snr.alias("snr_db"))


def speaking_rate(activity: DataFrame, syllables: DataFrame, keys: list[str]) -> DataFrame:
    """J6 + A23: optional transcript (left join); syllables and rate NaN when
    missing, rate NaN when there is no speech time."""
    j = activity.join(syllables, keys, "left")
    secs = F.col("active_frames") * float(HOP) / float(SR)
    has = F.col("syllables").isNotNull()
    return j.select(*keys, F.when(has, F.col("syllables").cast("double")).otherwise(_nan()).alias("syllable_count"),
                    F.when(has & (secs > 0), F.col("syllables") / secs).otherwise(_nan()).alias("speaking_rate"))


def clip_syllables(turns: DataFrame) -> DataFrame:
    """Syllables per clip transcript (turns joined by a space, so the count
    is the sum over turns: a partial aggregate)."""
    return turns.groupBy("clip_id").agg(F.sum(count_syllables(F.col("text"))).alias("syllables"))


GLOBAL_COLS = ["energy_mean", "energy_std", "pitch_mean_hz", "pitch_std_hz", "pitch_variation",
               "snr_db", "speech_ratio", "syllable_count", "speaking_rate"]


def audio_global_features(frames: DataFrame, turns: DataFrame | None,
                          max_seconds: float = GLOBAL_MAX_S) -> DataFrame:
    """Nine values per clip over its first `max_seconds`."""
    f = clip_prefix(frames, max_seconds)
    k = ["clip_id"]
    act = cut_lineage(speech_activity(f, k))  # one row a clip, read twice
    syl = clip_syllables(turns) if turns is not None else \
        f.sparkSession.createDataFrame([], "clip_id bigint, syllables bigint")
    out = (energy_stats(f, k).join(pitch_stats(f, k), k).join(half_shift(f, k), k)
           .join(act, k).join(speaking_rate(act, syl, k), k))
    out = out.select("clip_id", "energy_mean", "energy_std", F.col("pitch_mean").alias("pitch_mean_hz"),
                     F.col("pitch_std").alias("pitch_std_hz"), "pitch_variation", "snr_db", "speech_ratio",
                     "syllable_count", "speaking_rate")
    return out.withColumn("vector", F.array(*[F.col(c) for c in GLOBAL_COLS]))
