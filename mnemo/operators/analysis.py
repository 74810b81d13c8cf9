"""Result-table analysis: A1 fold_stats, A2 overall_stats, A3 with_without,
A4 welch_t, P8 has_markers, P10 stars, T1 leaderboard, A26 best per
combination, A28 combo_shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import has_markers
from ..functions.stats import significance_stars, t_two_sided_p, welch_df, welch_t

# The six feature types analysed by default and their logic
# (require_all = True means every marker must be present).
DEFAULT_MARKERS = [
    ("audio_o", ["audio_o"], False),
    ("audio_c", ["audio_c"], False),
    ("Audio", ["audio_c", "audio_o"], True),
    ("semantic", ["semantic"], False),
    ("emotion", ["emotion"], False),
    ("EmotionSemantic", ["emotion", "semantic"], True),
]


def fold_stats(scores: DataFrame, group_cols: list[str], col: str = "spearman",
               prefix: str = "", digits: int = 4) -> DataFrame:
    """A1: mean, population std, min, max over folds, rounded."""
    return scores.groupBy(*group_cols).agg(
        F.round(F.avg(col), digits).alias(f"mean_{prefix}{col}"),
        F.round(F.stddev_pop(col), digits).alias(f"std_{prefix}{col}"),
        F.round(F.min(col), digits).alias(f"min_{prefix}{col}"),
        F.round(F.max(col), digits).alias(f"max_{prefix}{col}"))


def overall_stats(results: DataFrame) -> DataFrame:
    """A2: n, mean, population std of mean_spearman."""
    return results.agg(F.count(F.lit(1)).alias("n"),
                       F.avg("mean_spearman").alias("mean"),
                       F.stddev_pop("mean_spearman").alias("std"))


def _marker_array(markers):
    return F.array(*[F.struct(F.lit(name).alias("feature"),
                              F.array(*[F.lit(m) for m in ms]).alias("markers"),
                              F.lit(req).alias("require_all")) for name, ms, req in markers])


def mark(results: DataFrame, markers=DEFAULT_MARKERS) -> DataFrame:
    """P8 per (result row, feature type): `with` flag.  The marker list is a
    small fixed parameter, inlined per row (no join)."""
    return (results.select("*", F.inline(_marker_array(markers)))
                   .withColumn("with", has_markers(F.col("features"), F.col("markers"),
                                                   F.col("require_all"))))


def with_without(results: DataFrame, markers=DEFAULT_MARKERS) -> DataFrame:
    """A3 + A4 + P10: per feature type, n / mean / pop. std with and without,
    the difference, Welch's t (sample variances), df, p and stars."""
    m = mark(results, markers)
    x = F.col("mean_spearman")
    w, wo = F.col("with"), ~F.col("with")
    agg = m.groupBy("feature", "require_all").agg(
        F.count(F.when(wo, 1)).alias("n_without"),
        F.avg(F.when(wo, x)).alias("mean_without"),
        F.stddev_pop(F.when(wo, x)).alias("std_without"),
        F.var_samp(F.when(wo, x)).alias("_v0"),
        F.count(F.when(w, 1)).alias("n_with"),
        F.avg(F.when(w, x)).alias("mean_with"),
        F.stddev_pop(F.when(w, x)).alias("std_with"),
        F.var_samp(F.when(w, x)).alias("_v1"))
    n1, n0 = F.col("n_with").cast("double"), F.col("n_without").cast("double")
    t = welch_t(F.col("mean_with"), F.col("_v1"), n1, F.col("mean_without"), F.col("_v0"), n0)
    df = welch_df(F.col("_v1"), n1, F.col("_v0"), n0)
    return (agg.withColumn("logic", F.when(F.col("require_all"), "AND").otherwise("OR"))
               .withColumn("diff", F.col("mean_with") - F.col("mean_without"))
               .withColumn("t", t).withColumn("df", df)
               .withColumn("p", t_two_sided_p(F.col("t"), F.col("df")))
               .withColumn("sig", significance_stars(F.col("p")))
               .drop("_v0", "_v1", "require_all"))


def leaderboard(results: DataFrame, n: int = 10) -> DataFrame:
    """Top n by mean_spearman (ties: model, selector, combination)."""
    return (results.orderBy(F.col("mean_spearman").desc(), "model", "selector", "combination")
                   .limit(n)
                   .select("combination", "model", "selector", "n_features",
                           "mean_spearman", "std_spearman"))


def best_per_combination(results: DataFrame) -> DataFrame:
    """Best row per combination, best first."""
    w = Window.partitionBy("combination").orderBy(F.col("mean_spearman").desc(), "model", "selector")
    return (results.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
                   .select("combination", "model", "selector", "mean_spearman")
                   .orderBy(F.col("mean_spearman").desc(), "combination"))


def combo_shape(aligned_long: DataFrame) -> DataFrame:
    """n_features and n_samples of each combination from its aligned
    long table (combination, feature_set, idx, item_id)."""
    return aligned_long.groupBy("combination").agg(
        F.countDistinct("feature_set", "idx").alias("n_features"),
        F.countDistinct("item_id").alias("n_samples"))
