"""A27 column_moments and M1 standardize (train-fitted, applied to test)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import null_safe_join
from .ranks import fold_rho, rank_correlation, value_ranks

EPS10 = 10 * 2.220446049250313e-16


def column_moments(train_long: DataFrame, group_cols: list[str]) -> DataFrame:
    """Per feature mean, population std, min, max of the training rows.
    A plain grouped aggregate: partial (map-side) aggregation, skew-safe."""
    return train_long.groupBy(*group_cols, "feature_set", "idx").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"),
        F.min("value").alias("min"), F.max("value").alias("max"))


def scale_of(sd: Column) -> Column:
    """Population std, with (near-)zero replaced by 1: a constant training
    column maps to x - mean."""
    return F.when(sd.isNull() | (sd < EPS10), F.lit(1.0)).otherwise(sd)


def standardize(rows: DataFrame, moments: DataFrame, keys: list[str]) -> DataFrame:
    """M1: z = (x - mean) / scale with moments fitted on the training rows."""
    return (rows.join(moments.select(*keys, "mean", "sd"), keys)
                .withColumn("z", (F.col("value") - F.col("mean")) / scale_of(F.col("sd")))
                .drop("mean", "sd"))


def fold_feature_stats(long_df: DataFrame, train: DataFrame) -> DataFrame:
    """Per (fold, feature_set, idx) on the training rows of the fold:
    Spearman rho with y, mean and population std.

    long_df: (item_id, feature_set, idx, value); train: (fold, item_id, y).
    """
    ranked = null_safe_join(train, value_ranks(train, ["fold"], "y"), ["fold", "y"])
    rows = long_df.join(ranked, "item_id")
    keys = ["fold", "feature_set", "idx"]
    moments = rows.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    return rank_correlation(rows, keys, "value", out="rho").join(moments, keys)


def all_fold_stats(long_df: DataFrame, folded: DataFrame, k: int = 5, by: tuple[str, ...] = ()) -> DataFrame:
    """`fold_feature_stats` of every fold of a fold plan (one per `by`), without a copy of the rows per fold.

    long_df: (item_id, feature_set, idx, value); folded: (*by, item_id, y, fold).
    All folds' moments are columns of one aggregate.
    """
    keys = [*by, "feature_set", "idx"]
    rows = long_df.join(folded.select(*by, "item_id", "fold"), [c for c in (*by, "item_id") if c in long_df.columns])
    return fold_rho(long_df, folded, k, by).join(fold_moments(rows, range(1, k + 1), by), ["fold", *keys])


def fold_moments(rows: DataFrame, folds, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, feature_set, idx, fold, mean, sd) of the training rows of every fold; rows: (*by, feature_set, idx, value, fold)."""
    keys = [*by, "feature_set", "idx"]
    train = {f: F.when(F.col("fold") != f, F.col("value")) for f in folds}
    moments = rows.groupBy(*keys).agg(
        *[F.struct(F.lit(f).cast("bigint").alias("fold"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd")).alias(f"f{f}")
          for f, v in train.items()])
    return moments.select(*keys, F.inline(F.array(*[f"f{f}" for f in train])))
