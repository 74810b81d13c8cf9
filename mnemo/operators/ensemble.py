"""Ensembles over prediction tables: E4 rank-average fusion, E5 ensemble CV
metrics, E6 predict-split fusion, E7 many ensembles in one pass, P7 labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import null_safe_join
from .ranks import mse, safe_pearson, spearman, value_ranks

ENSEMBLE_LABEL = "Ensemble (rank average)"


def config_label(label: Column, combo: Column, model: Column, selector: Column,
                 preprocessing: Column) -> Column:
    """The label, or combo/model/selector/preprocessing when empty/missing."""
    return F.coalesce(F.nullif(label, F.lit("")),
                      F.concat_ws("/", combo, model, selector, preprocessing))


def doubled_ranks(preds: DataFrame, group_cols: list[str]) -> DataFrame:
    """Twice the average rank of p (a whole number) and the row count n, per (group, cfg)."""
    g = [*group_cols, "cfg_id"]
    n = preds.groupBy(*g).agg(F.count(F.lit(1)).alias("rows"))
    r = null_safe_join(preds, value_ranks(preds, g, "p").withColumnRenamed("rank2", "r2"), [*g, "p"])
    return null_safe_join(r, n, g)


def mean_rank(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fused, _k): mean over configs of rank / n.  Whole numbers are
    summed per n, and the sums are divided in the order of n, so equal
    averages tie exactly in whatever order the partial sums arrive."""
    per_n = ranked.groupBy(*keys, "rows").agg(F.sum("r2").alias("s"), F.countDistinct("cfg_id").alias("c"))
    parts = F.sort_array(F.collect_list(F.struct("rows", "s")))
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x["s"] / x["rows"])
    return per_n.groupBy(*keys).agg((total / (2 * F.sum("c"))).alias("fused"), F.sum("c").alias("_k"))


def fuse_rank_average(preds: DataFrame, group_cols: list[str],
                      n_configs: Column | int | None = None) -> DataFrame:
    """Mean over configs of rank/n, keyed by item (never by position).

    Only items predicted by every fused config are kept (id intersection).
    preds: (*group_cols, cfg_id, item_id, p) -> (*group_cols, item_id, fused)
    """
    if not group_cols:
        return fuse_rank_average(preds.withColumn("_g0", F.lit(0)), ["_g0"], n_configs).drop("_g0")
    fused = mean_rank(doubled_ranks(preds, group_cols), [*group_cols, "item_id"])
    if n_configs is None:
        n_cfg = preds.groupBy(*group_cols).agg(F.countDistinct("cfg_id").alias("_need"))
        return (fused.join(n_cfg, group_cols).where(F.col("_k") == F.col("_need"))
                     .drop("_k", "_need"))
    return fused.where(F.col("_k") == n_configs).drop("_k")


def _metrics(df: DataFrame, group_cols: list[str], y: str, p: str) -> DataFrame:
    plain = df.groupBy(*group_cols).agg(safe_pearson(y, p).alias("pearson"), mse(y, p).alias("mse"))
    return null_safe_join(spearman(df, group_cols, y, p), plain, group_cols)


def ensemble_cv(preds: DataFrame, on_error: str = "zero") -> DataFrame:
    """E5: per fold and config Spearman / Pearson / MSE, the same for the
    rank-averaged ensemble, then mean / pop. std / min / max over folds.

    preds: (fold, cfg_id, label, item_id, y, p); a failed config has NULL p
    and predicts zeros (`on_error='zero'`) or is left out ('drop').
    Returns (config, metric, mean, std, min, max).
    """
    if on_error == "zero":
        preds = preds.withColumn("p", F.coalesce("p", F.lit(0.0)))
    else:
        preds = preds.where(F.col("p").isNotNull())
    per_cfg = _metrics(preds, ["fold", "cfg_id", "label"], "y", "p")
    ys = preds.select("fold", "item_id", "y").distinct()
    fused = fuse_rank_average(preds.select("fold", "cfg_id", "item_id", "p"), ["fold"])
    ens = _metrics(fused.join(ys, ["fold", "item_id"]), ["fold"], "y", "fused") \
        .withColumn("label", F.lit(ENSEMBLE_LABEL))
    allm = per_cfg.drop("cfg_id").unionByName(ens)
    long = allm.select("fold", F.col("label").alias("config"), F.inline(F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in ("spearman", "pearson", "mse")])))
    return long.groupBy("config", "metric").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"))


def ensemble_predict(preds: DataFrame) -> DataFrame:
    """Fuse the predict-split outputs of the configs that succeeded.
    preds: (cfg_id, item_id, p), failed configs have NULL p (dropped)."""
    ok = preds.where(F.col("p").isNotNull())
    return fuse_rank_average(ok, [])


def batch_ensembles(preds: DataFrame, runs: DataFrame) -> DataFrame:
    """Many ensembles at once.  Normalised ranks are computed once per
    config and shared by every run that uses it; runs: (run_id, cfg_id)."""
    ok = preds.where(F.col("p").isNotNull())
    ranked = doubled_ranks(ok, [])
    used = runs.join(ok.select("cfg_id").distinct(), "cfg_id")
    need = used.groupBy("run_id").agg(F.countDistinct("cfg_id").alias("_need"))
    fused = mean_rank(ranked.join(used, "cfg_id"), ["run_id", "item_id"])
    return (fused.join(need, "run_id").where(F.col("_k") == F.col("_need"))
                 .drop("_k", "_need"))
