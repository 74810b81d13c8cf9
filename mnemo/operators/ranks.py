"""Rank family: W1 average_rank, F7 normalised_rank, A5 spearman,
A6 safe_pearson, A7 mse, T2 top_n_spearman (per fold), T3 top_n_full.

Ranks are made from counts of distinct (group, value) pairs: rows are combined
by value before the shuffle, and running sums over range partitions give the
rank of every value (`operators.prefix`).  No task sorts a whole group, and
equal values are one row however many they are.  Correlations of ranks need
sums per value only, so ranks are not joined back to the rows of the ranked
column; folds are columns of these sums, not copies of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import null_safe_join
from .prefix import BEFORE, running_sums


def value_ranks(df: DataFrame, partition_cols: list[str], value_col: str, ranges: int | None = None) -> DataFrame:
    """(partition_cols, value_col, rank2): twice the average rank of every distinct value, a whole number; NULLs rank last."""
    counts = df.groupBy(*partition_cols, value_col).agg(F.count(F.lit(1)).alias("_n"))
    r = running_sums(counts, partition_cols, [F.col(value_col).asc_nulls_last()], ["_n"], ranges)
    return r.select(*partition_cols, value_col, (2 * F.col("_n" + BEFORE) + F.col("_n") + 1).alias("rank2"))


def average_rank(df: DataFrame, partition_cols: list[str], value_col: str,
                 out: str = "avg_rank", blocks: int | None = None) -> DataFrame:
    """1-based ranks, ties get the mean of their positions; NULLs rank last.

    Ranks are joined back by value (adaptive execution splits a hot one).
    `blocks` fixes the number of value ranges; by default Spark chooses it.
    """
    ranks = value_ranks(df, partition_cols, value_col, blocks)
    return null_safe_join(df, ranks, [*partition_cols, value_col]).withColumn(out, F.col("rank2") / 2.0).drop("rank2")


def normalised_rank(df: DataFrame, partition_cols: list[str], value_col: str,
                    out: str = "norm_rank") -> DataFrame:
    """average rank / n within the partition."""
    n = df.groupBy(*partition_cols).agg(F.count(F.lit(1)).alias("_n_rows"))
    r = null_safe_join(average_rank(df, partition_cols, value_col, "_ar"), n, partition_cols)
    return r.withColumn(out, F.col("_ar") / F.col("_n_rows")).drop("_ar", "_n_rows")


def safe_pearson(a: str | Column, b: str | Column) -> Column:
    """A6 aggregate: Pearson correlation, 0 when either side is constant
    (the guard avoids ANSI errors and NaN)."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    const = (F.min(a) == F.max(a)) | (F.min(b) == F.max(b))
    r = F.covar_pop(a, b) / (F.stddev_pop(a) * F.stddev_pop(b))
    return F.when(const | r.isNull() | F.isnan(r), F.lit(0.0)).otherwise(r)


def mse(y: str, p: str) -> Column:
    """A7 aggregate."""
    return F.avg((F.col(y) - F.col(p)) * (F.col(y) - F.col(p)))


#: Names of `_sums`.
SUMS = ("n", "x", "xx", "y", "yy", "xy", "low", "high")


def _sums(x: Column, n: Column, y: Column, yy: Column) -> list[Column]:
    """Sums over values for the correlation of x (n rows a value) with y (summed per value)."""
    return [F.sum(n).alias("n"), F.sum(n * x).alias("x"), F.sum(n * x * x).alias("xx"), F.sum(y).alias("y"), F.sum(yy).alias("yy"),
            F.sum(x * y).alias("xy"), F.min(F.when(n > 0, x)).alias("low"), F.max(F.when(n > 0, x)).alias("high")]


def _correlation(s: Column, y_low: Column, y_high: Column) -> Column:
    """Pearson correlation from `_sums`, 0 when either side is constant."""
    def m(c):
        return s[c] / F.nullif(s["n"], F.lit(0))
    xx, yy, xy = m("xx") - m("x") * m("x"), m("yy") - m("y") * m("y"), m("xy") - m("x") * m("y")
    const = (s["low"] == s["high"]) | (y_low == y_high) | (xx <= 0) | (yy <= 0) | (s["n"] == 0)
    return F.when(F.coalesce(const, F.lit(True)), F.lit(0.0)).otherwise(xy / F.sqrt(xx * yy))


def rank_correlation(df: DataFrame, group_cols: list[str], x: str, rank2: str = "rank2", out: str = "spearman") -> DataFrame:
    """Correlation per group of the ranks of x with given (doubled) ranks, 0 when either is constant."""
    r = F.col(rank2).cast("double")
    by_value = df.groupBy(*group_cols, F.col(x).alias("_x")).agg(F.count(F.lit(1)).alias("_n"), F.sum(r).alias("_s"), F.sum(r * r).alias("_ss"),
                                                                 F.min(r).alias("_low"), F.max(r).alias("_high"))
    t = running_sums(by_value, group_cols, [F.col("_x").asc_nulls_last()], ["_n"])
    rx = (2 * F.col("_n" + BEFORE) + F.col("_n") + 1).cast("double")
    g = t.groupBy(*group_cols).agg(*_sums(rx, F.col("_n"), F.col("_s"), F.col("_ss")), F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    return g.select(*group_cols, _correlation(F.struct(*SUMS), F.col("_low"), F.col("_high")).alias(out))


def spearman(df: DataFrame, group_cols: list[str], x: str, y: str,
             out: str = "spearman") -> DataFrame:
    """A5: Spearman correlation per group = Pearson of average ranks, 0 for constant input."""
    d = df.select(*group_cols, F.col(x).alias("_v"), F.col(y).alias("_y"))
    return rank_correlation(null_safe_join(d, value_ranks(d, group_cols, "_y"), [*group_cols, "_y"]), group_cols, "_v", out=out)


def role_rho(rows: DataFrame) -> DataFrame:
    """(fold, feature_set, idx, rho) over the rows of role `train`; the label is ranked once per fold.

    rows: (fold, role, item_id, y, feature_set, idx, value).
    """
    train = rows.where(F.col("role") == "train")
    labels = train.select("fold", "item_id", "y").distinct()
    ranked = null_safe_join(train, value_ranks(labels, ["fold"], "y"), ["fold", "y"])
    return rank_correlation(ranked, ["fold", "feature_set", "idx"], "value", out="rho")


def fold_rho(long_df: DataFrame, labelled: DataFrame, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, fold, feature_set, idx, rho): Spearman of every feature with the label over each fold's training rows.

    long_df: (item_id, feature_set, idx, value); labelled: (*by, item_id, y, fold), an own fold plan per `by`
    (long_df may have the columns of `by` too, and then holds rows of each plan).
    The training rows of fold f are those of other folds; a fold f without
    items of its own ranks them all.
    """
    folds = range(1, k + 1)
    keys = [c for c in (*by, "item_id") if c in long_df.columns]
    return ranked_rho(long_df.join(label_ranks(labelled.select(*by, "item_id", "y", "fold"), folds, by), keys), folds, by)


def label_ranks(labelled: DataFrame, folds, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds r<f>, the doubled rank of y among the rows of other folds than f, for every f of `folds`; labelled: (*by, y, fold, ...)."""
    names = [f"n{f}" for f in folds]
    y = running_sums(labelled.groupBy(*by, "y").agg(*[F.count_if(F.col("fold") != f).alias(f"n{f}") for f in folds]),
                     list(by), [F.col("y").asc_nulls_last()], names)
    y = y.select(*by, "y", *[(2 * F.col(n + BEFORE) + F.col(n) + 1).cast("double").alias(f"r{n[1:]}") for n in names])
    return null_safe_join(labelled, y, [*by, "y"])


def ranked_rho(rows: DataFrame, folds, by: tuple[str, ...] = (), ranges: int | None = None) -> DataFrame:
    """`fold_rho` of rows (*by, feature_set, idx, value, fold, r<f> for every f of `folds`).

    Counts and label-rank sums of all folds are columns of one aggregate by (feature, value); what does not depend
    on the order of the values is summed per feature, so it is neither kept per value nor sorted.
    """
    names, feature = [f"n{f}" for f in folds], [*by, "feature_set", "idx"]
    train = {f: F.when(F.col("fold") != f, F.col(f"r{f}")) for f in folds}
    by_value = rows.groupBy(*feature, "value").agg(*[c for f, r in train.items() for c in (
        F.count_if(F.col("fold") != f).alias(f"n{f}"), F.coalesce(F.sum(r), F.lit(0.0)).alias(f"s{f}"))])
    whole = rows.groupBy(*feature).agg(*[c for f, r in train.items() for c in (
        F.sum(r * r).alias(f"yy_{f}"), F.min(r).alias(f"ylow_{f}"), F.max(r).alias(f"yhigh_{f}"))])
    t = running_sums(by_value, feature, [F.col("value").asc_nulls_last()], names, ranges)
    sums = []
    for f in folds:
        n = F.col(f"n{f}")
        rank = (2 * F.col(f"n{f}{BEFORE}") + n + 1).cast("double")
        sums += [c.alias(f"{name}_{f}") for name, c in zip(SUMS, _sums(rank, n, F.col(f"s{f}"), F.lit(0.0))) if name != "yy"]
    g = null_safe_join(t.groupBy(*feature).agg(*sums), whole, feature)
    each = F.array(*[F.struct(F.lit(f).cast("bigint").alias("fold"), F.col(f"n_{f}").alias("_n"), _correlation(
        F.struct(*[F.col(f"{c}_{f}").alias(c) for c in SUMS]),
        F.col(f"ylow_{f}"), F.col(f"yhigh_{f}")).alias("rho")) for f in folds])
    out = g.select(*feature, F.inline(each))
    return out.where(F.col("_n") > 0).select(*by, "fold", "feature_set", "idx", "rho")


def _select_top(rho: DataFrame, group_cols: list[str], n: int, sets: list[str]) -> DataFrame:
    # Ties: equal |rho| (to 9 places) -> earlier position in the concatenation.
    set_ord = F.array_position(F.array(*[F.lit(s) for s in sets]), F.col("feature_set"))
    w = Window.partitionBy(*group_cols).orderBy(F.round(F.abs("rho"), 9).desc(), set_ord, "idx")
    return (rho.withColumn("sel_rank", F.row_number().over(w).cast("bigint"))
               .where(F.col("sel_rank") <= n))


def top_n_spearman(long_df: DataFrame, folded: DataFrame, n: int, sets: list[str],
                   k: int = 5) -> DataFrame:
    """Per training fold, the top min(n, D) features by |Spearman| with y.

    long_df: (item_id, feature_set, idx, value) of the labelled split.
    folded:  (item_id, y, fold).
    Returns (fold, feature_set, idx, rho, sel_rank).  Only training rows of a
    fold take part in its ranking (leakage-free).
    """
    return _select_top(fold_rho(long_df, folded, k), ["fold"], n, sets)


def top_n_full(long_df: DataFrame, labels: DataFrame, n: int, sets: list[str]) -> DataFrame:
    """The same on all labelled rows; the result is the reusable
    `selected(feature_set, idx)` transform."""
    rho = fold_rho(long_df, labels.withColumn("fold", F.lit(0)), 1)
    return _select_top(rho, ["fold"], n, sets).drop("fold")
