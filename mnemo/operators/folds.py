"""W2 kfold: shuffled K-fold assignment by keyed hash.

Same fold sizes as a shuffled K-fold (the first n mod K folds get one more
item) and the same assignment as `ntile(K) OVER (ORDER BY md5(id || ':' ||
seed))`, but computed without a single-partition window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .positions import block_row_number


def hash_key(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))


def ntile_of(pos: Column, n: Column, k: int) -> Column:
    """1-based ntile bucket of 0-based position `pos` among `n` rows."""
    q = F.floor(n / k)
    r = n - q * k
    big = r * (q + 1)
    return (F.when(pos < big, F.floor(pos / (q + 1)))
             .otherwise(r + F.floor((pos - big) / F.greatest(q, F.lit(1)))) + 1).cast("bigint")


def assign_folds(items: DataFrame, id_col: str = "item_id", k: int = 5, seed: int = 42,
                 partition_cols: list[str] | None = None) -> DataFrame:
    """Add `fold` (1..k). `partition_cols` gives independent fold plans per group."""
    parts = partition_cols or []
    h = items.withColumn("_h", hash_key(id_col, seed)).withColumn("_blk", F.substring("_h", 1, 3))
    numbered = block_row_number(h, parts, "_blk", ["_h", id_col], out="_pos", total="_cnt")
    return (numbered.withColumn("fold", ntile_of(F.col("_pos"), F.col("_cnt"), k))
                    .drop("_h", "_blk", "_pos", "_cnt"))


def explode_train(folded: DataFrame, k: int = 5, fold_col: str = "fold",
                  out: str = "tf") -> DataFrame:
    """Fold explode: one row per training fold `tf` an item belongs to
    (all folds but its own).  No cross join: an array explode per row."""
    seq = F.sequence(F.lit(1), F.lit(k))
    return folded.withColumn(out, F.explode(F.filter(seq, lambda f: f != F.col(fold_col)))) \
                 .withColumn(out, F.col(out).cast("bigint"))


def explode_roles(folded: DataFrame, k: int = 5, fold_col: str = "fold") -> DataFrame:
    """(cv_fold, role) for every item: 'test' in its own fold, 'train' elsewhere."""
    seq = F.sequence(F.lit(1).cast("bigint"), F.lit(k).cast("bigint"))
    return (folded.withColumn("cv_fold", F.explode(seq))
                  .withColumn("role", F.when(F.col("cv_fold") == F.col(fold_col), "test")
                              .otherwise("train")))
