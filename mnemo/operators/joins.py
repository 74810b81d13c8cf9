"""A key lookup with skew handling.

`skew_safe_lookup`: key lookup where a few keys are hot (a third of all
  rows may share one key).  Hot keys are found from the lookup table itself
  (bounded by construction: at most 1/share keys can hold that share), the
  probe side spreads each hot key over `salts` tasks and only hot keys of
  the lookup side are replicated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def skew_safe_lookup(probe: DataFrame, lookup: DataFrame, key: str, weight: str,
                     salt_by: str, salts: int = 32, hot_share: float = 1e-3,
                     how: str = "left") -> DataFrame:
    """Join `probe` to `lookup` on `key`, salting hot keys.

    weight: column of `lookup` giving how many probe rows a key attracts
    (e.g. a word's corpus count); keys with weight > hot_share * total are
    hot (at most 1/hot_share of them, so the hot list is safe to broadcast).
    salt_by: probe column spreading a hot key (e.g. doc_id).
    """
    # the lookup table is read three times (total, hot list, salted side):
    # written once instead of recomputed (reliable checkpoint)
    lookup = cut_lineage(lookup)
    tot = lookup.agg(F.sum(weight).alias("_tot")).withColumn("_j", F.lit(0))
    hot = (lookup.withColumn("_j", F.lit(0)).join(F.broadcast(tot), "_j")
                 .where(F.col(weight) > F.col("_tot") * hot_share)
                 .select(key, F.lit(True).alias("_hot")))
    p = (probe.join(F.broadcast(hot), key, "left")
              .withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(salt_by), F.lit(salts)))
                          .otherwise(F.lit(0)).cast("int"))
              .drop("_hot"))
    lk = (lookup.join(F.broadcast(hot), key, "left")
                .withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1)))
                                               .otherwise(F.array(F.lit(0)))))
                .drop("_hot"))
    return p.join(lk, [key, "_salt"], how).drop("_salt")


def null_safe_join(a: DataFrame, b: DataFrame, cols: list[str], how: str = "inner") -> DataFrame:
    """Join on columns of the same names in which null equals null; they appear once."""
    names = {c: f"_key_{i}" for i, c in enumerate(cols)}
    b = b.withColumnsRenamed(names)
    cond = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()] or [F.lit(True)]
    return a.join(b, cond, how).drop(*names.values())
