"""Alignment before the folds: which items a combination of feature sets has.

An item may lack a set, or hold a set with missing values.  Both are two bit
masks per item, from one aggregate over the sets.  The items of a combination
are those whose mask holds all its sets (J1, J2): for early fusion the mask of
sets without missing values (P6), for kernels, which keep sets apart, that of
sets present (J3).  Folds are made from these items, so every combination has
folds of its own; combinations with the same items share one plan, and what is
fitted per plan is fitted once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import has_missing
from ..operators.folds import assign_folds
from ..session import cut_lineage


def presence(vecs: DataFrame, sets: list[str]) -> DataFrame:
    """(item_id, has, whole): bit i for set i present, and present without null or NaN.

    vecs: (item_id, feature_set, values); a null or empty vector counts as absent.
    At most 62 sets.
    """
    if len(sets) > 62:
        raise ValueError("a presence mask holds at most 62 sets")
    bit = F.element_at(F.create_map(*[x for i, s in enumerate(sets) for x in (F.lit(s), F.lit(1 << i))]), F.col("feature_set")).cast("long")
    here = vecs.where(F.col("feature_set").isin(sets) & (F.coalesce(F.size("values"), F.lit(0)) > 0))
    zero = F.lit(0).cast("long")
    return here.groupBy("item_id").agg(F.bit_or(bit).alias("has"),
                                       F.bit_or(F.when(has_missing(F.col("values")), zero).otherwise(bit)).alias("whole"))


def mask_of(names: list[str], sets: list[str]) -> int:
    return sum(1 << sets.index(n) for n in names)


@dataclass
class Plans:
    """members: (plan, item_id, y, fold); of: combination -> plan; n_samples: combination -> aligned items."""

    members: DataFrame
    of: dict[str, str]
    n_samples: dict[str, int]


def aligned_items(vecs: DataFrame, sets: list[str], names: list[str], labels: DataFrame | None, complete: bool) -> DataFrame:
    """(item_id[, y]) of one combination."""
    want = mask_of(names, sets)
    ids = presence(vecs, sets).where(F.col("whole" if complete else "has").bitwiseAND(F.lit(want)) == want).select("item_id")
    return ids if labels is None else labels.join(ids, "item_id")


def make_plans(vecs: DataFrame, labels: DataFrame, combos: dict[str, list[str]], sets: list[str], complete: bool = True,
               k: int = 5, seed: int = 42) -> Plans:
    """Fold plans of all combinations over the labelled items they have.

    Combinations with the same items (count and two sums of hashes) share a
    plan, named by the first of them.  Only these sums reach the driver.
    """
    masks = cut_lineage(presence(vecs, sets).join(labels, "item_id").withColumn("mask", F.col("whole" if complete else "has")))
    each = F.array(*[F.struct(F.lit(c).alias("plan"), F.lit(mask_of(names, sets)).cast("long").alias("want")) for c, names in combos.items()])

    def spread(of):
        return masks.select("item_id", "y", "mask", F.inline(of)).where(F.col("mask").bitwiseAND(F.col("want")) == F.col("want")) \
            .select("plan", "item_id", "y")

    hashes = [F.sum(F.xxhash64("item_id", F.lit(i)).cast("decimal(38,0)")).alias(f"h{i}") for i in (1, 2)]
    found = {r["plan"]: r for r in spread(each).groupBy("plan").agg(F.count(F.lit(1)).alias("n"), *hashes).collect()}
    first: dict[tuple, str] = {}
    of = {c: first.setdefault((found[c]["n"], found[c]["h1"], found[c]["h2"]), c) for c in combos if c in found}
    plans = set(of.values())
    wanted = [F.struct(F.lit(c).alias("plan"), F.lit(mask_of(names, sets)).cast("long").alias("want")) for c, names in combos.items() if c in plans]
    members = spread(F.array(*wanted)) if wanted else labels.limit(0).select(F.lit("").alias("plan"), "item_id", "y")
    members = cut_lineage(assign_folds(members, k=k, seed=seed, partition_cols=["plan"]))
    return Plans(members, of, {c: found[c]["n"] for c in of})
