"""Alignment of feature sets by key, set operations and projections:
J1 align_inner, J2 align_labels, J3 semi_align, J4 anti_done,
J5 extract_status, J9 grid, U1 intersect_ids, U2 union_parts,
U4 registry_union, P3 explode_features, P4 concat_features,
P5 take_indices, P6 drop_incomplete, P11 validate_names, A25 run_counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import has_missing


def shared_ids(vecs: DataFrame, sets: list[str]) -> DataFrame:
    """Ids present in every one of `sets` - one shuffle (group by id)
    instead of N-1 chained joins."""
    return (vecs.where(F.col("feature_set").isin(*sets))
                .groupBy("item_id").agg(F.countDistinct("feature_set").alias("_k"))
                .where(F.col("_k") == len(sets)).select("item_id"))


def align_inner(vecs: DataFrame, sets: list[str], labels: DataFrame | None = None) -> DataFrame:
    """J1 (+ J2 when labels are given): ids of the inner join of the sets
    (and of the labels).  -> (item_id[, y])."""
    ids = shared_ids(vecs, sets)
    return ids.join(labels, "item_id") if labels is not None else ids


def semi_align(vecs: DataFrame, sets: list[str], labels: DataFrame | None = None) -> DataFrame:
    """Every set restricted to the shared ids, kept separate."""
    ids = align_inner(vecs, sets, labels).select("item_id")
    return vecs.where(F.col("feature_set").isin(*sets)).join(ids, "item_id", "left_semi")


def concat_features(vecs: DataFrame, sets: list[str], drop_incomplete: bool = True) -> DataFrame:
    """P4 (+ P6): early fusion in list order as one vector per item; items
    missing a set drop out (inner join), items with a missing value too."""
    order = F.array_position(F.array(*[F.lit(s) for s in sets]), F.col("feature_set"))
    g = (vecs.where(F.col("feature_set").isin(*sets)).withColumn("_o", order)
             .groupBy("item_id").agg(F.collect_list(F.struct("_o", "values")).alias("_p"),
                                     F.count(F.lit(1)).alias("_k")))
    out = (g.where(F.col("_k") == len(sets))
            .select("item_id", F.flatten(F.transform(F.array_sort("_p"), lambda s: s["values"])).alias("values")))
    return out.where(~has_missing(F.col("values"))) if drop_incomplete else out


def concat_long(long_df: DataFrame, sets: list[str], widths: dict[str, int]) -> DataFrame:
    """P4 in long form: global position = offset of the set + idx."""
    off, acc = [], 0
    for s in sets:
        off += [F.lit(s), F.lit(acc)]
        acc += widths[s]
    return (long_df.where(F.col("feature_set").isin(*sets))
                   .withColumn("pos", (F.element_at(F.create_map(*off), F.col("feature_set")) + F.col("idx"))
                               .cast("bigint")))


def explode_features(vecs: DataFrame) -> DataFrame:
    """Positional columns as rows, name = <set>_<i>."""
    return vecs.select("item_id", "feature_set", F.posexplode("values").alias("idx", "value")) \
               .withColumn("name", F.concat_ws("_", "feature_set", F.col("idx").cast("string")))


def take_indices(long_df: DataFrame, selected: DataFrame, keys: list[str]) -> DataFrame:
    """P5: keep the selected positions (semi join on the small selection,
    same positions for train and test rows)."""
    return long_df.join(selected.select(*keys).distinct(), keys, "left_semi")


def validate_names(requested: DataFrame, registry: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """Unknown names raise (strict) or are dropped with a warning."""
    unknown = requested.join(registry.select(key), key, "left_anti")
    bad = [r[key] for r in unknown.limit(20).collect()]
    if bad and strict:
        raise ValueError(f"unknown {key}: {bad}")
    if bad:
        print(f"[WARNING] unknown {key} skipped: {bad}")
    return requested.join(registry, key, "inner")


def anti_done(pending: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks / items whose output does not exist yet."""
    return pending.join(done.select(*keys).distinct(), keys, "left_anti")


def grid(combos: DataFrame, models: list[str], selectors: list[str], fusions: list[str]) -> DataFrame:
    """Combos x models x selectors x fusion, as array explodes of the
    small parameter lists (no join)."""
    def arr(xs):
        return F.array(*[F.lit(x) for x in xs])
    return (combos.withColumn("model", F.explode(arr(models)))
                  .withColumn("selector", F.explode(arr(selectors)))
                  .withColumn("fusion", F.explode(arr(fusions))))


def registry_union(*tables: DataFrame) -> DataFrame:
    """U4: name -> sets, later tables override earlier ones."""
    parts = [t.select("combination", "feature_sets", F.lit(i).alias("_p")) for i, t in enumerate(tables)]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    best = u.groupBy("combination").agg(F.max_by("feature_sets", "_p").alias("feature_sets"))
    return best


def run_counts(status: DataFrame, keys: list[str]) -> DataFrame:
    """Done / skipped / failed / total per extractor."""
    s = F.col("status")
    return status.groupBy(*keys).agg(
        F.sum(F.when(s == "ok", 1).otherwise(0)).cast("bigint").alias("done"),
        F.sum(F.when(s.startswith("skip"), 1).otherwise(0)).cast("bigint").alias("skipped"),
        F.sum(F.when(s == "fail", 1).otherwise(0)).cast("bigint").alias("failed"),
        F.count(F.lit(1)).cast("bigint").alias("total"))
