"""Hard-negative mining by slot-decomposed selection.

A row's score is the inner product of its quantised vector with an anchor's.
An anchor's positives are its first rows of the same label; each positive
allows the scores from `low` to `high` percent of its own as negatives, and
the first few rows of other labels in that window are its hard negatives.

The windows of one anchor overlap.  Their upper limits split the scores into
disjoint slots: slot i holds the scores above the next smaller limit and up
to its own.  A window's first k rows are the first k of its slot and all
lower slots, as far as they reach the window's lower limit.  So

1. blocks of anchors meet blocks of rows of the same label, and each block
   pair keeps `positives` rows per anchor;
2. the positives of an anchor give its slots;
3. blocks of anchors meet blocks of all rows; each block pair keeps the first
   k rows of other labels per (anchor, slot), and so do the combiners of the
   merge;
4. from the lowest slot up, slots are merged and cut to k; every positive
   reads the merge at its own slot.

Rows and anchors are dealt to blocks by hash, so a hot label is many tasks;
a block pair is one matrix product.  Products run in double precision while
they are exact there (below 2^53), else in whole numbers.

Defined cases: rows with a null label or vector, an empty vector, or a null or
non-finite component take no part, nor do those whose quantised components
pass 2^28 / sqrt(length) (scores stay below 2^56); vectors of different length
are not compared; a null id is after all others among equal scores and is no anchor;
equal ids are different rows, ordered by their place; an anchor without
positives or a positive without negatives gives no row; a positive of
negative score allows nothing, one of score 0 allows 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, written

POSITIVES, NEGATIVES, LOW, HIGH, BLOCK = 5, 3, 50, 95, 2048
LIMIT = 1 << 28


def quantise(vectors: DataFrame, anchor: Column, label: Column, steps: int = 256) -> DataFrame:
    """_row, id, label, dim, x (whole numbers), anchor of the rows that take part; `vectors` has id, label, vector."""
    bound = F.lit(float(LIMIT) / steps) / F.sqrt(F.size("vector").cast("double"))
    ok = F.col("label").isNotNull() & (F.coalesce(F.size("vector"), F.lit(0)) > 0)
    ok &= F.forall("vector", lambda v: F.coalesce(F.abs(v.cast("double")) < bound, F.lit(False)))  # false for NaN too
    x = F.transform("vector", lambda v: F.floor(v.cast("double") * steps))
    return written(vectors.where(ok).select(
        F.monotonically_increasing_id().alias("_row"), F.col("id").cast("long").alias("id"), label.alias("label"),
        F.size("vector").alias("dim"), F.coalesce(anchor, F.lit(False)).alias("anchor"), x.alias("x")), "negatives-rows")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.chunk(0)
    return flat.flatten().to_numpy().reshape(len(flat), -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows."""
    if a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _first(score: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k: highest score, then lowest rank."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= least)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((rank[at], -score[at]))[:k]]


def block_pairs(anchors: DataFrame, rows: DataFrame, by: list[str], fn, schema: str, block: int = BLOCK) -> DataFrame:
    """fn(anchors, rows) as Arrow tables for every pair of blocks of equal `by`; blocks hold about `block` rows."""
    sizes = (rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("row_blocks"))
             .join(anchors.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("anchor_blocks")), by))

    def dealt(df, own, own_blocks, other, other_blocks):
        df = df.select(*[F.col(c).alias(c) for c in df.columns])  # both sides may read one table
        return (df.join(sizes, by).withColumn(own, F.pmod(F.xxhash64("_row"), F.col(own_blocks)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_blocks) - 1))).drop("row_blocks", "anchor_blocks"))

    keys = [*by, "_a", "_b"]
    left, right = dealt(anchors, "_a", "anchor_blocks", "_b", "row_blocks"), dealt(rows, "_b", "row_blocks", "_a", "anchor_blocks")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(fn, schema)


def _place(t: pa.Table) -> np.ndarray:
    """Order of the rows among equal scores: by id, nulls last, then by row."""
    ids = t.column("id")
    null = ids.is_null().to_numpy(zero_copy_only=False)
    order = np.lexsort((t.column("_row").to_numpy(), ids.fill_null(0).to_numpy(), null))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place


def _same_label(k: int):
    schema = pa.schema([("anchor", pa.int64()), ("score", pa.int64()), ("row", pa.int64()), ("id", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        score, place = products(_matrix(left["x"]), _matrix(right["x"])), _place(right)
        a, r = left["_row"].to_numpy(), right["_row"].to_numpy()
        out, at = [], []
        for i in range(len(a)):
            other = np.flatnonzero(r != a[i])
            best = other[_first(score[i, other], place[other], k)]
            out.append(np.full(len(best), i))
            at.append(best)
        i, j = np.concatenate(out), np.concatenate(at)
        return pa.table({"anchor": a[i], "score": score[i, j], "row": r[j], "id": right["id"].combine_chunks().take(pa.array(j))}, schema=schema)
    return run


def _slots(k: int):
    schema = pa.schema([("anchor", pa.int64()), ("slot", pa.int32()), ("score", pa.int64()), ("row", pa.int64()), ("id", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        score, place = products(_matrix(left["x"]), _matrix(right["x"])), _place(right)
        a, r = left["_row"].to_numpy(), right["_row"].to_numpy()
        labels = left["label"].to_numpy(), right["label"].to_numpy()
        limits, least = left["limits"].to_pylist(), left["least"].to_numpy()
        parts = [[], [], []]
        for i in range(len(a)):
            bounds = [*limits[i], int(least[i]) - 1]  # descending
            row = np.where(labels[1] != labels[0][i], score[i], np.iinfo(np.int64).min)
            fits = np.flatnonzero((row <= bounds[0]) & (row > bounds[-1]))
            slot = np.searchsorted(-np.array(bounds), -row[fits], side="right") - 1  # bounds[slot] >= score > bounds[slot + 1]
            for s in np.unique(slot).tolist():
                at = fits[slot == s]
                at = at[_first(row[at], place[at], k)]
                for p, v in zip(parts, (np.full(len(at), i), np.full(len(at), s), at)):
                    p.append(v)
        if not parts[0]:
            return schema.empty_table()
        i, s, j = (np.concatenate(p) for p in parts)
        return pa.table({"anchor": a[i], "slot": s.astype(np.int32), "score": score[i, j], "row": r[j],
                         "id": right["id"].combine_chunks().take(pa.array(j))}, schema=schema)
    return run


def _top(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first k rows per key, with their rank; Spark cuts every task's rows to k before they are sent."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchor: Column, label: Column, vec_id: str = "vec_id", vector: str = "embedding", label_name: str = "label",
         positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, steps: int = 256,
         block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank.

    `anchor` and `label` are expressions over the columns id, label and vector.
    """
    rows = quantise(pick(vectors, id=vec_id, label=label_name, vector=vector), anchor, label, steps)
    anchors = rows.where("anchor")
    best = block_pairs(anchors.select("_row", "x", "label", "dim"), rows.select("_row", "id", "x", "label", "dim"), ["label", "dim"],
                       _same_label(positives), "anchor long, score long, row long, id long", block)
    pos = written(_top(best, ["anchor"], positives).withColumnRenamed("rank", "positive_rank"), "negatives-positives")
    pos = pos.withColumns({"upper": _floor_div(F.col("score") * high, 100), "lower": -_floor_div(-F.col("score") * low, 100)})
    usable = pos.where("lower <= upper")
    slots = usable.groupBy("anchor").agg(F.reverse(F.array_sort(F.collect_set("upper"))).alias("limits"), F.min("lower").alias("least"))
    able = anchors.join(slots, anchors["_row"] == slots["anchor"]).select("_row", "x", "label", "dim", "limits", "least")
    kept = _top(block_pairs(able, rows.select("_row", "id", "x", "label", "dim"), ["dim"], _slots(negatives),
                            "anchor long, slot int, score long, row long, id long", block), ["anchor", "slot"], negatives)
    # at most slots x negatives rows an anchor
    merged = kept.groupBy("anchor").agg(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("id").isNull().alias("n"), "id", "row", "slot")).alias("kept"))
    out = usable.join(slots.drop("least"), "anchor").join(merged, "anchor")
    own = F.array_position("limits", F.col("upper")) - 1
    first = F.slice(F.array_sort(F.filter("kept", lambda x: x["slot"] >= own)), 1, negatives)
    out = out.withColumn("found", F.filter(first, lambda x: -x["s"] >= F.col("lower")))
    names = anchors.select(F.col("_row").alias("anchor"), F.col("id").alias("anchor_id"))
    return (out.join(names, "anchor").select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"),
                                             "positive_rank", F.posexplode("found").alias("p", "x"))
            .select("anchor_id", "positive_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.id").alias("negative_id"),
                    "positive_score", (-F.col("x.s")).alias("negative_score"), "positive_rank"))


def _floor_div(a: Column, b: int) -> Column:
    """Whole-number quotient, rounded down."""
    return F.call_function("div", a - F.pmod(a, F.lit(b)), F.lit(b))
