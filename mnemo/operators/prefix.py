"""Running sums over groups of any size.

A window sorts one group in one task.  `running_sums` range-partitions the rows
by (group, order) instead, sums inside each range, and adds to a range what the
ranges before it hold of the same group.  A group of any share of all rows is
spread over as many tasks as it has ranges; the table of offsets has at most
one row per range.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from ..session import cut_lineage

BEFORE = "_before"


def _group_starts(batch: pa.RecordBatch, group_cols: list[str], last: tuple | None) -> tuple[np.ndarray, tuple]:
    """Rows that begin a group (not the first row of all), and the group of the last row."""
    new = np.zeros(batch.num_rows, bool)
    for c in group_cols:
        codes = batch.column(c).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    first, end = (tuple(repr(batch.column(c)[i].as_py()) for c in group_cols) for i in (0, -1))
    new[0] = last is not None and first != last
    return new, end


def _local_sums(group_cols: list[str], sums: list[str], names: list[str]):
    """Sums over the earlier rows of the group in this range, and whether the row is of the range's first group."""
    def run(batches):
        block = TaskContext.get().partitionId()
        carry, last, first_group = dict.fromkeys(sums, 0), None, True
        for b in batches:
            if not b.num_rows:
                continue
            new, last = _group_starts(b, group_cols, last)
            starts, segment = np.flatnonzero(new), np.cumsum(new)
            out = []
            for c in sums:
                v = b.column(c).fill_null(0).to_numpy(zero_copy_only=False)
                before = np.concatenate([[0], np.cumsum(v)[:-1]])
                before = before - np.concatenate([[-carry[c]], before[starts]])[segment]
                carry[c] = int(before[-1] + v[-1])
                out.append(pa.array(before, pa.int64()))
            head = (segment == 0) & first_group
            first_group = first_group and not len(starts)
            yield pa.RecordBatch.from_arrays([*b.columns, *out, pa.array(np.full(b.num_rows, block), pa.int32()), pa.array(head)], names=names)
    return run


def running_sums(df: DataFrame, group_cols: list[str], order: list[Column | str], sums: list[str],
                 ranges: int | None = None) -> DataFrame:
    """Adds `<c>_before` for every whole-number column of `sums`: its sum over the rows of the group that come before.

    `order` must not tie inside a group (rows that tie get sums in any order).
    Nulls in `sums` count as 0; null groups are groups.  The ranged rows are
    written once (checkpoint): ranges are sampled, so they must not be made twice.
    """
    keys = [*map(F.col, group_cols), *order]
    ranged = (df.repartitionByRange(ranges, *keys) if ranges else df.repartitionByRange(*keys)).sortWithinPartitions(*keys)
    extra = [*[StructField(c + BEFORE, LongType()) for c in sums], StructField("_range", IntegerType()), StructField("_head", BooleanType())]
    schema = StructType([*df.schema.fields, *extra])
    local = cut_lineage(ranged.mapInArrow(_local_sums(group_cols, sums, schema.names), schema))
    # what each range holds of each group; a group that goes on from an earlier range is the first of its range
    held = local.groupBy("_range", *group_cols).agg(*[F.sum(c).alias(c) for c in sums])
    w = Window.partitionBy(*(group_cols or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select("_range", *[F.sum(c).over(w).alias(f"_off_{c}") for c in sums], F.count(F.lit(1)).over(w).alias("_earlier"))
    offsets = offsets.where(F.col("_earlier") > 0).drop("_earlier")  # at most one row per range
    out = local.join(F.broadcast(offsets), "_range", "left")
    for c in sums:
        out = out.withColumn(c + BEFORE, F.col(c + BEFORE) + F.when(F.col("_head"), F.coalesce(F.col(f"_off_{c}"), F.lit(0))).otherwise(0))
    return out.select(*df.columns, *[c + BEFORE for c in sums])
