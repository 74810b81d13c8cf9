"""Skew-safe row numbering.

`row_number()` over a large partition puts the whole partition in one task.
`block_row_number` numbers rows in two phases: count rows per (partition,
block), turn the small count table into offsets with a running sum, then
number rows only inside each block.  Blocks must be monotone in the order
(every row of a lower block precedes every row of a higher one), e.g. a hash
prefix when ordering by that hash, or an hour bucket when ordering by time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def block_row_number(df: DataFrame, partition_cols: list[str], block: str,
                     order_cols: list, out: str = "pos",
                     total: str | None = None) -> DataFrame:
    counts = df.groupBy(*partition_cols, block).agg(F.count(F.lit(1)).alias("_n"))
    run = (Window.partitionBy(*partition_cols).orderBy(block)
           .rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(run), F.lit(0)))
    if total:
        offsets = offsets.withColumn(total, F.sum("_n").over(Window.partitionBy(*partition_cols)))
    offsets = offsets.drop("_n")
    inner = Window.partitionBy(*partition_cols, block).orderBy(*order_cols)
    return (df.join(offsets, [*partition_cols, block])
              .withColumn(out, (F.col("_off") + F.row_number().over(inner) - 1).cast("bigint"))
              .drop("_off"))
