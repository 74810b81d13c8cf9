"""Read the driver's parquet tables (one file or folder per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Parallelism floor for CPU-heavy per-row work.

    A scan yields one task per file split; a small table stored as one row
    group is a single task, and everything narrow after it (regexes,
    explodes, numpy blocks) would run on one core.  Below the floor
    (default: 2 x the cluster's cores) the rows are round-robin repartitioned;
    above it - any large input - nothing changes.  Projections and filters
    still push below the repartition into the scan.
    """
    spark = df.sparkSession
    target = min_partitions or 2 * spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one table; Catalyst prunes columns and pushes filters into it."""
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))
