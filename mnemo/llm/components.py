"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before the shuffle) and an
equi-join that adaptive execution may split at a hot node.  Edges are written
between rounds, which end when all components are stars; nothing but that
answer reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> node, component (its smallest node), for every node that has an edge."""
    e = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _stars(e):
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        e = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        small = e.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        e = written(small.union(low).distinct(), "edges")
    return e.union(e.select(F.col("b").alias("a"), "b")).distinct().toDF("node", "component")


def _stars(e: DataFrame) -> bool:
    """Whether every node is either the smaller end of its edges or the larger end of a single one: steps change nothing more."""
    ends = e.select(F.col("a").alias("node"), F.lit(1).alias("above"), F.lit(0).alias("below")).union(
        e.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("above").alias("above"), F.max("below").alias("below")).where("above + below > 1").isEmpty()
