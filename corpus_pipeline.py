"""The corpus pipeline: five stages over `documents`, each written and read again.

quality      rejects what the importance-resampling classifier rejects
near_dedup   keeps the smallest id of each group of near duplicates
decontam     drops documents that share a window with the benchmark
secrets      replaces live-looking credentials; widely copied examples stay
mixture      how often each document is taken to reach the sources' targets

A stage takes (spark, docs, sf_dir) and works on all rows of `docs`; all but
the last return the columns of `documents`.  Its result is to be written before
the next stage starts: a stage deletes the working tables of the one before.

Defined cases: null, empty and repeated texts and ids are rows like others
(each operator's docstring says what it makes of them); an empty table stays
empty through all stages; further columns of `docs` go along, whatever their
names.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemo.llm.common import drop_tables, keep_rows, keyed, read, release_driver_memory, tables, written
from mnemo.llm.count_rtree import jaccard_components
from mnemo.llm.importance import importance_resample
from mnemo.llm.pivotal_mixing import mix
from mnemo.llm.secret_scan import redact
from mnemo.llm.winnowing import contaminated_windows


_working: list[str] = []


def stage(fn):
    """A stage that first drops the working tables of the stage before, and notes its own."""
    @functools.wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_tables(spark, _working)
        release_driver_memory(spark)
        before = set(tables())
        out = fn(spark, docs, sf_dir)
        _working[:] = [t for t in tables() if t not in before]
        return out
    return run_stage


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, key = keyed(docs)
    return keep_rows(docs, key, importance_resample(docs, read(spark, sf_dir, "labels"), row=key).where("kept"))


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, key = keyed(docs)
    groups = jaccard_components(docs, row=key)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    return keep_rows(docs, key, groups.groupBy("component").agg(F.min_by("_row", order).alias("_row")))


@stage
def decontam(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, key = keyed(docs)
    windows = contaminated_windows(docs, read(spark, sf_dir, "benchmark"), row=key)
    return keep_rows(docs, key, windows.where(F.size("hits") == 0))


@stage
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


@stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontam", decontam), ("secrets", secrets), ("mixture", mixture)]

#: The model, the similarity join and the random rounding have no plain SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; returns the manifest of the mix."""
    docs, last = read(spark, sf_dir, "documents"), []
    for name, step in STAGES:
        out = step(spark, docs, sf_dir)
        before = set(tables())
        docs = written(out, f"pipeline-{name}")
        drop_tables(spark, last)
        last = [t for t in tables() if t not in before]
    return docs
