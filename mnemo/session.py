"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import gc
import os
import re
import tempfile
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import SparkSession

import mnemo

# Functions of the package travel to the workers by value: they need no copy of it on their path.
cloudpickle.register_pickle_by_value(mnemo)

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "mnemo", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the engine's defaults.

    On a cluster pass ``master=None`` and let spark-submit decide; local tests
    pass ``local[N]``.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("MNEMO_DRIVER_MEMORY", "16g"))
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    ``spark.checkpoint.dir`` is read from the session.  Only a local-mode
    session (tests, single machine) may get a private folder when it is
    unset; on a cluster an unset folder is an error, never a machine-local
    temporary directory.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not d:
        if (have := sc.getCheckpointDir()) is not None:
            return have
        if not re.fullmatch(r"local(\[.*\])?", sc.master or ""):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/...) for this cluster")
        d = tempfile.mkdtemp(prefix="mnemo-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)  # the setting itself can't be changed in a running session
    return d


def cut_lineage(df):
    """Reliable checkpoint (survives executor loss); never a local one."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release_shuffles(spark):
    """Deletes the shuffle files of steps that are done: those of no plan that Python or the JVM still refers to."""
    gc.collect()  # Python's handles first
    spark.sparkContext._jvm.System.gc()


def step_done(df):
    """`cut_lineage`, after which the shuffle files that only `df` needed go: disk holds one step at a time, not all of them."""
    out = cut_lineage(df)
    del df
    release_shuffles(out.sparkSession)
    return out


@contextmanager
def more_partitions(spark, n: int):
    """Shuffles planned inside have at least n partitions (adaptive execution joins small ones): what a task holds does not grow with the data."""
    name = "spark.sql.shuffle.partitions"
    have = spark.conf.get(name)
    spark.conf.set(name, str(max(int(have), n)))
    try:
        yield
    finally:
        spark.conf.set(name, have)
