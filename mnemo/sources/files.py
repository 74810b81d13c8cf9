"""File sources and sinks.

* Feature store: Parquet partitioned by (split, feature_set) with rows
  (item_id, is_global, frames ARRAY<ARRAY<FLOAT>>); a scan of one set prunes
  partitions instead of listing folders.
* `.npy` ingest: `binaryFile` + `mapInPandas` (numpy decodes one file per
  row inside the task), written once to the feature store; a file that can't
  be decoded is a row with its error.
* CSV labels / item lists, whole-text transcripts, asset resolution.
"""

from __future__ import annotations

import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import flatten_frames, nan_to_num

RAW_SCHEMA = T.StructType([
    T.StructField("item_id", T.StringType()),
    T.StructField("is_global", T.BooleanType()),
    T.StructField("frames", T.ArrayType(T.ArrayType(T.FloatType()))),
])


def scan_feature_set(raw: DataFrame, feature_set: str, split: str = "devset") -> DataFrame:
    """S1 over a raw feature table (already read): partition filter,
    nan_to_num, flatten.  -> (item_id, values ARRAY<DOUBLE>).
    Raises when the set has no rows, like a missing / empty folder."""
    sel = raw.where((F.col("split") == split) & (F.col("feature_set") == feature_set))
    if sel.limit(1).count() == 0:
        raise FileNotFoundError(f"no vectors for feature set {feature_set!r} in split {split!r}")
    return sel.select("item_id", nan_to_num(flatten_frames(F.col("frames"), F.col("is_global"))).alias("values"))


def read_feature_store(spark: SparkSession, root: str) -> DataFrame:
    """The feature store as one DataFrame; split / feature_set are partition
    columns, so filters on them prune directories."""
    return spark.read.parquet(root)


def write_feature_store(raw: DataFrame, root: str, mode: str = "append", files_per_set: int = 8) -> None:
    """Save vectors, one partition directory per (split, feature_set), each
    written by up to `files_per_set` tasks."""
    bucket = F.pmod(F.xxhash64("item_id"), F.lit(files_per_set))
    (raw.repartition("split", "feature_set", bucket)
        .write.mode(mode).partitionBy("split", "feature_set").parquet(root))


DECODED_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()), *RAW_SCHEMA.fields,
    T.StructField("status", T.StringType()), T.StructField("message", T.StringType()),
])


def _decode_npy(batches):
    import numpy as np
    import pandas as pd
    for pdf in batches:
        out = []
        for path, content in zip(pdf["path"], pdf["content"]):
            stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
            try:
                arr = np.load(io.BytesIO(bytes(content)), allow_pickle=False).astype(np.float32)
                if arr.ndim not in (1, 2):
                    raise ValueError(f"an array of {arr.ndim} dimensions")
                out.append((path, stem, arr.ndim == 1, [arr.tolist()] if arr.ndim == 1 else [r.tolist() for r in arr], "ok", None))
            except Exception as exc:  # noqa: BLE001 - the row says so
                out.append((path, stem, None, None, "fail", f"{type(exc).__name__}: {exc}"[:1000]))
        yield pd.DataFrame(out, columns=DECODED_SCHEMA.names)


def decode_arrays(files: DataFrame) -> DataFrame:
    """(path, content) of `.npy` files -> path, item_id (file stem), is_global, frames, status, message.

    One row per file: a file that can't be decoded (cut off, not an array,
    null content, more than two dimensions) has status `fail`, the error's
    text and no frames; it ends neither its task nor the job.  Spark's file
    sources leave out files of no bytes: these show up as missing items.
    """
    return files.select("path", "content").mapInPandas(_decode_npy, schema=DECODED_SCHEMA)


def ingest_arrays(spark: SparkSession, folder: str, split: str, feature_set: str, failed: bool = False) -> DataFrame:
    """One `.npy` per item -> raw rows; id = file stem.  Files are read
    and decoded in parallel tasks (one file per row).  `failed`: also the files
    that could not be decoded, with the columns path, status and message."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(folder)
    rows = decode_arrays(files)
    rows = rows if failed else rows.where("status = 'ok'").select(*RAW_SCHEMA.names)
    return rows.select(F.lit(split).alias("split"), F.lit(feature_set).alias("feature_set"), "*")


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(dir, file, bytes) of all files below `root`; contents are not read."""
    found = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
             .select("path", F.col("length").alias("bytes")))
    return found.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("dir"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "bytes")


def folder_states(spark: SparkSession, root: str, dirs: list[str]) -> DataFrame:
    """(dir, state, files): every expected folder as `present`, `empty` or `missing`."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    here = [d for d in dirs if fs.exists(path(f"{root.rstrip('/')}/{d}"))]
    expected = spark.createDataFrame([(d, d in here) for d in dirs], "dir string, here boolean")
    counts = list_files(spark, root).groupBy("dir").agg(F.count(F.lit(1)).alias("files"))
    state = F.when(~F.col("here"), "missing").when(F.col("files").isNull(), "empty").otherwise("present")
    return expected.join(counts, "dir", "left").select("dir", state.alias("state"), F.coalesce("files", F.lit(0)).alias("files"))


def scan_labels(spark: SparkSession, path: str, target: str = "memorability_score") -> DataFrame:
    """S3: CSV indexed by `id`, one target column cast to float."""
    df = spark.read.option("header", True).csv(path)
    return df.select(F.col("id").alias("item_id"), F.col(target).cast("float").alias("y"))


def scan_item_list(spark: SparkSession, path: str) -> DataFrame:
    """The `id` column of a CSV manifest."""
    return spark.read.option("header", True).csv(path).select(F.col("id").alias("item_id"))


def scan_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """One UTF-8 text per item (whole file), id = file stem."""
    t = spark.read.text(folder, wholetext=True)
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.[^./]*)?$", 1)
    return t.select(stem.alias("item_id"), F.col("value").alias("text"))


def resolve_asset(items: DataFrame, listing: DataFrame, priority: list[str]) -> DataFrame:
    """First existing candidate per item in `priority` order, else NULL.

    listing: (item_id, ext).  `min_by` is a partial aggregate, so an item
    with many candidates never needs a window over all of them.
    """
    rank = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("ext"))
    best = (listing.withColumn("_r", rank).where(F.col("_r") > 0)
                   .groupBy("item_id").agg(F.min_by("ext", "_r").alias("asset")))
    return items.select("item_id").distinct().join(best, "item_id", "left")


def sink_sweep_results(parts: list[DataFrame], path: str | None = None) -> DataFrame:
    """S8 + U2: union the partial result tables, sort by mean desc and
    (optionally) write one CSV with a header."""
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    ordered = merged.orderBy(F.col("mean_spearman").desc(), "model", "selector", "combination")
    if path:
        ordered.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return ordered


def sink_predictions(fused: DataFrame, path: str | None = None) -> DataFrame:
    """Predictions per run with the sink's column names."""
    out = fused.select("run_id", F.col("item_id").alias("video"), F.col("fused").alias("mem_score"))
    if path:
        out.write.mode("append").partitionBy("run_id").option("header", True).csv(path)
    return out
