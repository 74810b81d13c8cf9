"""Feature-quality rules Q1-Q7, the directory summary A24 and the gate S10.

Input `vectors`: (dir, kind, item_id, shape ARRAY<INT>, values ARRAY<DOUBLE>)
as loaded from one array per item; `kind` in audio_c / audio_o / semantic /
emotion.  Every rule is a per-row expression over the vector (no shuffle);
the transcript and audio-level lookups are key joins.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# Expected shapes per kind, optional NaN positions of the
# global audio vector, silence threshold in dB.
EXPECTED_SHAPES = {"audio_c": [3, 9], "audio_o": [9], "semantic": [7], "emotion": [19]}
AUDIO_O_OPTIONAL_NAN = [7, 8]
SILENCE_THRESHOLD_DB = -50.0
AUDIO_KINDS = ["audio_c", "audio_o"]
TEXT_KINDS = ["semantic", "emotion"]


def _is_inf(x: Column) -> Column:
    return F.abs(x) == F.lit(float("inf"))


def expected_shape(kind: Column) -> Column:
    m = F.create_map(*sum([[F.lit(k), F.array(*[F.lit(d) for d in v])]
                           for k, v in EXPECTED_SHAPES.items()], []))
    return F.element_at(m, kind)


def vector_facts(vectors: DataFrame) -> DataFrame:
    """Per-vector counts used by the rules."""
    v = F.col("values")
    valid = F.filter(v, lambda x: ~F.isnan(x) & ~_is_inf(x))
    bad_nan = F.filter(F.transform(v, lambda x, i: F.when(F.isnan(x) & ~i.isin(*AUDIO_O_OPTIONAL_NAN), i)),
                       lambda i: i.isNotNull())
    return vectors.select(
        "*",
        (F.col("shape") == expected_shape(F.col("kind"))).alias("shape_ok"),
        F.size(v).alias("n"),
        F.size(F.filter(v, _is_inf)).alias("inf_n"),
        F.size(F.filter(v, lambda x: F.isnan(x))).alias("nan_n"),
        F.size(bad_nan).alias("bad_nan_n"),
        ((F.size(valid) > 0) & F.forall(valid, lambda x: x == 0)).alias("all_zero"))


def issues(vectors: DataFrame, transcripts: DataFrame, levels: DataFrame) -> DataFrame:
    """Q1-Q6: the issue list of every vector.

    transcripts: (item_id, empty) emptiness of the item's transcript
    (missing = empty);
    levels: (item_id, peak_db) of the item's audio (missing = unknown).
    vectors may have `load_error`: the error of a file that could not be
    decoded (its values are null), which is then its only issue.
    Returns vectors' keys + `issues ARRAY<STRING>` (empty when clean).
    """
    f = (vector_facts(vectors)
         .join(transcripts.select("item_id", F.col("empty").alias("_e")), "item_id", "left")
         .join(levels.select("item_id", F.col("peak_db").alias("_pk")), "item_id", "left"))
    kind = F.col("kind")
    audio = kind.isin(*AUDIO_KINDS)
    inf_i = F.when(F.col("inf_n") > 0, F.lit("FAIL Inf"))
    nan_audio = (F.when(kind == "audio_o",
                        F.when(F.col("bad_nan_n") > 0, F.lit("FAIL NaN at unexpected indices")))
                  .when(F.col("nan_n") == F.col("n"), F.lit("FAIL all NaN"))
                  .when(F.col("nan_n") > 0, F.lit("FAIL NaN")))
    zero_audio = F.when(F.col("all_zero"),
                        F.when(F.col("_pk").isNull(), F.lit("FAIL all-zero and could not determine audio level"))
                         .when(F.col("_pk") < SILENCE_THRESHOLD_DB, F.lit("BENIGN silent audio"))
                         .otherwise(F.lit("FAIL all-zero but audio not silent")))
    empty = F.coalesce(F.col("_e"), F.lit(True))
    flagged = (F.col("nan_n") > 0) | F.col("all_zero")
    all_nan_text = F.col("nan_n") == F.col("n")
    text_a = (F.when(all_nan_text, F.lit("FAIL all NaN"))
               .when(flagged & empty, F.lit("BENIGN empty transcript"))
               .when(flagged & (F.col("nan_n") > 0), F.lit("FAIL NaN (transcript has content)")))
    text_b = F.when(~all_nan_text & ~empty & F.col("all_zero"),
                    F.lit("FAIL all-zero valid elements (transcript has content)"))
    error = F.col("load_error") if "load_error" in vectors.columns else F.lit(None)
    checks = F.when(error.isNotNull(), F.array(F.concat(F.lit("FAIL not readable: "), error))) \
              .when(~F.coalesce("shape_ok", F.lit(False)), F.array(F.lit("FAIL wrong shape"))) \
              .when(audio, F.array_compact(F.array(inf_i, nan_audio, zero_audio))) \
              .otherwise(F.array_compact(F.array(inf_i, text_a, text_b)))
    return f.select("dir", "kind", "item_id", checks.alias("issues"))


def item_level(iss: DataFrame) -> DataFrame:
    """Q7: FAIL over BENIGN over ok."""
    i = F.col("issues")
    lvl = (F.when(F.exists(i, lambda s: s.startswith("FAIL")), "FAIL")
            .when(F.exists(i, lambda s: s.startswith("BENIGN")), "BENIGN").otherwise("ok"))
    return iss.withColumn("level", lvl)


def qa_summary(levels: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """Per directory files / ok / warn / fail and a status, plus the
    grand total (dir = 'total') via ROLLUP.

    folders: (dir, state) of the expected directories; one that is `missing` or
    `empty` counts as one failure and has that as its status.
    """
    if folders is not None:
        gone = folders.where(F.col("state") != "present").select("dir", F.col("state").alias("status"))
        plain = qa_summary(levels)
        total = plain.where(F.col("dir") == "total").crossJoin(gone.agg(F.count(F.lit(1)).cast("bigint").alias("_gone")))  # one row each
        total = total.select("dir", "files", "ok", "warn", (F.col("fail") + F.col("_gone")).alias("fail"),
                             F.when(F.col("_gone") > 0, "FAIL").otherwise(F.col("status")).alias("status"))
        zero = F.lit(0).cast("bigint")
        return plain.where(F.col("dir") != "total").unionByName(total).unionByName(gone.select(
            "dir", zero.alias("files"), zero.alias("ok"), zero.alias("warn"), F.lit(1).cast("bigint").alias("fail"), "status"))
    lv = F.col("level")
    agg = levels.rollup("dir").agg(
        F.count(F.lit(1)).cast("bigint").alias("files"),
        F.sum(F.when(lv == "ok", 1).otherwise(0)).cast("bigint").alias("ok"),
        F.sum(F.when(lv == "BENIGN", 1).otherwise(0)).cast("bigint").alias("warn"),
        F.sum(F.when(lv == "FAIL", 1).otherwise(0)).cast("bigint").alias("fail"))
    status = (F.when((F.col("warn") + F.col("fail")) == 0, "ok")
               .when(F.col("fail") > 0, "FAIL").otherwise("warn"))
    return agg.select(F.coalesce("dir", F.lit("total")).alias("dir"), "files", "ok", "warn", "fail",
                      status.alias("status"))


def gate(summary: DataFrame) -> DataFrame:
    """S10 decision: publish only when the total fail count is 0."""
    return summary.where(F.col("dir") == "total").select(
        F.col("fail").alias("fail_total"), (F.col("fail") == 0).alias("publish"))


CURRENT = "CURRENT"


def gated_publish(summary: DataFrame, outputs: dict[str, DataFrame], root: str,
                  report: DataFrame | None = None) -> bool:
    """A new version of every output (and the report), only if nothing failed.

    Outputs are written to a staging folder with a manifest, the folder is
    renamed to a version, and a pointer file names the version (one rename).
    A publish that is interrupted, or that the gate stops, leaves the version
    that was there readable (`read_published`).  One scalar comes back to the
    driver; the data never does.
    """
    row = gate(summary).first()
    if row is None or not row["publish"]:
        return False
    spark = summary.sparkSession
    root, version = root.rstrip("/"), uuid.uuid4().hex
    staging = f"{root}/_staging-{version}"
    every = outputs if report is None else {**outputs, "check_report": report}
    manifest = []
    for name, df in every.items():
        df.write.parquet(f"{staging}/{name}")
        manifest.append((name, spark.read.parquet(f"{staging}/{name}").count(), df.schema.simpleString()))
    spark.createDataFrame(manifest, "name string, rows long, columns string").coalesce(1).write.json(f"{staging}/_manifest")
    path, fs = _fs(spark, root)
    if not fs.rename(path(staging), path(f"{root}/{version}")):
        raise OSError(f"could not rename {staging}")
    pointer = fs.create(path(f"{root}/{CURRENT}-{version}"), False)
    pointer.writeBytes(version)
    pointer.close()
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(root).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(context.makeQualified(path(f"{root}/{CURRENT}-{version}")), context.makeQualified(path(f"{root}/{CURRENT}")), options)
    return True


def _fs(spark: SparkSession, root: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path, path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def published_version(spark: SparkSession, root: str) -> str | None:
    """The version that the pointer names, None before the first publish."""
    path, fs = _fs(spark, root)
    if not fs.exists(path(f"{root.rstrip('/')}/{CURRENT}")):
        return None
    return spark.read.format("binaryFile").load(f"{root.rstrip('/')}/{CURRENT}").first()["content"].decode()


def read_published(spark: SparkSession, root: str, name: str) -> DataFrame:
    """An output of the published version."""
    version = published_version(spark, root)
    if version is None:
        raise FileNotFoundError(f"nothing is published below {root}")
    return spark.read.parquet(f"{root.rstrip('/')}/{version}/{name}")
