"""Helpers shared by the operators: row keys, columns, written tables, Arrow maps."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

import mnemo

from ..session import ensure_checkpoint_dir

# functions of this package travel to the executors by value
cloudpickle.register_pickle_by_value(mnemo)


#: Bytes of a batch that a function of `arrow_map` gets at once (a longer single row is one piece).
PART_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one table (its partitions follow spark.sql.files.*)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, renamed: other columns of the input can't clash."""
    return df.select(*[df[f"`{c}`"].alias(a) for a, c in columns.items()])


def plain(df: DataFrame) -> DataFrame:
    """`df` itself if it only projects and filters file scans, else `df` written as a table.

    A place behind a shuffle may change when a lost task runs again.
    """
    tree = df._jdf.queryExecution().optimizedPlan().treeString()
    nodes = {line.lstrip(" +-:").split(" ")[0] for line in tree.splitlines()}
    return df if nodes <= {"Project", "Filter", "Relation"} else written(df, "rows")


def with_row(df: DataFrame) -> DataFrame:
    """Adds `_row`, a key of the input row for one pass: doc ids may repeat or be null.

    It is the place in the scan, whose splits follow the cores that are
    registered when a pass starts: several passes need `numbered`.
    """
    return plain(df).withColumn("_row", F.monotonically_increasing_id())


def numbered(df: DataFrame) -> DataFrame:
    """`df` with a key `_row` of the input row, written once: it is the same in every pass."""
    return written(df.withColumn("_row", F.monotonically_increasing_id()), "rows")


def keyed(df: DataFrame) -> tuple[DataFrame, str]:
    """`df` written with a key in a column of a fresh name, and that name: the key is the same in every pass."""
    name = f"_key_{uuid.uuid4().hex}"
    return written(df.withColumn(name, F.monotonically_increasing_id()), "rows"), name


def keep_rows(docs: DataFrame, key: str, rows: DataFrame) -> DataFrame:
    """The rows of `docs`, a table of `keyed`, whose key is in the column `_row` of `rows`; without the key."""
    return docs.join(rows.select(F.col("_row").alias(key)), key, "left_semi").drop(key)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table below spark.checkpoint.dir; lineage ends here.

    The table is read by later steps from the shared folder, so a lost
    executor costs only its own tasks.  It is deleted when the session ends,
    or before by `drop_tables`.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables.append(path)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


#: Paths of the tables that `written` has made and nobody has dropped.
_tables: list[str] = []


def tables() -> list[str]:
    return list(_tables)


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Deletes working tables; nothing that reads them may be left to run."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        if path in _tables:
            _tables.remove(path)
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release_driver_memory(spark: SparkSession) -> None:
    """A full collection in the driver's JVM: broadcasts and shuffle files that nothing uses any more go, and free heap returns to the system."""
    spark.sparkContext._jvm.System.gc()


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow for functions that yield {column: array}; empty results are left out."""
    struct: StructType = _parse_datatype_string(schema)
    target = to_arrow_schema(struct)

    def run(batches):
        for out in fn(part for b in batches for part in _parts(b)):
            batch = pa.RecordBatch.from_arrays(
                [a if isinstance(a, pa.Array) and a.type == f.type else _cast(a, f.type)
                 for f, a in ((f, out[f.name]) for f in target)], schema=target)
            if batch.num_rows:
                yield batch
        release_memory()

    return df.mapInArrow(run, struct)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about PART_BYTES."""
    rows = max(1, batch.num_rows * PART_BYTES // max(1, batch.nbytes))
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def release_memory() -> None:
    """Gives free memory of this Python worker back: workers live on and run the tasks of later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _cast(a, kind: pa.DataType) -> pa.Array:
    if not isinstance(a, pa.Array):
        return pa.array(a, type=kind)
    return a.cast(kind)


def list_array(values, ptr, kind=None) -> pa.Array:
    """List column from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.array(values) if kind is None else pa.array(values, kind))
