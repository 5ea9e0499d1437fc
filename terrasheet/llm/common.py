"""Helpers shared by the training-data operators: tables, the shared folder, Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Bytes of text that one pass of numpy works on; bounds a Python worker's memory.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_folders: dict[tuple[str, str | None], str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The application's folder in spark.checkpoint.dir, which driver and executors share; it is deleted when Spark ends.

    Where that is unset, a local session, as in tests, gets a temporary folder; on a cluster it is an error, as each
    machine would write to its own disk.
    """
    app, given = spark.sparkContext.applicationId, spark.conf.get("spark.checkpoint.dir", None)
    if (app, given) not in _folders:
        if not given and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = f"{(given or 'file://' + tempfile.gettempdir()).rstrip('/')}/terrasheet-{app}-{uuid.uuid4().hex[:8]}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _folders[app, given] = at
    return _folders[app, given]


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str, compression: str = "snappy") -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there, and lost executors don't matter."""
    at = new_path(df.sparkSession, what)
    df.write.parquet(at, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def schema_of(df: DataFrame, columns: list[str], more: str) -> T.StructType:
    """The types of these columns of df, whatever their names, and of `more`, which are given as DDL."""
    own = [T.StructField(c, df.schema[c].dataType) for c in columns]
    return T.StructType(own + T.StructType.fromDDL(more).fields)


def check_names(id_column: str, *results: str) -> None:
    """An error where the id column's name would stand twice in a result."""
    if id_column.lower() in results:
        raise ValueError(f"the id column is named {id_column}, like a column of the result")


def bounded_fraction(rows: int, most: int) -> float:
    """The fraction of rows to keep so that about `most` are left."""
    return 1.0 if rows <= most else most / rows


def give_back() -> None:
    """Returns freed memory to the system: workers live on between tasks, and several share an executor's memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def text_slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that `column` holds at most `most` bytes in each (or one row)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ends = np.cumsum(byte_lengths(batch.column(column)))
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(at, to - at)
            at = to
    give_back()


def byte_lengths(column: pa.Array) -> np.ndarray:
    return np.diff(offsets(column))


def offsets(column: pa.Array) -> np.ndarray:
    """Byte offsets of a string or binary column; a null takes no bytes in Spark's batches."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    raw = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    return raw[column.offset : column.offset + len(column) + 1].astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes end to end, and where each begins (one more: the end). Null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    at = offsets(column)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]
