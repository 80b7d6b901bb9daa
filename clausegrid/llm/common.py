"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 1 << 20


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column, nulls as empty, and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds one row or at most ``limit`` bytes of ``column``; this bounds a task's memory.

    A column of integers is taken as the rows' sizes.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        own = batch.column(column)
        sizes = pc.fill_null(own if pa.types.is_integer(own.type) else pc.binary_length(own), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only a session without other machines may leave it unset, as in tests: it
    gets a temporary folder. On a cluster such a folder would not be shared, so
    that is an error.
    """
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="checkpoints-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: survives lost executors and ends the lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes a table under the shared folder and reads it again; and its path."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table under the shared folder and reads it again."""
    return stored_at(df, name)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Removes a table that stored_at() has written and nothing reads any more."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def under_plain_names(docs: DataFrame, used: tuple[str, ...], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``work`` makes of rows whose columns, but for those used, have names of their own; the names come back afterwards.

    So neither dots in a name nor names that the work itself uses can clash.
    """
    plain = [c if c in used else f"_c{i}" for i, c in enumerate(docs.columns)]
    return work(docs.toDF(*plain)).select(*plain).toDF(*docs.columns)


def rows_of(df: DataFrame) -> int:
    """The number of rows, as an action."""
    return df.count()
