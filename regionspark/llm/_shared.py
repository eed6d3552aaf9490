"""Folder and file helpers shared by the training-data operators.

Everything an operator keeps between jobs lives in the folder the cluster names in
``spark.checkpoint.dir``. Files are written under a temporary name and renamed, so a retried or
speculative task replaces a file by an identical one.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, NullType, ShortType


def shared_root(spark: SparkSession) -> str:
    """URI of the shared folder; where the setting is missing (tests), a local one is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "regionspark-shared")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder URI below the shared root."""
    return f"{shared_root(spark)}/regionspark/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it again."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _fs(uri: str):
    from pyarrow import fs

    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_bytes(uri: str, *parts) -> None:
    """Write buffers to one file, atomically."""
    fs, path = _fs(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    tmp = f"{os.path.dirname(path)}/.{uuid.uuid4().hex}"
    with fs.open_output_stream(tmp) as out:
        for part in parts:
            out.write(part)
    fs.move(tmp, path)


def read_bytes(uri: str) -> bytes:
    fs, path = _fs(uri)
    with fs.open_input_stream(path) as f:
        return f.read()


def open_array(uri: str, dtype: str) -> np.ndarray:
    """Memory-map an array file; from a store that can't be mapped, read it instead."""
    if uri.startswith(("/", "file:")):
        path = "/" + uri.removeprefix("file:").lstrip("/")
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.empty(0, dtype)
    return np.frombuffer(read_bytes(uri), dtype)


def whole_id(df: DataFrame, key: str) -> Column:
    """The id column as a long; ids of other types are refused, as casting them would change or lose some."""
    kind = df.schema[key].dataType
    if not isinstance(kind, ByteType | ShortType | IntegerType | LongType | NullType):
        raise TypeError(f"column {key} must hold whole numbers (byte to long), not {kind.simpleString()}")
    return F.col(key).cast("long")


#: A table of at most so many rows is broadcast.
BROADCAST_ROWS = 10_000


def skew_join(big: DataFrame, small: DataFrame, on: str, rows: str, how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """Join ``small``, one row for each value of ``on``, to ``big``; column ``rows`` of ``small`` tells
    about how many rows of ``big`` have the value. A table of ``most`` rows is broadcast. Of a larger one, values
    that hold more than a fair share of a task are: as each has over 1 / (4 x partitions) of the
    rows, they are at most 4 x partitions. The rest is joined by a shuffle."""
    parts = shuffle_parts(big.sparkSession)
    n, total = small.agg(F.count(F.lit(1)), F.sum(rows)).first()
    if n <= most:
        return big.join(F.broadcast(small), on, how)
    hot = F.broadcast(small.filter(F.col(rows) * 4 * parts > total))
    rest = big.join(hot.select(on), on, "left_anti").join(small.filter(F.col(rows) * 4 * parts <= total), on, how)
    return big.join(hot, on).unionByName(rest)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def trimmed(run):
    """``run`` over a task's batches; what it freed then goes back to the system, as a Python worker lives on
    for later tasks and stages."""

    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
        if trim:
            trim(0)

    return whole
