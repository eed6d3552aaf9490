"""Cutting lineage in a way that outlives a lost executor."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder named by ``spark.checkpoint.dir`` and read it from there. Where
    the setting is missing (tests on one machine), a local folder is used. How rows are dealt is kept."""
    _folder(df)
    return df.checkpoint()


def store(df: DataFrame) -> DataFrame:
    """The same as compressed columns: for large tables; how rows are dealt is lost."""
    path = f"{_folder(df)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _folder(df: DataFrame) -> str:
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            root = "file://" + os.path.join(tempfile.gettempdir(), "regionspark-checkpoints")
        spark.sparkContext.setCheckpointDir(root)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()
