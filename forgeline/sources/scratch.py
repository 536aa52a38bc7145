"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``.

    Where the session names none (local tests), a temporary folder is set for the session.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(base)
    if base.startswith("file:") and not base.startswith("file:///"):
        base = "file:///" + base[5:].lstrip("/")
    return f"{base}/{what}-{uuid.uuid4().hex}"


def materialized(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read again: what several branches of a plan use is computed once."""
    path = shared_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
