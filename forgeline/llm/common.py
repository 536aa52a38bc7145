"""Helpers that the training-data operators share. ``shared_dir`` stands in the base library too: either works without the other."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space between words, as the word rules of these operators have it.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which driver and executors share.

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


def saved(df: DataFrame, what: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there, on replicated storage."""
    path = path or shared_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession, "none")  # sets a folder where there is none
    return df.checkpoint()


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def prefix_sums(df: DataFrame, position: str, sums: dict[str, str], chunk: int = 1024) -> DataFrame:
    """Exclusive running sums over the whole integer ``position`` (unique, from 0), in two levels.

    ``sums`` maps a new column to the summed one. Rows are summed by chunks of ``chunk`` positions, the
    chunk sums run on alone, and each chunk adds its own start, so no task orders all rows.
    """
    rows = df.withColumn("_chunk", F.floor(F.col(position) / chunk))
    totals = rows.groupBy("_chunk").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_chunk", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in sums])
    inner = Window.partitionBy("_chunk").orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    running = rows.withColumns({n: F.coalesce(F.sum(c).over(inner), F.lit(0)) for n, c in sums.items()})
    return running.join(starts, "_chunk").withColumns({n: F.col(n) + F.col(f"_s_{n}") for n in sums}).drop("_chunk", *[f"_s_{n}" for n in sums])
