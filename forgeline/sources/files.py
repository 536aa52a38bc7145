"""CSV and parquet sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forgeline.functions.scalars import lenient_timestamp, null_tokens
from forgeline.schemas import all_strings


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV file with a header and a given schema: no pass over the data to infer one."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_strings(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """All columns as text, tokens for missing values as null; nothing is rejected or trimmed."""
    raw = spark.read.schema(all_strings(columns)).option("header", True).option("enforceSchema", False).csv(path)
    return raw.select(*[null_tokens(F.col(c)).alias(c) for c in columns])


def read_with_timestamp(spark: SparkSession, path: str, columns: tuple[str, ...], at: str = "timestamp") -> DataFrame:
    return read_strings(spark, path, columns).withColumn(at, lenient_timestamp(F.col(at)))


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, where: Column | str | None = None) -> DataFrame:
    """Chosen columns and rows of a parquet table; both reach the scan."""
    df = spark.read.parquet(path)
    df = df.filter(where) if where is not None else df
    return df.select(*columns) if columns else df


def write_versioned_csv(df: DataFrame, base: str, topic: str, run: str) -> str:
    """Write to base/topic/run and return that folder; times keep their microseconds."""
    path = f"{base}/{topic}/{run}"
    df.write.option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").csv(path)
    return path


def full_refresh(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def append(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows of ``old`` and ``new``, one for each key: new ones win, then the largest ``order``. Null keys are all kept."""
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    ranked = Window.partitionBy(*keys).orderBy(F.desc("_new"), *([F.desc_nulls_last(order)] if order else []))
    missing = F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
    return rows.withColumn("_rank", F.row_number().over(ranked)).filter((F.col("_rank") == 1) | missing).drop("_new", "_rank")
