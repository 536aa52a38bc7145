"""Tables that can be refreshed and upserted while others read them.

Rows lie in buckets by a hash of their keys. A change writes new folders, of the buckets with new keys only, and then a manifest that names the
folder of each bucket; the manifest's one file is put in place last, so a reader sees the table before or after a change and never between.
Readers that opened an older version keep its files until ``expire``. One writer at a time; a writer that is lost leaves files that
no manifest names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forgeline.sources.files import upsert as merged

BUCKET = "_bucket"
MANIFEST = "version int, buckets int, bucket int, folder string, schema string"


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def manifest(spark: SparkSession, path: str, version: int | None = None) -> list:
    """The rows of a version, the latest by default: a row a bucket, and one without a bucket that holds the schema."""
    rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    version = rows.agg(F.max("version")).first()[0] if version is None else version
    found = rows.filter(F.col("version") == version).collect()  # a row a bucket
    if not found:
        raise ValueError(f"no version {version} at {path}")
    return found


def _of(spark: SparkSession, rows: list) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(rows[0]["schema"]))
    folders = [f"{r['folder']}/{BUCKET}={r['bucket']}" for r in rows if r["bucket"] is not None]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    return _of(spark, manifest(spark, path, version))


def _put(df: DataFrame, path: str, keys: list[str], buckets: int, version: int, untouched: list) -> list[int]:
    """Write ``df``'s buckets and then the manifest that names them beside the untouched ones; returns the buckets written."""
    spark, folder = df.sparkSession, f"{path}/data/{uuid.uuid4().hex}"
    df.withColumn(BUCKET, bucket_of(keys, buckets)).repartition(BUCKET).write.partitionBy(BUCKET).parquet(folder)
    written = sorted(r[0] for r in spark.read.schema(f"{BUCKET} int").parquet(folder).select(BUCKET).distinct().collect())
    schema = df.schema.json()
    rows = [(version, buckets, None, None, schema)] + [(version, buckets, b, folder, schema) for b in written] + [(version, buckets, r["bucket"], r["folder"], schema) for r in untouched]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return written


def create(df: DataFrame, path: str, keys: list[str], buckets: int = 16) -> None:
    """The first version of a table at ``path``, which holds none yet."""
    _put(df, path, keys, buckets, 1, [])


def refresh(df: DataFrame, path: str, keys: list[str]) -> None:
    """All rows replaced by those of ``df``."""
    now = manifest(df.sparkSession, path)
    _put(df, path, keys, now[0]["buckets"], now[0]["version"] + 1, [])


def upsert(new: DataFrame, path: str, keys: list[str], order: str | None = None) -> list[int]:
    """``new`` put in, one row for each key: new ones win, then the largest ``order``; null keys are all kept. Returns the buckets rewritten."""
    spark, now = new.sparkSession, manifest(new.sparkSession, path)
    buckets = now[0]["buckets"]
    touched = {r[0] for r in new.select(bucket_of(keys, buckets)).distinct().collect()}  # the buckets at most
    if not touched:
        return []
    old = _of(spark, [r for r in now if r["bucket"] is None or r["bucket"] in touched])
    return _put(merged(old, new, keys, order), path, keys, buckets, now[0]["version"] + 1, [r for r in now if r["bucket"] is not None and r["bucket"] not in touched])


def expire(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete data that none of the last ``keep`` versions names; returns the number of folders deleted."""
    rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    latest = rows.agg(F.max("version")).first()[0]
    named = {r["folder"].rpartition("/")[2] for r in rows.filter((F.col("version") > latest - keep) & F.col("folder").isNotNull()).select("folder").distinct().collect()}
    data = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/data")
    system = data.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = [s.getPath() for s in system.listStatus(data) if s.getPath().getName() not in named]
    return sum(bool(system.delete(p, True)) for p in gone)
