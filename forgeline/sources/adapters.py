"""Telemetry, incident, machine and maintenance tables from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forgeline.functions.scalars import shift_of
from forgeline.schemas import FLAGS, MACHINE, MAINTENANCE, MEASURES


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return df.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.regexp_extract("props", r'"k": *([0-9]+)', 1).cast("int"))


def readings(spark: SparkSession, sf_dir: str, hourly: bool = False) -> DataFrame:
    """line_id, machine_id, observed_at and the five measures, typed; ``hourly`` cuts the time to the hour."""
    k, at = F.col("k"), F.date_trunc("hour", "ts") if hourly else F.col("ts")
    return (
        _events(spark, sf_dir)
        .filter("event_type <> 'error'")
        .select(
            F.col("event_id").alias("line_id"),
            F.concat(F.lit("MACH-"), F.col("user_id")).alias("machine_id"),
            at.alias("observed_at"),
            F.when(k % 11 != 0, F.col("value") * 1.2).alias("temperature_c"),
            (k * 10.5).alias("pressure_bar"),
            (F.col("value") + k).alias("voltage_mean_v"),
            (F.col("value") * k).alias("rotation_mean_rpm"),
            (k - 1).alias("pieces_produced"),
            k.alias("_k"),
        )
    )


def raw_readings(spark: SparkSession, sf_dir: str, hourly: bool = False) -> DataFrame:
    """The readings as a file has them: all text, identifiers in mixed case and padded."""
    df = readings(spark, sf_dir, hourly)
    name = F.when(F.col("_k") % 2 == 1, F.concat(F.lit("  "), F.lower("machine_id"), F.lit(" "))).otherwise(F.col("machine_id"))
    return df.select("line_id", name.alias("machine_id"), F.date_format("observed_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"), *[F.col(c).cast("string").alias(c) for c in MEASURES])


def raw_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The incidents as a file has them, with the line number."""
    k, at = F.col("k"), F.col("ts")
    flags = [F.when((k == 98) & F.lit(i == 0), 2).when(k % 9 == i, 1).otherwise(0).cast("string").alias(f) for i, f in enumerate(FLAGS)]
    return (
        _events(spark, sf_dir)
        .filter("event_type = 'error'")
        .select(
            F.col("event_id").alias("line_id"),
            F.concat(F.lit("INC-"), F.col("event_id")).alias("incident_id"),
            F.date_format(at, "yyyy-MM-dd").alias("date"),
            F.date_format(at, "HH:mm").alias("time"),
            F.concat(F.lit("Op "), k % 20).alias("operator_name"),
            F.concat(F.lit("B"), k % 20).alias("operator_badge"),
            F.concat(F.lit("MACH-"), F.col("user_id")).alias("machine_id"),
            (k % 7).cast("string").alias("severity"),
            shift_of(at).alias("shift"),
            *flags,
            F.when(k % 3 != 0, F.concat(F.lit("note "), k)).alias("comment"),
        )
    )


def machines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    key = F.col("c_custkey")
    return c.select(
        F.concat(F.lit("MACH-"), key).alias("machine_code"),
        (F.lit(500) + key).cast("int").alias("max_daily_capacity"),
        F.element_at(F.array(F.lit("LOW"), F.lit("MEDIUM"), F.lit("HIGH")), (key % 3 + 1).cast("int")).alias("criticality"),
        F.col("c_nationkey").cast("string").alias("location"),
    )


def maintenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _events(spark, sf_dir)
        .filter("event_type = 'signup' AND k % 2 = 0")
        .select(F.col("event_id").cast("int").alias("maintenance_id"), F.concat(F.lit("MACH-"), F.col("user_id")).alias("machine_code"), F.col("ts").alias("maintenance_at"), F.lit("proactive").alias("maintenance_type"))
    )


def machine_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of ``MACHINE``."""
    key = F.col("c_custkey")
    daily = (F.lit(500) + key).cast("int")
    columns = {
        "machine_code": F.concat(F.lit("MACH-"), key),
        "commissioning_date": F.date_add(F.lit("2019-01-01").cast("date"), (key % 2000).cast("int")),
        "max_daily_capacity": daily,
        "max_hourly_capacity_pieces": F.floor(daily / 16).cast("int"),
        "model": F.col("c_mktsegment"),
        "production_line": F.concat(F.lit("Ligne-"), F.element_at(F.array(*map(F.lit, "ABC")), (key % 3 + 1).cast("int"))),
        "location": F.concat(F.lit("Atelier-"), F.col("c_nationkey")),
        "criticality": F.element_at(F.array(F.lit("LOW"), F.lit("MEDIUM"), F.lit("HIGH")), (key % 3 + 1).cast("int")),
        "is_active": F.col("c_acctbal") >= 0,
        "created_at": F.lit("2024-01-01").cast("timestamp"),
        "updated_at": F.when(key % 5 != 0, F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=(key % 24).cast("int"))),
    }
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(*[columns[f.name].cast(f.dataType).alias(f.name) for f in MACHINE])


def maintenance_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of ``MAINTENANCE``: proactive ones, and reactive ones that follow an incident."""
    k, reactive = F.col("k"), F.col("k") % 4 == 0
    columns = {
        "maintenance_id": F.col("event_id"),
        "machine_code": F.concat(F.lit("MACH-"), F.col("user_id")),
        "maintenance_at": F.col("ts"),
        "maintenance_type": F.when(reactive, "reactive").otherwise("proactive"),
        "action_type": F.when(reactive, "reparation").otherwise("changement_programme"),
        "component": F.concat(F.lit("capteur "), k % 5),
        "description": F.when(k % 3 != 0, F.concat(F.lit("Remplacement, "), k)),
        "related_incident_id": F.when(reactive, F.concat(F.lit("INC-"), F.col("event_id") - 1)),
        "duration_hours": F.col("k").cast("decimal(6,2)") / 8,
        "created_at": F.col("ts"),
        "updated_at": F.lit(None),
    }
    rows = _events(spark, sf_dir).filter("event_type = 'signup' AND k % 2 = 0")
    return rows.select(*[columns[f.name].cast(f.dataType).alias(f.name) for f in MAINTENANCE])
