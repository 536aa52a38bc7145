"""The three steps from files to features: bronze, silver, gold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgeline.functions import scalars as S
from forgeline.operators import profile, quality, reshape, timeline, windows
from forgeline.schemas import FLAGS, MEASURES, gold_columns
from forgeline.sources.scratch import materialized


def bronze_readings(raw: DataFrame, grain: str = "instant", tasks: int | None = None) -> DataFrame:
    """All raw rows with parse_ok and parse_ok_reason: row rules, then the duplicate rule among valid rows; ``tasks`` as in ``windows.dealt``."""
    return quality.reject_duplicates(quality.validate_telemetry(raw), grain, tasks=tasks)


def bronze_incidents(raw: DataFrame) -> DataFrame:
    return quality.validate_incidents(raw)


def typed_readings(bronze: DataFrame) -> DataFrame:
    """Valid rows: line_id, machine_id, observed_at and the measures."""
    values = {c: S.lenient_int(F.col(c)) if c == "pieces_produced" else S.lenient_double(F.col(c)) for c in MEASURES}
    return bronze.filter("parse_ok").select("line_id", S.identifier(F.col("machine_id")).alias("machine_id"), S.lenient_timestamp(F.col("timestamp")).alias("observed_at"), *[v.alias(c) for c, v in values.items()])


def silver_readings(readings: DataFrame, factor: float = 1.5, tasks: int | None = None) -> DataFrame:
    """Long form with unit and the flags missing, duplicate (all but the first line) and outlier (by sensor).

    A line has all sensors of its instant, so lines are compared before they become a row for each sensor; ``tasks`` as in ``windows.dealt``.
    """
    rows = quality.residual_duplicates(windows.dealt(readings, tasks, "machine_id", "observed_at"), ["machine_id", "observed_at"], "line_id")
    rows = reshape.to_long(rows, ["line_id", "machine_id", "observed_at", "is_duplicate"], keep_dealt=bool(tasks)).withColumn("is_missing", F.col("sensor_value").isNull())
    return profile.flag_outliers(rows, factor)


def operators(incidents: DataFrame) -> DataFrame:
    """(operator_key, operator_id, badge_hash), the first line of each key; a null key has no operator."""
    rows = incidents.withColumn("operator_key", S.operator_key(F.col("operator_name"))).filter("operator_key IS NOT NULL")
    first = quality.keep_first(rows, ["operator_key"], "line_id")
    return first.select("operator_key", F.hex(F.xxhash64("operator_key")).alias("operator_id"), S.badge_hash(F.col("operator_name"), F.col("operator_badge")).alias("badge_hash"))


def silver_incidents(bronze: DataFrame) -> DataFrame:
    """Valid incidents, typed, with operator instead of the name and the nine flags carried along."""
    known = operators(bronze)
    rows = bronze.filter("parse_ok").withColumn("operator_key", S.operator_key(F.col("operator_name"))).join(known, "operator_key", "left")
    severity = S.lenient_int(F.col("severity"))
    return rows.select(
        F.col("incident_id").alias("incident_code"), S.identifier(F.col("machine_id")).alias("machine_id"), "operator_id", S.date_and_time(F.col("date"), F.col("time")).alias("occurred_at"), severity.cast("short").alias("severity"),
        "shift", "comment", S.label_event(severity).alias("is_label_event"), *[S.lenient_int(F.col(f)).alias(f) for f in FLAGS],
    )


def wide_readings(silver: DataFrame) -> DataFrame:
    return reshape.to_wide(silver.filter("NOT is_missing AND NOT is_duplicate"), ["machine_id", "observed_at"])


def train_statistics(wide: DataFrame) -> DataFrame:
    """Mean and deviation of temperature and pressure by machine, over train rows only."""
    train = wide.filter("split_set = 'train'")
    return train.groupBy("machine_id").agg(*[f(c).alias(f"_{n}_{k}") for c, n in (("temperature_c", "temp"), ("pressure_bar", "pressure")) for k, f in (("mean", F.avg), ("std", F.stddev_samp))])


def gold(silver: DataFrame, incidents: DataFrame, batch: str = "batch", chunk_hours: int = windows.CHUNK_HOURS, chunk_rows: int = windows.CHUNK_ROWS) -> DataFrame:
    """The feature table: 78 columns, one row for each machine and instant.

    The wide readings feed the features, the cuts and the train statistics, so they are written once, and the cuts are, as two branches read them. Differences go by chunks of rows, everything
    else by chunks of time, in one exchange of the whole rows, in tasks that do not grow with the table; the cuts are one row and the train statistics one row a
    machine, which the rows meet before the time line makes them wide.
    """
    wide = materialized(wide_readings(silver), "wide")
    tasks = windows.tasks_for(wide)
    cuts = materialized(reshape.cut_points(wide, "observed_at", tasks=tasks), "cuts")
    known = train_statistics(reshape.with_split(wide, "observed_at", cuts))
    rows = windows.differences(windows.hour_aggregates(wide), chunk_rows, tasks).join(known, "machine_id", "left")
    rows = timeline.features(rows, incidents, chunk_hours=chunk_hours, beside=tuple(c for c in known.columns if c != "machine_id"), places=wide, tasks=tasks)
    rows = reshape.with_split(rows, "observed_at", cuts)
    scores = {}
    for c, n in (("temperature_c", "temp"), ("pressure_bar", "pressure")):
        scores[f"{n}_zscore_24h"] = windows.z_score(F.col(c), F.col(f"{n}_mean_24h"), F.col(f"{n}_std_24h"))
        scores[f"{n}_zscore_machine"] = windows.z_score(F.col(c), F.col(f"_{n}_mean"), F.col(f"_{n}_std"))
    keys = {"ingestion_batch_id": F.lit(batch), "window_start": F.col("observed_at"), "window_end": F.col("observed_at") + F.expr("INTERVAL 1 HOUR")}
    return rows.withColumns(scores | keys).select(*gold_columns())
