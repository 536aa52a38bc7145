"""Column lists and types of the telemetry and incident tables."""

from __future__ import annotations

from pyspark.sql import types as T

#: Sensors as (reading column, sensor type, unit).
SENSORS = (
    ("temperature_c", "temperature", "°C"),
    ("pressure_bar", "pressure", "bar"),
    ("voltage_mean_v", "voltage", "V"),
    ("rotation_mean_rpm", "rotation", "RPM"),
    ("pieces_produced", "pieces", "pcs"),
)
#: Incident type flags.
FLAGS = (
    "type_surchauffe",
    "type_baisse_pression",
    "type_vibration",
    "type_bruit_mecanique",
    "type_surconsommation",
    "type_blocage_mecanique",
    "type_alarme_capteur",
    "type_arret_urgence",
    "type_defaut_qualite",
)
#: Shifts in their order.
SHIFTS = ("matin", "apres-midi", "nuit")
#: Horizons of failure labels, in hours.
HORIZONS = (6, 12, 24, 48)
WINDOWS = (6, 12, 24)

MEASURES = tuple(c for c, _, _ in SENSORS)
#: The columns of the raw files.
TELEMETRY = ("machine_id", "timestamp", *MEASURES)
INCIDENTS = ("incident_id", "date", "time", "operator_name", "operator_badge", "machine_id", "severity", "shift", *FLAGS, "comment")


def all_strings(columns: tuple[str, ...]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


MACHINE = T.StructType(
    [
        T.StructField("machine_code", T.StringType(), False),
        T.StructField("commissioning_date", T.DateType()),
        T.StructField("max_daily_capacity", T.IntegerType()),
        T.StructField("max_hourly_capacity_pieces", T.IntegerType()),
        T.StructField("model", T.StringType()),
        T.StructField("production_line", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("criticality", T.StringType()),
        T.StructField("is_active", T.BooleanType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

MAINTENANCE = T.StructType(
    [
        T.StructField("maintenance_id", T.IntegerType(), False),
        T.StructField("machine_code", T.StringType()),
        T.StructField("maintenance_at", T.TimestampType()),
        T.StructField("maintenance_type", T.StringType()),
        T.StructField("action_type", T.StringType()),
        T.StructField("component", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("related_incident_id", T.StringType()),
        T.StructField("duration_hours", T.DecimalType(6, 2)),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)


def gold_columns() -> list[str]:
    """The gold table's 78 columns in order: keys, hour, rolling, trends, z-scores, production, incidents, labels."""
    short, two = ("temp", "pressure", "voltage", "rotation"), ("temp", "pressure")
    keys = ["ingestion_batch_id", "machine_id", "window_start", "window_end", "split_set"]
    hour = [f"{s}_{f}_1h" for s in two for f in ("mean", "max", "std")] + ["voltage_mean_1h", "rotation_mean_1h", "pieces_produced_sum_1h"]
    rolling = [f"{s}_{f}_{w}h" for w in WINDOWS for s in short for f in (("mean", "max", "std") if s in two else ("mean", "std"))]
    trends = [f"{s}_{t}" for s in short for t in ("delta_1h", "delta_3h", "trend_6h")]
    scores = [f"{s}_zscore_{k}" for s in two for k in ("24h", "machine")] + ["pieces_produced_sum_24h"]
    incidents = ["incident_count_prev_24h", "incident_max_severity_prev_24h", "incident_count_prev_7d", "hours_since_last_incident", *(f"{f}_count_prev_24h" for f in FLAGS)]
    return keys + hour + rolling + trends + scores + incidents + [f"label_failure_next_{h}h" for h in HORIZONS]
