"""Registered queries of the telemetry and incident operators, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forgeline.functions import scalars as S
from forgeline.operators import modelling, profile, quality, reshape, timeline, windows
from forgeline.plans import base_sql as B
from forgeline.plans import medallion as M
from forgeline.schemas import FLAGS, HORIZONS, MACHINE, MAINTENANCE, MEASURES, TELEMETRY, gold_columns
from forgeline.sources import adapters, files, versioned
from forgeline.sources.scratch import materialized, shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: Measures that are numbers with a fraction.
FLOATS = MEASURES[:-1]
SALT = "salt"
OFF = 1.3e-8


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = off_ties(sql)
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of additions does not show; ``OFF`` moves them off exact ties first."""
    return df.withColumns({c: F.round(F.col(c) + OFF, digits) for c, kind in df.dtypes if kind == "double"})


def off_ties(sql: str) -> str:
    """``sql`` with ``OFF`` added to what each round() takes, as ``rounded`` does."""
    out, at = [], 0
    while (k := sql.find("round(", at)) >= 0:
        depth, comma, j = 1, 0, k + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            comma = j if sql[j] == "," and depth == 1 else comma
            j += 1
        out += [sql[at : k + 6], off_ties(sql[k + 6 : comma]), f" + {OFF}::DOUBLE"]
        at = comma
    return "".join(out) + sql[at:]


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.readings(spark, sf_dir).drop("_k")


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver incidents. Both steps are written once: else the rules' text parsing is repeated in each condition and branch that uses it."""
    bronze = materialized(M.bronze_incidents(adapters.raw_incidents(spark, sf_dir)), "bronze-incidents")
    return materialized(M.silver_incidents(bronze), "silver-incidents")


def bronze_readings(spark: SparkSession, sf_dir: str, grain: str = "instant") -> DataFrame:
    """Bronze readings, in tasks that do not grow with the table."""
    raw = adapters.raw_readings(spark, sf_dir)
    return M.bronze_readings(raw, grain, windows.tasks_for(raw))


def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver readings; the valid ones are written once, as quartiles and flags both read them."""
    typed = materialized(M.typed_readings(bronze_readings(spark, sf_dir)), "typed")
    return M.silver_readings(typed, tasks=windows.tasks_for(typed))


RD = f"WITH {B.EVENTS}, {B.READINGS}"
IC = f"WITH {B.EVENTS}, {B.INCIDENTS}"
BOTH = f"WITH {B.EVENTS}, {B.READINGS}, {B.INCIDENTS}"
BZ = f"WITH {B.bronze()}"
SL = f"WITH {B.bronze()}, {B.silver()}"
SI = f"{SL}, {B.INCIDENTS}"


def rnd(*columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}::DOUBLE, {digits}) AS {c}" for c in columns)


# --- sources and sinks -------------------------------------------------------------------------------------------


@query(f"{RD} SELECT line_id, machine_id, observed_at, {rnd(*FLOATS)}, pieces_produced FROM rd")
def s_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings written as a versioned CSV file, read as text, tokens to null, then typed."""
    raw = adapters.raw_readings(spark, sf_dir)
    path = files.write_versioned_csv(raw.withColumn("temperature_c", F.coalesce("temperature_c", F.lit("NA"))), shared_dir(spark, "ingestions"), "telemetry", "202401010000")
    back = files.read_with_timestamp(spark, path, ("line_id", *TELEMETRY))
    typed = back.select(F.col("line_id").cast("long").alias("line_id"), S.identifier(F.col("machine_id")).alias("machine_id"), F.col("timestamp").alias("observed_at"), *[S.lenient_double(F.col(c)).alias(c) for c in FLOATS], S.lenient_int(F.col("pieces_produced")).alias("pieces_produced"))
    return rounded(typed)


@query(f"{BZ} SELECT line_id, machine_id, observed_at FROM bz WHERE parse_ok")
def s_table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze refreshed in full as a versioned table, then scanned with filter and projection."""
    path = shared_dir(spark, "bronze")
    bronze = bronze_readings(spark, sf_dir).drop("errors")
    versioned.create(bronze.filter("line_id % 2 = 0"), path, ["line_id"])
    versioned.refresh(bronze, path, ["line_id"])
    rows = versioned.read(spark, path).filter("parse_ok").select("line_id", "machine_id", "timestamp")
    return rows.select("line_id", S.identifier(F.col("machine_id")).alias("machine_id"), S.lenient_timestamp(F.col("timestamp")).alias("observed_at"))


@query(f"{SL} SELECT sensor_type, count(*) AS n FROM sl WHERE NOT is_missing AND NOT is_duplicate GROUP BY sensor_type")
def s_table_conjunction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver scanned with projection and two conditions."""
    path = shared_dir(spark, "silver")
    files.full_refresh(silver(spark, sf_dir), path, ["sensor_type"])
    return profile.counts(files.read_table(spark, path, ["machine_id", "sensor_type", "sensor_value"], "is_missing = false AND is_duplicate = false"), "sensor_type")


@query(f"{BZ}, {B.INCIDENTS}, a AS (SELECT 'telemetry' AS dataset_name, count(*) AS n FROM bz WHERE NOT parse_ok UNION ALL SELECT 'incidents', count(*) FROM ir WHERE line_id NOT IN (SELECT line_id FROM ic)) SELECT * FROM a WHERE n > 0")
def s_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of both datasets appended to one table."""
    path = shared_dir(spark, "issues")
    files.append(quality.issues(bronze_readings(spark, sf_dir), "telemetry", "b1", F.col("machine_id")), path, ["ingestion_batch_id"])
    files.append(quality.issues(M.bronze_incidents(adapters.raw_incidents(spark, sf_dir)), "incidents", "b2", F.col("incident_id")), path, ["ingestion_batch_id"])
    return profile.counts(files.read_table(spark, path), "dataset_name")


@query(f"{RD} SELECT machine_id, max_by(line_id, observed_at) AS line_id, max(observed_at) AS observed_at FROM rd GROUP BY machine_id")
def s_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last reading of each machine, upserted in two batches by time."""
    rows = readings(spark, sf_dir).select("machine_id", "line_id", "observed_at")
    half, path = F.lit("2024-01-15").cast("timestamp"), shared_dir(spark, "last-readings")
    versioned.create(rows.limit(0), path, ["machine_id"])
    for batch in (F.col("observed_at") < half, F.col("observed_at") >= half):
        versioned.upsert(rows.filter(batch), path, ["machine_id"], "observed_at")
    return versioned.read(spark, path)


@query("SELECT 'MACH-' || c_custkey AS machine_code, (500 + c_custkey)::INT AS max_daily_capacity, ['LOW', 'MEDIUM', 'HIGH'][c_custkey % 3 + 1] AS criticality, c_nationkey::VARCHAR AS location FROM customer")
def s_machines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The machine dimension."""
    return adapters.machines(spark, sf_dir)


def _through_csv(spark: SparkSession, df: DataFrame, topic: str) -> DataFrame:
    """``df`` written as CSV with a header and loaded with its schema."""
    return files.read_csv(spark, files.write_versioned_csv(df, shared_dir(spark, "reference"), topic, "202401010000"), MACHINE if topic == "machine" else MAINTENANCE)


@query("""SELECT 'MACH-' || c_custkey AS machine_code, DATE '2019-01-01' + (c_custkey % 2000)::INT AS commissioning_date, (500 + c_custkey)::INT AS max_daily_capacity, ((500 + c_custkey) // 16)::INT AS max_hourly_capacity_pieces,
c_mktsegment AS model, 'Ligne-' || ['A', 'B', 'C'][c_custkey % 3 + 1] AS production_line, 'Atelier-' || c_nationkey AS location, ['LOW', 'MEDIUM', 'HIGH'][c_custkey % 3 + 1] AS criticality, c_acctbal >= 0 AS is_active,
TIMESTAMP '2024-01-01' AS created_at, CASE WHEN c_custkey % 5 <> 0 THEN TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (c_custkey % 24) END AS updated_at FROM customer""")
def s_machine_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The machine dimension with all its columns, loaded from CSV."""
    return _through_csv(spark, adapters.machine_dimension(spark, sf_dir), "machine")


@query(f"""WITH {B.EVENTS} SELECT event_id::INT AS maintenance_id, 'MACH-' || user_id AS machine_code, ts AS maintenance_at, CASE WHEN k % 4 = 0 THEN 'reactive' ELSE 'proactive' END AS maintenance_type,
CASE WHEN k % 4 = 0 THEN 'reparation' ELSE 'changement_programme' END AS action_type, 'capteur ' || (k % 5) AS component, CASE WHEN k % 3 <> 0 THEN 'Remplacement, ' || k END AS description,
CASE WHEN k % 4 = 0 THEN 'INC-' || (event_id - 1) END AS related_incident_id, (k * 125::BIGINT / 1000)::DECIMAL(6, 2) AS duration_hours, ts AS created_at, NULL::TIMESTAMP AS updated_at FROM ev WHERE event_type = 'signup' AND k % 2 = 0""")
def s_maintenance_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maintenance log with all its columns, loaded from CSV."""
    return _through_csv(spark, adapters.maintenance_log(spark, sf_dir), "maintenance")


@query(f"{SL}, {B.CUTS} SELECT CASE WHEN observed_at < cut_1 THEN 'train' WHEN observed_at < cut_2 THEN 'validation' ELSE 'test' END AS split_set, count(*) AS n, count(DISTINCT machine_id) AS machines FROM wd, ct GROUP BY 1")
def s_gold_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table written by split and read again."""
    path = shared_dir(spark, "gold")
    files.full_refresh(gold_table(spark, sf_dir), path, ["split_set"])
    return files.read_table(spark, path).groupBy("split_set").agg(F.count("*").alias("n"), F.count_distinct("machine_id").alias("machines"))


# --- projection, filters, typing ---------------------------------------------------------------------------------


@query("SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN o_orderkey::INT WHEN 1 THEN (o_orderkey)::INT WHEN 2 THEN o_orderkey::INT END AS i, CASE WHEN o_orderkey % 7 IN (0, 1, 2) THEN o_orderkey::DOUBLE WHEN o_orderkey % 7 = 3 THEN o_orderkey + 0.5::DOUBLE WHEN o_orderkey % 7 = 4 THEN 1000.0::DOUBLE END AS d FROM orders")
def p_lenient_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as text in seven spellings."""
    key = F.col("o_orderkey").cast("string")
    text = F.element_at(F.array(F.concat(key, F.lit(".0")), F.concat(F.lit(" +"), key, F.lit(" ")), key, F.concat(key, F.lit(".5")), F.lit("1e3"), F.lit("1,5"), F.lit("nan")), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", S.lenient_int(text).alias("i"), S.lenient_double(text).alias("d"))


@query(f"{IC} SELECT incident_id, CASE WHEN k % 5 <> 0 THEN occurred_at END AS occurred_at FROM ir")
def p_date_and_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date and time joined and parsed; every fifth k has a malformed time."""
    raw = adapters.raw_incidents(spark, sf_dir)
    k = F.regexp_extract("operator_name", r"(\d+)$", 1).cast("int") % 5
    return raw.select("incident_id", S.date_and_time(F.concat(F.lit(" "), "date"), F.when(k == 0, F.lit("25:99")).otherwise(F.col("time"))).alias("occurred_at"))


@query(f"{RD} SELECT line_id, machine_id, pieces_produced = 0 AS stopped, coalesce(temperature_c > 400, false) OR coalesce(pressure_bar > 1000, false) AS hot_or_tight, CASE WHEN pieces_produced % 2 = 0 THEN 'MACH' END AS note, observed_at + INTERVAL 1 HOUR AS window_end, round_even(temperature_c, 2) AS temperature_c FROM rd")
def p_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers, blanks, flags, window ends, rounding with ties to even."""
    raw = adapters.raw_readings(spark, sf_dir)
    temperature, pressure, pieces = S.lenient_double(F.col("temperature_c")), S.lenient_double(F.col("pressure_bar")), S.lenient_int(F.col("pieces_produced"))
    return raw.select(
        "line_id", S.identifier(F.col("machine_id")).alias("machine_id"), S.stopped(pieces).alias("stopped"), S.any_of(temperature > 400, pressure > 1000).alias("hot_or_tight"),
        S.blank_to_null(F.when(pieces % 2 == 0, " MACH ").otherwise("  ")).alias("note"), (S.lenient_timestamp(F.col("timestamp")) + F.expr("INTERVAL 1 HOUR")).alias("window_end"), F.bround(temperature, 2).alias("temperature_c"),
    )


@query(f"{IC} SELECT is_label_event, count(*) AS n FROM ic GROUP BY 1")
def p_label_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label events among valid incidents."""
    return profile.counts(incidents(spark, sf_dir), "is_label_event")


@query(f"{SL} SELECT line_id, sensor_type, {rnd('sensor_value')}, unit FROM lf")
def p_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid readings in long form."""
    rows = M.typed_readings(bronze_readings(spark, sf_dir))
    return rounded(reshape.to_long(rows, ["line_id"]))


@query(f"{SL} SELECT machine_id, observed_at, {rnd(*MEASURES)} FROM wd")
def p_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver in wide form again."""
    return rounded(M.wide_readings(silver(spark, sf_dir)))


@query(f"{IC} SELECT year(occurred_at)::VARCHAR || '-W' || lpad(weekofyear(occurred_at)::VARCHAR, 2, '0') AS week, " + ", ".join(f'count(*) FILTER (WHERE severity = {s}) AS "{s}"' for s in range(1, 6)) + " FROM ic GROUP BY 1")
def p_unstack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severities by week as columns."""
    rows = incidents(spark, sf_dir).select(S.week_label(F.col("occurred_at")).alias("week"), "severity")
    return reshape.unstack_counts(rows, "week", "severity", [1, 2, 3, 4, 5])


# --- quality -----------------------------------------------------------------------------------------------------


@query(f"{BZ} SELECT line_id, reason IS NULL AS parse_ok, reason AS parse_ok_reason FROM bz")
def q_telemetry_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row rules of readings with all reasons (Q1, Q2, Q4)."""
    return quality.validate_telemetry(adapters.raw_readings(spark, sf_dir)).select("line_id", "parse_ok", "parse_ok_reason")


@query(f"{IC} SELECT line_id, nullif(concat_ws(' | ', CASE WHEN severity NOT BETWEEN 1 AND 5 THEN 'severity:RANGE' END, CASE WHEN type_surchauffe > 1 THEN 'type_surchauffe:RANGE' END), '') AS parse_ok_reason FROM ir")
def q_incident_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row rules of incidents with all reasons (Q3, Q4)."""
    return quality.validate_incidents(adapters.raw_incidents(spark, sf_dir)).select("line_id", "parse_ok_reason")


@query(f"WITH {B.bronze(True)} SELECT line_id, parse_ok, parse_ok_reason FROM bz")
def q_duplicate_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All copies of a machine's hour rejected, with their number."""
    return bronze_readings(spark, sf_dir, "hour").select("line_id", "parse_ok", "parse_ok_reason")


@query(f"WITH {B.bronze(True)} SELECT CASE WHEN reason IS NULL THEN 'DOUBLON_HORAIRE' ELSE 'VALIDATION' END AS rule_code, CASE WHEN reason IS NULL THEN 'WARNING' ELSE 'ERROR' END AS severity, machine_id || '|' || line_id AS entity_key, parse_ok_reason AS details, 'telemetry' AS dataset_name, 'b1' AS ingestion_batch_id FROM bz WHERE NOT parse_ok")
def q_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An issue for each rejected reading (Q6)."""
    bad = bronze_readings(spark, sf_dir, "hour")
    return quality.issues(bad, "telemetry", "b1", F.concat_ws("|", S.identifier(F.col("machine_id")), "line_id"))


@query(f"{IC}, a AS (SELECT operator_name, count(*) AS n FROM ir GROUP BY 1 HAVING count(*) > 1), b AS (SELECT incident_id FROM ir WHERE machine_id NOT IN (SELECT 'MACH-' || c_custkey FROM customer WHERE c_custkey % 2 = 0)) SELECT 'operator_name' AS rule, count(*) AS violations FROM a UNION ALL SELECT 'machine', count(*) FROM b UNION ALL SELECT 'severity', count(*) FROM ir WHERE NOT severity BETWEEN 1 AND 5 UNION ALL SELECT 'shift', 0")
def q_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uniqueness, reference and domain checks as counts (Q7, Q8, Q9)."""
    raw, known = adapters.raw_incidents(spark, sf_dir), adapters.machines(spark, sf_dir).filter(F.substring_index("machine_code", "-", -1).cast("long") % 2 == 0)
    named = lambda df, rule: df.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations")
    domains = quality.domain_violations(raw, {"severity": S.lenient_int(F.col("severity")).between(1, 5), "shift": F.col("shift").isin("matin", "apres-midi", "nuit")})
    return named(quality.repeated_keys(raw, "operator_name"), "operator_name").union(named(quality.orphans(raw, "machine_id", known, "machine_code"), "machine")).union(domains)


@query(f"{SL} SELECT line_id, sensor_type, is_missing, is_duplicate, is_outlier FROM sl")
def q_silver_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing, residual duplicate and outlier flags of silver."""
    return silver(spark, sf_dir).select("line_id", "sensor_type", "is_missing", "is_duplicate", "is_outlier")


@query(f"{BZ}, {B.INCIDENTS} SELECT 'b1' AS ingestion_batch_id, 'telemetry' AS source_name, count(*) AS rows_read, count(*) FILTER (WHERE parse_ok) AS rows_loaded, count(*) FILTER (WHERE NOT parse_ok) AS rows_rejected, CASE WHEN count(*) = count(*) FILTER (WHERE parse_ok) THEN 'SUCCESS' ELSE 'PARTIAL' END AS status FROM bz UNION ALL SELECT 'b1', 'incidents', count(*), (SELECT count(*) FROM ic), count(*) - (SELECT count(*) FROM ic), CASE WHEN count(*) = (SELECT count(*) FROM ic) THEN 'SUCCESS' ELSE 'PARTIAL' END FROM ir")
def q_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch log of both sources (Q12)."""
    a = quality.batch_log(bronze_readings(spark, sf_dir), "b1", "telemetry", F.col("parse_ok"))
    return a.union(quality.batch_log(M.bronze_incidents(adapters.raw_incidents(spark, sf_dir)), "b1", "incidents", F.col("parse_ok")))


@query(f"{RD} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(*) AS total FROM rd" for c in MEASURES))
def q_null_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls of each measure (Q13)."""
    return quality.null_profile(readings(spark, sf_dir), list(MEASURES))


@query(f"{BOTH}, a AS (SELECT DISTINCT machine_id FROM rd), b AS (SELECT DISTINCT machine_id FROM ic) SELECT (SELECT count(*) FROM a) AS in_a, (SELECT count(*) FROM b) AS in_b, (SELECT count(*) FROM a JOIN b USING (machine_id)) AS in_both")
def q_common_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Machines of readings and incidents."""
    return quality.common_keys(readings(spark, sf_dir), incidents(spark, sf_dir), "machine_id")


# --- joins -------------------------------------------------------------------------------------------------------


@query(f"{IC} SELECT incident_id AS incident_code, substr(sha256(lower(operator_name) || '|' || lower(operator_badge)), 1, 16) AS badge_hash, severity::SMALLINT AS severity FROM ic")
def j_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents with their operator by normalised name."""
    bronze = M.bronze_incidents(adapters.raw_incidents(spark, sf_dir))
    return M.silver_incidents(bronze).join(M.operators(bronze).select("operator_id", "badge_hash"), "operator_id", "left").select("incident_code", "badge_hash", "severity")


@query(f"{IC} SELECT incident_id AS incident_code, severity::SMALLINT AS severity, {', '.join(FLAGS)} FROM ic")
def j_incident_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver and bronze incidents on their code."""
    bronze = M.bronze_incidents(adapters.raw_incidents(spark, sf_dir))
    own = M.silver_incidents(bronze).select("incident_code", "severity")
    return own.join(bronze.select(F.col("incident_id").alias("incident_code"), *[S.lenient_int(F.col(f)).alias(f) for f in FLAGS]), "incident_code")


_PEAKS = f"""{BOTH}, hq AS (SELECT {", ".join(f"quantile_cont({c}, 0.9) AS q_{c}" for c in MEASURES)} FROM rd),
hf AS (SELECT machine_id, observed_at, {", ".join(f"coalesce(bool_or({c} > q_{c}), false) AS outlier_{c}" for c in MEASURES)} FROM rd, hq GROUP BY 1, 2), ho AS (SELECT * FROM hf WHERE {" OR ".join(f"outlier_{c}" for c in MEASURES)})"""
NEAR = f"""{_PEAKS}, nr AS (SELECT ho.*, ic.* EXCLUDE (machine_id), row_number() OVER (PARTITION BY ho.machine_id, ho.observed_at ORDER BY occurred_at, incident_id) AS rn FROM ho JOIN ic ON ho.machine_id = ic.machine_id
  AND abs(epoch_us(ho.observed_at) - epoch_us(occurred_at)) <= 86400000000), nn AS (SELECT * FROM nr WHERE rn = 1)"""
_EACH_NEAR = lambda table: " UNION ALL ".join(f"SELECT '{c}' AS sensor_type, * FROM {table} WHERE outlier_{c}" for c in MEASURES)


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants with any measure above its 0.9 quantile, written once."""
    return materialized(profile.sensor_peaks(readings(spark, sf_dir), list(MEASURES)), "peaks")


def matched(spark: SparkSession, sf_dir: str, flagged: DataFrame) -> DataFrame:
    """Flagged instants with the earliest incident within a day, their flags beside it."""
    found = incidents(spark, sf_dir).select("machine_id", "occurred_at", F.col("incident_code").alias("incident_id"), "severity", "shift", *FLAGS)
    return timeline.nearby_incidents(flagged, found).join(flagged, ["machine_id", "observed_at"])


@query(f"{NEAR} SELECT machine_id, observed_at, incident_id, occurred_at, {', '.join(f'outlier_{c}' for c in MEASURES)} FROM nn")
def j_nearby(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High readings of any measure with the earliest incident within a day, before or after."""
    return matched(spark, sf_dir, peaks(spark, sf_dir)).select("machine_id", "observed_at", "incident_id", "occurred_at", *[f"outlier_{c}" for c in MEASURES])


def _back(alias: str, span: str) -> str:
    return f"{alias}.machine_id = r.machine_id AND {alias}.occurred_at >= r.observed_at - INTERVAL {span} AND {alias}.occurred_at < r.observed_at"


@query(
    f"""{BOTH} SELECT line_id, (SELECT count(*) FROM ic WHERE {_back('ic', '24 HOUR')}) AS incident_count_prev_24h, (SELECT coalesce(max(severity), 0)::SMALLINT FROM ic WHERE {_back('ic', '24 HOUR')}) AS incident_max_severity_prev_24h,
  (SELECT count(*) FROM ic WHERE {_back('ic', '7 DAY')}) AS incident_count_prev_7d, round((SELECT (epoch_us(r.observed_at) - max(epoch_us(occurred_at))) / 3600000000.0::DOUBLE FROM ic WHERE ic.machine_id = r.machine_id AND ic.occurred_at < r.observed_at), 6) AS hours_since_last_incident,
  {', '.join(f"(SELECT coalesce(sum({f}), 0)::BIGINT FROM ic WHERE {_back('ic', '24 HOUR')}) AS {f}_count_prev_24h" for f in FLAGS)} FROM rd r"""
)
def j_lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents of the last day and week, and hours since the last one."""
    out = timeline.lookback(readings(spark, sf_dir), incidents(spark, sf_dir))
    names = ["incident_count_prev_24h", "incident_max_severity_prev_24h", "incident_count_prev_7d", "hours_since_last_incident", *[f"{f}_count_prev_24h" for f in FLAGS]]
    return rounded(out.select("line_id", *names)).withColumn("incident_max_severity_prev_24h", F.col("incident_max_severity_prev_24h").cast("short"))


@query(f"{BOTH} SELECT line_id, " + ", ".join(f"EXISTS (SELECT 1 FROM ic WHERE is_label_event AND ic.machine_id = r.machine_id AND occurred_at > r.observed_at AND occurred_at <= r.observed_at + INTERVAL {h} HOUR) AS label_failure_next_{h}h" for h in HORIZONS) + " FROM rd r")
def j_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label events within 6, 12, 24 and 48 hours after a reading."""
    out = timeline.labels(readings(spark, sf_dir), incidents(spark, sf_dir).filter("is_label_event"))
    return out.select("line_id", *[f"label_failure_next_{h}h" for h in HORIZONS])


@query(f"""{RD}, mt AS (SELECT 'MACH-' || user_id AS machine_id, ts AS done_at FROM ev WHERE event_type = 'signup' AND k % 2 = 0)
SELECT line_id, round((SELECT (epoch_us(r.observed_at) - max(epoch_us(done_at))) / 86400000000.0::DOUBLE FROM mt WHERE mt.machine_id = r.machine_id AND done_at < r.observed_at), 6) AS days_since_last_maintenance,
(SELECT count(*) FROM mt WHERE mt.machine_id = r.machine_id AND done_at < r.observed_at AND done_at >= r.observed_at - INTERVAL 30 DAY) AS maintenance_count_30d FROM rd r""")
def j_maintenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days since the last maintenance and its count over 30 days."""
    past = adapters.maintenance(spark, sf_dir).withColumnRenamed("machine_code", "machine_id")
    return rounded(timeline.maintenance_lookback(readings(spark, sf_dir), past).select("line_id", "days_since_last_maintenance", "maintenance_count_30d"))


# --- aggregations ------------------------------------------------------------------------------------------------


def _each(columns: tuple[str, ...], select: str, table: str = "rd") -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, {select.replace('$', c)} FROM {table}" for c in columns)


@query(f"{RD} " + _each(MEASURES, "count($) AS n, round(avg($), 4) AS mean, round(stddev_samp($), 4) AS std, round(min($)::DOUBLE, 4) AS min, round(quantile_cont($, 0.25)::DOUBLE, 4) AS q1, round(quantile_cont($, 0.5)::DOUBLE, 4) AS median, round(quantile_cont($, 0.75)::DOUBLE, 4) AS q3, round(max($)::DOUBLE, 4) AS max"))
def a_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles."""
    return rounded(profile.summary(readings(spark, sf_dir), list(MEASURES)), 4)


@query(f"{IC} SELECT machine_id, occurred_at::DATE AS day, count(*) AS n FROM ic GROUP BY 1, 2")
def a_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents by machine and day (A2)."""
    return profile.counts(incidents(spark, sf_dir), "machine_id", F.to_date("occurred_at").alias("day"))


@query("SELECT year(o_orderdate)::VARCHAR || '-W' || lpad(weekofyear(o_orderdate)::VARCHAR, 2, '0') AS week, count(*) AS n FROM orders GROUP BY 1")
def a_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by calendar year and ISO week, over year ends."""
    return profile.counts_by_week(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderdate")


@query(f"{IC}, s AS (SELECT unnest([0, 1, 2, 3])::INT AS position, unnest(['matin', 'apres-midi', 'nuit', 'week-end']) AS category) SELECT position, category, (SELECT count(*) FROM ic WHERE shift = category) AS n FROM s")
def a_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents by shift in a fixed order, absent categories kept (A4)."""
    return profile.counts_in_order(incidents(spark, sf_dir), "shift", ("matin", "apres-midi", "nuit", "week-end"))


@query(f"{IC} " + " UNION ALL ".join(f"SELECT '{f}' AS flag, coalesce(sum({f}), 0)::BIGINT AS incidents, coalesce(round_even(sum({f}) FILTER (WHERE comment IS NOT NULL) * 100.0::DOUBLE / nullif(sum({f}), 0), 1), 0) AS confidence FROM ic" for f in FLAGS))
def a_flag_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents of each flag and the percentage with a comment (A5)."""
    return profile.flag_confidence(incidents(spark, sf_dir))


@query(f"{IC} SELECT machine_id, count(*) AS n, round(avg(severity), 6) AS mean FROM ic GROUP BY 1")
def a_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents and mean severity by machine, most first."""
    return rounded(profile.count_and_mean(incidents(spark, sf_dir), "machine_id", "severity"))


_LONG_FLAGS = " UNION ALL ".join(f"SELECT '{f}' AS flag, {f} AS x, year(occurred_at)::VARCHAR || '-W' || lpad(weekofyear(occurred_at)::VARCHAR, 2, '0') AS week FROM ic" for f in FLAGS)


@query(f"{IC}, f AS ({_LONG_FLAGS}), t AS (SELECT flag FROM f GROUP BY flag ORDER BY sum(x) DESC, flag LIMIT 5) SELECT flag, week, sum(x)::BIGINT AS incidents FROM f WHERE flag IN (SELECT flag FROM t) GROUP BY 1, 2")
def a_top_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five commonest flags by week."""
    return profile.top_flags_by_week(incidents(spark, sf_dir), "occurred_at")


@query("WITH w AS (SELECT year(o_orderdate)::VARCHAR || '-W' || lpad(weekofyear(o_orderdate)::VARCHAR, 2, '0') AS week, count(*) AS n FROM orders GROUP BY 1) SELECT (SELECT week FROM w ORDER BY n DESC, week LIMIT 1) AS busiest, max(n) AS most, (SELECT week FROM w ORDER BY n, week LIMIT 1) AS calmest, min(n) AS least FROM w")
def a_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The busiest and the calmest week."""
    return profile.extremes(profile.counts_by_week(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderdate"), "week")


@query(f"{RD} SELECT last_day(observed_at) AS month_end, machine_id, " + ", ".join(f"round(avg({c}), 6) AS mean_{c}" for c in FLOATS) + " FROM rd GROUP BY 1, 2")
def a_monthly_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly means by machine."""
    return rounded(profile.monthly_means(readings(spark, sf_dir), list(FLOATS)))


@query("SELECT last_day(o_orderdate) AS month_end, o_orderpriority, round(avg(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) * 100, 6) AS stop_rate FROM orders GROUP BY 1, 2")
def a_stop_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly share of a flag in per cent, over several years (A10)."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("stopped", F.col("o_orderstatus") == "P")
    return rounded(profile.monthly_stop_rate(rows, "stopped", "o_orderdate", "o_orderpriority"))


_BOUNDS = lambda table, columns, factor: " UNION ALL ".join(f"SELECT '{c}' AS column_name, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, q1 - {factor} * (q3 - q1) AS low, q3 + {factor} * (q3 - q1) AS high FROM {table}" for c in columns)


@query(f"{RD}, b AS ({_BOUNDS('rd', FLOATS, 1.0)}) SELECT column_name, round(low, 6) AS low, round(high, 6) AS high, CASE column_name " + " ".join(f"WHEN '{c}' THEN (SELECT count(*) FROM rd WHERE {c} < low OR {c} > high)" for c in FLOATS) + " END AS outliers FROM b")
def a_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outliers and bounds of each measure."""
    return rounded(profile.outlier_report(readings(spark, sf_dir), list(FLOATS), 1.0))


@query(f"{RD} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM rd" for i, a in enumerate(MEASURES) for b in MEASURES[i + 1 :]))
def a_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pearson correlation of all pairs of measures."""
    return rounded(profile.correlations(readings(spark, sf_dir), list(MEASURES)))


@query(f"{IC} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, coalesce(sum({a} * {b}), 0)::BIGINT AS n FROM ir" for i, a in enumerate(FLAGS) for b in FLAGS[i + 1 :]))
def a_co_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often two flags stand together, over all incidents."""
    raw = adapters.raw_incidents(spark, sf_dir)
    return profile.co_occurrence(raw.select(*[S.lenient_int(F.col(f)).alias(f) for f in FLAGS]))


@query(f"{RD} SELECT machine_id, 'temperature_c' AS column_name, count(*) AS nulls FROM rd WHERE temperature_c IS NULL GROUP BY 1")
def a_nulls_by_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls by machine and measure."""
    return profile.nulls_by_machine(readings(spark, sf_dir), list(MEASURES))


@query(f"{RD} " + _each(MEASURES, "count(*) FILTER (WHERE $ IS NULL) AS nulls, count(*) FILTER (WHERE $ IS NULL AND pieces_produced < 30) AS during_stops, round(count(*) FILTER (WHERE $ IS NULL AND pieces_produced < 30) * 100.0::DOUBLE / nullif(count(*) FILTER (WHERE $ IS NULL), 0), 6) AS share"))
def a_nulls_during_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of nulls while a machine makes little."""
    rows = readings(spark, sf_dir).withColumn("slow", F.col("pieces_produced") < 30)
    return rounded(profile.nulls_during_stops(rows, list(MEASURES), "slow"))


@query(f"{NEAR}, en AS ({_EACH_NEAR('nn')}) " + " UNION ALL ".join(f"SELECT sensor_type, '{f}' AS flag, round_even(avg({f}::DOUBLE) * 100, 1) AS share FROM en GROUP BY 1" for f in FLAGS))
def a_outlier_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For matched high readings of each measure, the share of each incident type."""
    return profile.outlier_types(profile.by_sensor(matched(spark, sf_dir, peaks(spark, sf_dir)), list(MEASURES), list(FLAGS)))


@query(f"{NEAR}, en AS ({_EACH_NEAR('nn')}), eo AS ({_EACH_NEAR('ho')}), o AS (SELECT sensor_type, count(*) AS outliers FROM eo GROUP BY 1), m AS (SELECT sensor_type, count(*) AS matched, avg(severity) AS sev FROM en GROUP BY 1) SELECT sensor_type, outliers, coalesce(matched, 0) AS matched, round(coalesce(matched, 0) * 100.0::DOUBLE / outliers, 6) AS matched_pct, round(sev, 6) AS mean_severity FROM o LEFT JOIN m USING (sensor_type)")
def a_matched_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each measure's high readings near an incident, and the severity."""
    flagged = peaks(spark, sf_dir)
    found = profile.by_sensor(matched(spark, sf_dir, flagged), list(MEASURES), ["severity"])
    return rounded(profile.matched_profile(profile.by_sensor(flagged, list(MEASURES), []), found))


@query(f"{NEAR}, en AS ({_EACH_NEAR('nn')}) SELECT sensor_type, severity::SMALLINT AS severity, count(*) AS n FROM en GROUP BY 1, 2")
def a_matched_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The severities of the incidents near high readings of each measure."""
    return profile.severity_counts(profile.by_sensor(matched(spark, sf_dir, peaks(spark, sf_dir)), list(MEASURES), ["severity"]), by=("sensor_type",))


_LOW_HIGH = ", ".join(f"quantile_cont({c}, 0.25) - 3 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo_{c}, quantile_cont({c}, 0.75) + 3 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi_{c}" for c in FLOATS)
ANY_NEAR = f"""{BOTH}, lh AS (SELECT {_LOW_HIGH} FROM rd), ft AS (SELECT machine_id, observed_at, {", ".join(f"coalesce(bool_or({c} < lo_{c} OR {c} > hi_{c}), false) AS outlier_{c}" for c in FLOATS)} FROM rd, lh GROUP BY 1, 2),
fo AS (SELECT * FROM ft WHERE {" OR ".join(f"outlier_{c}" for c in FLOATS)}), fr AS (SELECT fo.*, ic.* EXCLUDE (machine_id), row_number() OVER (PARTITION BY fo.machine_id, fo.observed_at ORDER BY occurred_at, incident_id) AS rn FROM fo JOIN ic
  ON fo.machine_id = ic.machine_id AND abs(epoch_us(fo.observed_at) - epoch_us(occurred_at)) <= 86400000000), fn AS (SELECT * FROM fr WHERE rn = 1)"""


def sensor_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants with an outlier of any sensor (three interquartile ranges), their flags, and the earliest incident within a day."""
    flagged = materialized(profile.sensor_outliers(readings(spark, sf_dir), list(FLOATS)), "outliers")
    return matched(spark, sf_dir, flagged)


@query(f"{ANY_NEAR} SELECT machine_id, observed_at, incident_id, occurred_at, severity::SMALLINT AS severity, {', '.join(f'outlier_{c}' for c in FLOATS)} FROM fn")
def j_nearby_sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outliers of all sensors with the earliest incident within a day, before or after."""
    return sensor_matched(spark, sf_dir).select("machine_id", "observed_at", "incident_id", "occurred_at", "severity", *[f"outlier_{c}" for c in FLOATS])


@query(f"{ANY_NEAR} " + " UNION ALL ".join(f"SELECT '{c}' AS sensor_type, '{f}' AS flag, round_even(avg({f}::DOUBLE) * 100, 1) AS share FROM fn WHERE outlier_{c} HAVING count(*) > 0" for c in FLOATS for f in FLAGS))
def a_sensor_outlier_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each sensor's matched outliers, the share of each incident type; sensors without any are left out."""
    return profile.outlier_types(profile.by_sensor(sensor_matched(spark, sf_dir), list(FLOATS), list(FLAGS)))


@query(f"{SL}, {B.CUTS} SELECT machine_id, round(avg(temperature_c), 6) AS _temp_mean, round(stddev_samp(temperature_c), 6) AS _temp_std, round(avg(pressure_bar), 6) AS _pressure_mean, round(stddev_samp(pressure_bar), 6) AS _pressure_std FROM wd, ct WHERE observed_at < cut_1 GROUP BY 1")
def a_train_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation by machine over train rows (A21); the measures it reads are written once for the cuts and the statistics."""
    wide = materialized(M.wide_readings(silver(spark, sf_dir)).select("machine_id", "observed_at", "temperature_c", "pressure_bar"), "wide")
    return rounded(M.train_statistics(reshape.with_split(wide, "observed_at", reshape.cut_points(wide, "observed_at", tasks=windows.tasks_for(wide)))))


@query(f"{SL} SELECT sensor_type, count(*) AS total, count(*) FILTER (WHERE is_missing) AS missing, count(*) FILTER (WHERE is_duplicate) AS duplicates, count(*) FILTER (WHERE is_outlier) AS outliers, ROUND(avg(sensor_value), 3) AS mean_value FROM sl GROUP BY 1")
def a_silver_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality report of silver."""
    return profile.silver_quality(silver(spark, sf_dir))


@query(f"WITH {B.bronze(True)} SELECT 'telemetry' AS dataset_name, CASE WHEN reason IS NULL THEN 'DOUBLON_HORAIRE' ELSE 'VALIDATION' END AS rule_code, CASE WHEN reason IS NULL THEN 'WARNING' ELSE 'ERROR' END AS severity, count(*) AS n FROM bz WHERE NOT parse_ok GROUP BY 2, 3")
def a_issue_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues by dataset, rule and severity."""
    return profile.issue_report(q_issues(spark, sf_dir))


@query(f"{SI}, {B.CUTS}, g AS (SELECT wd.*, CASE WHEN observed_at < cut_1 THEN 'train' WHEN observed_at < cut_2 THEN 'validation' ELSE 'test' END AS split_set, EXISTS (SELECT 1 FROM ic WHERE is_label_event AND ic.machine_id = wd.machine_id AND occurred_at > observed_at AND occurred_at <= observed_at + INTERVAL 24 HOUR) AS y FROM wd, ct) SELECT split_set, count(*) AS n, count(DISTINCT machine_id) AS machines, min(observed_at) AS first_at, max(observed_at) AS last_at, round(avg(y::INT) * 100, 6) AS label_pct FROM g GROUP BY 1")
def a_split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, machines, range and labels of each split."""
    return rounded(profile.split_report(gold_table(spark, sf_dir)))


@query(f"{RD}, v AS ({_each(FLOATS, '$ AS value')}), e AS (SELECT column_name, min(value) AS a, max(value) AS b FROM v GROUP BY 1) SELECT column_name, least(floor((value - a) * 50 / (b - a)), 49)::INT AS bin, count(*) AS n FROM v JOIN e USING (column_name) WHERE value IS NOT NULL GROUP BY 1, 2")
def a_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """50 equal bins of each measure."""
    return profile.histogram(readings(spark, sf_dir), list(FLOATS))


@query(f"""{RD}, v AS ({_each(MEASURES, 'machine_id, $ AS value')}), b AS (SELECT machine_id, column_name, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM v WHERE value IS NOT NULL GROUP BY 1, 2),
w AS (SELECT v.*, q1, median, q3, value BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1) AS inside FROM v JOIN b USING (machine_id, column_name) WHERE value IS NOT NULL)
SELECT machine_id, column_name, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, round(min(value) FILTER (WHERE inside), 4) AS whisker_low, round(max(value) FILTER (WHERE inside), 4) AS whisker_high, count(*) FILTER (WHERE NOT inside) AS outliers FROM w GROUP BY ALL""")
def a_box_plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles, whiskers and outliers of all measures by machine."""
    return rounded(profile.box_plots(readings(spark, sf_dir), list(MEASURES)), 4)


@query(f"""{RD}, v AS ({_each(MEASURES, 'machine_id, observed_at, $ AS value')}), x AS (SELECT machine_id, column_name, value - avg(value) OVER w AS x, row_number() OVER (PARTITION BY machine_id, column_name ORDER BY observed_at) AS n FROM v WHERE value IS NOT NULL WINDOW w AS (PARTITION BY machine_id, column_name)),
t AS (SELECT machine_id, column_name, sum(x * x) AS t FROM x GROUP BY 1, 2), l AS (SELECT unnest(range(0, 49))::INT AS lag) SELECT a.machine_id, a.column_name, lag, round(sum(a.x * b.x) / nullif(any_value(t), 0), 6) AS acf FROM l, x a JOIN x b ON a.machine_id = b.machine_id AND a.column_name = b.column_name
JOIN t ON a.machine_id = t.machine_id AND a.column_name = t.column_name WHERE b.n = a.n + lag GROUP BY 1, 2, 3""")
def a_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Autocorrelation of all measures over 48 row lags, every machine."""
    return rounded(windows.autocorrelation(readings(spark, sf_dir), list(MEASURES)))


# --- windows -----------------------------------------------------------------------------------------------------


def _range(h: int) -> str:
    return f"(PARTITION BY machine_id ORDER BY epoch_us(observed_at) RANGE BETWEEN {h * windows.HOUR} PRECEDING AND 1 PRECEDING)"


_ROLL = ", ".join(
    [f"round(avg({c}) OVER {_range(h)}, 4) AS {n}_mean_{h}h, round(stddev_samp({c}) OVER {_range(h)}, 4) AS {n}_std_{h}h" + (f", round(max({c}) OVER {_range(h)}, 4) AS {n}_max_{h}h" if peak else "") for h in (6, 12, 24) for c, n, peak in windows.FEATURES]
    + [f"sum(pieces_produced) OVER {_range(24)}::BIGINT AS pieces_produced_sum_24h"]
)


def rolling_names(h: tuple[int, ...] = (6, 12, 24)) -> list[str]:
    return [f"{n}_{k}_{w}h" for w in h for _, n, peak in windows.FEATURES for k in (("mean", "std", "max") if peak else ("mean", "std"))] + ["pieces_produced_sum_24h"]


@query(f"{RD} SELECT line_id, {_ROLL} FROM rd")
def w_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling mean, deviation, maximum over 6, 12, 24 hours before a reading, and pieces of 24 hours."""
    return rounded(windows.rolling(readings(spark, sf_dir)).select("line_id", *rolling_names()), 4)


@query(f"{RD} SELECT line_id, {_ROLL} FROM rd")
def w_rolling_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in chunks of a week with a halo of a day, for few and long machines."""
    return rounded(windows.rolling_chunked(readings(spark, sf_dir)).select("line_id", *rolling_names()), 4)


_LINE = "(PARTITION BY machine_id ORDER BY observed_at)"


@query(f"{RD} SELECT line_id, " + ", ".join(f"round({c} - lag({c}, {k}) OVER {_LINE}, 6) AS {n}_{label}" for c, n, _ in windows.FEATURES for k, label in ((1, "delta_1h"), (3, "delta_3h"), (6, "trend_6h"))) + " FROM rd")
def w_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences to 1, 3 and 6 rows before."""
    names = [f"{n}_{label}" for _, n, _ in windows.FEATURES for label in ("delta_1h", "delta_3h", "trend_6h")]
    return rounded(windows.differences(readings(spark, sf_dir)).select("line_id", *names))


@query(f"""{SL}, {B.CUTS}, ts AS (SELECT machine_id, avg(temperature_c) AS m, stddev_samp(temperature_c) AS s FROM wd, ct WHERE observed_at < cut_1 GROUP BY 1), ro AS (SELECT *, avg(temperature_c) OVER w AS m24, stddev_samp(temperature_c) OVER w AS s24 FROM wd WINDOW w AS {_range(24)})
SELECT ro.machine_id, observed_at, round((temperature_c - m24) / nullif(s24, 0), 4) AS temp_zscore_24h, round((temperature_c - m) / nullif(s, 0), 4) AS temp_zscore_machine FROM ro LEFT JOIN ts ON ro.machine_id = ts.machine_id""")
def w_z_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z-scores against 24 hours and against the machine's train rows."""
    g = gold_table(spark, sf_dir)
    return rounded(g.select("machine_id", F.col("window_start").alias("observed_at"), "temp_zscore_24h", "temp_zscore_machine"), 4)


_BANDS = ", ".join(f"round(CASE WHEN n_{c} >= 24 THEN m_{c}{x} END, 4) AS {c}_{side}" for c in MEASURES for side, x in (("mean", ""), ("lower", f" - 2 * s_{c}"), ("upper", f" + 2 * s_{c}")))


@query(f"""{RD}, b AS (SELECT line_id, {", ".join(f"count({c}) OVER w AS n_{c}, avg({c}) OVER w AS m_{c}, stddev_samp({c}) OVER w AS s_{c}" for c in MEASURES)} FROM rd WINDOW w AS (PARTITION BY machine_id ORDER BY observed_at ROWS BETWEEN 167 PRECEDING AND CURRENT ROW))
SELECT line_id, {_BANDS}, {", ".join(f"round(CASE WHEN n_{c} >= 24 THEN s_{c} END, 4) AS {c}_std" for c in MEASURES)} FROM b""")
def w_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and band of all measures over 168 rows, from 24 values on."""
    return rounded(windows.band(readings(spark, sf_dir), list(MEASURES)).select("line_id", *[f"{c}_{k}" for c in MEASURES for k in ("mean", "std", "lower", "upper")]), 4)


def _filled(table: str) -> str:
    """nb, nc, fl: the measures of ``table`` with their gaps filled by row position."""
    known = [(f"last_value({c} IGNORE NULLS) OVER b AS v0_{c}, last_value(CASE WHEN {c} IS NOT NULL THEN n END IGNORE NULLS) OVER b AS n0_{c}, first_value({c} IGNORE NULLS) OVER a AS v1_{c}, first_value(CASE WHEN {c} IS NOT NULL THEN n END IGNORE NULLS) OVER a AS n1_{c}") for c in MEASURES]
    return f""", nb AS (SELECT *, row_number() OVER w AS n FROM {table} WINDOW w AS (PARTITION BY machine_id ORDER BY observed_at)), nc AS (SELECT *, {", ".join(known)} FROM nb
WINDOW b AS (PARTITION BY machine_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY machine_id ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
fl AS (SELECT line_id, {", ".join(f"coalesce({c}::DOUBLE, v0_{c} + (v1_{c} - v0_{c}) * (n - n0_{c}) / nullif(n1_{c} - n0_{c}, 0)::DOUBLE, v0_{c}::DOUBLE, v1_{c}::DOUBLE) AS {c}" for c in MEASURES)} FROM nc)"""


_INSIDE = f"""q AS (SELECT {", ".join(f"quantile_cont({c}::DOUBLE, 0.25) AS q1_{c}, quantile_cont({c}::DOUBLE, 0.75) AS q3_{c}" for c in MEASURES)} FROM rd),
xs AS (SELECT line_id, machine_id, observed_at, {", ".join(f"CASE WHEN {c} BETWEEN q1_{c} - 0.5::DOUBLE * (q3_{c} - q1_{c}) AND q3_{c} + 0.5::DOUBLE * (q3_{c} - q1_{c}) THEN {c}::DOUBLE END AS {c}" for c in MEASURES)} FROM rd, q)"""


@query(f"{RD}, xs AS (SELECT line_id, machine_id, observed_at, {', '.join(MEASURES)} FROM rd){_filled('xs')} SELECT line_id, {rnd(*MEASURES)} FROM fl")
def w_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of all measures filled by row position."""
    return rounded(windows.interpolate(readings(spark, sf_dir), list(MEASURES)).select("line_id", *MEASURES))


@query(f"{RD}, {_INSIDE}{_filled('xs')} SELECT line_id, {rnd(*MEASURES)} FROM fl")
def w_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outliers of all measures taken out and gaps filled."""
    return rounded(profile.clean(readings(spark, sf_dir), list(MEASURES), 0.5, digits=None).select("line_id", *MEASURES))


_NULLS = " UNION ALL ".join(f"SELECT machine_id, observed_at, '{c}' AS column_name, {c} IS NULL AS z FROM rd" for c in MEASURES)


@query(f"""{RD}, z AS ({_NULLS}), n AS (SELECT machine_id, column_name, z, row_number() OVER (PARTITION BY machine_id, column_name ORDER BY observed_at) AS a, row_number() OVER (PARTITION BY machine_id, column_name, z ORDER BY observed_at) AS b FROM z),
i AS (SELECT machine_id, column_name, a - b AS g, count(*) AS c FROM n WHERE z GROUP BY 1, 2, 3) SELECT machine_id, column_name, count(*) AS runs, max(c) AS longest, median(c) AS median_length FROM i GROUP BY 1, 2""")
def w_null_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of missing values of each measure: number, longest, median."""
    return windows.null_runs(readings(spark, sf_dir), list(MEASURES))


# --- functions, sets ---------------------------------------------------------------------------------------------


@query(f"{IC} SELECT DISTINCT operator_name, 'OP_ANON_' || upper(substr(sha256('{SALT}:' || operator_name), 1, 8)) AS pseudonym, substr(sha256(lower(operator_name) || '|none'), 1, 16) AS badge_hash FROM ir")
def f_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudonyms and hashes of operators (F1, F2)."""
    names = adapters.raw_incidents(spark, sf_dir).select("operator_name").distinct()
    return names.select("operator_name", S.pseudonym(F.col("operator_name"), SALT).alias("pseudonym"), S.badge_hash(F.col("operator_name"), F.lit(None).cast("string")).alias("badge_hash"))


@query("SELECT o_orderkey, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, day(o_orderdate)::INT AS day, hour(o_orderdate)::INT AS hour, (isodow(o_orderdate) - 1)::INT AS day_of_week, isodow(o_orderdate) IN (6, 7) AS is_weekend FROM orders")
def f_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar fields."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", *[c.alias(n) for n, c in S.calendar(F.col("o_orderdate")).items()])


_BY_HOUR = "PARTITION BY machine_id, date_trunc('hour', observed_at)"


def readings_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings(spark, sf_dir).withColumn("hour", F.date_trunc("hour", "observed_at"))


@query(f"{RD} SELECT machine_id, date_trunc('hour', observed_at) AS hour, line_id FROM (SELECT *, row_number() OVER ({_BY_HOUR} ORDER BY line_id) AS r FROM rd) WHERE r = 1")
def u_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of each machine and hour."""
    return quality.keep_first(readings_by_hour(spark, sf_dir), ["machine_id", "hour"], "line_id").select("machine_id", "hour", "line_id")


@query(f"{RD}, r AS (SELECT machine_id, date_trunc('hour', observed_at) AS hour, line_id AS rejected, min(line_id) OVER ({_BY_HOUR}) AS kept, row_number() OVER ({_BY_HOUR} ORDER BY line_id)::INT AS position FROM rd) SELECT * FROM r WHERE position > 1")
def u_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that keep-first drops, with the line that was kept."""
    return quality.rejected_duplicates(readings_by_hour(spark, sf_dir), ["machine_id", "hour"], "line_id")


@query(f"{BOTH} SELECT 'both' AS part, count(*) AS n FROM (SELECT machine_id FROM rd INTERSECT SELECT machine_id FROM ic) UNION ALL SELECT 'only_readings', count(*) FROM (SELECT machine_id FROM rd EXCEPT SELECT machine_id FROM ic) UNION ALL SELECT 'all', count(*) FROM (SELECT machine_id FROM rd UNION ALL SELECT machine_id FROM ic)")
def u_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection, difference and concatenation of machine lists."""
    a, b = readings(spark, sf_dir).select("machine_id"), incidents(spark, sf_dir).select("machine_id")
    named = lambda df, part: df.agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "n")
    return named(a.intersect(b), "both").union(named(a.subtract(b), "only_readings")).union(named(a.unionByName(b), "all"))


# --- the feature table -------------------------------------------------------------------------------------------


def gold_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.gold(silver(spark, sf_dir), incidents(spark, sf_dir))


_GOLD_ROLL = _ROLL.replace("::BIGINT AS pieces_produced_sum_24h", " AS pieces_produced_sum_24h")


@query(
    f"""{SI}, {B.CUTS}, ro AS (SELECT machine_id, observed_at, {_GOLD_ROLL}, round(temperature_c - lag(temperature_c, 6) OVER {_LINE}, 4) AS temp_trend_6h FROM wd)
SELECT ro.machine_id, observed_at AS window_start, observed_at + INTERVAL 1 HOUR AS window_end, CASE WHEN observed_at < cut_1 THEN 'train' WHEN observed_at < cut_2 THEN 'validation' ELSE 'test' END AS split_set, {", ".join(n for n in rolling_names())}, temp_trend_6h,
(SELECT count(*) FROM ic WHERE ic.machine_id = ro.machine_id AND occurred_at >= observed_at - INTERVAL 24 HOUR AND occurred_at < observed_at) AS incident_count_prev_24h,
EXISTS (SELECT 1 FROM ic WHERE is_label_event AND ic.machine_id = ro.machine_id AND occurred_at > observed_at AND occurred_at <= observed_at + INTERVAL 24 HOUR) AS label_failure_next_24h FROM ro, ct"""
)
def gold_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling features, incidents, label and split of each machine and instant, from raw files through bronze and silver."""
    g = gold_table(spark, sf_dir)
    return rounded(g.select("machine_id", "window_start", "window_end", "split_set", *rolling_names(), "temp_trend_6h", "incident_count_prev_24h", "label_failure_next_24h"), 4)


def _gold_sql() -> str:
    """All 78 columns, doubles to 4 digits."""
    short = {n: c for c, n, _ in windows.FEATURES}
    raw = [f"{f}({c}) OVER {_range(h)} AS {n}_{k}_{h}h" for h in (6, 12, 24) for c, n, peak in windows.FEATURES for k, f in (("mean", "avg"), ("std", "stddev_samp"), ("max", "max")) if k != "max" or peak]
    raw += [f"{c} - lag({c}, {k}) OVER {_LINE} AS {n}_{label}" for c, n, _ in windows.FEATURES for k, label in ((1, "delta_1h"), (3, "delta_3h"), (6, "trend_6h"))]
    raw.append(f"sum(pieces_produced) OVER {_range(24)} AS pieces_produced_sum_24h")
    doubles = {name.split(" AS ")[1]: name.split(" AS ")[1] for name in raw}
    doubles |= {f"{n}_{k}_1h": c for n, c in short.items() for k in (("mean", "max") if n in ("temp", "pressure") else ("mean",))} | {"pieces_produced_sum_1h": "pieces_produced"}
    doubles |= {f"{n}_zscore_24h": f"({short[n]} - {n}_mean_24h) / nullif({n}_std_24h, 0)" for n in ("temp", "pressure")} | {f"{n}_zscore_machine": f"({short[n]} - m_{n}) / nullif(s_{n}, 0)" for n in ("temp", "pressure")}
    back = lambda what, span: f"(SELECT {what} FROM ic WHERE ic.machine_id = r.machine_id AND occurred_at >= r.observed_at - INTERVAL {span} AND occurred_at < r.observed_at)"
    doubles["hours_since_last_incident"] = "(SELECT (epoch_us(r.observed_at) - max(epoch_us(occurred_at))) / 3600000000.0::DOUBLE FROM ic WHERE ic.machine_id = r.machine_id AND occurred_at < r.observed_at)"
    exact = {"ingestion_batch_id": "'batch'", "machine_id": "r.machine_id", "window_start": "r.observed_at", "window_end": "r.observed_at + INTERVAL 1 HOUR", "split_set": "split_set", "temp_std_1h": "NULL::DOUBLE", "pressure_std_1h": "NULL::DOUBLE"}
    exact |= {"incident_count_prev_24h": back("count(*)", "24 HOUR"), "incident_count_prev_7d": back("count(*)", "7 DAY"), "incident_max_severity_prev_24h": back("coalesce(max(severity), 0)::INT", "24 HOUR")}
    exact |= {f"{f}_count_prev_24h": back(f"coalesce(sum({f}), 0)::BIGINT", "24 HOUR") for f in FLAGS}
    exact |= {f"label_failure_next_{h}h": f"EXISTS (SELECT 1 FROM ic WHERE is_label_event AND ic.machine_id = r.machine_id AND occurred_at > r.observed_at AND occurred_at <= r.observed_at + INTERVAL {h} HOUR)" for h in HORIZONS}
    columns = ", ".join(f"round(({doubles[n]})::DOUBLE, 4) AS {n}" if n in doubles else f"{exact[n]} AS {n}" for n in gold_columns())
    return f"""{SI}, {B.CUTS}, sp AS (SELECT wd.*, CASE WHEN observed_at < cut_1 THEN 'train' WHEN observed_at < cut_2 THEN 'validation' ELSE 'test' END AS split_set FROM wd, ct),
ts AS (SELECT machine_id, avg(temperature_c) AS m_temp, stddev_samp(temperature_c) AS s_temp, avg(pressure_bar) AS m_pressure, stddev_samp(pressure_bar) AS s_pressure FROM sp WHERE split_set = 'train' GROUP BY 1),
ro AS (SELECT sp.*, {", ".join(raw)} FROM sp) SELECT {columns} FROM ro r LEFT JOIN ts ON ts.machine_id = r.machine_id"""


@query(_gold_sql())
def gold_all_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole feature table with its 78 columns (W11 and all before)."""
    return rounded(gold_table(spark, sf_dir), 4)


# --- options from the specification ------------------------------------------------------------------------------


@query(f"{RD} SELECT line_id, round(CASE WHEN temperature_c > 80 THEN (temperature_c - 32) * 5 / 9 ELSE temperature_c END, 6) AS temperature_c, coalesce(temperature_c > 80, false) AS converted FROM rd")
def d_celsius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suspect temperatures taken as Fahrenheit."""
    return rounded(readings(spark, sf_dir).select("line_id", S.celsius(F.col("temperature_c")).alias("temperature_c"), S.any_of(F.col("temperature_c") > 80).alias("converted")))


@query(f"{RD} SELECT machine_id, date_trunc('hour', observed_at) AS hour, round(avg(temperature_c), 6) AS temp_mean_1h, round(max(temperature_c), 6) AS temp_max_1h, round(stddev_samp(temperature_c), 6) AS temp_std_1h, sum(pieces_produced)::BIGINT AS pieces_sum_1h FROM rd GROUP BY 1, 2")
def d_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly aggregates."""
    rows = readings(spark, sf_dir).groupBy("machine_id", F.date_trunc("hour", "observed_at").alias("hour"))
    return rounded(rows.agg(F.avg("temperature_c").alias("temp_mean_1h"), F.max("temperature_c").alias("temp_max_1h"), F.when(F.count("temperature_c") > 1, F.stddev_samp("temperature_c")).alias("temp_std_1h"), F.sum("pieces_produced").alias("pieces_sum_1h")))


@query(f"{RD} SELECT line_id, " + ", ".join(f"round(avg({c}) OVER (PARTITION BY machine_id ORDER BY observed_at ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 4) AS {n}_mean_6h, round(max({c}) OVER (PARTITION BY machine_id ORDER BY observed_at ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 4) AS {n}_max_6h" for c, n, _ in windows.FEATURES) + " FROM rd")
def d_rolling_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling by rows with the current one, maxima of all measures."""
    out = windows.rolling_rows(readings(spark, sf_dir), (6,))
    return rounded(out.select("line_id", *[f"{n}_{k}_6h" for _, n, _ in windows.FEATURES for k in ("mean", "max")]), 4)


_HOURS = "hc AS (SELECT machine_id, date_trunc('hour', occurred_at) AS hour, count(*) AS incidents, " + ", ".join(f"sum({f})::BIGINT AS {f}" for f in FLAGS) + " FROM ic GROUP BY 1, 2)"


@query(f"{IC}, {_HOURS} SELECT * FROM hc")
def d_hourly_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents and type flags at hour grain."""
    return timeline.hourly_counts(incidents(spark, sf_dir))


_ROLLED = ", ".join(f"(sum(incidents) OVER (PARTITION BY machine_id ORDER BY hour ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW))::BIGINT AS incidents_{n}_rows" for n in (24, 168))


@query(f"{BOTH}, {_HOURS}, rh AS (SELECT DISTINCT machine_id, date_trunc('hour', observed_at) AS hour FROM rd), h AS (SELECT rh.*, coalesce(incidents, 0) AS incidents FROM rh LEFT JOIN hc USING (machine_id, hour)) SELECT machine_id, hour, incidents, {_ROLLED} FROM h")
def d_rolling_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly incidents joined to a machine's hours, and their sums over 24 and 168 rows."""
    hours = readings(spark, sf_dir).select("machine_id", F.date_trunc("hour", "observed_at").alias("hour")).distinct()
    return timeline.rolling_counts(hours, timeline.hourly_counts(incidents(spark, sf_dir)))


@query(f"{BOTH}, {_HOURS}, rh AS (SELECT DISTINCT machine_id, date_trunc('hour', observed_at) AS hour FROM rd), h AS (SELECT rh.*, coalesce(incidents, 0) AS incidents FROM rh LEFT JOIN hc USING (machine_id, hour)) SELECT machine_id, hour, " + ", ".join(f"(sum(incidents) OVER (PARTITION BY machine_id ORDER BY hour ROWS BETWEEN CURRENT ROW AND {h - 1} FOLLOWING))::BIGINT AS future_incident_count_{h}h, (sum(incidents) OVER (PARTITION BY machine_id ORDER BY hour ROWS BETWEEN CURRENT ROW AND {h - 1} FOLLOWING)) > 0 AS label_incident_next_{h}h" for h in HORIZONS) + " FROM h")
def d_inclusive_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by rows from the current hour on."""
    hours = readings(spark, sf_dir).select("machine_id", F.date_trunc("hour", "observed_at").alias("hour")).distinct()
    counted = hours.join(timeline.hourly_counts(incidents(spark, sf_dir)).select("machine_id", "hour", "incidents"), ["machine_id", "hour"], "left").withColumn("incidents", F.coalesce("incidents", F.lit(0)))
    return timeline.inclusive_labels(counted).drop("incidents")


@query(f"{RD}, c AS (SELECT floor(quantile_cont(epoch_us(observed_at)::DOUBLE, 0.7))::BIGINT AS a, floor(quantile_cont(epoch_us(observed_at)::DOUBLE, 0.85))::BIGINT AS b FROM rd) SELECT CASE WHEN epoch_us(observed_at) < a THEN 'train' WHEN epoch_us(observed_at) < b THEN 'validation' ELSE 'test' END AS split_set, count(*) AS n FROM rd, c GROUP BY 1")
def d_row_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split at quantiles of the rows' instants."""
    rows = readings(spark, sf_dir)
    return profile.counts(reshape.with_split(rows, "observed_at", reshape.row_quantile_cuts(rows, "observed_at")), "split_set")


@query(f"{RD}, r AS (SELECT line_id, machine_id, sum(pieces_produced) OVER {_range(24)} AS p FROM rd) SELECT line_id, round(p * 100.0::DOUBLE / (500 + c_custkey), 6) AS capacity_utilization_pct FROM r JOIN customer ON machine_id = 'MACH-' || c_custkey")
def d_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of 24 hours against the daily capacity."""
    rows = windows.rolling_chunked(readings(spark, sf_dir), (24,)).join(adapters.machines(spark, sf_dir).withColumnRenamed("machine_code", "machine_id"), "machine_id")
    return rounded(rows.select("line_id", (F.col("pieces_produced_sum_24h") * 100.0 / F.col("max_daily_capacity")).alias("capacity_utilization_pct")))


@query(f"{RD} " + _each(FLOATS, "count(*) FILTER (WHERE abs($ - (SELECT avg($) FROM rd)) / nullif((SELECT stddev_samp($) FROM rd), 0) > 2) AS outliers"))
def d_z_score_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values beyond two deviations."""
    return profile.z_score_outliers(readings(spark, sf_dir), list(FLOATS), 2.0)


@query(f"""{RD}, dt AS (SELECT list_sort(list(DISTINCT observed_at)) AS ts FROM rd), cu AS (SELECT {", ".join(f"ts[floor(len(ts) * ({(k + 1) / 5!r})::DOUBLE)::INT + 1] AS c{k + 1}" for k in range(4))} FROM dt)
SELECT fold, role, count(*) AS n FROM (""" + " UNION ALL ".join(f"SELECT {k} AS fold, CASE WHEN observed_at < c{k} THEN 'train' WHEN {f'observed_at < c{k + 1}' if k < 4 else 'true'} THEN 'test' END AS role FROM rd, cu" for k in range(1, 5)) + ") WHERE role IS NOT NULL GROUP BY 1, 2")
def d_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expanding folds in time."""
    return profile.counts(reshape.expanding_folds(readings(spark, sf_dir), "observed_at"), "fold", "role")


@query(f"{IC} SELECT machine_id, shift, severity, count(*) AS n FROM ir GROUP BY 1, 2, 3 HAVING count(*) < 3")
def d_identifying(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute combinations that few incidents share."""
    raw = adapters.raw_incidents(spark, sf_dir).withColumn("severity", S.lenient_int(F.col("severity")))
    return quality.identifying_groups(raw, ["machine_id", "shift", "severity"], 3)


_TRAITS = ("machine_id", "shift", "severity", "operator_name")
_BIT = {a: 1 << (3 - i) for i, a in enumerate(_TRAITS)}


@query(
    f"""{IC}, g AS (SELECT {', '.join(_TRAITS)}, {' + '.join(f'{b} * grouping({a})' for a, b in _BIT.items())} AS gid, count(*) AS n FROM ir GROUP BY GROUPING SETS (CUBE ({', '.join(_TRAITS)})) HAVING count(*) < 3), m AS (SELECT * FROM g WHERE gid <> 15)
SELECT concat_ws('+', {', '.join(f"CASE WHEN x.gid & {b} = 0 THEN '{a}' END" for a, b in _BIT.items())}) AS combination, (4 - bit_count(x.gid::BIGINT))::INT AS size, {', '.join(f'x.{a}' for a in _TRAITS)}, n FROM m x
WHERE NOT EXISTS (SELECT 1 FROM m y WHERE y.gid <> x.gid AND (y.gid | x.gid) = y.gid AND {' AND '.join(f'(y.gid & {b} > 0 OR y.{a} IS NOT DISTINCT FROM x.{a})' for a, b in _BIT.items())})"""
)
def d_identifying_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest attribute combinations that few incidents share, over all subsets of four attributes."""
    raw = adapters.raw_incidents(spark, sf_dir).withColumn("severity", S.lenient_int(F.col("severity")))
    return quality.minimal_identifying(materialized(raw.select(*_TRAITS), "traits"), list(_TRAITS), 3)


@query(f"{IC} SELECT shift AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM ic)::DOUBLE, 6) AS share FROM ic GROUP BY 1")
def d_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Representation of shifts."""
    return rounded(profile.shares(incidents(spark, sf_dir), "shift"))


@query(f"{IC} SELECT count(*) FILTER (WHERE is_label_event) AS positives, count(*) FILTER (WHERE NOT is_label_event) AS negatives, round(negatives / positives::DOUBLE, 6) AS positive_weight FROM ic")
def d_class_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class balance and the weight of positives."""
    return rounded(profile.class_weight(incidents(spark, sf_dir), "is_label_event"))


@query(f"""{RD}, e AS (SELECT quantile_cont(voltage_mean_v, [{", ".join(repr(k / 10) for k in range(1, 10))}]) AS es FROM rd WHERE observed_at < '2024-01-08'), p AS (SELECT CASE WHEN observed_at < '2024-01-08' THEN 'w1' WHEN observed_at < '2024-01-15' THEN 'w2' ELSE 'w3' END AS period, len(list_filter(es, lambda x: x <= voltage_mean_v)) AS bin FROM rd, e),
s AS (SELECT period, b AS bin, greatest(count(*) FILTER (WHERE bin = b) / count(*)::DOUBLE, 0.0001::DOUBLE) AS s FROM p, (SELECT unnest(range(10)) AS b) GROUP BY 1, 2) SELECT a.period, round(sum((a.s - r.s) * ln(a.s / r.s)), 6) AS psi, sum((a.s - r.s) * ln(a.s / r.s)) > 0.2 AS alert FROM s a JOIN s r ON r.period = 'w1' AND r.bin = a.bin GROUP BY 1""")
def d_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stability index of voltage by period against the first week."""
    at = F.col("observed_at")
    rows = readings(spark, sf_dir).withColumn("period", F.when(at < F.lit("2024-01-08").cast("timestamp"), "w1").when(at < F.lit("2024-01-15").cast("timestamp"), "w2").otherwise("w3"))
    return rounded(modelling.drift(rows, "voltage_mean_v", "period", "w1"))


@query(f"{BOTH}, p AS (SELECT temperature_c > 100 AS predicted, EXISTS (SELECT 1 FROM ic WHERE ic.machine_id = r.machine_id AND occurred_at > observed_at AND occurred_at <= observed_at + INTERVAL 24 HOUR AND is_label_event) AS label FROM rd r), c AS (SELECT count(*) FILTER (WHERE label AND coalesce(predicted, false)) AS tp, count(*) FILTER (WHERE NOT label AND coalesce(predicted, false)) AS fp, count(*) FILTER (WHERE label AND NOT coalesce(predicted, false)) AS fn, count(*) FILTER (WHERE NOT label AND NOT coalesce(predicted, false)) AS tn FROM p) SELECT tp, fp, fn, tn, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1, fn * 10000.0::DOUBLE AS cost_missed, fp * 500.0::DOUBLE AS cost_false_alarms, fn * 10000.0::DOUBLE + fp * 500.0::DOUBLE AS cost_total FROM c")
def d_confusion_and_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A temperature rule against labels: confusion, scores and costs."""
    rows = timeline.labels(readings(spark, sf_dir), incidents(spark, sf_dir).filter("is_label_event"), (24,))
    marked = rows.select(F.col("label_failure_next_24h").cast("int").alias("label"), F.coalesce(F.col("temperature_c") > 100, F.lit(False)).cast("int").alias("predicted"))
    return rounded(modelling.cost(modelling.confusion(marked)))


_RANKED = f"""{BOTH}, t AS (SELECT temperature_c AS s, EXISTS (SELECT 1 FROM ic WHERE ic.machine_id = r.machine_id AND occurred_at > observed_at AND occurred_at <= observed_at + INTERVAL 24 HOUR AND is_label_event)::INT AS y FROM rd r WHERE temperature_c IS NOT NULL),
g AS (SELECT s, sum(y) AS p, count(*) AS n FROM t GROUP BY s), u AS (SELECT s, p, n, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS above, sum(n - p) OVER (ORDER BY s) - (n - p) AS below, (SELECT sum(y) FROM t) AS pos FROM g),
th AS (SELECT s AS threshold, above::BIGINT AS above, tp / above::DOUBLE AS precision, tp / pos::DOUBLE AS recall FROM u)"""


def scored_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temperature as a score of a label event within a day, written once."""
    rows = timeline.labels(readings(spark, sf_dir), incidents(spark, sf_dir).filter("is_label_event"), (24,))
    return materialized(rows.select(F.col("temperature_c").alias("score"), F.col("label_failure_next_24h").cast("int").alias("label")), "scores")


@query(f"{_RANKED} SELECT {rnd('threshold')}, above, {rnd('precision', 'recall')} FROM th")
def d_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall at every distinct score."""
    return rounded(modelling.thresholds(scored_readings(spark, sf_dir)))


@query(f"{_RANKED} SELECT (SELECT round(sum(p * (below + (n - p) / 2.0::DOUBLE)) / (sum(p)::DOUBLE * sum(n - p)), 6) FROM u) AS auc, (SELECT round(max(recall), 6) FROM th WHERE precision >= 0.1) AS recall, (SELECT round(threshold, 6) FROM th WHERE precision >= 0.1 ORDER BY recall DESC, threshold DESC LIMIT 1) AS threshold")
def d_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact area under the curve, and the best recall at a precision of 10 %."""
    rows = scored_readings(spark, sf_dir)
    return rounded(modelling.area_under_curve(rows).join(modelling.recall_at(rows, 0.1), F.lit(True)))


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold_table(spark, sf_dir).withColumn("label", F.col("label_failure_next_48h").cast("int"))


MODEL_COLUMNS = ["temp_mean_1h", "pressure_mean_1h", "voltage_mean_1h", "rotation_mean_1h", "temp_mean_24h", "pressure_mean_24h", "incident_count_prev_24h", "incident_count_prev_7d"]


def _imputation_sql() -> str:
    """Errors on masked values: regression on three inputs by determinants of the centred products."""
    det = lambda a, b, c: f"({a[0]} * ({b[1]} * {c[2]} - {b[2]} * {c[1]}) - {a[1]} * ({b[0]} * {c[2]} - {b[2]} * {c[0]}) + {a[2]} * ({b[0]} * {c[1]} - {b[1]} * {c[0]}))"
    steps, out = [], []
    for t, c in enumerate(FLOATS):
        xs = [o for o in FLOATS if o != c]
        value = lambda o: f"coalesce({o}, mean_{o})"
        use = f"split_set = 'train' AND NOT hide AND {c} IS NOT NULL"
        pairs = {(i, j): f"covar_pop({value(xs[i])}, {value(xs[j])}) FILTER ({use})" for i in range(3) for j in range(i, 3)}
        steps.append(f"m{t} AS (SELECT {', '.join(f'{p} AS a{i}{j}' for (i, j), p in pairs.items())}, {', '.join(f'covar_pop({value(o)}, {c}) FILTER ({use}) AS b{i}, avg({value(o)}) FILTER ({use}) AS x{i}' for i, o in enumerate(xs))}, avg({c}) FILTER ({use}) AS y, quantile_cont({c}, 0.5) FILTER ({use}) AS med FROM hd, mn)")
        cell = lambda i, j: f"a{min(i, j)}{max(i, j)}"
        column = lambda k: det(*[[f"b{i}" if j == k else cell(i, j) for j in range(3)] for i in range(3)])
        steps.append(f"r{t} AS (SELECT *, {', '.join(f'{column(k)} / {det(*[[cell(i, j) for j in range(3)] for i in range(3)])} AS w{k}' for k in range(3))} FROM m{t})")
        guess = " + ".join(f"w{i} * ({value(o)} - x{i})" for i, o in enumerate(xs))
        for method, expr in (("median", "med"), ("interpolation", f"fl.{c}"), ("regression", f"y + {guess}")):
            out.append(f"SELECT '{c}' AS column_name, '{method}' AS method, sqrt(avg(({expr} - hd.{c}) ** 2)) AS rmse FROM hd JOIN fl USING (line_id), mn, r{t} WHERE hide AND hd.{c} IS NOT NULL".replace("coalesce(", "coalesce(hd.") if method == "regression" else f"SELECT '{c}' AS column_name, '{method}' AS method, sqrt(avg(({expr} - hd.{c}) ** 2)) AS rmse FROM hd JOIN fl USING (line_id), r{t} WHERE hide AND hd.{c} IS NOT NULL")
    return f"""{RD}, dt AS (SELECT list_sort(list(DISTINCT observed_at)) AS ts FROM rd), ct AS (SELECT ts[floor(len(ts) * 0.7::DOUBLE)::INT + 1] AS cut_1, ts[floor(len(ts) * 0.85::DOUBLE)::INT + 1] AS cut_2 FROM dt),
hd AS (SELECT rd.*, CASE WHEN observed_at < cut_1 THEN 'train' WHEN observed_at < cut_2 THEN 'validation' ELSE 'test' END AS split_set, ('0x' || substr(md5(line_id::VARCHAR), 1, 7))::BIGINT % 10 = 0 AS hide FROM rd, ct),
mn AS (SELECT {", ".join(f"avg({c}) AS mean_{c}" for c in FLOATS)} FROM hd WHERE split_set = 'train'), xs AS (SELECT line_id, machine_id, observed_at, {", ".join(f"CASE WHEN NOT hide THEN {c} END AS {c}" for c in FLOATS)}, pieces_produced FROM hd){_filled('xs')},
{", ".join(steps)}, er AS ({" UNION ALL ".join(out)}), be AS (SELECT column_name, arg_min(method, (rmse, method)) AS best FROM er GROUP BY 1) SELECT column_name, method, round(rmse, 4) AS rmse, best FROM er JOIN be USING (column_name)"""


@query(_imputation_sql())
def d_imputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of three imputations on masked values, and the best (D3)."""
    rows = readings(spark, sf_dir)
    split = reshape.with_split(rows, "observed_at", reshape.cut_points(rows, "observed_at"))
    errors = materialized(modelling.imputation_errors(split, list(FLOATS)), "imputation-errors")
    return rounded(errors.join(modelling.best_imputation(errors).withColumnRenamed("method", "best"), "column_name"), 4)


_R = {(i, j): f"(SELECT abs(corr({a}, {b})) > 0.95 FROM rd)" for i, a in enumerate(MEASURES) for j, b in enumerate(MEASURES) if i < j}


@query(f"{RD}, g0 AS (SELECT false AS g0), " + ", ".join(f"g{j} AS (SELECT *, coalesce({' OR '.join(f'(NOT g{i} AND {_R[i, j]})' for i in range(j))}, false) AS g{j} FROM g{j - 1})" for j in range(1, len(MEASURES))) + " " + " UNION ALL ".join(f"SELECT '{c}' AS column_name FROM g{len(MEASURES) - 1} WHERE g{j}" for j, c in enumerate(MEASURES)))
def d_correlated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures to leave out, as an earlier one says nearly the same."""
    gone = modelling.correlated(readings(spark, sf_dir), list(MEASURES))
    return spark.createDataFrame([(c,) for c in gone], "column_name string")


@query()
def d_classifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic regression, forest and boosted trees on the feature table: test area under the curve and recall at precision 80 % (null: not reached) and 30 %."""
    from pyspark.ml import Pipeline

    path = shared_dir(spark, "model-rows")
    files.full_refresh(training_rows(spark, sf_dir).select("split_set", "label", *[F.col(c).cast("double").alias(c) for c in MODEL_COLUMNS]), path)
    rows = spark.read.parquet(path)
    # features are fitted and written once for the three classifiers, and scores once for the measures of each
    features = Pipeline(stages=modelling.prepared(MODEL_COLUMNS)).fit(rows.filter("split_set = 'train'")).transform(rows)
    rows = materialized(features.select("split_set", "label", "features"), "model-features")
    train = rows.filter("split_set = 'train'")
    weight = profile.class_weight(train.withColumn("y", F.col("label") == 1), "y").first()["positive_weight"] or 1.0
    out = None
    for kind in ("logistic", "forest", "boosted"):
        scored = modelling.scored(modelling.classifier(kind, train, None, weight=weight), rows.filter("split_set = 'test'")).select("label", "score")
        scored = materialized(scored, f"scores-{kind}")
        low = modelling.recall_at(scored, 0.3).withColumnsRenamed({"recall": "recall_at_30", "threshold": "threshold_at_30"})
        part = modelling.area_under_curve(scored).join(modelling.recall_at(scored, 0.8), F.lit(True)).join(low, F.lit(True)).withColumn("model", F.lit(kind))
        out = part if out is None else out.union(part)
    return out.select("model", "auc", "recall", "threshold", "recall_at_30", "threshold_at_30")


@query()
def d_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Principal components of scaled features, fitted on train rows: means of the first three by split."""
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    path = shared_dir(spark, "component-rows")
    files.full_refresh(gold_table(spark, sf_dir).select("split_set", *[F.col(c).cast("double").alias(c) for c in MODEL_COLUMNS]), path)
    rows = spark.read.parquet(path)
    model = Pipeline(stages=modelling.prepared(MODEL_COLUMNS, 3)).fit(rows.filter("split_set = 'train'"))
    values = model.transform(rows).select("split_set", vector_to_array("features").alias("v"))
    return values.groupBy("split_set").agg(F.count("*").alias("n"), *[F.avg(F.get("v", F.lit(i))).alias(f"mean_{i + 1}") for i in range(3)])


_AFTER = f"r AS (SELECT {', '.join(f'quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.75) AS q3_{c}' for c in MEASURES)} FROM fl)"
_BEYOND = lambda c: f"count(*) FILTER (WHERE {c} < q1_{c} - 0.5::DOUBLE * (q3_{c} - q1_{c}) OR {c} > q3_{c} + 0.5::DOUBLE * (q3_{c} - q1_{c}))"


@query(
    f"{RD}, {_INSIDE}{_filled('xs')}, {_AFTER}, d AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS column_name, (SELECT {_BEYOND(c)} FROM rd, q) AS outliers_before, (SELECT {_BEYOND(c)} FROM fl, r) AS outliers_after" for c in MEASURES)
    + ") SELECT *, round_even((outliers_before - outliers_after) * 100.0::DOUBLE / nullif(outliers_before, 0), 1) AS reduction FROM d"
)
def a_before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outliers of all measures before and after cleaning, with bounds computed on each (A14); the cleaned rows are written once."""
    rows = readings(spark, sf_dir)
    cleaned = materialized(profile.clean(rows, list(MEASURES), 0.5, digits=None).select(*MEASURES), "cleaned")
    return profile.before_after(rows, cleaned, list(MEASURES), 0.5)
