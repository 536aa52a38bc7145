"""Common table expressions that the SQL of the registered queries starts from."""

from __future__ import annotations

from forgeline.schemas import FLAGS, MEASURES

_FLAG = lambda i, f: f"CASE WHEN k = 98 AND {i} = 0 THEN 2 WHEN k % 9 = {i} THEN 1 ELSE 0 END AS {f}"
EVENTS = """ev AS (SELECT *, regexp_extract(props, '"k": *([0-9]+)', 1)::INT AS k FROM events)"""
READINGS = """rd AS (SELECT event_id AS line_id, 'MACH-' || user_id AS machine_id, ts AS observed_at, CASE WHEN k % 11 <> 0 THEN value * 1.2::DOUBLE END AS temperature_c,
  k * 10.5::DOUBLE AS pressure_bar, value + k AS voltage_mean_v, value * k AS rotation_mean_rpm, k - 1 AS pieces_produced FROM ev WHERE event_type <> 'error')"""
INCIDENTS = f"""ir AS (SELECT event_id AS line_id, 'INC-' || event_id AS incident_id, 'MACH-' || user_id AS machine_id, date_trunc('minute', ts) AS occurred_at, 'Op ' || (k % 20) AS operator_name,
  'B' || (k % 20) AS operator_badge, k % 7 AS severity, CASE WHEN hour(ts) BETWEEN 6 AND 13 THEN 'matin' WHEN hour(ts) BETWEEN 14 AND 21 THEN 'apres-midi' ELSE 'nuit' END AS shift,
  CASE WHEN k % 3 <> 0 THEN 'note ' || k END AS comment, {", ".join(_FLAG(i, f) for i, f in enumerate(FLAGS))}, k FROM ev WHERE event_type = 'error'),
ic AS (SELECT *, severity >= 4 AS is_label_event FROM ir WHERE severity BETWEEN 1 AND 5 AND type_surchauffe IN (0, 1))"""


def bad_reading(table: str = "rd") -> str:
    """SQL for the reason of a row's failure, null where it is valid."""
    return f"""nullif(concat_ws(' | ', CASE WHEN {table}.temperature_c NOT BETWEEN -50 AND 500 THEN 'temperature_c:RANGE' END,
  CASE WHEN {table}.pressure_bar NOT BETWEEN 0 AND 1000 THEN 'pressure_bar:RANGE' END, CASE WHEN {table}.pieces_produced < 0 THEN 'pieces_produced:RANGE' END), '')"""


def bronze(hourly: bool = False) -> str:
    """rd, then bz: readings with reason (row rules), parse_ok and parse_ok_reason after the duplicate rule.

    The rule compares identifiers as the file spells them, and the spelling goes with k (pieces_produced + 1).
    """
    at = "date_trunc('hour', observed_at)" if hourly else "observed_at"
    return f"""{EVENTS}, {READINGS}, rr AS (SELECT * REPLACE ({at} AS observed_at), {bad_reading()} AS reason FROM rd),
rc AS (SELECT *, count(*) FILTER (WHERE reason IS NULL) OVER (PARTITION BY machine_id, pieces_produced % 2 = 0, observed_at) AS n FROM rr),
bz AS (SELECT *, reason IS NULL AND n = 1 AS parse_ok, CASE WHEN reason IS NULL AND n > 1 THEN 'DOUBLON_HORAIRE:' || n ELSE reason END AS parse_ok_reason FROM rc)"""


def silver() -> str:
    """After ``bronze``: sl (long form with flags) and wd (wide again)."""
    parts = " UNION ALL ".join(
        f"SELECT line_id, machine_id, observed_at, '{s}' AS sensor_type, {c}::DOUBLE AS sensor_value, '{u}' AS unit FROM bz WHERE parse_ok"
        for c, s, u in (("temperature_c", "temperature", "°C"), ("pressure_bar", "pressure", "bar"), ("voltage_mean_v", "voltage", "V"), ("rotation_mean_rpm", "rotation", "RPM"), ("pieces_produced", "pieces", "pcs"))
    )
    return f"""lf AS ({parts}), qt AS (SELECT sensor_type, quantile_cont(sensor_value, 0.25) AS q1, quantile_cont(sensor_value, 0.75) AS q3 FROM lf GROUP BY sensor_type),
sl AS (SELECT lf.*, sensor_value IS NULL AS is_missing, row_number() OVER (PARTITION BY machine_id, observed_at, lf.sensor_type ORDER BY line_id) > 1 AS is_duplicate,
  coalesce(sensor_value < q1 - 1.5 * (q3 - q1) OR sensor_value > q3 + 1.5 * (q3 - q1), false) AS is_outlier FROM lf JOIN qt USING (sensor_type)),
wd AS (SELECT machine_id, observed_at, {", ".join(f"avg(sensor_value) FILTER (WHERE sensor_type = '{s}') AS {c}" for c, s in zip(MEASURES, ("temperature", "pressure", "voltage", "rotation", "pieces")))}
  FROM sl WHERE NOT is_missing AND NOT is_duplicate GROUP BY machine_id, observed_at)"""


CUTS = """dt AS (SELECT list_sort(list(DISTINCT observed_at)) AS ts FROM wd), ct AS (SELECT ts[floor(len(ts) * 0.7::DOUBLE)::INT + 1] AS cut_1, ts[floor(len(ts) * 0.85::DOUBLE)::INT + 1] AS cut_2 FROM dt)"""
