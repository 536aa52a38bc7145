"""Range and as-of joins between readings and events of a machine.

Readings and events are put on one time line and range windows look back or ahead, so the cost is one exchange and one sort and
never readings times events. The line is cut into chunks of time: an event also stands in the chunks whose readings can see it (so many hours
after or before it), and what has no bound, the last event ever, is carried into each chunk by a row of its own. A machine with most of
the rows is thus spread like many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forgeline.operators.windows import CHUNK_HOURS, HOUR, chunk_of, copied, dealt, over_rows, rolling_columns
from forgeline.schemas import FLAGS, HORIZONS

DAY = 24 * HOUR


def line() -> Window:
    return Window.partitionBy("machine_id", "_chunk").orderBy("_us")


def on_time_line(
    readings: DataFrame, events: DataFrame, back: int, ahead: int = 0, columns: tuple[str, ...] = (), event_at: str = "occurred_at", at: str = "observed_at", halo: int = 0, values: tuple[str, ...] = (), ever: bool = False, chunk_hours: int = CHUNK_HOURS,
    beside: tuple[str, ...] = (), places: DataFrame | None = None, tasks: int | None = None,
) -> DataFrame:
    """Readings and events by ``machine_id`` and ``_chunk``, at ``_us``.

    Events (``_is_event``) have their ``columns`` as `_e_...` and are seen ``back`` hours after and ``ahead`` hours before themselves. Readings are whole in
    ``_row``, with ``values`` as `_m_...` also, and are copied to the next chunk if it begins within ``halo`` hours. ``ever`` adds a row just
    before each chunk that has the last event of all chunks before in ``_carried``. Readings' columns ``beside`` stay out of ``_row``, so that Spark drops those that nothing
    reads. ``places`` has the machines and instants of the readings, where it costs less than they do to find the chunks; ``tasks`` as in ``dealt``.
    """
    us, event_us = F.unix_micros(at), F.unix_micros(event_at)
    left = readings.select("machine_id", us.alias("_us"), F.lit(False).alias("_is_event"), chunk_of(us, chunk_hours).alias("_own"), F.explode(copied(us, halo, chunk_hours)).alias("_chunk"), *[F.col(c).alias(f"_m_{c}") for c in values], *beside, F.struct(*[c for c in readings.columns if c not in beside]).alias("_row"))
    known = events.filter(F.col(event_at).isNotNull())
    seen = F.sequence(chunk_of(event_us - ahead * HOUR, chunk_hours), chunk_of(event_us + back * HOUR, chunk_hours))
    out = left.unionByName(known.select("machine_id", event_us.alias("_us"), F.lit(True).alias("_is_event"), F.explode(seen).alias("_chunk"), *[F.col(c).alias(f"_e_{c}") for c in columns]), allowMissingColumns=True)
    if ever:
        chunks = (readings if places is None else places).select("machine_id", chunk_of(us, chunk_hours).alias("_chunk"), F.lit(None).cast("long").alias("_last")).union(known.select("machine_id", chunk_of(event_us, chunk_hours), event_us))
        last = chunks.groupBy("machine_id", "_chunk").agg(F.max("_last").alias("_last"))
        earlier = Window.partitionBy("machine_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        carried = last.select("machine_id", "_chunk", F.max("_last").over(earlier).alias("_carried")).filter("_carried IS NOT NULL AND _chunk IS NOT NULL")
        out = out.unionByName(carried.withColumns({"_us": F.col("_chunk") * (chunk_hours * HOUR) - 1, "_is_event": F.lit(False)}), allowMissingColumns=True)
    return dealt(out, tasks, "machine_id", "_chunk")


def _readings(df: DataFrame, new: dict[str, Column], beside: tuple[str, ...] = ()) -> DataFrame:
    return df.withColumns(new).filter("_row IS NOT NULL AND _own <=> _chunk").select("_row.*", *beside, *new)


def _count(hours: int, event: Column | None = None) -> Column:
    return F.count(F.when(F.col("_is_event") if event is None else event, 1)).over(line().rangeBetween(-hours * HOUR, -1))


def _since() -> Column:
    """Microseconds since the last event before a reading; the line has to be made with ``ever``."""
    return F.col("_us") - F.max(F.when(F.col("_is_event"), F.col("_us")).otherwise(F.col("_carried"))).over(line().rangeBetween(Window.unboundedPreceding, -1))


def _past() -> dict[str, Column]:
    """What is known of incidents before a reading, as columns over the time line."""
    day = line().rangeBetween(-DAY, -1)
    new = {
        "incident_count_prev_24h": _count(24),
        "incident_max_severity_prev_24h": F.coalesce(F.max("_e_severity").over(day), F.lit(0)),
        "incident_count_prev_7d": _count(168),
        "hours_since_last_incident": _since() / float(HOUR),
    }
    return new | {f"{f}_count_prev_24h": F.coalesce(F.sum(f"_e_{f}").over(day), F.lit(0)) for f in FLAGS}


def _ahead(is_event: Column, horizons: tuple[int, ...]) -> dict[str, Column]:
    return {f"label_failure_next_{h}h": F.count(F.when(is_event, 1)).over(line().rangeBetween(1, h * HOUR)) > 0 for h in horizons}


def lookback(readings: DataFrame, incidents: DataFrame, chunk_hours: int = CHUNK_HOURS) -> DataFrame:
    """Incidents in [t - 24h, t) and [t - 7d, t): counts, largest severity, flag sums; hours since the last one before t."""
    return _readings(on_time_line(readings, incidents, 168, columns=("severity", *FLAGS), ever=True, chunk_hours=chunk_hours), _past())


def labels(readings: DataFrame, events: DataFrame, horizons: tuple[int, ...] = HORIZONS, chunk_hours: int = CHUNK_HOURS) -> DataFrame:
    """label_failure_next_{h}h: an event in (t, t + h]."""
    return _readings(on_time_line(readings, events, 0, max(horizons), chunk_hours=chunk_hours), _ahead(F.col("_is_event"), horizons))


def features(readings: DataFrame, incidents: DataFrame, windows: tuple[int, ...] = (6, 12, 24), chunk_hours: int = CHUNK_HOURS, **options) -> DataFrame:
    """Rolling features of readings, ``lookback`` of all incidents and ``labels`` of label events (is_label_event), on one time line.

    ``options`` are ``beside``, ``places`` and ``tasks`` of ``on_time_line``.
    """
    values = ("temperature_c", "pressure_bar", "voltage_mean_v", "rotation_mean_rpm", "pieces_produced")
    rows = on_time_line(readings, incidents, 168, max(HORIZONS), ("severity", "is_label_event", *FLAGS), halo=max(24, *windows), values=values, ever=True, chunk_hours=chunk_hours, **options)
    rolled = rolling_columns(windows, lambda h: line().rangeBetween(-h * HOUR, -1), value=lambda c: F.col(f"_m_{c}"))
    return _readings(rows, rolled | _past() | _ahead(F.col("_e_is_label_event"), HORIZONS), options.get("beside", ()))


def maintenance_lookback(readings: DataFrame, maintenance: DataFrame, chunk_hours: int = 720) -> DataFrame:
    """days_since_last_maintenance (strictly before t) and maintenance_count_30d, [t - 30d, t)."""
    rows = on_time_line(readings, maintenance, 720, event_at="maintenance_at", ever=True, chunk_hours=chunk_hours)
    return _readings(rows, {"days_since_last_maintenance": _since() / float(DAY), "maintenance_count_30d": _count(720)})


def nearby_incidents(outliers: DataFrame, incidents: DataFrame, hours: int = 24, chunk_hours: int = CHUNK_HOURS) -> DataFrame:
    """Outlier rows with the earliest incident of their machine within ``hours``, before or after, both ends included; ties go by incident_id.

    The least incident in a frame around each outlier, so no pairs are made. Returns machine_id, observed_at and the incident's columns.
    """
    columns = tuple(c for c in incidents.columns if c != "machine_id")
    rows = on_time_line(outliers.select("machine_id", "observed_at").distinct(), incidents, hours, hours, columns, chunk_hours=chunk_hours)
    order = [F.col(f"_e_{c}") for c in ("incident_id",) if c in columns]
    incident = F.when(F.col("_is_event"), F.struct("_us", *order, F.struct(*[F.col(f"_e_{c}").alias(c) for c in columns]).alias("_found")))
    near = _readings(rows, {"_near": F.min(incident).over(line().rangeBetween(-hours * HOUR, hours * HOUR))})
    return near.filter("_near IS NOT NULL").select("machine_id", "observed_at", "_near._found.*")


def hourly_counts(incidents: DataFrame) -> DataFrame:
    """(machine_id, hour, incidents, flag sums) at hour grain."""
    return incidents.groupBy("machine_id", F.date_trunc("hour", "occurred_at").alias("hour")).agg(F.count("*").alias("incidents"), *[F.sum(f).alias(f) for f in FLAGS])


def rolling_counts(hours: DataFrame, counted: DataFrame, rows: tuple[int, ...] = (24, 168)) -> DataFrame:
    """(machine_id, hour, incidents, incidents_{n}_rows): counts on a machine's hours, 0 where there is none, and sums over the last n rows."""
    both = hours.join(counted.select("machine_id", "hour", "incidents"), ["machine_id", "hour"], "left").withColumn("incidents", F.coalesce("incidents", F.lit(0)))
    return over_rows(both, max(rows) - 1, lambda w: {f"incidents_{n}_rows": F.sum("incidents").over(w.rowsBetween(1 - n, 0)) for n in rows}, order=("hour",))


def inclusive_labels(hours: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Labels by rows from the current one on, from (machine_id, hour, incidents): any incident counts."""
    sums = {h: f"future_incident_count_{h}h" for h in horizons}
    out = over_rows(hours, 0, lambda w: {n: F.sum("incidents").over(w.rowsBetween(0, h - 1)) for h, n in sums.items()}, order=("hour",), later=max(horizons) - 1)
    return out.withColumns({f"label_incident_next_{h}h": F.col(n) > 0 for h, n in sums.items()})
