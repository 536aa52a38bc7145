"""Operators on small hand-made rows: the edge cases that the given tables lack."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from forgeline.functions import scalars as S
from forgeline.operators import modelling, profile, quality, reshape, timeline, windows
from forgeline.plans import medallion as M
from forgeline.schemas import FLAGS, MEASURES, TELEMETRY, gold_columns
from forgeline.sources import files

T0 = dt.datetime(2024, 1, 1)


def hours(h: float) -> dt.datetime:
    return T0 + dt.timedelta(hours=h)


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def values(df, c):
    return [r[0] for r in df.orderBy("i").select(c).collect()]


def test_lenient_numbers(spark):
    df = column(spark, ["4.0", " 4 ", "+4", "4.5", "1e3", "1,5", "", "nan", "inf", "NA", None])
    assert values(df, S.lenient_int(F.col("x"))) == [4, 4, 4, None, None, None, None, None, None, None, None]
    assert values(df, S.lenient_double(F.col("x"))) == [4, 4, 4, 4.5, 1000, None, None, None, None, None, None]


def test_text_functions(spark):
    df = column(spark, [" mach-01 ", "", "  ", None])
    assert values(df, S.identifier(F.col("x"))) == ["MACH-01", "", "", None]
    assert values(df, S.blank_to_null(F.col("x"))) == ["mach-01", None, None, None]


def test_week_labels_and_rounding(spark):
    df = column(spark, [dt.datetime(2025, 12, 29), dt.datetime(2027, 1, 1)], "timestamp")
    assert values(df, S.week_label(F.col("x"))) == ["2025-W01", "2027-W53"]
    assert values(column(spark, [0.125, 0.375, 2.5, -0.125, 1.005], "double"), F.bround("x", 2)) == [0.12, 0.38, 2.5, -0.12, 1.0]


def test_pseudonyms(spark):
    df = column(spark, ["Anna", None])
    import hashlib

    assert values(df, S.pseudonym(F.col("x"), "s")) == ["OP_ANON_" + hashlib.sha256(b"s:Anna").hexdigest()[:8].upper(), None]
    assert values(df, S.badge_hash(F.col("x"), F.lit(" B1 "))) == [hashlib.sha256(b"anna|b1").hexdigest()[:16], hashlib.sha256(b"none|b1").hexdigest()[:16]]


def telemetry(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "line_id int, " + ", ".join(f"{c} string" for c in TELEMETRY))


def test_row_rules(spark):
    good = ("M", "2024-01-01 00:00:00", "1", "1", "1", "1", "1")
    df = telemetry(spark, [good, ("", *good[1:]), ("M", "soon", *good[2:]), (*good[:2], "500.01", "-1", "x", "1", "4.5"), (*good[:2], "nan", *good[3:]), (*good[:2], None, None, None, None, None)])
    got = [r[0] for r in quality.validate_telemetry(df).orderBy("line_id").select("parse_ok_reason").collect()]
    assert got == [None, "machine_id:REQUIRED", "timestamp:TYPE", "temperature_c:RANGE | pressure_bar:RANGE | voltage_mean_v:TYPE | pieces_produced:TYPE", "temperature_c:TYPE", None]


def test_contract(spark):
    with pytest.raises(ValueError, match="timestamp"):
        quality.validate_telemetry(spark.createDataFrame([("M",)], "machine_id string"))


def test_duplicates_reject_all_copies(spark):
    ok, bad = ("1", "1", "1", "1", "1"), ("501", "1", "1", "1", "1")
    rows = [("M", "2024-01-01 00:00:00", *ok)] * 3 + [("M", "2024-01-01 00:00:00", *bad), ("M", "2024-01-01 01:00:00", *ok), ("M", "2024-01-01 01:00:00", *bad), ("M", "2024-01-01 01:15:00", *ok)]
    df = quality.validate_telemetry(telemetry(spark, rows))
    got = [r[0] for r in quality.reject_duplicates(df).orderBy("line_id").select("parse_ok_reason").collect()]
    assert got == ["DOUBLON_HORAIRE:3"] * 3 + ["temperature_c:RANGE", None, "temperature_c:RANGE", None]
    by_hour = [r[0] for r in quality.reject_duplicates(df, "hour").orderBy("line_id").select("parse_ok").collect()]
    assert by_hour == [False] * 7


def test_upsert(spark):
    old, new = (spark.createDataFrame(r, "k string, v int") for r in ([("a", 1), ("b", 1), (None, 1)], [("b", 2), ("c", 2), (None, 2)]))
    assert sorted(map(tuple, files.upsert(old, new, ["k"]).collect()), key=str) == sorted([("a", 1), ("b", 2), ("c", 2), (None, 1), (None, 2)], key=str)


def readings(spark, rows):
    """rows: (machine, hour, temperature)"""
    return spark.createDataFrame([(i, m, hours(h), t, t, t, t, 1) for i, (m, h, t) in enumerate(rows)], "line_id long, machine_id string, observed_at timestamp, " + ", ".join(f"{c} double" for c in MEASURES[:-1]) + ", pieces_produced int")


def test_rolling_excludes_now_and_includes_the_far_end(spark):
    df = readings(spark, [("A", 0, 1.0), ("A", 6, 3.0), ("A", 6.5, 5.0), ("A", 40, 7.0)])
    got = [tuple(r) for r in windows.rolling(df).orderBy("line_id").select("temp_mean_6h", "temp_std_6h", "temp_max_24h").collect()]
    assert got == [(None, None, None), (1.0, None, 1.0), (3.0, None, 3.0), (None, None, None)]


def test_chunked_rolling_equals_plain(spark):
    rnd = random.Random(3)
    df = readings(spark, [(rnd.choice("AB"), rnd.uniform(0, 900), rnd.choice([None, rnd.random() * 100])) for _ in range(300)])
    names = [c for c in windows.rolling(df).columns if c not in df.columns]
    key = lambda x: {r["line_id"]: [None if r[n] is None else round(r[n], 6) for n in names] for r in x.collect()}
    assert key(windows.rolling(df)) == key(windows.rolling_chunked(df, chunk_hours=24)) == key(windows.rolling_chunked(df, chunk_hours=100))


def test_interpolation_equals_pandas(spark):
    for series in ([None, 1.0, None, None, 4.0, None], [None, None], [2.0], [1.0, None, 2.0, None, None, 5.0]):
        df = readings(spark, [("A", i, v) for i, v in enumerate(series)])
        got = [r[0] for r in windows.interpolate(df, ["temperature_c"]).orderBy("line_id").select("temperature_c").collect()]
        want = pd.Series(series, dtype=float).interpolate(limit_direction="both").tolist()
        assert np.allclose(np.array(got, dtype=float), want, equal_nan=True)


def test_null_runs_stay_in_their_machine(spark):
    df = readings(spark, [("A", 0, None), ("A", 1, None), ("A", 2, 1.0), ("A", 3, None), ("B", 0, None)])
    assert {tuple(r) for r in windows.null_runs(df, ["temperature_c", "pressure_bar"]).filter("column_name = 'temperature_c'").drop("column_name").collect()} == {("A", 2, 2, 1.5), ("B", 1, 1, 1.0)}


def test_differences_count_rows(spark):
    df = readings(spark, [("A", 0, 1.0), ("A", 30, 4.0)])
    assert [r[0] for r in windows.differences(df).orderBy("line_id").select("temp_delta_1h").collect()] == [None, 3.0]


def events(spark, rows):
    """rows: (machine, occurred_at, severity)"""
    data = [(f"I{i}", m, at, s, s >= 4, "matin", *([1] + [0] * 8)) for i, (m, at, s) in enumerate(rows)]
    return spark.createDataFrame(data, "incident_id string, machine_id string, occurred_at timestamp, severity int, is_label_event boolean, shift string, " + ", ".join(f"{f} int" for f in FLAGS))


def test_time_line_borders(spark):
    one = dt.timedelta(microseconds=1)
    df = readings(spark, [("A", 100, 1.0), ("B", 100, 1.0)])
    found = events(spark, [("A", hours(100), 5), ("A", hours(100) - one, 2), ("A", hours(76), 3), ("A", hours(76) - one, 1), ("A", hours(106), 4)])
    back = {r["machine_id"]: r for r in timeline.lookback(df, found).collect()}
    assert back["A"]["incident_count_prev_24h"] == 2 and back["A"]["incident_max_severity_prev_24h"] == 3 and back["A"]["incident_count_prev_7d"] == 3
    assert back["A"]["type_surchauffe_count_prev_24h"] == 2 and back["A"]["hours_since_last_incident"] == pytest.approx(1 / 3.6e9)
    assert back["B"]["incident_count_prev_24h"] == 0 and back["B"]["hours_since_last_incident"] is None
    ahead = {r["machine_id"]: r for r in timeline.labels(df, found.filter("is_label_event")).collect()}
    assert ahead["A"]["label_failure_next_6h"] and not ahead["B"]["label_failure_next_48h"]
    early = timeline.labels(readings(spark, [("A", 100 - 1 / 3.6e9, 1.0)]), found.filter("is_label_event")).first()
    assert early["label_failure_next_6h"]


def test_time_line_equals_brute_force(spark):
    rnd = random.Random(5)
    rows, found = [(rnd.choice("AB"), rnd.uniform(0, 400), 1.0) for _ in range(120)], [(rnd.choice("AB"), hours(rnd.uniform(0, 400)), rnd.randint(1, 5)) for _ in range(40)]
    got = {r["line_id"]: r for r in timeline.features(readings(spark, rows), events(spark, found)).collect()}
    for i, (m, h, _) in enumerate(rows):
        t = got[i]["observed_at"]
        day = [s for n, at, s in found if n == m and t - dt.timedelta(days=1) <= at < t]
        assert got[i]["incident_count_prev_24h"] == len(day) and got[i]["incident_max_severity_prev_24h"] == max(day, default=0)
        for k in (6, 12, 24, 48):
            assert got[i][f"label_failure_next_{k}h"] == any(n == m and s >= 4 and t < at <= t + dt.timedelta(hours=k) for n, at, s in found)


def test_nearby_keeps_the_earliest(spark):
    df = readings(spark, [("A", 100, 1.0), ("A", 200, 1.0)])
    found = events(spark, [("A", hours(124), 5), ("A", hours(76), 2), ("A", hours(75.99), 1), ("B", hours(100), 1)])
    got = timeline.nearby_incidents(df, found).collect()
    assert [(r["observed_at"], r["severity"]) for r in got] == [(hours(100), 2)]


def test_cuts_truncate_as_doubles(spark):
    for n, first in ((10, 7), (90, 62)):
        df = spark.range(n).select(F.timestamp_micros(F.col("id") * 3_600_000_000).alias("t")).union(spark.range(1).select(F.timestamp_micros(F.lit(0).cast("long"))))
        assert reshape.cut_points(df, "t").first()["cut_1"] == dt.datetime(1970, 1, 1) + dt.timedelta(hours=first)


def test_zero_deviation_and_flat_columns(spark):
    df = readings(spark, [("A", 0, 2.0), ("A", 1, 2.0), ("A", 2, 2.0)])
    assert df.select(windows.z_score(F.col("temperature_c"), F.lit(1.0), F.lit(0.0)).alias("z")).first()["z"] is None
    flat = readings(spark, [("A", i, 1.0 if i == 4 else 0.0) for i in range(12)])
    assert [r[0] for r in profile.clean(flat, ["temperature_c"]).orderBy("line_id").select("temperature_c").collect()][4] == 1.0
    assert [r[0] for r in profile.clean(flat, ["temperature_c"], binary=True).orderBy("line_id").select("temperature_c").collect()][4] == 0.0


def test_operators_of_null_names(spark):
    rows = [(0, "Al ", "B1"), (1, "al", "B2"), (2, None, "B3")]
    df = spark.createDataFrame(rows, "line_id int, operator_name string, operator_badge string")
    assert [r["operator_key"] for r in M.operators(df).collect()] == ["al"]


def machine_days(spark, change_after: float | None = None):
    rnd = random.Random(9)
    rows = [(m, h, rnd.random() * 50) for m in "AB" for h in range(0, 120, 2)]
    rows = [(m, h, t + 100 if change_after is not None and h >= change_after else t) for m, h, t in rows]
    silver = M.silver_readings(readings(spark, rows))
    found = events(spark, [("A", hours(30.5), 5), ("B", hours(90.5), 4)]).withColumnRenamed("incident_id", "incident_code")
    return M.gold(silver, found)


def test_gold_has_its_columns_and_does_not_leak(spark):
    plain, changed = machine_days(spark).toPandas(), machine_days(spark, 100).toPandas()
    assert list(plain.columns) == gold_columns() and len(gold_columns()) == 78
    early = [f[f.window_start < pd.Timestamp(hours(100))].sort_values(["machine_id", "window_start"]).reset_index(drop=True) for f in (plain, changed)]
    pd.testing.assert_frame_equal(*early)
    order = plain.groupby("split_set").window_start.agg(["min", "max"])
    assert order.loc["train", "max"] < order.loc["validation", "min"] and order.loc["validation", "max"] < order.loc["test", "min"]
    for a, b in ((6, 12), (12, 24), (24, 48)):
        assert (plain[f"label_failure_next_{a}h"] <= plain[f"label_failure_next_{b}h"]).all()


def test_evaluation(spark):
    df = spark.createDataFrame([(1, 0.9, 1), (0, 0.8, 1), (1, 0.7, 0), (0, 0.1, 0)], "label int, score double, predicted int")
    c = modelling.cost(modelling.confusion(df)).first()
    assert (c["tp"], c["fp"], c["fn"], c["tn"], c["cost_total"]) == (1, 1, 1, 1, 10_500.0)
    assert modelling.area_under_curve(df).first()["auc"] == 0.75
    assert modelling.recall_at(df, 0.6).first()["recall"] == 1.0
    assert modelling.confusion(df.limit(0)).first()["precision"] is None


def test_empty_tables(spark):
    df = readings(spark, [("A", 0, 1.0)]).limit(0)
    assert windows.rolling(df).count() == windows.autocorrelation(df, ["temperature_c"]).count() == reshape.to_long(df, ["line_id"]).count() == 0
    assert timeline.lookback(df, events(spark, [("A", hours(1), 1)]).limit(0)).count() == 0
    assert profile.summary(df, ["temperature_c"]).count() == 0


def test_correlated_columns(spark):
    df = spark.range(50).select(F.col("id").cast("double").alias("a"), (F.col("id") * 2.0).alias("b"), F.rand(1).alias("c"))
    assert modelling.correlated(df, ["a", "b", "c"]) == ["b"]


def test_rejected_duplicates(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2), (None, 5), (None, 4), ("a", 7)], "k string, line long")
    rows = {tuple(r) for r in quality.rejected_duplicates(df, ["k"], "line").collect()}
    assert rows == {("a", 3, 1, 2), ("a", 7, 1, 3), (None, 5, 4, 2)}
    assert quality.keep_first(df, ["k"], "line").count() + len(rows) == df.count()


def test_sensor_outliers(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [("m", at + dt.timedelta(hours=i), float(i % 4), None if i == 3 else 1.0) for i in range(40)]
    rows += [("m", at, 99.0, 1.0), ("n", at, None, 5.0), ("n", at + dt.timedelta(hours=1), None, None)]
    df = spark.createDataFrame(rows, "machine_id string, observed_at timestamp, x double, y double")
    got = profile.sensor_outliers(df, ["x", "y"])
    assert {tuple(r) for r in got.collect()} == {("m", at, True, False), ("n", at, False, True)}
    assert {tuple(r) for r in profile.by_sensor(got, ["x", "y"], ["machine_id"]).collect()} == {("m", "x"), ("n", "y")}
    assert profile.sensor_outliers(df.limit(0), ["x", "y"]).count() == 0
