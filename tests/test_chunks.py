"""Chunked time lines, row frames and quantiles against plain passes, with one machine that holds nearly all rows."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from test_operators import events, hours, readings

from forgeline.operators import profile, quantiles, reshape, timeline, windows
from forgeline.plans import medallion as M
from forgeline.plans.queries import QUERIES
from forgeline.schemas import FLAGS, HORIZONS, MEASURES
from forgeline.sources import adapters

DAY = 24 * windows.HOUR


@pytest.fixture(scope="module")
def long_rows():
    """(machine, hour, temperature): a machine with 90 % of the rows, over 60 days with pauses of weeks."""
    rnd = random.Random(11)
    out, h = [], 0.0
    for i in range(540):
        h += 300.0 if i in (200, 203) else rnd.choice([0.25, 1.0, 2.0, 5.0])
        out.append(("A", h, None if 300 < i < 350 or rnd.random() < 0.2 else round(rnd.uniform(-50, 50), 3)))
    return out + [(m, rnd.uniform(0, 1500), rnd.choice([None, rnd.uniform(0, 9)])) for m in "BC" for _ in range(30)] + [(None, 5.0, 1.0), (None, 6.0, 2.0)]


@pytest.fixture(scope="module")
def long_line(spark, long_rows):
    return readings(spark, long_rows).cache()


@pytest.fixture(scope="module")
def found(spark):
    rnd = random.Random(12)
    return events(spark, [(rnd.choice("AAAB"), hours(rnd.uniform(-900, 2000)), rnd.randint(1, 5)) for _ in range(40)] + [("A", hours(3.0), 5), ("A", hours(3.0), 2)]).cache()


def by_line(df, names):
    return {r["line_id"]: [None if r[n] is None else round(float(r[n]), 6) for n in names] for r in df.collect()}


def plain_line(long_line, found):
    """Look-back and labels with a machine in one window."""
    rows = long_line.select("machine_id", F.unix_micros("observed_at").alias("us"), F.lit(0).alias("e"), "line_id").unionByName(found.select("machine_id", F.unix_micros("occurred_at").alias("us"), F.lit(1).alias("e"), "severity", "is_label_event", *FLAGS), allowMissingColumns=True)
    w = Window.partitionBy("machine_id").orderBy("us")
    day, week, month = (w.rangeBetween(-d * DAY, -1) for d in (1, 7, 30))
    last = F.col("us") - F.max(F.when(F.col("e") == 1, F.col("us"))).over(w.rangeBetween(Window.unboundedPreceding, -1))
    new = {"incident_count_prev_24h": F.sum("e").over(day), "incident_max_severity_prev_24h": F.coalesce(F.max("severity").over(day), F.lit(0)), "incident_count_prev_7d": F.sum("e").over(week), "hours_since_last_incident": last / float(windows.HOUR), "days": last / float(DAY), "month": F.sum("e").over(month)}
    new |= {f"{f}_count_prev_24h": F.coalesce(F.sum(f).over(day), F.lit(0)) for f in FLAGS}
    new |= {f"label_failure_next_{h}h": F.count(F.when(F.col("is_label_event"), 1)).over(w.rangeBetween(1, h * windows.HOUR)) > 0 for h in HORIZONS}
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("incident_count_prev_24h", "incident_count_prev_7d", "month")}
    return rows.withColumns(new).withColumns(zero).filter("e = 0")


@pytest.mark.parametrize("chunk_hours", [48, 168, 5000])
def test_time_line_in_chunks(long_line, found, chunk_hours):
    plain = plain_line(long_line, found)
    names = ["incident_count_prev_24h", "incident_max_severity_prev_24h", "incident_count_prev_7d", "hours_since_last_incident", *[f"{f}_count_prev_24h" for f in FLAGS]]
    labels = [f"label_failure_next_{h}h" for h in HORIZONS]
    assert by_line(timeline.lookback(long_line, found, chunk_hours), names) == by_line(plain, names)
    assert by_line(timeline.labels(long_line, found.filter("is_label_event"), chunk_hours=chunk_hours), labels) == by_line(plain, labels)
    features = timeline.features(long_line, found, chunk_hours=chunk_hours)
    assert by_line(features, names + labels) == by_line(plain, names + labels)
    rolled = [c for c in windows.rolling(long_line).columns if c not in long_line.columns]
    assert by_line(features, rolled) == by_line(windows.rolling(long_line), rolled)
    kept = timeline.maintenance_lookback(long_line, found.withColumnRenamed("occurred_at", "maintenance_at"), chunk_hours)
    assert by_line(kept, ["days_since_last_maintenance", "maintenance_count_30d"]) == by_line(plain, ["days", "month"])


def test_time_line_spreads_a_machine(long_line, found):
    rows = timeline.on_time_line(long_line, found, 168, 48, ever=True)
    sizes = [r["count"] for r in rows.groupBy("machine_id", "_chunk").count().collect()]
    assert max(sizes) < 0.4 * sum(sizes)


def test_nearby_in_chunks(long_line, found):
    w = Window.partitionBy("line_id").orderBy("occurred_at", "incident_id")
    pairs = long_line.select("line_id", "machine_id", "observed_at").join(found, "machine_id").filter(F.abs(F.unix_micros("observed_at") - F.unix_micros("occurred_at")) <= DAY)
    want = {(r["machine_id"], r["observed_at"]): r["incident_id"] for r in pairs.withColumn("_n", F.row_number().over(w)).filter("_n = 1").collect()}
    for chunk_hours in (24, 100):
        near = timeline.nearby_incidents(long_line, found, chunk_hours=chunk_hours)
        assert {(r["machine_id"], r["observed_at"]): r["incident_id"] for r in near.collect()} == want
    assert "Join" not in near._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("size", [7, 200, 4096])
def test_row_frames_in_chunks(long_line, size):
    w = Window.partitionBy("machine_id").orderBy("observed_at")
    steps = {f"temp_{n}": F.col("temperature_c") - F.lag("temperature_c", k).over(w) for k, n in ((1, "delta_1h"), (3, "delta_3h"), (6, "trend_6h"))}
    assert by_line(windows.differences(long_line, size), list(steps)) == by_line(long_line.withColumns(steps), list(steps))
    last = w.rowsBetween(-23, 0)
    plain = long_line.withColumns({"temp_mean_24h": F.avg("temperature_c").over(last), "rotation_max_24h": F.max("rotation_mean_rpm").over(last), "pieces_produced_sum_24h": F.sum("pieces_produced").over(last)})
    names = ["temp_mean_24h", "rotation_max_24h", "pieces_produced_sum_24h"]
    assert by_line(windows.rolling_rows(long_line, (24,), size), names) == by_line(plain, names)
    last = w.rowsBetween(-167, 0)
    enough = F.count("temperature_c").over(last) >= 24
    plain = long_line.withColumns({"temperature_c_mean": F.when(enough, F.avg("temperature_c").over(last)), "temperature_c_std": F.when(enough, F.stddev_samp("temperature_c").over(last))}).withColumn("temperature_c_upper", F.col("temperature_c_mean") + 2 * F.col("temperature_c_std"))
    names = ["temperature_c_mean", "temperature_c_std", "temperature_c_upper"]
    assert by_line(windows.band(long_line, ["temperature_c", "pressure_bar"], size=size), names) == by_line(plain, names)


def test_row_numbers_and_frames_ahead(spark, long_line):
    rows = windows.ranked(long_line, {"nulls": F.col("temperature_c").isNull()}, chunk_hours=24)
    w = Window.partitionBy("machine_id").orderBy("observed_at")
    plain = long_line.withColumns({"_rank": F.row_number().over(w), "nulls": F.count_if(F.col("temperature_c").isNull()).over(w), "_all": F.count("*").over(Window.partitionBy("machine_id"))})
    assert by_line(rows, ["_rank", "nulls", "_all"]) == by_line(plain, ["_rank", "nulls", "_all"])
    counts = spark.createDataFrame([(m, hours(i), i % 7 % 3) for m in "AB" for i in range(100)], "machine_id string, hour timestamp, incidents long")
    w = Window.partitionBy("machine_id").orderBy("hour")
    for rows, names in ((windows.over_rows(counts, 0, lambda w: {"n": F.sum("incidents").over(w.rowsBetween(0, 5))}, 10, ("hour",), 5), ["n"]), (timeline.inclusive_labels(counts).withColumnRenamed("future_incident_count_6h", "n"), ["n"])):
        key = lambda df: sorted((r["machine_id"], r["hour"], r["n"]) for r in df.collect())
        assert key(rows) == key(counts.withColumn("n", F.sum("incidents").over(w.rowsBetween(0, 5))))


@pytest.mark.parametrize("size", [3, 50, 4096])
def test_interpolation_in_chunks(long_line, long_rows, size):
    got = by_line(windows.interpolate(long_line, ["temperature_c", "voltage_mean_v"], size=size), ["temperature_c", "voltage_mean_v"])
    table = pd.DataFrame([(i, m, h, t) for i, (m, h, t) in enumerate(long_rows)], columns=["i", "m", "h", "t"])
    for _, part in table.groupby("m", dropna=False):
        part = part.sort_values("h")
        for i, v in zip(part.i, part.t.astype(float).interpolate(limit_direction="both")):
            assert got[i] == [round(v, 6)] * 2


def test_null_runs_over_chunks(long_line, long_rows):
    got = {(r["machine_id"], r["column_name"]): (r["runs"], r["longest"], r["median_length"]) for r in windows.null_runs(long_line, list(MEASURES)).collect()}
    want = {}
    for m in ("A", "B", "C", None):
        lengths, run = [], 0
        for _, t in sorted((h, t) for n, h, t in long_rows if n == m):
            if t is None:
                run += 1
            elif run:
                lengths, run = [*lengths, run], 0
        lengths += [run] if run else []
        if lengths:
            want |= {(m, c): (len(lengths), max(lengths), float(np.median(lengths))) for c in MEASURES[:-1]}
    assert got == want


def test_autocorrelation_of_a_machine_cut_in_ten(spark, long_line, long_rows):
    for size in (54, 4096):
        got = {(r["machine_id"], r["column_name"], r["lag"]): r["acf"] for r in windows.autocorrelation(long_line, ["temperature_c", "pieces_produced"], size=size).collect()}
        for m in ("A", "B", None):
            x = np.array([t for _, t in sorted((h, t) for n, h, t in long_rows if n == m and t is not None)])
            x -= x.mean()
            for k in range(min(49, len(x))):
                assert got[m, "temperature_c", k] == pytest.approx((x[k:] * x[: len(x) - k]).sum() / (x * x).sum(), abs=1e-9)
            assert (m, "temperature_c", len(x)) not in got
        assert got["A", "pieces_produced", 3] is None  # does not vary


def test_gold_in_chunks_equals_one_chunk(spark, long_line, found):
    silver = M.silver_readings(long_line.filter("machine_id IS NOT NULL"))
    known = found.withColumnRenamed("incident_id", "incident_code")
    many, one = (M.gold(silver, known, chunk_hours=h, chunk_rows=n).toPandas().sort_values(["machine_id", "window_start"]).reset_index(drop=True) for h, n in ((48, 16), (10**6, 10**6)))
    pd.testing.assert_frame_equal(many, one)


def test_autocorrelation_of_small_changes_on_a_large_value(spark):
    rnd = random.Random(5)
    x = np.array([1e9 + rnd.random() for _ in range(60)])
    got = {r["lag"]: r["acf"] for r in windows.autocorrelation(readings(spark, [("A", float(h), float(v)) for h, v in enumerate(x)]), ["temperature_c"]).collect()}
    x -= x.mean()
    assert [got[k] for k in range(49)] == pytest.approx([(x[k:] * x[: len(x) - k]).sum() / (x * x).sum() for k in range(49)], abs=1e-5)


def test_wide_form_compares_lines_once_and_needs_no_limits(spark):
    rows = [("A", 0.0, 1.0), ("A", 0.0, 5.0), ("A", 1.0, None), ("B", 0.0, None)]
    wide = M.wide_readings(M.silver_readings(readings(spark, rows)))
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Subquery" not in plan  # no outlier limits, which the wide form does not read
    assert plan.index("Expand") < plan.index("Window")  # lines are compared before they become five rows
    assert {(r["machine_id"], r["temperature_c"]) for r in wide.collect()} == {("A", 1.0), ("A", None), ("B", None)}


def gold_and_plan(silver, found):
    rows = M.gold(silver, found.withColumnRenamed("incident_id", "incident_code"))
    return rows, rows._jdf.queryExecution().executedPlan().toString()


def test_large_tables_get_more_tasks(spark, long_line, found, monkeypatch):
    line = long_line.filter("machine_id IS NOT NULL")
    few, plan = gold_and_plan(M.silver_readings(line), found)
    assert "REPARTITION_BY_NUM" not in plan
    monkeypatch.setattr(windows, "TASK_ROWS", 100)
    assert windows.tasks_for(line) == 6 and windows.tasks_for(line.limit(200)) is None  # two partitions hold those
    silver = M.silver_readings(line, tasks=6)
    assert "6), REPARTITION_BY_NUM" in silver._jdf.queryExecution().executedPlan().toString()
    many, plan = gold_and_plan(silver, found)
    assert plan.count("6), REPARTITION_BY_NUM") == 3  # row numbers, differences, time line
    assert "ENSURE_REQUIREMENTS" not in plan[: plan.rindex("REPARTITION_BY_NUM")].split("Join")[0]  # windows need no exchange of their own
    few, many = (df.toPandas().sort_values(["machine_id", "window_start"]).reset_index(drop=True) for df in (few, many))
    pd.testing.assert_frame_equal(few, many)


def test_each_step_to_the_wide_form_is_dealt_by_rows(spark, long_line, monkeypatch):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    raw = adapters.raw_readings(spark, "/root/testdata/sf0.001")
    for grain in ("instant", "hour"):
        few, many = (M.bronze_readings(raw, grain, tasks) for tasks in (None, 6))
        assert plan(many).count("Exchange") == plan(many).count("6), REPARTITION_BY_NUM") == 1
        assert sorted(map(repr, few.collect())) == sorted(map(repr, many.collect()))
    line = long_line.unionByName(long_line.filter("machine_id = 'B'"))
    few, many = (M.wide_readings(M.silver_readings(line, tasks=tasks)) for tasks in (None, 6))
    assert plan(many).count("Exchange") == plan(many).count("6), REPARTITION_BY_NUM") == 1  # the means of a key are found where its lines were compared
    assert sorted(map(repr, few.collect())) == sorted(map(repr, many.collect()))
    silver = M.silver_readings(line, tasks=6)
    assert silver.schema == M.silver_readings(line).schema and sorted(map(repr, silver.collect())) == sorted(map(repr, M.silver_readings(line).collect()))
    cuts = reshape.cut_points(line, "observed_at", tasks=6)
    assert plan(cuts).count("6), REPARTITION_BY_NUM") == 2 and cuts.first() == reshape.cut_points(line, "observed_at").first()  # counts, ranks
    names = ("a_train_statistics", "p_pivot", "q_duplicate_hours")
    few = {n: sorted(map(repr, QUERIES[n](spark, "/root/testdata/sf0.001").collect())) for n in names}
    monkeypatch.setattr(windows, "TASK_ROWS", 100)
    written = []
    monkeypatch.setattr(reshape, "dealt", lambda df, tasks, *keys: written.append(tasks) or windows.dealt(df, tasks, *keys))
    assert {n: sorted(map(repr, QUERIES[n](spark, "/root/testdata/sf0.001").collect())) for n in names} == few
    assert written and all(written)


def test_gold_joins_statistics_before_rows_are_wide(spark, long_line, found):
    silver = M.silver_readings(long_line.filter("machine_id IS NOT NULL"))
    rows, plan = gold_and_plan(silver, found)
    assert plan.count("lag(") > 0 and len([x for x in plan.splitlines() if "Window [" in x and "lag(" in x]) == 1  # the chunks are found without the differences
    at = [i for i, x in enumerate(plan.splitlines()) if "Join" in x and "LeftOuter" in x]
    line = next(i for i, x in enumerate(plan.splitlines()) if "Window [" in x and "temp_mean_6h" in x)
    assert len(at) == 1 and at[0] > line  # printed from the last step to the first
    plain = rows.select("temp_mean_24h", "label_failure_next_24h")._jdf.queryExecution().executedPlan().toString()
    assert "LeftOuter" not in plain  # nothing reads the statistics


# --- quantiles -----------------------------------------------------------------------------------------------------

ODD = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.0, -1.0, 1 - 2**-53, 1 + 2**-52, 2.0**31, 1.7976931348623157e308, -1.7976931348623157e308, float("inf"), float("-inf"), 8.0, 7.999999999999999, 1e-300, 1e300, 3.0]


def test_order_keys_are_the_bits(spark):
    rnd = np.random.default_rng(1)
    xs = ODD + rnd.normal(0, 1e3, 300).tolist() + (2.0 ** rnd.integers(-1070, 1023, 300)).tolist() + rnd.integers(1, 2**62, 300).view(np.float64).tolist()
    rows = quantiles.with_order_key(spark.createDataFrame([(x,) for x in xs], "x double"), "x", "k").collect()
    for r in rows:
        bits = int(np.array(abs(r["x"])).view(np.int64))
        assert r["k"] == (-bits if r["x"] < 0 else bits)
    both = quantiles.with_order_key(spark.createDataFrame([(float("nan"),), (None,)], "x double"), "x", "k").collect()
    assert both[0]["k"] > 2047 << 52 and both[1]["k"] is None


def test_quantiles_equal_numpy(spark):
    rnd = np.random.default_rng(2)
    groups = {
        "normal": rnd.normal(0, 100, 501), "ties": rnd.integers(0, 3, 300).astype(float), "one": np.array([4.5]), "two": np.array([1.0, 2.0]), "near": 1 + rnd.integers(0, 50, 200) * 2.0**-52,
        "wide": rnd.choice([-1, 1], 200) * 10.0 ** rnd.integers(-200, 200, 200), "ends": np.array(ODD[:13]),
    }
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("none", None), ("one", None), (None, 2.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "g string, value double").repartition(4)
    shares = (0.0, 0.25, 0.5, 0.7, 1.0)
    for few in (True, False):
        got = {r["g"]: (r["n"], r["q"]) for r in quantiles.quantiles(df, ["g"], shares, few).collect()}
        assert set(got) == {*groups, None} and got[None] == (2, [2.0, 2.5, 3.0, 3.4, 4.0])
        for g, xs in groups.items():
            assert got[g][0] == len(xs)
            assert got[g][1] == pytest.approx(np.quantile(xs, shares).tolist(), rel=1e-12)
    assert quantiles.quantiles(df, [], (0.5,), True).first()["n"] == len(rows) - 2
    assert quantiles.quantiles(df.limit(0), ["g"], (0.5,), True).count() == quantiles.quantiles(df.limit(0), [], (0.5,), True).count() == 0


def test_one_value_repeated_a_million_times(spark):
    df = spark.range(1_000_000).select(F.lit(7.25).alias("value")).union(spark.range(10).select((F.col("id") * 1.0).alias("value")))
    assert quantiles.quantiles(df, [], (0.0, 0.25, 0.5, 0.75, 1.0), True).first()["q"] == [0.0, 7.25, 7.25, 7.25, 9.0]


def test_profiles_by_selection(spark):
    df = spark.createDataFrame([(float(i), None) for i in range(101)], "x double, nothing double")
    got = {r["column_name"]: r for r in profile.summary(df, ["x", "nothing"]).collect()}
    assert (got["x"]["q1"], got["x"]["median"], got["x"]["q3"]) == (25.0, 50.0, 75.0)
    assert got["nothing"]["n"] == 0 and got["nothing"]["q1"] is None
    assert profile.bounds(df, ["x"], approx=True).first()["q1"] == pytest.approx(25, abs=1)
    flagged = profile.flag_outliers(df.select(F.lit("s").alias("sensor_type"), F.col("x").alias("sensor_value")).union(spark.createDataFrame([("s", 1e6), ("t", None)], "sensor_type string, sensor_value double")))
    assert [r["sensor_value"] for r in flagged.filter("is_outlier").collect()] == [1e6]
    empty = spark.createDataFrame([], "at timestamp")
    assert reshape.row_quantile_cuts(empty, "at").first()["cut_1"] is None


def test_running_sums(spark):
    rnd = np.random.default_rng(3)
    keys = np.unique(np.concatenate([rnd.integers(-(2**62), 2**62, 200), rnd.integers(-5, 5, 30), rnd.integers(2**43, 2**43 + 3000, 200)]))
    df = spark.createDataFrame([(int(k), int(k) % 7) for k in keys], "k long, v long").repartition(5)
    got = {r["k"]: (r["s"], r["n"]) for r in quantiles.running_sums(df.withColumn("one", F.lit(1)), "k", {"s": "v", "n": "one"}).collect()}
    assert got == {int(k): (int(s), i + 1) for i, (k, s) in enumerate(zip(keys, np.cumsum(keys % 7)))}
