"""Profiles and reports: summaries, outliers, correlations, co-occurrence, histograms."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forgeline.functions.scalars import week_label
from forgeline.operators.quantiles import quantiles
from forgeline.operators.windows import interpolate
from forgeline.schemas import FLAGS, SHIFTS


def long_form(df: DataFrame, columns: list[str], ids: list[str] | None = None) -> DataFrame:
    """(ids, column_name, value: double)."""
    ids = ids or []
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(ids, columns, "column_name", "value")


def quartiles(values: DataFrame, keys: list[str], value: str = "value", approx: bool = False, few: bool = True) -> DataFrame:
    """(keys, q1, median, q3), exact with linear interpolation or, in one pass, approximate; see ``quantiles`` for ``few``."""
    shares = (0.25, 0.5, 0.75)
    if approx:
        found = values.groupBy(*keys).agg(F.percentile_approx(F.col(value).cast("double"), list(shares), 10_000).alias("q"))
    else:
        found = quantiles(values, keys, shares, few, value)
    return found.select(*keys, *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("q1", "median", "q3"))])


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """n, mean, std, min, q1, median, q3, max of each column."""
    rows = long_form(df, columns)
    sums = rows.groupBy("column_name").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    return sums.join(F.broadcast(quartiles(rows, ["column_name"])), "column_name", "left").select("column_name", "n", "mean", "std", "min", "q1", "median", "q3", "max")  # a row a column


def counts(df: DataFrame, *keys: str | Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def counts_by_week(df: DataFrame, at: str) -> DataFrame:
    return counts(df, week_label(F.col(at)).alias("week"))


def counts_in_order(df: DataFrame, c: str, categories: tuple[str, ...] = SHIFTS) -> DataFrame:
    """(position, category, n) of all categories, 0 for absent ones."""
    rows = df.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, categories))).alias("position", "category"))
    return rows.join(counts(df, F.col(c).alias("category")), "category", "left").select("position", "category", F.coalesce("n", F.lit(0)).alias("n"))


def flag_confidence(df: DataFrame, flags: tuple[str, ...] = FLAGS, comment: str = "comment") -> DataFrame:
    """(flag, incidents, confidence): sums, and the percentage with a comment, 0 if there is none."""
    packed = df.agg(*[F.struct(F.sum(f).alias("n"), F.sum(F.when(F.col(comment).isNotNull(), F.col(f)).otherwise(0)).alias("c")).alias(f) for f in flags])
    rows = packed.unpivot([], list(flags), "flag", "x")
    n, c = F.coalesce("x.n", F.lit(0)), F.coalesce("x.c", F.lit(0))
    return rows.select("flag", n.alias("incidents"), F.when(n > 0, F.bround(c * 100.0 / n, 1)).otherwise(0.0).alias("confidence"))


def count_and_mean(df: DataFrame, key: str, c: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"), F.avg(c).alias("mean")).orderBy(F.desc("n"), key)


def top_flags_by_week(df: DataFrame, at: str, n: int = 5, flags: tuple[str, ...] = FLAGS) -> DataFrame:
    """(flag, week, incidents) of the n commonest flags; ties by name."""
    rows = df.select(week_label(F.col(at)).alias("week"), *flags).unpivot("week", list(flags), "flag", "x").groupBy("flag", "week").agg(F.sum("x").alias("incidents"))
    top = rows.groupBy("flag").agg(F.sum("incidents").alias("_t")).orderBy(F.desc("_t"), "flag").limit(n)
    return rows.join(F.broadcast(top.select("flag")), "flag", "left_semi")


def extremes(df: DataFrame, key: str, n: str = "n") -> DataFrame:
    """(busiest, most, calmest, least); ties go to the smallest key."""
    return df.agg(F.min_by(key, F.struct(-F.col(n), F.col(key))).alias("busiest"), F.max(n).alias("most"), F.min_by(key, F.struct(n, key)).alias("calmest"), F.min(n).alias("least"))


def monthly_means(df: DataFrame, columns: list[str], at: str = "observed_at", by: str = "machine_id") -> DataFrame:
    return df.groupBy(F.last_day(at).alias("month_end"), by).agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])


def monthly_stop_rate(df: DataFrame, stopped: str, at: str = "observed_at", by: str = "machine_id") -> DataFrame:
    return df.groupBy(F.last_day(at).alias("month_end"), by).agg((F.avg(F.col(stopped).cast("int")) * 100).alias("stop_rate"))


def bounds(df: DataFrame, columns: list[str], factor: float = 3.0, approx: bool = False) -> DataFrame:
    """(column_name, q1, q3, low, high): one row a column."""
    reach = factor * (F.col("q3") - F.col("q1"))
    return quartiles(long_form(df, columns), ["column_name"], approx=approx).drop("median").withColumns({"low": F.col("q1") - reach, "high": F.col("q3") + reach})


def outlier_report(df: DataFrame, columns: list[str], factor: float = 3.0, approx: bool = False) -> DataFrame:
    """(column_name, low, high, outliers). The bounds are one row a column and joined to the values."""
    limits = bounds(df, columns, factor, approx)
    outside = (F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))
    return long_form(df, columns).join(F.broadcast(limits), "column_name").groupBy("column_name", "low", "high").agg(F.count(F.when(outside, 1)).alias("outliers"))


def flagged_instants(df: DataFrame, outside: dict[str, Column]) -> DataFrame:
    """(machine_id, observed_at, outlier_<column>...): instants at which any condition holds, readings of one instant together."""
    rows = df.groupBy("machine_id", "observed_at").agg(*[F.coalesce(F.bool_or(o), F.lit(False)).alias(f"outlier_{c}") for c, o in outside.items()])
    return rows.filter(" OR ".join(f"outlier_{c}" for c in outside))


def sensor_outliers(df: DataFrame, columns: list[str], factor: float = 3.0) -> DataFrame:
    """``flagged_instants`` of the columns that lie outside their bounds."""
    limits = bounds(df, columns, factor).agg(F.map_from_entries(F.collect_list(F.struct("column_name", F.struct("low", "high")))).alias("_limits"))
    limit = {c: F.element_at("_limits", F.lit(c)) for c in columns}
    return flagged_instants(df.join(F.broadcast(limits), F.lit(True)), {c: (F.col(c) < x["low"]) | (F.col(c) > x["high"]) for c, x in limit.items()})


def sensor_peaks(df: DataFrame, columns: list[str], share: float = 0.9) -> DataFrame:
    """``flagged_instants`` of the columns that lie above the quantile at ``share``."""
    limits = quantiles(long_form(df, columns), ["column_name"], (share,), few=True).agg(F.map_from_entries(F.collect_list(F.struct("column_name", F.get("q", F.lit(0))))).alias("_limits"))
    return flagged_instants(df.join(F.broadcast(limits), F.lit(True)), {c: F.col(c) > F.element_at("_limits", F.lit(c)) for c in columns})


def by_sensor(flagged: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """(sensor_type, *keep): a row for each column that is an outlier there."""
    rows = flagged.select(*keep, F.explode(F.array(*[F.when(F.col(f"outlier_{c}"), F.lit(c)) for c in columns])).alias("sensor_type"))
    return rows.filter("sensor_type IS NOT NULL")


def severity_counts(matched: DataFrame, severity: str = "severity", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, severity, n) of the matched incidents."""
    return counts(matched, *by, F.col(severity).alias("severity"))


def flag_outliers(df: DataFrame, factor: float = 1.5, group: str = "sensor_type", value: str = "sensor_value", approx: bool = False) -> DataFrame:
    """is_outlier by the quartiles of the row's group; null values are none. Groups are few, such as sensors.

    The limits are one value, a map by group: where nothing reads is_outlier, Spark leaves them out.
    """
    reach = factor * (F.col("q3") - F.col("q1"))
    limits = quartiles(df.select(group, value), [group], value, approx).filter(F.col(group).isNotNull())
    each = F.struct(F.col(group), F.struct((F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high")))
    limit = F.element_at(limits.agg(F.map_from_entries(F.collect_list(each)).alias("_limits")).scalar(), F.col(group))
    outside = (F.col(value) < limit["low"]) | (F.col(value) > limit["high"])
    return df.withColumn("is_outlier", F.coalesce(outside, F.lit(False)))


def clean(df: DataFrame, columns: list[str], factor: float = 3.0, binary: bool = False, digits: int | None = 2) -> DataFrame:
    """Outliers to null, interpolated by machine, rounded to ``digits`` (None: not at all) with ties to even.

    Columns whose quartiles are equal (such as rare flags) are left alone unless ``binary``.
    """
    packed = bounds(df, columns, factor).agg(F.map_from_entries(F.collect_list(F.struct("column_name", F.struct("q1", "q3", "low", "high")))).alias("_limits"))
    rows = df.join(F.broadcast(packed), F.lit(True))
    for c in columns:
        limit = F.element_at("_limits", F.lit(c))
        outside = (F.col(c) < limit["low"]) | (F.col(c) > limit["high"])
        outside = outside if binary else outside & (limit["q1"] != limit["q3"])
        rows = rows.withColumn(c, F.when(~F.coalesce(outside, F.lit(False)), F.col(c).cast("double")))
    filled = interpolate(rows.drop("_limits"), columns)
    return filled.withColumns({c: F.bround(c, digits) for c in columns}) if digits is not None else filled


def before_after(before: DataFrame, after: DataFrame, columns: list[str], factor: float = 3.0) -> DataFrame:
    """(column_name, outliers_before, outliers_after, reduction): bounds are computed on each; null without outliers before."""
    a = outlier_report(before, columns, factor).select("column_name", F.col("outliers").alias("outliers_before"))
    b = outlier_report(after, columns, factor).select("column_name", F.col("outliers").alias("outliers_after"))
    n, m = F.col("outliers_before"), F.col("outliers_after")
    return a.join(b, "column_name").withColumn("reduction", F.when(n > 0, F.bround((n - m) * 100.0 / n, 1)))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) of all pairs in one aggregation, each over the rows where both are there."""
    pairs = list(combinations(columns, 2))
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}") for a, b in pairs])
    rows = one.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "r")
    return rows.select(F.split_part("pair", F.lit("|"), F.lit(1)).alias("a"), F.split_part("pair", F.lit("|"), F.lit(2)).alias("b"), "r")


def co_occurrence(df: DataFrame, flags: tuple[str, ...] = FLAGS) -> DataFrame:
    """(a, b, n) of all pairs in one aggregation."""
    pairs = list(combinations(flags, 2))
    one = df.agg(*[F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0)).alias(f"{a}|{b}") for a, b in pairs])
    rows = one.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "n")
    return rows.select(F.split_part("pair", F.lit("|"), F.lit(1)).alias("a"), F.split_part("pair", F.lit("|"), F.lit(2)).alias("b"), "n")


def nulls_by_machine(df: DataFrame, columns: list[str]) -> DataFrame:
    """(machine_id, column_name, nulls) above 0, most first."""
    per = df.groupBy("machine_id").agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns])
    return per.unpivot("machine_id", columns, "column_name", "nulls").filter("nulls > 0").orderBy(F.desc("nulls"), "machine_id", "column_name")


def nulls_during_stops(df: DataFrame, columns: list[str], stopped: str) -> DataFrame:
    """(column_name, nulls, during_stops, share in %); null share without nulls."""
    rows = df.agg(*[F.struct(F.count(F.when(F.col(c).isNull(), 1)).alias("n"), F.count(F.when(F.col(c).isNull() & F.col(stopped), 1)).alias("s")).alias(c) for c in columns]).unpivot([], columns, "column_name", "x")
    return rows.select("column_name", F.col("x.n").alias("nulls"), F.col("x.s").alias("during_stops"), F.when(F.col("x.n") > 0, F.col("x.s") * 100.0 / F.col("x.n")).alias("share"))


def outlier_types(matched: DataFrame, sensor: str = "sensor_type", flags: tuple[str, ...] = FLAGS) -> DataFrame:
    """(sensor, flag, share): % of a sensor's matched outliers whose incident has the flag, to 1 decimal."""
    rows = matched.select(sensor, *flags).unpivot(sensor, list(flags), "flag", "x")
    return rows.groupBy(sensor, "flag").agg(F.bround(F.avg(F.col("x").cast("double")) * 100, 1).alias("share"))


def histogram(df: DataFrame, columns: list[str], bins: int = 50) -> DataFrame:
    """(column_name, bin, n): equal bins between minimum and maximum, the last one closed; a constant column has bin 0."""
    rows = long_form(df, columns).filter("value IS NOT NULL")
    ends = rows.groupBy("column_name").agg(F.min("value").alias("_a"), F.max("value").alias("_b"))
    at = F.when(F.col("_b") > F.col("_a"), F.least(F.floor((F.col("value") - F.col("_a")) * bins / (F.col("_b") - F.col("_a"))), F.lit(bins - 1))).otherwise(F.lit(0))
    return rows.join(F.broadcast(ends), "column_name").groupBy("column_name", at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def box_plots(df: DataFrame, columns: list[str], by: str = "machine_id", factor: float = 1.5) -> DataFrame:
    """(by, column_name, q1, median, q3, whiskers, outliers): whiskers are the outermost values within the bounds; null groups are left out."""
    keys = [by, "column_name"]
    rows = long_form(df, columns, [by]).filter(f"value IS NOT NULL AND {by} IS NOT NULL")
    reach = factor * (F.col("q3") - F.col("q1"))
    inside = (F.col("value") >= F.col("q1") - reach) & (F.col("value") <= F.col("q3") + reach)
    return (
        rows.join(quartiles(rows, keys, few=False), keys)
        .groupBy(*keys, "q1", "median", "q3")
        .agg(F.min(F.when(inside, F.col("value"))).alias("whisker_low"), F.max(F.when(inside, F.col("value"))).alias("whisker_high"), F.count(F.when(~inside, 1)).alias("outliers"))
    )


def silver_quality(silver: DataFrame) -> DataFrame:
    """By sensor: total, missing, duplicates, outliers, mean to 3 decimals."""
    return silver.groupBy("sensor_type").agg(F.count("*").alias("total"), F.count_if("is_missing").alias("missing"), F.count_if("is_duplicate").alias("duplicates"), F.count_if("is_outlier").alias("outliers"), F.round(F.avg("sensor_value"), 3).alias("mean_value"))


def issue_report(issues: DataFrame) -> DataFrame:
    return issues.groupBy("dataset_name", "rule_code", "severity").agg(F.count("*").alias("n")).orderBy("dataset_name", "rule_code")


def split_report(gold: DataFrame, label: str = "label_failure_next_24h") -> DataFrame:
    return gold.groupBy("split_set").agg(F.count("*").alias("n"), F.count_distinct("machine_id").alias("machines"), F.min("window_start").alias("first_at"), F.max("window_start").alias("last_at"), (F.avg(F.col(label).cast("int")) * 100).alias("label_pct"))


def z_score_outliers(df: DataFrame, columns: list[str], k: float = 3.0) -> DataFrame:
    """(column_name, outliers): values further than k deviations from the mean."""
    rows = long_form(df, columns)
    stats = rows.groupBy("column_name").agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"))
    far = F.abs(F.col("value") - F.col("_m")) / F.nullif("_s", F.lit(0.0)) > k
    return rows.join(F.broadcast(stats), "column_name").groupBy("column_name").agg(F.count(F.when(far, 1)).alias("outliers"))


def shares(df: DataFrame, c: str) -> DataFrame:
    """(value, n, share): representation of each value."""
    return counts(df, F.col(c).alias("value")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def class_weight(df: DataFrame, label: str) -> DataFrame:
    """(positives, negatives, positive_weight): negatives for each positive."""
    rows = df.agg(F.count_if(F.col(label)).alias("positives"), F.count_if(~F.col(label)).alias("negatives"))
    return rows.withColumn("positive_weight", F.col("negatives") / F.nullif("positives", F.lit(0)))


def matched_profile(outliers: DataFrame, matched: DataFrame, by: str = "sensor_type") -> DataFrame:
    """(by, outliers, matched, matched_pct, mean_severity): both sides have a row for each sensor and instant."""
    a = counts(outliers, by).withColumnRenamed("n", "outliers")
    b = matched.groupBy(by).agg(F.count("*").alias("matched"), F.avg("severity").alias("mean_severity"))
    n = F.coalesce("matched", F.lit(0))
    return a.join(b, by, "left").select(by, "outliers", n.alias("matched"), (n * 100.0 / F.col("outliers")).alias("matched_pct"), "mean_severity")
