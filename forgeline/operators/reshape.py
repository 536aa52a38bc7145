"""Pivots, unpivots, splits and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forgeline.operators.quantiles import quantiles
from forgeline.operators.windows import dealt
from forgeline.schemas import SENSORS


def to_long(df: DataFrame, ids: list[str], keep_dealt: bool = False) -> DataFrame:
    """One row for each sensor: sensor_type, sensor_value, unit.

    ``keep_dealt``: Spark still knows afterwards how ``df`` was dealt, which an unpivot makes it forget, so that an aggregate by the same keys exchanges nothing.
    """
    typed = df.select(*ids, *[F.col(c).cast("double").alias(s) for c, s, _ in SENSORS])
    units = F.create_map(*[F.lit(x) for _, s, u in SENSORS for x in (s, u)])
    if keep_dealt:
        rows = typed.select(*ids, F.inline(F.array(*[F.struct(F.lit(s).alias("sensor_type"), F.col(s).alias("sensor_value")) for _, s, _ in SENSORS])))
    else:
        rows = typed.unpivot(ids, [s for _, s, _ in SENSORS], "sensor_type", "sensor_value")
    return rows.withColumn("unit", F.element_at(units, F.col("sensor_type")))


def to_wide(df: DataFrame, keys: list[str]) -> DataFrame:
    """The mean of each sensor, one row a key; a sensor without rows gives null.

    One aggregate with a condition for each sensor: no task holds a group for each key and sensor.
    """
    each = df.select(*keys, *[F.when(F.col("sensor_type") == s, F.col("sensor_value")).alias(c) for c, s, _ in SENSORS])
    return each.groupBy(*keys).agg(*[F.avg(c).alias(c) for c, _, _ in SENSORS])


def unstack_counts(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts by row with one column for each value, 0 where there is none."""
    return df.groupBy(row).pivot(column, values).count().na.fill(0)


def cut_points(df: DataFrame, at: str, shares: tuple[float, ...] = (0.70, 0.85), tasks: int | None = None) -> DataFrame:
    """One row (cut_1, cut_2, ...): the instants at share * n of the sorted distinct ones, the product cut off as a double.

    The distinct instants are counted by hour; only the hours that hold a cut are ranked inside, so no task orders them all. ``tasks`` as in ``windows.dealt``.
    """
    instants = dealt(df.select(F.col(at).alias("_t")).filter("_t IS NOT NULL"), tasks, "_t")
    distinct = instants.distinct().withColumn("_h", F.date_trunc("hour", "_t"))
    run = Window.orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)
    counted = distinct.groupBy("_h").agg(F.count("*").alias("_n"))
    placed = counted.select("_h", "_n", F.coalesce(F.sum("_n").over(run), F.lit(0)).alias("_start"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    wanted = F.array(*[F.floor(F.col("_all") * F.lit(float(s))) for s in shares])
    holding = placed.withColumn("_wanted", wanted).filter(F.exists("_wanted", lambda w: (w >= F.col("_start")) & (w < F.col("_start") + F.col("_n"))))
    inside = Window.partitionBy("_h").orderBy("_t")
    ranked = distinct.join(F.broadcast(holding), "_h").withColumn("_rank", F.col("_start") + F.row_number().over(inside) - 1)  # an hour a cut at most
    return ranked.agg(*[F.min(F.when(F.col("_rank") == F.get("_wanted", F.lit(i)), F.col("_t"))).alias(f"cut_{i + 1}") for i in range(len(shares))])


def split_set(at: Column) -> Column:
    """train before cut_1, validation before cut_2, else test."""
    return F.when(at < F.col("cut_1"), "train").when(at < F.col("cut_2"), "validation").otherwise("test")


def with_split(df: DataFrame, at: str, cuts: DataFrame) -> DataFrame:
    """``df`` with split_set; the cuts are one row and joined to each."""
    return df.join(F.broadcast(cuts), F.lit(True)).withColumn("split_set", split_set(F.col(at))).drop(*cuts.columns)


def row_quantile_cuts(df: DataFrame, at: str, shares: tuple[float, ...] = (0.70, 0.85)) -> DataFrame:
    """One row (cut_1, cut_2, ...): quantiles of the rows' instants, duplicates counted; null without instants."""
    found = quantiles(df.select(F.unix_micros(at).alias("value")), [], shares, few=True)
    return found.agg(*[F.timestamp_micros(F.floor(F.max(F.get("q", F.lit(i)))).cast("long")).alias(f"cut_{i + 1}") for i in range(len(shares))])


def expanding_folds(df: DataFrame, at: str, folds: int = 4) -> DataFrame:
    """Rows once for each fold they belong to: fold k trains on what is before its cut and tests on the part up to the next one."""
    shares = tuple((k + 1) / (folds + 1) for k in range(folds))
    cuts = cut_points(df, at, shares)
    rows = df.join(F.broadcast(cuts), F.lit(True))
    ends = [F.col(f"cut_{k + 1}") for k in range(folds)]
    marks = []
    for k in range(folds):
        until = F.col(at) < ends[k + 1] if k + 1 < folds else F.lit(True)
        marks.append(F.struct(F.lit(k + 1).alias("fold"), F.when(F.col(at) < ends[k], "train").when(until, "test").alias("role")))
    return rows.withColumn("_m", F.explode(F.filter(F.array(*marks), lambda m: m["role"].isNotNull()))).select(*df.columns, "_m.fold", "_m.role")
