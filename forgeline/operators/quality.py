"""Data-quality rules: contracts, row validation, duplicates, issues, checks and batch logs."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forgeline.functions.scalars import blank_to_null, date_and_time, lenient_double, lenient_int, lenient_timestamp
from forgeline.operators.windows import dealt
from forgeline.schemas import FLAGS, INCIDENTS, MEASURES, TELEMETRY

DUPLICATE = "DOUBLON_HORAIRE"
#: Allowed ranges of measures.
RANGES = {"temperature_c": (-50, 500), "pressure_bar": (0, 1000), "pieces_produced": (0, None)}


def contract(df: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """``df``, or an error that names the required columns it lacks."""
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def _rule(code: str, field: str, bad: Column) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.lit(f"{field}:{code}"))


def checked(df: DataFrame, rules: list[Column]) -> DataFrame:
    """``df`` with errors (array of `field:CODE`, in rule order), parse_ok and parse_ok_reason."""
    found = df.withColumn("errors", F.array_compact(F.array(*rules)))
    return found.withColumn("parse_ok", F.size("errors") == 0).withColumn("parse_ok_reason", F.when(F.size("errors") > 0, F.array_join("errors", " | ")))


def validate_telemetry(df: DataFrame) -> DataFrame:
    """Text rows with validation columns; blanks are null, null measures are allowed."""
    df = contract(df, TELEMETRY).withColumns({c: blank_to_null(F.col(c)) for c in TELEMETRY})
    rules = [_rule("REQUIRED", c, F.col(c).isNull()) for c in ("machine_id", "timestamp")]
    rules.append(_rule("TYPE", "timestamp", F.col("timestamp").isNotNull() & lenient_timestamp(F.col("timestamp")).isNull()))
    for c in MEASURES:
        value = lenient_int(F.col(c)) if c == "pieces_produced" else lenient_double(F.col(c))
        rules.append(_rule("TYPE", c, F.col(c).isNotNull() & value.isNull()))
        if c in RANGES:
            least, most = RANGES[c]
            rules.append(_rule("RANGE", c, (value < least) | (value > most) if most is not None else value < least))
    return checked(df, rules)


def validate_incidents(df: DataFrame) -> DataFrame:
    """Text rows with validation columns; severity 1 to 5 and the nine flags 0 or 1 are required."""
    df = contract(df, INCIDENTS).withColumns({c: blank_to_null(F.col(c)) for c in INCIDENTS})
    rules = [_rule("REQUIRED", c, F.col(c).isNull()) for c in ("incident_id", "date", "time", "machine_id", "severity", *FLAGS)]
    rules.append(_rule("TYPE", "date", F.col("date").isNotNull() & F.col("time").isNotNull() & date_and_time(F.col("date"), F.col("time")).isNull()))
    for c, least, most in (("severity", 1, 5), *((f, 0, 1) for f in FLAGS)):
        value = lenient_int(F.col(c))
        rules += [_rule("TYPE", c, F.col(c).isNotNull() & value.isNull()), _rule("RANGE", c, (value < least) | (value > most))]
    return checked(df, rules)


def reject_duplicates(df: DataFrame, grain: str = "instant", only_valid: bool = True, tasks: int | None = None) -> DataFrame:
    """All copies of a machine's instant (or ``grain`` 'hour') become invalid; the reason carries their number.

    ``only_valid`` counts rows that are still valid, else all rows that have both keys; ``tasks`` as in ``windows.dealt``.
    """
    at = F.date_trunc("hour", lenient_timestamp(F.col("timestamp"))) if grain == "hour" else F.col("timestamp")
    counted = F.col("parse_ok") if only_valid else F.col("machine_id").isNotNull() & F.col("timestamp").isNotNull()
    w = Window.partitionBy("machine_id", at)
    rows = dealt(df, tasks, "machine_id", at).withColumn("_n", F.count(F.when(counted, 1)).over(w))
    bad = counted & (F.col("_n") > 1)
    reason = F.concat(F.lit(f"{DUPLICATE}:"), F.col("_n").cast("string"))
    return rows.withColumn("parse_ok_reason", F.when(bad, F.concat_ws(" | ", "parse_ok_reason", reason)).otherwise(F.col("parse_ok_reason"))).withColumn("parse_ok", F.col("parse_ok") & ~bad).drop("_n")


def issues(df: DataFrame, dataset: str, batch: str, entity: Column) -> DataFrame:
    """One row for each rejected row."""
    duplicate = F.col("parse_ok_reason").startswith(DUPLICATE)
    return df.filter("NOT parse_ok").select(
        F.lit(batch).alias("ingestion_batch_id"),
        F.lit(dataset).alias("dataset_name"),
        F.when(duplicate, DUPLICATE).otherwise("VALIDATION").alias("rule_code"),
        F.when(duplicate, "WARNING").otherwise("ERROR").alias("severity"),
        entity.alias("entity_key"),
        F.col("parse_ok_reason").alias("details"),
    )


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that stand more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(df: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key is missing from the parent; null keys are allowed."""
    return df.filter(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def domain_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations): rows where a rule is false; null passes, as in a CHECK."""
    counts = df.agg(*[F.count(F.when(~ok, 1)).alias(name) for name, ok in rules.items()])
    return counts.unpivot([], list(rules), "rule", "violations")


def residual_duplicates(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """is_duplicate: all but the first row of a key, null keys being equal."""
    return df.withColumn("is_duplicate", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) > 1)


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by ``order``."""
    return residual_duplicates(df, keys, order).filter("NOT is_duplicate").drop("is_duplicate")


def rejected_duplicates(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, rejected, kept, position): the log of what ``keep_first`` drops, by the values of ``order``; null keys are equal."""
    line = Window.partitionBy(*keys).orderBy(order)
    rows = df.select(*keys, F.col(order).alias("rejected"), F.first(order).over(line).alias("kept"), F.row_number().over(line).alias("position"))
    return rows.filter("position > 1")


def batch_log(df: DataFrame, batch: str, source: str, loaded: Column) -> DataFrame:
    """One row: rows read, loaded and rejected in one pass, and the status."""
    ok = F.coalesce(loaded, F.lit(False))
    counts = df.agg(F.count("*").alias("rows_read"), F.count(F.when(ok, 1)).alias("rows_loaded"), F.count(F.when(~ok, 1)).alias("rows_rejected"))
    return counts.select(F.lit(batch).alias("ingestion_batch_id"), F.lit(source).alias("source_name"), "rows_read", "rows_loaded", "rows_rejected", F.when(F.col("rows_rejected") == 0, "SUCCESS").otherwise("PARTIAL").alias("status"))


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, nulls, total) in one pass."""
    counts = df.agg(F.count("*").alias("_total"), *[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns])
    return counts.unpivot(["_total"], columns, "column_name", "nulls").withColumnRenamed("_total", "total")


def common_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(in_a, in_b, in_both): distinct keys."""
    marks = a.select(key).distinct().withColumn("_a", F.lit(1)).join(b.select(key).distinct().withColumn("_b", F.lit(1)), key, "full")
    return marks.filter(F.col(key).isNotNull()).agg(F.count("_a").alias("in_a"), F.count("_b").alias("in_b"), F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)).alias("in_both"))


def identifying_groups(df: DataFrame, attributes: list[str], k: int) -> DataFrame:
    """Attribute combinations that fewer than k rows share."""
    return df.groupBy(*attributes).agg(F.count("*").alias("n")).filter(F.col("n") < k)


def minimal_identifying(df: DataFrame, attributes: list[str], k: int, most: int | None = None) -> DataFrame:
    """(combination, size, *attributes, n): values of attribute combinations that fewer than ``k`` rows share and no part of which is so rare.

    Level by level: one aggregate counts all combinations of a size (grouping sets), and those that hold a rare one of a size less
    are taken out. What stands above a rare combination is rarer still, so looking one level down is enough. Attributes outside a combination are
    null in its row; null is a value like any other inside it.
    """
    bit = {a: 1 << (len(attributes) - 1 - i) for i, a in enumerate(attributes)}
    out = below = None
    for size in range(1, (most or len(attributes)) + 1):
        counted = df.groupingSets([list(c) for c in combinations(attributes, size)], *attributes).agg(F.count("*").alias("n"), F.grouping_id().alias("_outside"))
        rare = counted.filter(F.col("n") < k).withColumn("_key", F.struct("_outside", *attributes))
        found = rare
        if below is not None:
            without = [F.when(F.col("_outside").bitwiseAND(bit[a]) == 0, F.struct((F.col("_outside") + bit[a]).alias("_outside"), *[F.lit(None).cast(df.schema[b].dataType).alias(b) if a == b else F.col(b) for b in attributes])) for a in attributes]
            parts = rare.select("_key", F.explode(F.array_compact(F.array(*without))).alias("_part"))
            found = rare.join(parts.join(below, "_part", "left_semi").select("_key").distinct(), "_key", "left_anti")
        below = rare.select(F.col("_key").alias("_part"))
        name = F.concat_ws("+", *[F.when(F.col("_outside").bitwiseAND(bit[a]) == 0, a) for a in attributes])
        level = found.select(name.alias("combination"), F.lit(size).alias("size"), *attributes, "n")
        out = level if out is None else out.union(level)
    return out
