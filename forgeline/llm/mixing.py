"""Mixing sources to target weights, with DataFrame functions only.

Each document has a hash-random key; the keys of a source are range-sorted in ``BUCKETS`` equal ranges (a hash spreads
evenly, so the ranges need no sampling), each range's token counts are summed, the sums run on per source, and each
document adds its range's start to the running sum inside its range. So a source of any size is sorted by many tasks.
A source's target is met by whole epochs and a cut at the exact remainder in key order.

Sources are ordered by code point, null last, and weigh 1, 2, 3, repeating, of all tokens; a target stops at ``most``
times its source's size and the excess goes to the others by weight. That level is found in closed form: by the
ratio of cap and weight, all below the level are capped and the others share the rest.

The ranges' sums are written, so sizes are counted once for them and once for the documents. Sources are ordered in one task, a row
each, which does for millions of them.

Null texts have size 0 and are never taken. Rows that repeat a doc_id are ordered by size; equal rows are
interchangeable. Very long texts are counted whole. Reruns agree. An empty table gives an empty result. Only doc_id, text and source
are read; ``repeated`` packs the rows, so columns with names of this module's own (target, taken, _key and others) stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forgeline.llm.common import saved, word_count

#: Ranges of hash keys in a source: a power of 16.
DIGITS = 3
WEIGHTS = (1, 2, 3)
MOST = 3


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    One task orders the sources; what it reads is one row for each.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int"))
    by_ratio = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    rows = (
        sizes.withColumn("_w", weight.cast("double"))
        .withColumn("_ratio", most * F.col("source_size") / F.col("_w"))
        .withColumn("_all", F.sum("source_size").over(everything).cast("double"))
        .withColumn("_capped", F.coalesce(F.sum(most * F.col("source_size")).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_open", F.sum("_w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", (F.col("_all") - F.col("_capped")) / F.col("_open"))
    )
    level = F.max(F.when(F.col("_ratio") >= F.col("_level"), F.col("_level"))).over(everything)
    share = F.least(most * F.col("source_size").cast("double"), F.coalesce(F.col("_w") * level, most * F.col("source_size").cast("double")))
    return rows.select("source", "source_size", share.alias("target"))


def taken(df: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "mix") -> DataFrame:
    """``df`` (doc_id, source, size) with source_size, target and taken: the tokens that the mix takes of a document."""
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = df.withColumn("_key", key).withColumn("_range", F.substring("_key", 1, DIGITS)).withColumn("_s", F.coalesce("source", F.lit(""))).withColumn("_n", F.col("source").isNull())
    place = ["_s", "_n", "_range"]
    ranges = saved(rows.groupBy(*place).agg(F.first("source").alias("source"), F.sum("size").alias("_total")), "ranges")  # used twice
    sizes = ranges.groupBy("_s", "_n").agg(F.first("source").alias("source"), F.sum("_total").alias("source_size"))
    level = targets(sizes, weights, most).withColumn("_s", F.coalesce("source", F.lit(""))).withColumn("_n", F.col("source").isNull()).drop("source")
    by_range = Window.partitionBy("_s", "_n").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select(*place, F.coalesce(F.sum("_total").over(by_range), F.lit(0)).alias("_start")).join(level, ["_s", "_n"])
    in_range = Window.partitionBy(*place).orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_before", F.coalesce(F.sum("size").over(in_range), F.lit(0))).join(starts, place)
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size") - F.col("_start") - F.col("_before")
    return placed.withColumn("taken", epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))).drop("_key", "_before", "_start", *place)


def mixed(df: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of documents (doc_id, text, source)."""
    sizes = saved(df.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")  # texts are read once
    return taken(sizes, **options).select("doc_id", "size", "source_size", "target", "taken")


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents themselves: whole rows, once for each epoch that takes any of their tokens."""
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    copies = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    chosen = taken(rows, **options).withColumn("_copies", copies).filter("_copies > 0")
    return chosen.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")


MIXED_SQL = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [1, 2, 3][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM s),
r AS (SELECT *, 3 * source_size / w AS ratio, sum(source_size) OVER ()::DOUBLE AS al,
  coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
  sum(w) OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS op FROM w),
l AS (SELECT *, (al - capped) / op AS lev FROM r),
t AS (SELECT source, source_size, least(3 * source_size::DOUBLE, coalesce(w * max(CASE WHEN ratio >= lev THEN lev END) OVER (), 3 * source_size::DOUBLE)) AS target FROM l),
k AS (SELECT doc_id, size, source_size, target, round(target)::BIGINT AS budget, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5('mix:' || coalesce(doc_id::VARCHAR, '')), doc_id, size
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
  + greatest(0, least(size, budget - CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * source_size - before)))::BIGINT AS taken FROM k
"""
