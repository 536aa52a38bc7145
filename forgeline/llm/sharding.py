"""Resharding by minimum-cost flow.

Documents are kept in shards that consist of parts. From the old shards' bytes and the new capacities a minimum-cost flow finds how many
bytes go from each old shard to each new one so that the fewest bytes move; then each old shard is cut at these amounts,
and only parts that lose or gain rows are rewritten. The flow has one node for each old and new shard and is solved on the
driver, in plain Python: it is meant for hundreds of shards, not for many thousands; documents and texts stay in Spark.

One rule cuts shards of any size. A shard's rows are in order of a hash of their text, those of equal texts in order of a hash of
doc_id, and what stays comes first. A cut belongs at the text boundary next to its amount. Only where that is further away than
``SLACK`` of a shard, as in a text with very many copies, it stands inside the text, between two of 2^``COPY_BITS`` ranges of the
hashes of doc_id. So equal texts are together but for one text at a cut, and by law `bytes` the shards' sizes differ by ``SLACK`` for each
end of a piece at most, in general by a text or so. Amounts are found with prefix sums over ranges of the hash
(``BLOCK_BYTES`` each, their number grows with the bytes), then over the texts of the ranges that hold a cut; no task orders a shard.

What is in force is the newest version of the manifest, which names the generation of each part; readers go through it alone, so
files of an attempt that did not end are never read, and a reader that starts anew finds the resharded rows.

Null and empty texts have size 1 and are one group. Very long texts are rows like any other. Null doc_ids and rows that
repeat a doc_id are rows like any other, but rows that repeat doc_id and text can't be cut apart. Other columns are not kept.
Empty tables give empty results.
"""

from __future__ import annotations

import uuid
from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from forgeline.llm.common import saved, shared_dir

#: Share of a shard that a cut may be off its amount so that it is between texts.
SLACK = 1 / 32
#: Bytes of a hash range whose texts are summed at once, about, and of a part, which is rewritten as one.
BLOCK_BYTES, PART_BYTES = 16 << 20, 1 << 30
#: Fewest and most bits of a hash that number ranges, parts of a shard, and ranges that slots are counted in.
BLOCK_BITS, PART_BITS, SLOT_BITS = (10, 24), (3, 14), (4, 20)
#: Bits that number ranges of a text's copies.
COPY_BITS = 12
#: Rows of a range that slots are counted in, about.
SLOT_ROWS = 50_000
STORED = "doc_id long, text string, size long, text_crc32 long, h long, d long"
PLACE = "generation string, shard int, part int"


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Units from each supply to each capacity at the least total cost, by successive shortest paths."""
    n, m = len(supply), len(capacity)
    flow, left, room = [[0] * m for _ in supply], list(supply), list(capacity)
    if sum(left) > sum(room):
        raise ValueError("the capacities don't hold the supplies")
    while any(left):
        # shortest paths from all nodes with supply left, over unused and, backwards, used routes
        best = [0 if left[i] else None for i in range(n)] + [None] * m
        via: list[int | None] = [None] * (n + m)
        queue = deque(i for i in range(n) if left[i])
        while queue:
            u = queue.popleft()
            steps = [(n + j, cost[u][j]) for j in range(m)] if u < n else [(i, -cost[i][u - n]) for i in range(n) if flow[i][u - n]]
            for v, c in steps:
                if best[v] is None or best[u] + c < best[v]:
                    best[v], via[v] = best[u] + c, u
                    queue.append(v)
        end = min((j for j in range(m) if room[j] and best[n + j] is not None), key=lambda j: (best[n + j], j))
        path = [n + end]
        while via[path[-1]] is not None:
            path.append(via[path[-1]])
        path.reverse()
        amount = min([left[path[0]], room[end], *(flow[v][u - n] for u, v in zip(path, path[1:]) if u >= n)])
        for u, v in zip(path, path[1:]):
            if u < n:
                flow[u][v - n] += amount
            else:
                flow[v][u - n] -= amount
        left[path[0]] -= amount
        room[end] -= amount
    return flow


def bits(wanted: float, limits: tuple[int, int]) -> int:
    """Bits that number so many ranges, within limits."""
    return min(limits[1], max(limits[0], int(max(0.0, wanted)).bit_length()))


def top(h: Column, n: int) -> Column:
    """The first n bits of a hash as a number from 0, in the hash's (signed) order."""
    return (F.shiftright(h, 64 - n) + (1 << (n - 1))).cast("int")


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` with size (UTF-8 bytes of the text and 1), text_crc32, and the hashes h of the text and d of doc_id."""
    text = F.coalesce("text", F.lit(""))
    new = {"size": (F.octet_length(text) + 1).cast("long"), "text_crc32": F.crc32(F.encode(text, "UTF-8")), "h": F.xxhash64(text), "d": F.xxhash64("doc_id", F.lit(1))}
    return docs.withColumns(new)


def first_layout(docs: DataFrame, folder: str, shards: int) -> None:
    """Write the documents (doc_id, text) to ``shards`` shards by the hash of their text, as the first version."""
    rows = sized(docs.select("doc_id", "text"))
    total = rows.agg(F.sum("size").alias("b")).first()["b"] or 0
    n = bits(total / shards / PART_BYTES, PART_BITS)
    generation = write_generation(rows.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int")), folder, n)
    write_manifest(parts_of(docs.sparkSession, folder, generation), folder, 0, n)


def write_generation(rows: DataFrame, folder: str, n: int) -> str:
    """Write rows with their shard to parts (2^n ranges of h); ranges of rows go to a task, so that a part may have many files."""
    generation = uuid.uuid4().hex
    stored = rows.select(*[c.split()[0] for c in STORED.split(", ")], F.lit(generation).alias("generation"), "shard", top(F.col("h"), n).alias("part"))
    stored.repartitionByRange("shard", "h", "d").write.partitionBy("generation", "shard", "part").option("compression", "zstd").mode("append").parquet(f"{folder}/data")
    return generation


def parts_of(spark: SparkSession, folder: str, generation: str) -> DataFrame:
    rows = spark.read.schema(f"{STORED}, {PLACE}").parquet(f"{folder}/data")
    return rows.filter(F.col("generation") == generation).select("generation", "shard", "part").distinct()


def write_manifest(parts: DataFrame, folder: str, version: int, n: int) -> None:
    """Put a version in force; written as one, after its data."""
    parts.withColumn("part_bits", F.lit(n)).coalesce(1).write.parquet(f"{folder}/manifest/version={version}")


def manifest(spark: SparkSession, folder: str) -> tuple[DataFrame, int, int]:
    """The parts (generation, shard, part) in force, their version and the bits of a part; at most 2^``PART_BITS`` parts a shard."""
    every = spark.read.schema(f"{PLACE}, part_bits int, version int").parquet(f"{folder}/manifest")
    newest = every.agg(F.max("version").alias("v")).first()["v"]
    live = every.filter(F.col("version") == newest)
    return live.select("generation", "shard", "part"), newest or 0, (live.agg(F.max("part_bits").alias("n")).first()["n"] or PART_BITS[0])


def read_layout(spark: SparkSession, folder: str) -> DataFrame:
    """The rows in force with their shard and part, by the manifest."""
    live, _, _ = manifest(spark, folder)
    rows = spark.read.schema(f"{STORED}, {PLACE}").parquet(f"{folder}/data")
    return rows.join(F.broadcast(live), ["generation", "shard", "part"], "left_semi")


def pieces(stored: DataFrame, capacities: list[int] | None, shards: int) -> dict[int, list[tuple[int, tuple[int, int | None] | None]]]:
    """For each old shard its pieces in order: the new shard, and the (h, d) that the piece ends before (no d: after h; None: at the end).

    Without capacities shards get equal shares. What reaches the driver is a row a shard and a row a cut.
    """
    spark = stored.sparkSession
    total = stored.agg(F.sum("size").alias("b")).first()["b"] or 0
    n = bits(total / BLOCK_BYTES, BLOCK_BITS)
    blocked = stored.select("shard", "h", "size", top(F.col("h"), n).alias("block"))
    blocks = saved(blocked.groupBy("shard", "block").agg(F.sum("size").alias("bytes")), "blocks")
    old = {r["shard"]: r["b"] for r in blocks.groupBy("shard").agg(F.sum("bytes").alias("b")).collect()}
    olds = sorted(old)
    room = capacities or [total // shards + (j < total % shards) for j in range(shards)]
    flow = min_cost_flow([old[i] for i in olds], room, [[int(i != j) for j in range(len(room))] for i in olds])
    order = {i: [j for j in sorted(range(len(room)), key=lambda j: (j != i, j)) if row[j]] for i, row in zip(olds, flow)}  # what stays comes first
    cuts = []
    for i, row in zip(olds, flow):
        at = 0
        for k, j in enumerate(order[i][:-1]):
            at += row[j]
            cuts.append((i, k, at))
    wanted = F.broadcast(spark.createDataFrame(cuts, "shard int, k int, at long"))  # fewer than old and new shards together
    line = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    holding = blocks.withColumn("start", F.coalesce(F.sum("bytes").over(line), F.lit(0))).join(wanted, "shard").filter("start <= at AND at < start + bytes")
    inside = blocked.join(F.broadcast(holding.select("shard", "block", "k", "at", "start")), ["shard", "block"]).groupBy("shard", "k", "at", "start", "h").agg(F.sum("size").alias("bytes"))
    within = Window.partitionBy("shard", "k").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    texts = inside.withColumn("start", F.col("start") + F.coalesce(F.sum("bytes").over(within), F.lit(0))).filter("start <= at AND at < start + bytes")
    found = {(r["shard"], r["k"]): (r["h"], r["at"] - r["start"], r["bytes"]) for r in texts.collect()}
    ends = {key: beside(*where, SLACK * total / len(room)) for key, where in found.items()}
    heavy = [(*key, found[key][0], found[key][1]) for key, end in ends.items() if end is None]
    if heavy:
        ends |= inside_texts(stored, heavy)
    return {i: [(j, ends.get((i, k))) for k, j in enumerate(js)] for i, js in order.items()}


def beside(h: int, before: int, size: int, slack: float) -> tuple[int, int | None] | None:
    """The nearer boundary of a text to an amount that lies ``before`` bytes into it, None if that is too far."""
    if min(before, size - before) > slack:
        return None
    return (h, -(1 << 63)) if before <= size - before else (h, None)


def inside_texts(stored: DataFrame, heavy: list[tuple[int, int, int, int]]) -> dict:
    """Cuts inside texts, from (shard, k, h, amount) rows, at the nearest end of a range of d."""
    wanted = F.broadcast(stored.sparkSession.createDataFrame(heavy, "shard int, k int, h long, at long"))
    ranges = stored.select("shard", "h", "size", top(F.col("d"), COPY_BITS).alias("range")).join(wanted, ["shard", "h"]).groupBy("shard", "k", "h", "at", "range").agg(F.sum("size").alias("bytes"))
    line = Window.partitionBy("shard", "k").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    rows = ranges.withColumn("start", F.coalesce(F.sum("bytes").over(line), F.lit(0))).filter("start <= at AND at < start + bytes").collect()
    step = lambda r: r["range"] + (2 * (r["at"] - r["start"]) > r["bytes"])
    return {(r["shard"], r["k"]): (r["h"], None if step(r) >> COPY_BITS else (step(r) << (64 - COPY_BITS)) - (1 << 63)) for r in rows}


def destination(plan: dict) -> Column:
    """The new shard of a row (shard, h, d)."""
    out = F.col("shard")
    for i, own in plan.items():
        to = F.lit(own[-1][0])
        for j, (h, d) in reversed(own[:-1]):
            here = (F.col("h") < h) | ((F.col("h") == h) & (F.lit(True) if d is None else F.col("d") < d))
            to = F.when(here, j).otherwise(to)
        out = F.when(F.col("shard") == i, to).otherwise(out)
    return out.cast("int")


def affected(plan: dict, n: int) -> Column:
    """Whether a part (shard, part) loses rows: what stays is the beginning of a shard."""
    out = F.lit(False)
    for i, own in plan.items():
        if own[0][0] != i:
            out = F.when(F.col("shard") == i, True).otherwise(out)
        elif len(own) > 1:
            out = F.when(F.col("shard") == i, F.col("part") >= (own[0][1][0] >> (64 - n)) + (1 << (n - 1))).otherwise(out)
    return out


def reshard(spark: SparkSession, folder: str, capacities: list[int] | None = None, shards: int = 8) -> DataFrame:
    """Rewrite the affected parts of a layout and put them in force; returns the rows as a reader gets them."""
    live, version, n = manifest(spark, folder)
    stored = read_layout(spark, folder)
    plan = pieces(stored, capacities, shards)
    touched = affected(plan, n)
    generation = write_generation(stored.filter(touched).withColumn("shard", destination(plan)), folder, n)
    write_manifest(live.filter(~touched).union(parts_of(spark, folder, generation)), folder, version + 1, n)
    return read_layout(spark, folder)


def slots(rows: DataFrame) -> DataFrame:
    """``rows`` with slot: their place in the shard from 0, by a hash of doc_id and text, counted range by range of that hash."""
    shape = rows.groupBy("shard").count().agg(F.max("count").alias("n")).first()
    n = bits((shape["n"] or 0) / SLOT_ROWS, SLOT_BITS)
    rows = rows.withColumn("_u", F.xxhash64("doc_id", "h")).withColumn("_range", top(F.col("_u"), n))
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "_range").agg(F.count("*").alias("_n"))
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inner = Window.partitionBy("shard", "_range").orderBy("_u", "doc_id", "size", "text_crc32")
    return rows.withColumn("_k", F.row_number().over(inner) - 1).join(starts, ["shard", "_range"]).withColumn("slot", F.col("_start") + F.col("_k")).drop("_k", "_start", "_u", "_range")


def resharded(docs: DataFrame, old_shards: int = 6, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: documents moved from ``old_shards`` shards to ``shards``."""
    folder = shared_dir(docs.sparkSession, "shards")
    first_layout(docs, folder, old_shards)
    rows = slots(reshard(docs.sparkSession, folder, shards=shards).select("doc_id", "size", "text_crc32", "h", "shard"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
