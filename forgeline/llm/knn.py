"""Exact top-k search by inner product as a Voronoi kNN join.

Vectors are turned into integers (floor(scale * x)) and written once with a number for each row, so a row is itself whatever its
vec_id. Data are assigned to the nearest of about sqrt(n) pivots; a cell's summary holds its size and radius. First pass: each query meets
about ``SEEDS`` members of the cell whose pivot it scores highest with, and its k-th score there is a bound that its true k-th
can't fall below. Queries are grouped by pivots of their own into groups of about ``QUERIES``. For a group and a cell with pivot p a
member x at distance d from p scores at most <q, p> + |q| d with any query q, so only members with d from some limit on can matter: the
largest of (bound - <q, p>) / |q| that no query of the group undercuts. Cells whose radius is below it are not joined to the
group at all; of the others only the members beyond the limit are sent (``needed`` has these limits, ``spread`` what is sent).
A group's data are dealt to blocks of about ``BLOCK`` vectors by what the group's cells hold; each block is solved locally
against the group's queries, and the blocks' best are merged.

Limits and cells meet in a join on the cell, and every summary is combined before the shuffle. The driver holds pivots and a size and a
radius for each (``PIVOTS`` at most), and a count for each query centre. Bounds allow for rounding in float64; scores are exact integers
while k-th products stay below 2^53 (64-bit integers beyond, and an error where those don't hold them). Where vectors point in
all directions alike no bound keeps anything back, and the join is a blocked comparison of all queries with all rows.

Vectors that are null or hold null or non-finite components take no part; shorter vectors count as filled up with zeros.
Ties go to the smaller vec_id. Rows that repeat a vec_id count each: another row with the query's vec_id is a candidate like any other, and
query rows that share a vec_id have a ranking each. Rows without a vec_id take no part. Fewer candidates than k give them all. Other
columns are not read; empty data or no queries give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forgeline.llm.common import checkpointed, saved

#: Fewest and most pivots of the data; most centres of query groups.
FEWEST, PIVOTS, CENTRES = 16, 1 << 15, 1 << 12
#: Members of a cell in the first pass, queries of a group and data vectors of a block, about.
SEEDS, QUERIES, BLOCK = 1024, 512, 1 << 14
SCALE = 1024
#: Numbers of a matrix of vectors and pivots at once.
AT_ONCE = 1 << 22
NUMBERED = "row long, vec_id long, v array<long>"


def integers(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v: array<long>) of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return df.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).select("vec_id", F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of equal width from lists of integers."""
    values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    if len(ends) > 1 and (np.diff(ends) == width).all():
        return values[ends[0] : ends[-1]].reshape(-1, width)
    out = np.zeros((len(lists), width), np.int64)
    for k, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
        out[k, : b - a] = values[a:b]
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2.0**53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most >= 2.0**63:
        raise OverflowError("inner products need more than 64 bits")
    return a @ b.T


def norms(a: np.ndarray) -> np.ndarray:
    return np.sqrt((a.astype(np.float64) ** 2).sum(axis=1))


def nearest(rows: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each row and the distance to it."""
    square = (rows.astype(np.float64) ** 2).sum(axis=1)[:, None] - 2.0 * (rows.astype(np.float64) @ pivots.T) + (pivots**2).sum(axis=1)
    at = square.argmin(axis=1)
    return at, np.sqrt(((rows - pivots[at]) ** 2).sum(axis=1))


def slack(x: np.ndarray) -> np.ndarray:
    return 1e-9 * np.abs(x) + 1e-6


def sample(rows: DataFrame, n: int, width: int) -> np.ndarray:
    """The different ones of the n rows with the smallest hashes of vec_id, as pivots."""
    chosen = rows.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(n).collect()
    out = np.zeros((len(chosen), width))
    for k, r in enumerate(chosen):
        out[k, : len(r["v"])] = r["v"]
    return np.unique(out, axis=0)


def floats(lists: pa.Array, width: int) -> np.ndarray:
    return matrix(lists, width).astype(np.float64)


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def slices(b: pa.RecordBatch, others: int, at_once: int | None = None) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose matrix with ``others`` columns holds ``AT_ONCE`` numbers at most, or a row."""
    step = max(1, (at_once or AT_ONCE) // max(1, others))
    for a in range(0, b.num_rows, step):
        yield b.slice(a, step)


def numbered(df: DataFrame, what: str) -> DataFrame:
    """(row, vec_id, v), written: a row keeps its number whatever is computed again."""
    return saved(df.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v"), what)


def in_cells(data: DataFrame, pivots: np.ndarray, at_once: int | None = None) -> DataFrame:
    """(row, vec_id, v, cell, d) of data, written."""
    width = pivots.shape[1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, len(pivots), at_once):
                at, d = nearest(matrix(part["v"], width), pivots)
                yield batch(row=part["row"], vec_id=part["vec_id"], v=part["v"], cell=at.astype(np.int32), d=d)

    return saved(data.select("row", "vec_id", "v").mapInArrow(place, f"{NUMBERED}, cell int, d double"), "cells")


def bounded(queries: DataFrame, cells: DataFrame, pivots: np.ndarray, sizes: np.ndarray, k: int, at_once: int | None = None) -> DataFrame:
    """``queries`` (row, vec_id, v) with least, the k-th score among members of the query's best cell; -inf if there are fewer."""
    width, full = pivots.shape[1], np.flatnonzero(sizes > k)
    wanted = full if len(full) else np.flatnonzero(sizes)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, len(wanted), at_once):
                best = wanted[(floats(part["v"], width) @ pivots[wanted].T).argmax(axis=1)]
                yield batch(row=part["row"], vec_id=part["vec_id"], v=part["v"], cell=best.astype(np.int32))

    at_home = checkpointed(queries.mapInArrow(home, f"{NUMBERED}, cell int"))
    asked = {r["cell"]: r["count"] for r in at_home.groupBy("cell").count().collect()}
    parts = F.lit(np.array([-(-asked.get(c, 0) // (4 * QUERIES)) or 1 for c in range(len(sizes))], np.int32))
    share = F.lit(np.array([min(1.0, SEEDS / max(1, n)) if c in asked else 0.0 for c, n in enumerate(sizes.tolist())]))
    cell, draw = F.col("cell"), F.pmod(F.xxhash64("row", F.lit(2)), F.lit(1 << 30)) / float(1 << 30)
    members = cells.filter(draw < F.get(share, cell)).select("cell", "row", "v").withColumn("part", F.explode(F.sequence(F.lit(0), F.get(parts, cell) - 1)))
    askers = at_home.withColumn("part", F.pmod(F.xxhash64("row", F.lit(3)), F.get(parts, cell)).cast("int"))

    def first_pass(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = left[["row", "vec_id", "v"]].assign(least=-np.inf)
        if len(left) and len(right):
            q, x = (matrix(pa.array(side["v"], pa.list_(pa.int64())), width) for side in (left, right))
            rows, least = right["row"].to_numpy(), np.full(len(q), -np.inf)
            for a in range(0, len(q), 256):
                scores = products(q[a : a + 256], x).astype(np.float64)
                scores[left["row"].to_numpy()[a : a + 256, None] == rows] = -np.inf
                if len(rows) >= k:
                    least[a : a + 256] = np.partition(scores, len(rows) - k, axis=1)[:, len(rows) - k]
            out["least"] = least
        return out

    return askers.groupBy("cell", "part").cogroup(members.groupBy("cell", "part")).applyInPandas(first_pass, f"{NUMBERED}, least double")


def grouped(queries: DataFrame, centres: np.ndarray, at_once: int | None = None) -> DataFrame:
    """``queries`` with g, the group: by the nearest centre, and by a hash of the row where that has over 2 * ``QUERIES``."""
    width = centres.shape[1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, len(centres), at_once):
                yield batch(row=part["row"], vec_id=part["vec_id"], v=part["v"], least=part["least"], centre=nearest(matrix(part["v"], width), centres)[0].astype(np.int32))

    near = checkpointed(queries.mapInArrow(place, f"{NUMBERED}, least double, centre int"))
    counts = {r["centre"]: r["count"] for r in near.groupBy("centre").count().collect()}
    parts = F.lit(np.array([-(-counts.get(c, 0) // (2 * QUERIES)) or 1 for c in range(len(centres))], np.int32))
    return near.withColumn("g", F.col("centre") + F.lit(len(centres)) * F.pmod(F.xxhash64("row", F.lit(4)), F.get(parts, "centre"))).drop("centre")


def needed(groups: DataFrame, pivots: np.ndarray, sizes: np.ndarray, radius: np.ndarray) -> DataFrame:
    """(g, cell, limit, blocks): a group's cells, the distance to the pivot from which members can matter, and the group's blocks."""
    there, width = np.flatnonzero(sizes), pivots.shape[1]

    def limits(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        least_d = np.full(len(there), np.inf)
        for a in range(0, len(rows), 64):
            q = matrix(pa.array(rows["v"].iloc[a : a + 64], pa.list_(pa.int64())), width)
            short, length = rows["least"].to_numpy()[a : a + 64, None] - q @ pivots[there].T, norms(q)[:, None]
            short = short - slack(short)
            with np.errstate(divide="ignore", invalid="ignore"):
                d = np.where(length > 0, short / length, np.where(short > 0, np.inf, -np.inf))
            least_d = np.minimum(least_d, d.min(axis=0))
        least_d = least_d - slack(least_d)
        cells = np.flatnonzero(least_d <= radius[there])
        blocks = max(1, -(-int(sizes[there[cells]].sum()) // BLOCK))
        return pd.DataFrame({"g": np.full(len(cells), key[0]), "cell": there[cells].astype(np.int32), "limit": least_d[cells], "blocks": np.full(len(cells), blocks, np.int32)})

    return groups.groupBy("g").applyInPandas(limits, "g long, cell int, limit double, blocks int")


def spread(cells: DataFrame, needs: DataFrame) -> DataFrame:
    """(g, block, row, vec_id, v): data vectors once for each group that may need them."""
    sent = cells.join(needs, "cell").filter("d >= limit")
    return sent.select("g", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int").alias("block"), "row", "vec_id", "v")


def top_k(data: DataFrame, asks: Column, k: int = 10, at_once: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best of ``data`` (vec_id, v) for each of its rows where ``asks`` holds."""
    spark = data.sparkSession
    cells, groups, needs, width = joined(data, asks, k, at_once)
    if cells is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks = needs.groupBy("g").agg(F.max("blocks").alias("blocks"))
    wanted = groups.join(blocks, "g").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("g", "block", "row", "vec_id", "v")

    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["asker", "query_id", "vec_id", "score"]
        if not len(left) or not len(right):
            return pd.DataFrame({n: np.empty(0, np.int64) for n in names})
        q, x = (matrix(pa.array(side["v"], pa.list_(pa.int64())), width) for side in (left, right))
        order = np.argsort(right["vec_id"].to_numpy(), kind="stable")
        x, ids, rows = x[order], right["vec_id"].to_numpy()[order], right["row"].to_numpy()[order]
        found = []
        for i in range(0, len(q), 256):
            scores = products(q[i : i + 256], x)
            for s, own, own_id in zip(scores, left["row"].to_numpy()[i : i + 256], left["vec_id"].to_numpy()[i : i + 256]):
                other = np.flatnonzero(rows != own)
                s = s[other]
                if len(s) > k:
                    cut_at = np.partition(s, len(s) - k)[len(s) - k]
                    other, s = other[s >= cut_at], s[s >= cut_at]
                best = np.argsort(-s, kind="stable")[:k]  # ids ascend, so ties keep the smaller
                found.append((np.full(len(best), own), np.full(len(best), own_id), ids[other[best]], s[best]))
        return pd.DataFrame({n: np.concatenate(c) for n, c in zip(names, zip(*found))})

    local = wanted.groupBy("g", "block").cogroup(spread(cells, needs).groupBy("g", "block")).applyInPandas(solve, "asker long, query_id long, vec_id long, score long")
    ranked = Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def joined(data: DataFrame, asks: Column, k: int, at_once: int | None = None) -> tuple[DataFrame | None, DataFrame | None, DataFrame | None, int]:
    """Cells, groups and needs of a search, and the vectors' width; nothing without data or queries."""
    rows = numbered(data, "vectors")
    queries = rows.filter(asks)
    shape = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.count_if(asks).alias("asked")).first()
    width = shape["width"] or 0
    if not shape["n"] or not shape["asked"] or not width:
        return None, None, None, 0
    pivots = sample(rows, min(PIVOTS, max(FEWEST, int(shape["n"] ** 0.5))), width)
    cells = in_cells(rows, pivots, at_once)
    sizes, radius = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("d").alias("r")).collect():  # a row a pivot
        sizes[r["cell"]], radius[r["cell"]] = r["n"], r["r"]
    centres = sample(queries, min(CENTRES, -(-shape["asked"] // QUERIES)), width)
    groups = checkpointed(grouped(bounded(queries, cells, pivots, sizes, k, at_once), centres, at_once))
    return cells, groups, checkpointed(needed(groups, pivots, sizes, radius)), width


def replication(data: DataFrame, asks: Column, k: int = 10) -> tuple[float, int]:
    """How many groups a data vector is sent to on average, and how many groups there are."""
    cells, groups, needs, _ = joined(data, asks, k)
    return spread(cells, needs).count() / cells.count(), groups.select("g").distinct().count()


TOP_K_SQL = f"""
WITH e AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, d.vec_id, list_dot_product(q.v, d.v)::BIGINT AS score FROM e q JOIN e d ON q.r <> d.r WHERE q.vec_id % 100 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id))::INT AS rank FROM s) WHERE rank <= 10
"""
