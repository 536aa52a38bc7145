"""Lloyd's clustering with exact integers, where most vectors are not looked at in most rounds.

Vectors are packed to blocks of ``BLOCK`` rows and written once, bucketed by block. A vector's gap is the distance to its second nearest
centroid less the one to its own, kept with what its cluster's centroids have drifted so far: while the accumulated drift (own
centroid's move and the largest move of another, each round) has not used the gap up, no other centroid can be as near. Each block has a heap
of these keys for each cluster, kept as a run sorted by key, so the top of a heap is its beginning: a round pops what has expired, rescans those
vectors exactly against all centroids, and merges them back into the heaps of their new clusters. Everything else stays unread.

A round reads blocks and heaps of one bucket side by side (no shuffle), writes new heaps (a few bytes a vector), and returns for each task
the counts and sums that vectors took from one cluster to another; Spark adds these up, and the driver holds one count and one sum
vector for each centroid. Distances are whole numbers; bounds are float64 with a margin that covers their rounding, so results are
those of plain rounds, ties included. Heaps written by a lost or repeated attempt are never read, as only committed files are.

``k`` centroids and blocks of ``BLOCK`` vectors bound a task's memory; distances are taken ``AT_ONCE`` numbers at a time.

Vectors that are null, hold null or non-finite components or have another number of components than ``width`` take no part. Null
vec_ids sort behind all others as first centroids and are clustered like any row; repeated rows count each, and where the first centroids
are equal, the one with the smaller number takes all ties. Fewer vectors than ``k`` give fewer centroids; an empty table gives no rows. Columns of
other names are not looked at. Components whose squared distances need more than 63 bits are an error.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgeline.llm.common import saved, shared_dir
from forgeline.llm.knn import matrix

SCALE = 256
WIDTH = 64
CENTROIDS, ROUNDS = 40, 5
BLOCK = 1 << 12
#: Numbers of a distance matrix at once.
AT_ONCE = 1 << 22
PACKED = "block long, ids array<long>, kind string, vectors binary"
HEAPS = "block long, order binary, key binary, cuts binary, of int, n long, sums array<long>"
#: More than float64 roundings of a root, a difference and the sums of rounds can be off, as a share.
MARGIN = 1e-9


def kept(df: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(vec_id, v: array<long>) of the vectors that take part; a null vec_id stays."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return df.filter((F.size("embedding") == width) & fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def first_centroids(rows: DataFrame, k: int, seed: str = "2") -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of `seed:vec_id`, in that order."""
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    found = rows.orderBy(named.asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in found], np.int64)


def smallest_type(x: np.ndarray) -> np.ndarray:
    most = int(np.abs(x).max(initial=0))
    return x.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8")


def blocks(rows: DataFrame, width: int, size: int = BLOCK) -> DataFrame:
    """Blocks of about ``size`` vectors where they lie: block number, ids, packed vectors in the narrowest integers that hold them."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a in range(0, batch.num_rows, size):
                part = batch.slice(a, size)
                v = smallest_type(matrix(part["v"], width))
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([part["vec_id"].to_pylist()], pa.list_(pa.int64())), pa.array([v.dtype.str]), pa.array([v.tobytes()])], names=["block", "ids", "kind", "vectors"])
                number += 1

    return rows.mapInArrow(pack, PACKED)


def distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows."""
    most = float(np.abs(v).max(initial=0)) + float(np.abs(centroids).max(initial=0))
    if most**2 * v.shape[1] < 2.0**52:
        a, b = v.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    if most**2 * v.shape[1] >= 2.0**63:
        raise OverflowError("squared distances need more than 63 bits")
    return np.stack([((v - c) ** 2).sum(1) for c in centroids], axis=1)


def two_nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid (ties: the smaller number), and how much further the second one is, at least."""
    own, gap = np.empty(len(v), np.int64), np.empty(len(v))
    step = max(1, AT_ONCE // (len(centroids) + v.shape[1]))
    for a in range(0, len(v), step):
        d = distances(v[a : a + step], centroids)
        row, at = np.arange(len(d)), d.argmin(1)
        near = np.sqrt(d[row, at].astype(np.float64))
        d[row, at] = np.iinfo(np.int64).max
        far = np.sqrt(d.min(1).astype(np.float64))  # with one centroid: further than any
        own[a : a + step], gap[a : a + step] = at, far - near - MARGIN * (1 + far)
    return own, gap


class Block:
    """A block's vectors and heaps: ``order`` has the vectors by cluster and key, ``cuts`` says where each cluster begins in it."""

    def __init__(self, row: dict, k: int, width: int):
        self.vectors, self.k = np.frombuffer(row["vectors"].as_buffer(), row["kind"].as_py()).reshape(-1, width).astype(np.int64), k
        n, self.new = len(self.vectors), not row["cuts"].is_valid
        self.cluster, self.key = np.zeros(n, np.int64), np.full(n, -np.inf)
        self.order, self.cuts = np.arange(n), np.append(0, np.full(k, n))
        if not self.new:
            self.order = np.frombuffer(row["order"].as_buffer(), "<u4").astype(np.int64)
            self.cuts = np.frombuffer(row["cuts"].as_buffer(), "<u4").astype(np.int64)
            self.key[self.order] = np.frombuffer(row["key"].as_buffer(), "<f8")
            self.cluster[self.order] = np.repeat(np.arange(k), np.diff(self.cuts))

    def expired(self, drift: np.ndarray) -> np.ndarray:
        """What the clusters' heaps pop: their beginnings, up to the accumulated drift."""
        keys = self.key[self.order]
        tops = [self.order[a : a + np.searchsorted(keys[a:b], drift[c], "right")] for c, (a, b) in enumerate(zip(self.cuts[:-1], self.cuts[1:])) if b > a]
        return np.concatenate(tops) if tops else np.empty(0, np.int64)

    def rescan(self, drift: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """Rescans what has expired and puts it into its heaps; returns it with the clusters it had, None before the first round."""
        popped = self.expired(drift)
        had = None if self.new else self.cluster[popped]
        if len(popped):
            own, gap = two_nearest(self.vectors[popped], centroids)
            self.cluster[popped] = own
            self.key[popped] = gap + drift[own] * (1 - MARGIN)
            self.order = np.lexsort((self.key, self.cluster))
            self.cuts = np.searchsorted(self.cluster[self.order], np.arange(self.k + 1))
        return popped, had

    def heaps(self) -> dict:
        return {"order": self.order.astype("<u4").tobytes(), "key": self.key[self.order].astype("<f8").tobytes(), "cuts": self.cuts.astype("<u4").tobytes()}


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows as Arrow scalars by name."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch[name][k] for name in batch.schema.names}


def bucketed(df: DataFrame, what: str, buckets: int) -> str:
    """``df`` written as a table of the session in the shared folder, bucketed by block; returns its name."""
    name = f"{what}_{uuid.uuid4().hex}"
    df.write.format("parquet").option("path", shared_dir(df.sparkSession, what)).bucketBy(buckets, "block").saveAsTable(name)
    return name


def with_heaps(data: DataFrame, heaps: str | None) -> DataFrame:
    """Blocks beside their heaps (null before the first round); both are bucketed by block, so nothing is shuffled."""
    if heaps is None:
        return data.withColumns({c: F.lit(None).cast("binary") for c in ("order", "key", "cuts")})
    return data.join(data.sparkSession.table(heaps).filter("of IS NULL").select("block", "order", "key", "cuts"), "block", "left")


def one_round(both: DataFrame, centroids: np.ndarray, drift: np.ndarray) -> DataFrame:
    """New heaps of every block with ``n``, the vectors it rescanned; of every task a row for each cluster that lost or gained: of, n, sums."""
    k, width = centroids.shape
    schema = pa.schema([("block", pa.int64()), ("order", pa.binary()), ("key", pa.binary()), ("cuts", pa.binary()), ("of", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums, last = np.zeros(k, np.int64), np.zeros((k, width), np.int64), None
        for row in rows_of(batches):
            block, last = Block(row, k, width), row["block"].as_py()
            popped, had = block.rescan(drift, centroids)
            for sign, clusters in ((1, block.cluster[popped]), (-1, had)):
                if clusters is not None:
                    np.add.at(sums, clusters, sign * block.vectors[popped])
                    np.add.at(counts, clusters, sign)
            yield pa.RecordBatch.from_pylist([{"block": last, "n": len(popped), **block.heaps()}], schema)
        # under the number of a block of this task, so that they stand in its bucket
        if changed := [{"block": last, "of": c, "n": int(counts[c]), "sums": sums[c].tolist()} for c in range(k) if counts[c] or sums[c].any()]:
            yield pa.RecordBatch.from_pylist(changed, schema)

    return both.select("block", "kind", "vectors", "order", "key", "cuts").mapInArrow(work, HEAPS)


def last_pass(both: DataFrame, centroids: np.ndarray, drift: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of all vectors: what has expired is rescanned, the others are measured to their own centroid."""
    k, width = centroids.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            block = Block(row, k, width)
            block.rescan(drift, centroids)
            distance = ((block.vectors - centroids[block.cluster]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([row["ids"].values, pa.array(block.cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return both.mapInArrow(work, "vec_id long, cluster int, distance long")


def add_changes(heaps: DataFrame, counts: np.ndarray, sums: np.ndarray) -> None:
    """Adds what clusters lost and gained, summed by Spark, to counts and sums."""
    changes = heaps.filter("of IS NOT NULL")
    for r in changes.groupBy("of").agg(F.sum("n").alias("n")).collect():  # a row a centroid at most
        counts[r["of"]] += r["n"]
    for r in changes.select("of", F.posexplode("sums").alias("p", "s")).groupBy("of", "p").agg(F.sum("s").alias("s")).collect():  # a number a component
        sums[r["of"], r["p"]] += r["s"]


def others(moves: np.ndarray) -> np.ndarray:
    """For each centroid the largest move of another one."""
    if len(moves) < 2:
        return np.zeros(len(moves))
    top = np.sort(moves)[-2:]
    return np.where(np.arange(len(moves)) == moves.argmax(), top[0], top[1])


def clustered(rows: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, seed: str = "2", block: int = BLOCK, buckets: int | None = None) -> tuple[DataFrame, np.ndarray, list[int]]:
    """(vec_id, cluster, distance) of ``rows`` (vec_id, v), the final centroids, and how many vectors each round rescanned.

    The result is written. The tables of the rounds are dropped; their files go with the shared folder.
    """
    spark = rows.sparkSession
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), centroids, []
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # dealt by block first, so that a bucket is a file
    tables = [bucketed(blocks(rows, width, block).repartition(buckets, "block"), "vectors", buckets)]
    data, heaps, rescanned = spark.table(tables[0]), None, []
    drift, counts, sums = np.zeros(len(centroids)), np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
    try:
        for _ in range(rounds):
            heaps = bucketed(one_round(with_heaps(data, heaps), centroids, drift), "heaps", buckets)
            tables.append(heaps)
            add_changes(spark.table(heaps), counts, sums)
            rescanned.append(spark.table(heaps).filter("of IS NULL").agg(F.sum("n")).first()[0])
            now = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], centroids)
            moves = np.sqrt(((now - centroids).astype(np.float64) ** 2).sum(1)) * (1 + MARGIN)
            drift, centroids = drift + moves + others(moves), now
        return saved(last_pass(with_heaps(data, heaps), centroids, drift), "clusters"), centroids, rescanned
    finally:
        for name in tables:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def report(df: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of the vectors of ``df`` (vec_id, embedding)."""
    found, centroids, _ = clustered(kept(df, width), k, rounds, width)
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row a centroid at most
    named = [(c, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    clusters = found.sparkSession.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE) -> str:
    """The same in DuckDB: plain rounds, every vector against every centroid."""
    steps = [
        f"kv AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings "
        f"WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('2:' || vec_id) AS h, v FROM kv ORDER BY h, v LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT kv.r, any_value(kv.vec_id) AS vec_id, any_value(kv.v) AS v, min(list_sum(list_transform(list_zip(kv.v, c{i}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * {k} + c) AS m FROM kv, c{i} GROUP BY kv.r)")
        if i < rounds:
            steps.append(f"s{i} AS MATERIALIZED (SELECT c, p, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT m % {k} AS c, unnest(v) AS x, unnest(range({width})) AS p FROM a{i}) GROUP BY c, p)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce((SELECT list((s - ((s % n) + n) % n) // n ORDER BY p) FROM s{i} WHERE s{i}.c = c{i}.c), c{i}.v) AS v FROM c{i})")
    return (
        "WITH " + ",\n".join(steps) + f"\nSELECT vec_id, (m % {k})::INT AS cluster, m // {k} AS distance, (sum(m // {k}) OVER (PARTITION BY m % {k}))::BIGINT AS cluster_inertia, (sum(m // {k}) OVER ())::BIGINT AS inertia, "
        f"sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON c = m % {k}"
    )


REPORT_SQL = _sql()
