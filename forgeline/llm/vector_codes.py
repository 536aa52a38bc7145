"""Product codes of vectors: each of ``PARTS`` consecutive parts is named by the nearest entry of its position's codebook.

Codebooks are learnt by exact integer rounds over all vectors. The work of a round is cut down by boxes: vectors are written once in
chunks of ``CHUNK`` rows; in a chunk the parts of each position lie along a Hilbert curve, in flat blocks of ``BLOCK`` neighbours with the
smallest and largest component of each dimension (a box) and the sum of all parts. In a round an entry is on a block's shortlist if
its least distance to the box is not beyond the smallest of the entries' greatest distances. Entries that are off the list are beaten
for every part of the block; where one entry is left, the block's size and sums are taken as they are, and else a small integer kernel compares
the block's parts with the listed entries only.

Chunks are made where the rows lie and nothing of them is shuffled; a round reads them once and returns counts and sums by position
and entry for each task, which Spark adds up. The driver holds the codebooks (``ENTRIES`` a position) and these sums. A task's memory is a
few chunks. The order on the curve only changes how short the lists are, never a result.

Vectors that are null or hold null or non-finite components are dropped. Shorter vectors count as filled up with zeros to the longest one's
length, and that to a multiple of the parts. Null vec_ids come last among first entries, ties of vec_id go by the vector; fewer vectors than
entries give fewer entries; repeated rows count each; an empty table gives no rows. Columns of other names are not looked at. Components whose
squared distances need more than 63 bits are an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgeline.llm.common import saved
from forgeline.llm.knn import matrix

SCALE = 256
PARTS, ENTRIES, ROUNDS = 16, 64, 2
CHUNK, BLOCK = 1 << 13, 64
#: Bits a dimension on the Hilbert curve at most, and bits of a place on it.
FINE, PLACE = 10, 62
#: Arrays are packed by position: parts in curve order, their rows in the chunk, boxes and sums of the blocks.
CHUNKS = "ids array<long>, labels array<int>, kind string, parts array<binary>, places array<binary>, low array<binary>, high array<binary>, sums array<binary>"


def kept(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v: array<long>) of the vectors that take part; a null vec_id or label stays."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return df.filter(F.col("embedding").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def curve(x: np.ndarray) -> np.ndarray:
    """Places of integer points on a Hilbert curve through their bounding box."""
    x = x[:, :PLACE]  # further dimensions don't fit a place
    dims = x.shape[1]
    bits = max(1, min(FINE, PLACE // dims))
    low, span = x.min(0), np.maximum(1, np.ptp(x, axis=0)).astype(np.float64)
    a = np.minimum((x - low) / span * (1 << bits), (1 << bits) - 1).astype(np.int64)
    # undo the rotations and reflections that the curve has made, from the coarsest square to the finest one
    for q in (1 << np.arange(bits - 1, 0, -1)).tolist():
        for i in range(dims):
            upper = (a[:, i] & q) > 0
            swap = np.where(upper, 0, (a[:, 0] ^ a[:, i]) & (q - 1))
            a[:, 0] ^= np.where(upper, q - 1, swap)
            a[:, i] ^= swap
    for i in range(1, dims):
        a[:, i] ^= a[:, i - 1]
    flip = np.zeros(len(a), np.int64)
    for q in (1 << np.arange(bits - 1, 0, -1)).tolist():
        flip ^= np.where(a[:, -1] & q, q - 1, 0)
    a ^= flip[:, None]
    place = np.zeros(len(a), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            place = place << 1 | (a[:, i] >> b & 1)
    return place


def chunks(rows: DataFrame, width: int, parts: int = PARTS, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """Chunks of ``rows`` (vec_id, label, v) with their blocks, where they lie."""
    size = width // parts

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, chunk):
                own = batch.slice(a, chunk)
                v = matrix(own["v"], width)
                most = int(np.abs(v).max(initial=0))
                kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
                out = {"ids": own["vec_id"].to_pylist(), "labels": own["label"].to_pylist(), "kind": kind} | {c: [] for c in ("parts", "places", "low", "high", "sums")}
                for p in range(parts):
                    x = v[:, p * size : (p + 1) * size]
                    order = np.argsort(curve(x), kind="stable")
                    x, begins = x[order], np.arange(0, len(x), block)
                    out["parts"].append(x.astype(kind).tobytes())
                    out["places"].append(order.astype("<u4").tobytes())
                    for name, f, as_kind in (("low", np.minimum, kind), ("high", np.maximum, kind), ("sums", np.add, "<i8")):
                        out[name].append(f.reduceat(x, begins, axis=0).astype(as_kind).tobytes())
                yield pa.RecordBatch.from_pylist([out], CHUNK_SCHEMA)

    return rows.mapInArrow(pack, CHUNKS)


CHUNK_SCHEMA = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int32())), ("kind", pa.string()), *[(c, pa.list_(pa.binary())) for c in ("parts", "places", "low", "high", "sums")]])


def shortlists(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Which entries can be nearest to something in each box: (boxes, entries)."""
    below, above = low[:, None] - entries, entries - high[:, None]
    least = (np.maximum(0, np.maximum(below, above)) ** 2).sum(2)
    most = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(2)
    return least <= most.min(1, keepdims=True)


class Position:
    """A chunk's parts of one position, in curve order, with their blocks' boxes and sums."""

    def __init__(self, row: dict, p: int, size: int, block: int):
        kind = row["kind"].as_py()
        of = lambda name, kind: np.frombuffer(row[name][p].as_buffer(), kind).reshape(-1, size).astype(np.int64)
        self.parts, self.low, self.high = of("parts", kind), of("low", kind), of("high", kind)
        self.row, self.p, self.size, self.block = row, p, size, block

    def sums(self) -> np.ndarray:
        return np.frombuffer(self.row["sums"][self.p].as_buffer(), "<i8").reshape(-1, self.size)

    def nearest(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each part in curve order (ties: the lower one), and for each block its only candidate, or -1."""
        listed = shortlists(self.low, self.high, entries)
        alone = np.where(listed.sum(1) == 1, listed.argmax(1), -1)
        out = np.repeat(np.maximum(alone, 0), self.block)[: len(self.parts)]
        for b in np.flatnonzero(alone < 0).tolist():
            few = np.flatnonzero(listed[b])
            a = b * self.block
            x = self.parts[a : a + self.block]
            out[a : a + self.block] = few[((x[:, None] - entries[few]) ** 2).sum(2).argmin(1)]
        return out, alone


def fits(width: int, entries: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
    most = float(max(np.abs(low).max(initial=0), np.abs(high).max(initial=0))) + float(np.abs(entries).max(initial=0))
    if most**2 * width >= 2.0**63:
        raise OverflowError("squared distances need more than 63 bits")


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch[name][k] for name in batch.schema.names}


def taken(data: DataFrame, books: np.ndarray, block: int = BLOCK) -> DataFrame:
    """(p, e, n, sums) of each task: how many parts of position p are nearest to entry e, and their sums."""
    parts, entries, size = books.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64)
        for row in rows_of(batches):
            for p in range(parts):
                own = Position(row, p, size, block)
                fits(size, books[p], own.low, own.high)
                near, alone = own.nearest(books[p])
                counts[p] += np.bincount(near, minlength=entries)
                whole = np.flatnonzero(alone >= 0)
                np.add.at(sums[p], alone[whole], own.sums()[whole])
                rest = np.repeat(alone < 0, block)[: len(near)]
                np.add.at(sums[p], near[rest], own.parts[rest])
        p, e = np.nonzero(counts)
        if len(p):
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(counts[p, e]), pa.array(sums[p, e].tolist(), pa.list_(pa.int64()))], names=["p", "e", "n", "sums"])

    return data.select("kind", "parts", "low", "high", "sums").mapInArrow(work, "p int, e int, n long, sums array<long>")


def next_books(data: DataFrame, books: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Entries moved to the floor of their parts' mean; unused ones stay."""
    found = taken(data, books, block)
    each = found.select("p", "e", "n", F.posexplode("sums").alias("d", "s")).groupBy("p", "e", "d").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    out = books.copy()
    for r in each.collect():  # a number of the codebooks each
        out[r["p"], r["e"], r["d"]] = r["s"] // r["n"]
    return out


def coded(data: DataFrame, books: np.ndarray, block: int = BLOCK) -> DataFrame:
    """(vec_id, label, code, error) of all vectors."""
    parts, _, size = books.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            n = len(row["ids"])
            codes, error = np.empty((n, parts), np.uint8), np.zeros(n, np.int64)
            for p in range(parts):
                own = Position(row, p, size, block)
                fits(parts * size, books[p], own.low, own.high)
                near, _ = own.nearest(books[p])
                place = np.frombuffer(row["places"][p].as_buffer(), "<u4")
                codes[place, p] = near
                error[place] += ((own.parts - books[p][near]) ** 2).sum(1)
            digits = codes.tobytes().hex()
            code = [digits[a : a + 2 * parts] for a in range(0, len(digits), 2 * parts)]
            yield pa.RecordBatch.from_arrays([row["ids"].values, row["labels"].values, pa.array(code, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return data.drop("sums").mapInArrow(work, "vec_id long, label int, code string, error long")


def compressed(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, chunk: int = CHUNK, block: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of ``rows`` (vec_id, label, v), written, and the codebooks (part, entry, component)."""
    if not 0 < entries <= 256:
        raise ValueError("an entry's number has two hexadecimal digits: 1 to 256 entries")
    width = -(-max(1, rows.agg(F.max(F.size("v"))).first()[0] or 0) // parts) * parts
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    books = np.zeros((len(first), width), np.int64)
    for book, r in zip(books, first):
        book[: len(r["v"])] = r["v"]
    books = books.reshape(len(first), parts, width // parts).transpose(1, 0, 2).copy()
    if not len(first):
        return rows.sparkSession.createDataFrame([], "vec_id long, label int, code string, error long"), books
    data = saved(chunks(rows, width, parts, chunk, block), "vector-chunks")
    for _ in range(rounds):
        books = next_books(data, books, block)
    return saved(coded(data, books, block), "vector-codes"), books


def decoded(codes: DataFrame, books: np.ndarray, width: int | None = None) -> DataFrame:
    """``codes`` (with a column code) with approximation (array<long>): the entries that the codes name, in part order."""
    table = F.array(*[F.array(*[F.array(*[F.lit(int(x)) for x in entry]) for entry in book]) for book in books])
    named = F.transform(F.sequence(F.lit(0), F.lit(len(books) - 1)), lambda p: F.get(F.get(table, p), F.conv(F.substr(F.col("code"), 2 * p + 1, F.lit(2)), 16, 10).cast("int")))
    whole = F.flatten(named)
    return codes.withColumn("approximation", F.slice(whole, 1, width) if width else whole)


def report(df: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of the vectors of ``df`` (vec_id, embedding, label).

    Errors are summed by label before they are joined to the codes, so that Spark can split a label with very many rows.
    """
    codes, books = compressed(kept(df))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    sums = codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return codes.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql(width: int = 64, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same in DuckDB for vectors of one length: every part against every entry."""
    size = width // parts
    far = " + ".join(f"(x.v[{d}] - b.v[{d}]) * (x.v[{d}] - b.v[{d}])" for d in range(1, size + 1))
    steps = [
        f"kv AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings "
        "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"pp AS (SELECT unnest(range({parts})) AS p)",
        f"xs AS MATERIALIZED (SELECT r, p, v[{size} * p + 1 : {size} * p + {size}] AS v FROM kv, pp)",
        f"b0 AS MATERIALIZED (SELECT p, e, v[{size} * p + 1 : {size} * p + {size}] AS v FROM (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e, v FROM kv ORDER BY vec_id NULLS LAST, v LIMIT {entries}), pp)",
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT x.r, x.p, any_value(x.v) AS v, min(({far}) * 256 + e) AS m FROM xs x JOIN b{i} b USING (p) GROUP BY x.r, x.p)")
        if i < rounds:
            steps.append(f"s{i} AS MATERIALIZED (SELECT p, m % 256 AS e, d, sum(y)::BIGINT AS s, count(*) AS n FROM (SELECT p, m, unnest(v) AS y, unnest(range({size})) AS d FROM a{i}) GROUP BY 1, 2, 3)")
            steps.append(f"b{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce((SELECT list((s - ((s % n) + n) % n) // n ORDER BY d) FROM s{i} s WHERE s.p = b.p AND s.e = b.e), b.v) AS v FROM b{i} b)")
    return (
        "WITH " + ",\n".join(steps) + f",\ncd AS (SELECT r, string_agg(printf('%02x', m % 256), '' ORDER BY p) AS code, sum(m // 256)::BIGINT AS error FROM a{rounds} GROUP BY r) SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, "
        f"(SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256 FROM cd JOIN kv USING (r)"
    )


REPORT_SQL = _sql()
