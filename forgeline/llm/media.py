"""Media columns: payloads in archives, read by a Spark data source that plans byte ranges.

``store`` packs each text as an 8-bit grey PNG (lossless) into plain tar archives, with a sidecar index beside each
archive that holds the members' offsets. ``ArchiveSource`` (format ``media_archive``) lists archive folders, plans one
partition for each byte range of an archive, and streams the members that start in a range through Arrow. A member
that can't be read or whose checksum is wrong is tried again by its offset, alone; after that its row has an error
and no payload, and the others are not affected.

Null texts are empty. A payload is the UTF-8 text filled up with spaces to a positive multiple of ``ROW`` bytes. Equal
texts give equal stored forms, and rows that repeat are members of their own. A text of any length is one member: a task holds
it, its image and a batch of ``batch_bytes``, whatever the range. Only doc_id and text are read, so other columns of any
name do no harm and are not kept. An empty table makes no archive and reads as no rows. Archive names carry a random part and
only archives in the manifest count.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import time
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from forgeline.llm.common import saved, shared_dir

#: Samples in a row of the image.
ROW = 192
#: Bytes from which an archive is closed.
ARCHIVE_BYTES = 256 << 20
#: Least and most bytes of a range, and ranges that are planned where both allow it: the driver holds an object for each.
LEAST_RANGE, MOST_RANGE, RANGES = 16 << 20, 1 << 30, 20_000
SIGNATURE = b"\x89PNG\r\n\x1a\n"
INDEX = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("crc32", pa.int64())])
MEMBER = "archive string, offset long, doc_id long, n_bytes long, media binary, error string"


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(payload: bytes, level: int = 1) -> bytes:
    """Samples as a grey image of ``ROW`` columns."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)  # a filter byte (none) before each row
    lines[:, 1:] = rows
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + chunk(b"IEND", b"")


def samples(image: bytes) -> bytes:
    """The samples of an image that ``png`` made."""
    if image[:8] != SIGNATURE:
        raise ValueError("no PNG")
    at, data, width = 8, [], 0
    while at < len(image):
        n, kind = struct.unpack_from(">I4s", image, at)
        body = image[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", image, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("broken chunk")
        if kind == b"IHDR":
            width = struct.unpack_from(">I", body)[0]
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, width + 1)
    return lines[:, 1:].tobytes()


def payload_of(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode()
    return data.ljust(max(1, -(-len(data) // ROW)) * ROW, b" "), len(data)


def store(df: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, level: int = 1) -> DataFrame:
    """Write documents (doc_id, text) to archives in ``folder``, where they lie: nothing is shuffled.

    Returns the manifest, saved in ``folder``: archive, members, bytes. An archive is closed once it has ``archive_bytes``.
    """

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = pafs.FileSystem.from_uri(folder)
        part, out, index, at = TaskContext.get().partitionId(), None, [], 0

        def close() -> pa.RecordBatch:
            out.write(bytes(1024))
            out.close()
            with system.open_output_stream(f"{base}/{name}.idx") as file, pa.ipc.new_file(file, INDEX) as sink:
                sink.write_table(pa.Table.from_pylist(index, INDEX))
            return pa.RecordBatch.from_pylist([{"archive": name, "members": len(index), "bytes": at + 1024}])

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                if out is None:
                    name = f"part-{part:06d}-{uuid.uuid4().hex}.tar"
                    system.create_dir(base, recursive=True)
                    out, index, at = system.open_output_stream(f"{base}/{name}"), [], 0
                payload, n = payload_of(text)
                image = png(payload, level)
                entry = tarfile.TarInfo(f"{len(index):08d}.png")
                entry.size = len(image)
                head = entry.tobuf(tarfile.GNU_FORMAT)
                index.append({"doc_id": doc_id, "n_bytes": n, "offset": at + len(head), "length": len(image), "crc32": zlib.crc32(image)})
                block = head + image + bytes(-len(image) % 512)
                out.write(block)
                at += len(block)
                if at >= archive_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return saved(df.select("doc_id", "text").mapInArrow(archives, "archive string, members long, bytes long"), "manifest", f"{folder}/manifest")


class ByteRange:
    def __init__(self, archive: str, begin: int, end: int):
        self.archive, self.begin, self.end = archive, begin, end


class ByteRanges(InputPartition):
    def __init__(self, ranges: list[ByteRange]):
        self.ranges = ranges


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.range_bytes = int(options.get("range_bytes", 0))
        self.ranges = int(options.get("ranges", RANGES))
        self.tries = int(options.get("tries", 3))
        self.only_manifest = options.get("manifest") == "true"
        self.batch_bytes = int(options.get("batch_bytes", 8 << 20))

    def partitions(self) -> list[InputPartition]:
        """One partition for each ``range_bytes`` of an archive; only archives' names and sizes are looked at.

        Without that option partitions are as large as about ``RANGES`` of them need, of several archives if need be, so their number doesn't
        follow the data.
        """
        system, base = pafs.FileSystem.from_uri(self.folder)
        if self.only_manifest:
            files = [f for f in system.get_file_info(pafs.FileSelector(f"{base}/manifest")) if f.path.endswith(".parquet")]
            found = [(f"{base}/{x['archive']}", x["bytes"]) for f in files for x in pq.read_table(f.path, filesystem=system, columns=["archive", "bytes"]).to_pylist()]
        else:
            found = [(f.path, f.size) for f in system.get_file_info(pafs.FileSelector(base, allow_not_found=True)) if f.path.endswith(".tar")]
        goal = self.range_bytes or max(LEAST_RANGE, sum(size for _, size in found) // self.ranges)
        step = min(MOST_RANGE, goal)
        out, held = [], goal
        for r in [ByteRange(path, a, min(size, a + step)) for path, size in sorted(found) for a in range(0, size, step)]:
            if self.range_bytes or held + r.end - r.begin > goal:
                out.append([])
                held = 0
            out[-1].append(r)
            held += r.end - r.begin
        return [ByteRanges(ranges) for ranges in out] or [ByteRanges([])]

    def member(self, file, row: dict) -> tuple[bytes | None, str | None]:
        """A member's bytes, or what was wrong the last time."""
        wrong = ""
        for k in range(self.tries):
            if k:
                time.sleep(0.1 * k)
            try:
                data = file.read_at(row["length"], row["offset"])
                if len(data) == row["length"] and zlib.crc32(data) == row["crc32"]:
                    return data, None
                wrong = "checksum or length differs"
            except OSError as e:
                wrong = str(e)
        return None, wrong

    def read(self, partition: ByteRanges) -> Iterator[pa.RecordBatch]:
        for one in partition.ranges:
            yield from self.members(one)

    def members(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        system, _ = pafs.FileSystem.from_uri(self.folder)
        if not system.get_file_info(f"{partition.archive}.idx").is_file:
            return  # an attempt that did not end
        with system.open_input_file(f"{partition.archive}.idx") as file:
            index = pa.ipc.open_file(file).read_all()
        offsets = index["offset"].to_numpy()
        first, last = np.searchsorted(offsets, [partition.begin, partition.end])
        rows, held, name = [], 0, partition.archive.rpartition("/")[2]
        with system.open_input_file(partition.archive) as file:
            for row in index.slice(first, last - first).to_pylist():
                media, error = self.member(file, row)
                rows.append((name, row["offset"], row["doc_id"], row["n_bytes"], media, error))
                held += row["length"]
                if held >= self.batch_bytes:
                    yield as_batch(rows)
                    rows, held = [], 0
        if rows:
            yield as_batch(rows)


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["archive", "offset", "doc_id", "n_bytes", "media", "error"])


class ArchiveSource(DataSource):
    """``spark.read.format("media_archive").load(folder)``; options range_bytes, ranges, tries, batch_bytes, manifest."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return MEMBER

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)


def load(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Members of the archives in a folder: archive, offset, doc_id, n_bytes, media, error."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archive").options(**{k: str(v) for k, v in options.items()}).load(folder)


def features(df: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the digests and features of stored payloads.

    The feature names the rows, the rounded mean, the mean absolute difference of neighbours (in 1/1000) and the 64-bit
    average hash of an 8 x 8 reduction: bit 1 where a cell's mean is above the image's.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, n, media in zip(batch["doc_id"].to_pylist(), batch["n_bytes"].to_pylist(), batch["media"].to_pylist()):
                data = samples(media)
                rows.append((doc_id, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(data)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[f.split()[0] for f in schema.split(", ")])

    return df.select("doc_id", "n_bytes", "media").mapInArrow(measure, schema)


def feature(data: bytes) -> str:
    x = np.frombuffer(data, np.uint8)
    total, n = int(x.sum(dtype=np.int64)), len(x)
    steps = int(np.abs(np.diff(x.astype(np.int16))).sum(dtype=np.int64))
    cuts = n // ROW * np.arange(8) // 8
    grid = np.add.reduceat(x.reshape(-1, 8, ROW // 8).sum(axis=2, dtype=np.int64), cuts, axis=0)
    sizes = np.maximum(1, np.diff([*cuts, n // ROW])) * (ROW // 8)
    bits = (grid * n > total * sizes[:, None]).ravel()
    return f"rows={n // ROW};mean={(2 * total + n) // (2 * n)};step={1000 * steps // max(1, n - 1)};ahash={int(np.packbits(bits).tobytes().hex(), 16):016x}"


def round_trip(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Store all documents, read the archives back through the data source and compute the features.

    Only archives of the manifest are kept; a member that stays unreadable ends the run with its error.
    """
    folder = folder or shared_dir(df.sparkSession, "media")
    store(df, folder)
    members = load(df.sparkSession, folder, manifest="true")
    good = F.when(F.col("error").isNull(), F.col("media")).otherwise(F.raise_error(F.concat(F.lit("unreadable member: "), F.col("error"))).cast("binary"))
    return features(members.withColumn("media", good))


