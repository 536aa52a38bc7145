"""Token-id files of patched frame-of-reference blocks.

A file holds the ids of consecutive documents, each followed by an end id, as one sequence cut into blocks of
``BLOCK`` ids. A block keeps its minimum, the differences packed at the width that a percentile of them needs, and
a list of exceptions for the differences that are wider. The footer indexes the blocks' starts and the documents.

Layout (little-endian):

    b"PFORIDS1"
    blocks:  minimum u32, width u8, exceptions u16, packed differences (BLOCK * width / 8 bytes),
             positions of exceptions u16, their differences u32
    footer:  block starts u64 each; documents: has_id u8 each, doc_id i64 each, n_tokens u64 each
    tail:    block count u64, document count u64, footer start u64, b"PFORIDS1"

The last block is filled up with its own minimum. Documents are dealt by ranges of doc_id and the beginning of the text and sorted; a
partition's files are closed at ``FILE_IDS`` ids or ``FILE_DOCUMENTS`` documents and numbered on. A file's name carries a random part and only
names in the manifest count, so a repeated or lost attempt leaves nothing behind that is read. Memory in a task: one Arrow batch and a
file's footer, both bounded; a file is read by one task.

Null doc_ids come first and are spread like others; repeated rows are written each, one after another; a text of any length lies in one file. An
empty table gives no file, an empty manifest and no rows. Other columns of documents are not looked at, whatever their names.
"""

from __future__ import annotations

import functools
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from forgeline.llm.bpe import PieceSplitter
from forgeline.llm.common import prefix_sums, saved, shared_dir

MAGIC = b"PFORIDS1"
BLOCK = 2048
#: Share of a block's differences that fit its width.
FITTING = 0.9
HEADER = struct.Struct("<IBH")
TAIL = struct.Struct("<QQQ8s")
#: Words that are empty, begin or end with white space, or hold any but single line feeds.
ODD = re.compile(r"^\s|\s$|[^\S\n]|\n\n|^$").search
#: Words that a worker remembers.
WORDS = 1_700_000
#: Rows that are encoded and written at once.
ROWS = 2048
#: Ids and documents from which a file is closed and the next one begun.
FILE_IDS, FILE_DOCUMENTS = 1 << 26, 1 << 20
#: Characters of a text that range partitions look at, so that rows of one doc_id are shared among tasks.
PREFIX = 64
MANIFEST = "part long, file string, documents long, tokens long, bytes long"


def pack_block(ids: np.ndarray, fitting: float = FITTING) -> bytes:
    """A block of ids (unsigned 32-bit, ``len(ids)`` a multiple of 8 up to 65,536)."""
    least = int(ids.min())
    rest = ids - np.uint32(least)
    at = min(len(rest) - 1, int(len(rest) * fitting))
    width = int(np.partition(rest, at)[at]).bit_length()
    odd = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.empty(0, np.int64)
    bits = np.unpackbits(rest.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, count=width, bitorder="little") if width else np.empty(0, np.uint8)
    return HEADER.pack(least, width, len(odd)) + np.packbits(bits, bitorder="little").tobytes() + odd.astype("<u2").tobytes() + rest[odd].astype("<u4").tobytes()


def unpack_block(data: memoryview, at: int, size: int = BLOCK) -> np.ndarray:
    least, width, n = HEADER.unpack_from(data, at)
    at += HEADER.size
    ids = np.zeros(size, "<u4")
    if width:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, size * width // 8, at), bitorder="little").reshape(size, width)
        packed = np.packbits(bits, axis=1, bitorder="little")
        ids.view(np.uint8).reshape(size, 4)[:, : packed.shape[1]] = packed
    at += size * width // 8
    ids[np.frombuffer(data, "<u2", n, at)] = np.frombuffer(data, "<u4", n, at + 2 * n)
    return ids + np.uint32(least)


class Writer:
    """Writes one file; ``add`` takes the ids of documents in order."""

    def __init__(self, out):
        self.out, self.at, self.rest, self.starts, self.ids, self.counts, self.total = out, 0, np.empty(0, "<u4"), [], [], [], 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_ids: list[int | None], packed: list[bytes]) -> None:
        self.ids += doc_ids
        self.counts += [len(p) // 4 for p in packed]
        self.total += sum(map(len, packed)) // 4
        ids = np.concatenate([self.rest, np.frombuffer(b"".join(packed), "<u4")])
        full = len(ids) // BLOCK * BLOCK
        for k in range(0, full, BLOCK):
            self.starts.append(self.at)
            self._put(pack_block(ids[k : k + BLOCK]))
        self.rest = ids[full:]

    def close(self) -> int:
        if len(self.rest):
            self.starts.append(self.at)
            self._put(pack_block(np.concatenate([self.rest, np.full(BLOCK - len(self.rest), self.rest.min(), "<u4")])))
        footer = self.at
        known = [i is not None for i in self.ids]
        for values, kind in ((self.starts, "<u8"), (known, "u1"), ([i or 0 for i in self.ids], "<i8"), (self.counts, "<u8")):
            self._put(np.array(values, dtype=kind).tobytes())
        self._put(TAIL.pack(len(self.starts), len(self.ids), footer, MAGIC))
        return self.at


class Reader:
    """Reads a file: ``documents`` are (doc_id, tokens), ``ids(a, b)`` the ids from position a up to b."""

    def __init__(self, file):
        size = file.size()
        blocks, documents, footer, magic = TAIL.unpack(file.read_at(TAIL.size, size - TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a token-id file, or cut short")
        data = file.read_at(size - TAIL.size - footer, footer)
        self.file, self.footer = file, footer
        self.starts = np.frombuffer(data, "<u8", blocks)
        known = np.frombuffer(data, "u1", documents, 8 * blocks)
        ids = np.frombuffer(data, "<i8", documents, 8 * blocks + documents)
        self.counts = np.frombuffer(data, "<u8", documents, 8 * blocks + 9 * documents)
        self.doc_ids = [int(i) if k else None for i, k in zip(ids, known)]

    def ids(self, a: int, b: int) -> np.ndarray:
        if a >= b:
            return np.empty(0, "<u4")
        first, last = a // BLOCK, -(-b // BLOCK)
        begin = int(self.starts[first])
        end = int(self.starts[last]) if last < len(self.starts) else self.footer
        data = memoryview(self.file.read_at(end - begin, begin))
        return np.concatenate([unpack_block(data, int(self.starts[k]) - begin) for k in range(first, last)])[a - first * BLOCK : b - first * BLOCK]


class LibrarySplitter(PieceSplitter):
    """Words encoded by the tokenizers library, many in one call, and whole texts where words don't stand for themselves.

    Words go to the library as one text, each after a space. Only a word's first token holds that space, so the tokens that
    start with one mark where the words begin.
    """

    def __init__(self, path: str):
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        # the batch call keeps no offsets of tokens, which nobody asks for here
        self.encode = lambda text: np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<i4")
        super().__init__(self._alone, {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}, WORDS)
        space = tokenizer.id_to_token(int(self.encode(" ")[0]))
        vocabulary = tokenizer.get_vocab()
        self.starts = np.zeros(max(vocabulary.values()) + 1, bool)
        self.starts[[i for token, i in vocabulary.items() if token.startswith(space)]] = True

    def _alone(self, text: str) -> bytes:
        return self.encode(text).tobytes()

    def plain(self, text: str) -> bytes:
        return self.tokens[text] if len(text) < 32 else self._alone(text)

    def whole(self, text: str) -> bytes:
        return self._alone(text)

    def learn(self, words: set[str]) -> None:
        odd = {w for w in words if ODD(w)}
        even = list(words.difference(odd))
        if even:
            ids = self.encode(" " + " ".join(even))
            begins = (4 * np.flatnonzero(self.starts[ids])).tolist()
            if len(begins) != len(even):
                raise ValueError("the vocabulary does not keep words apart")
            data = ids.tobytes()
            self.words.update(zip(even, [data[a:b] for a, b in zip(begins, [*begins[1:], len(data)])]))
        self.words.update((w, None if not w or w[0].isspace() or w[-1].isspace() else self._alone(" " + w)) for w in odd)


@functools.lru_cache(maxsize=2)
def library_splitter(path: str) -> LibrarySplitter:
    return LibrarySplitter(path)


def write(df: DataFrame, tokenizer: str, folder: str, end_id: int = 0, file_ids: int = FILE_IDS, file_documents: int = FILE_DOCUMENTS, rows: int = ROWS) -> DataFrame:
    """Write the ids of documents in ascending doc_id order; returns the manifest, one row a file.

    Null doc_ids come first; documents with one doc_id are ordered by text. Null texts are empty: only the end id.
    """
    end = np.int32(end_id).tobytes()

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, number, writer, name = library_splitter(tokenizer), TaskContext.get().partitionId(), 0, None, ""
        system, base = pafs.FileSystem.from_uri(folder)

        def close() -> pa.RecordBatch:
            size = writer.close()
            writer.out.close()
            return pa.RecordBatch.from_pylist([{"part": part << 24 | number, "file": f"{folder}/{name}", "documents": len(writer.ids), "tokens": int(sum(writer.counts)), "bytes": size}])

        for batch in batches:
            for a in range(0, batch.num_rows, rows):
                own = batch.slice(a, rows)
                if writer is None:
                    system.create_dir(base, recursive=True)
                    name = f"part-{part:06d}-{number:06d}-{uuid.uuid4().hex}.pfor"
                    writer = Writer(system.open_output_stream(f"{base}/{name}"))
                writer.add(own["doc_id"].to_pylist(), [ids + end for ids in encode.many(own["text"].to_pylist())])
                if writer.total >= file_ids or len(writer.ids) >= file_documents:
                    yield close()
                    writer, number = None, number + 1
        if writer is not None:
            yield close()

    ordered = df.select("doc_id", "text").repartitionByRange("doc_id", F.substring("text", 1, PREFIX)).sortWithinPartitions("doc_id", "text")
    return saved(ordered.mapInArrow(files, MANIFEST), "token-manifest")


def read(manifest: DataFrame, at_once: int = 4_000_000) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all documents in the files; ids are read ``at_once`` at most, or a document."""
    parts = manifest.select("part", "file", "tokens", F.lit(1).alias("one"))
    starts = prefix_sums(parts, "part", {"base": "tokens"})

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, path = pafs.FileSystem.from_uri(row["file"])
                with system.open_input_file(path) as file:
                    yield from rows_of(Reader(file), row["base"], at_once)

    # a file a task, or a few; the number given keeps Spark from joining small partitions
    return starts.select("file", "base").repartition(max(1, manifest.count()), "file").mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def rows_of(reader: Reader, base: int, at_once: int) -> Iterator[pa.RecordBatch]:
    ends = np.cumsum(reader.counts.astype(np.int64))
    k = 0
    while k < len(ends):
        first = int(ends[k - 1]) if k else 0
        stop = max(k + 1, int(np.searchsorted(ends, first + at_once, "right")))
        data = reader.ids(first, int(ends[stop - 1])).tobytes()
        begin = [first, *ends[k : stop - 1].tolist()]
        crc = [zlib.crc32(data[4 * (a - first) : 4 * (int(b) - first)]) for a, b in zip(begin, ends[k:stop])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(reader.doc_ids[k:stop], pa.int64()), pa.array([base + a for a in begin], pa.int64()), pa.array(reader.counts[k:stop].astype(np.int64)), pa.array(crc, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"],
        )
        k = stop


def round_trip(df: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Write all documents and read the files back."""
    return read(write(df, tokenizer, folder or shared_dir(df.sparkSession, "token-files")))
