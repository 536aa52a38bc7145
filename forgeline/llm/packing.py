"""Packing of documents into training windows, best fit in decreasing order.

A document is its token ids and an end id. It is first cut into full windows; what is left is shorter than a window and packed
whole, so that a document is cut only where it has to be. The pieces, which are a few numbers each, are dealt at random to groups of
about ``GROUP``, and each group is packed for itself: longest piece first, into the tightest open window that still holds it. Open windows
are found in a segment tree over remaining capacities. A group leaves about one window partly empty, whatever its size, so the padding
is about 1 / (windows of a group).

Only numbers are shuffled, or the ids too where they are asked for (``with_ids``). Groups are dealt by a row's place in the written
pieces and not by any key, so copies, a hot source and null ids don't gather in one of them. Memory in a task: an Arrow batch and the
remembered words (bounded in number and length) while encoding, a group while packing.

Null texts are empty: the end id alone. Null doc_ids, repeated rows and very long texts are packed like any others; a repeated row
gives its pieces again. Ties (equal lengths) go by doc_id, start and checksum. Empty tables give no rows. Other columns of ``docs`` are
not looked at, whatever their names; ``pack`` keeps those of its pieces.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from forgeline.llm.common import saved

WINDOW = 4096
END = 2
#: Pieces of a group, about.
GROUP = 1 << 14
#: Words that a worker remembers, and the longest of them.
WORDS, LONGEST = 800_000, 64
#: Words of visible ASCII without apostrophes, and what such a vocabulary takes them apart into: letters, single digits, other characters.
PLAIN = re.compile(r"[!-&(-~]+").fullmatch
PARTS = re.compile(r"[A-Za-z]+|[0-9]|[^A-Za-z0-9]+").findall
#: Fixed value: how a token that ends a word ends.
WORD_END = "</w>"
#: Characters whose words are collected before the unknown ones are encoded; rows of a batch that is handed on.
AT_ONCE, ROWS = 1 << 20, 2048
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class WordEncoder:
    """Packed ids (32-bit little-endian) of whole texts, by a vocabulary that drops white space and never joins over it.

    Words between spaces or line feeds are looked up. Unknown ones of many texts go to the library together: plain ones by their parts, in lower
    case and each part once, others with a special token between any two. Texts that hold a special token's string go to the library whole.
    """

    def __init__(self, path: str, most: int = WORDS):
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.encode = lambda text: np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<i4")
        self.specials = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.between = next((s for s in self.specials if len(self.encode(s)) == 1), None)
        vocabulary = tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.by_parts = self._same("Ab1,c2--d.e", ["ab", "1", ",", "c", "2", "--", "d", ".", "e"]) and self._split(["ab", "1", "--"]) is not None
        # a vocabulary without special tokens, or whose words hang together, gets whole texts
        self.words = {"": b""} if self.between and self._same("one two'll 3\nfour's", ["one", "two'll", "3", "four's"]) else None
        self.parts: dict[str, bytes] = {}
        self.most = most

    def _same(self, text: str, parts: list[str]) -> bool:
        return np.array_equal(self.encode(text), np.concatenate([self.encode(p) for p in parts]))

    def _split(self, parts: list[str]) -> list[bytes] | None:
        """Ids of each of some parts that are a word each; None if they are not."""
        ids = self.encode(" ".join(parts))
        stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(stops) != len(parts):
            return None
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *stops], stops)]

    def _one_by_one(self, words: list[str]) -> dict[str, bytes]:
        ids = self.encode(self.between.join(words))
        ends = np.flatnonzero(ids == self.specials[self.between]).tolist()
        if len(ends) != len(words) - 1:
            raise ValueError("the vocabulary does not keep words apart")
        data = ids.tobytes()
        return {w: data[4 * a : 4 * b] for w, a, b in zip(words, [0, *[e + 1 for e in ends]], [*ends, len(ids)])}

    def _remember(self, held: dict[str, bytes], more: dict[str, bytes]) -> None:
        if len(held) > self.most:
            for _ in range(self.most // 2):  # the newer half: common words come early
                held.popitem()
        held.update((w, b) for w, b in more.items() if len(w) <= LONGEST)

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        found, rest = {}, words
        if self.by_parts:
            plain = {w: PARTS(w.lower()) for w in words if PLAIN(w)}
            new = sorted(set(chain.from_iterable(plain.values())).difference(self.parts))
            fresh = dict(zip(new, self._split(new) or [])) if new else {}
            if len(fresh) == len(new):
                known = self.parts
                found = {w: b"".join([known[p] if p in known else fresh[p] for p in parts]) for w, parts in plain.items()}
                self._remember(self.parts, fresh)
            letters = [w for w in words if w not in plain and w.isalpha()]  # a word each, but for letters that change in lower case
            alone = self._split(letters) if letters else None
            found |= dict(zip(letters, alone or []))
            rest = [w for w in words if w not in found]
        if rest:
            found |= self._one_by_one(rest)
        self._remember(self.words, found)
        return found

    def _group(self, texts: list[str]) -> list[bytes]:
        odd = [self.words is None or any(s in t for s in self.specials) for t in texts]
        split = [None if o else t.replace("\n", " ").split(" ") for t, o in zip(texts, odd)]
        unknown = sorted(set().union(*[w for w in split if w]).difference(self.words or ()))
        fresh = self._learn(unknown) if unknown else {}
        known = self.words
        out = []
        for text, words in zip(texts, split):
            if words is None:
                out.append(self.encode(text).tobytes())
                continue
            try:
                out.append(b"".join(map(known.__getitem__, words)))
            except KeyError:  # a long word, or one forgotten just now
                out.append(b"".join([known[w] if w in known else fresh[w] if w in fresh else self.encode(w).tobytes() for w in words]))
        return out

    def many(self, texts: list[str | None]) -> Iterator[bytes]:
        group, held = [], 0
        for text in texts:
            group.append(text or "")
            held += len(group[-1])
            if held >= AT_ONCE:
                yield from self._group(group)
                group, held = [], 0
        yield from self._group(group)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END, with_ids: bool = False) -> DataFrame:
    """The pieces of each document (doc_id, text): full windows, then the rest; ``with_ids`` adds ids (array<int>)."""
    end = np.int32(end_id).tobytes()
    kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())] * with_ids
    names = [c.split()[0] for c in PIECE.split(", ")] + ["ids"] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            rows = []
            for doc_id, packed in zip(batch["doc_id"].to_pylist(), encode.many(batch["text"].to_pylist())):
                packed += end
                n = len(packed) // 4
                for a in range(0, n, window):
                    own = packed[4 * a : 4 * (a + window)]
                    rows.append((doc_id, a, len(own) // 4, zlib.crc32(own), n, *([np.frombuffer(own, "<i4")] * with_ids)))
                    if len(rows) >= ROWS:
                        yield as_batch(rows, kinds, names)
                        rows = []
            if rows:
                yield as_batch(rows, kinds, names)

    return docs.select("doc_id", "text").mapInArrow(cut, PIECE + ", ids array<int>" * with_ids)


def as_batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


class OpenWindows:
    """Windows by remaining capacity, in a segment tree: a leaf for each capacity, set while a window has it."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.tree = bytearray(2 * self.size)
        self.having: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, capacity: int, window: int) -> None:
        self.having[capacity].append(window)
        k = capacity + self.size
        while k and not self.tree[k]:
            self.tree[k] = 1
            k >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(capacity, window) of the tightest window with ``least`` or more left, which is then no longer open."""
        k = least + self.size
        if not self.tree[k]:
            while k > 1 and (k & 1 or not self.tree[k + 1]):  # up, until there is something to the right
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.size:
                k = 2 * k if self.tree[2 * k] else 2 * k + 1
        capacity = k - self.size
        window = self.having[capacity].pop()
        if not self.having[capacity]:
            self.tree[k] = 0
            while k > 1 and not self.tree[k ^ 1]:
                k >>= 1
                self.tree[k] = 0
        return capacity, window


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(window number, offset) of each piece, in the given order."""
    open_windows, made = OpenWindows(window), 0
    numbers, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for k, n in enumerate(lengths.tolist()):
        found = open_windows.take(n)
        if found is None:
            found, made = (window, made), made + 1
        capacity, numbers[k] = found
        offsets[k] = window - capacity
        if capacity > n:
            open_windows.put(capacity - n, int(numbers[k]))
    return numbers, offsets


def pack(found: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """``found`` (pieces, saved) with sequence_id and offset.

    A sequence_id is its group's number times 2^32 plus the window's number in the group.
    """
    groups = max(1, round(found.count() / group))
    dealt = found.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def place(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        numbers, offsets = best_fit(rows["length"].to_numpy(), window)
        number = rows["_group"][0].as_py() << 32
        return rows.drop_columns("_group").append_column("offset", pa.array(offsets)).append_column("sequence_id", pa.array(number + numbers))

    schema = T.StructType([*found.schema.fields, T.StructField("offset", T.LongType()), T.StructField("sequence_id", T.LongType())])
    return dealt.groupBy("_group").applyInArrow(place, schema)


def packed(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END, with_ids: bool = False, group: int = GROUP) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece; the pieces are written once."""
    return pack(saved(pieces(docs, tokenizer, window, end_id, with_ids), "pieces"), window, group)


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the ids of each window, in order, from pieces packed ``with_ids``; a window bounds what a group holds."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda p: p["ids"])).alias("ids"))


def padding(placed: DataFrame, window: int = WINDOW) -> DataFrame:
    """(sequences, tokens, padding): what filling windows up takes, none at a power of two."""
    sums = placed.groupBy("sequence_id").agg(F.sum("length").alias("_n"))
    whole = F.bit_count("_n") == 1
    return sums.agg(F.count("*").alias("sequences"), F.coalesce(F.sum("_n"), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.when(whole, 0).otherwise(window - F.col("_n"))), F.lit(0)).alias("padding"))
