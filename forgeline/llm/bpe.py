"""Byte-level BPE encoding and decoding from a public vocabulary file.

Encoding merges symbols of a doubly linked list in the order of a priority queue of merge ranks; entries whose
symbols have changed meanwhile are skipped. Decoding concatenates vocabulary strings. Both are Arrow UDFs over
one column, so Spark keeps partitioning, retries and the other columns; nothing is shuffled. ``round_trips`` does both in one pass.

Null texts count as empty and give an empty list. Texts of any length are encoded whole. Repeated rows give
repeated results; a column that has the name of the result is replaced. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the split pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words and split tokens that a worker remembers. Beyond these it forgets the newer half: common ones come early.
WORDS, TOKENS = 300_000, 100_000
#: Characters of the longest word or split token that is remembered, so that what is remembered is bounded in bytes too.
LONGEST = 64
#: Rows of an Arrow batch that are Python objects at once.
ROWS = 512


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return [c for _, c in sorted([(b, chr(b)) for b in plain] + [(b, chr(256 + k)) for k, b in enumerate(rest)])]


class Remembered(dict):
    """A dictionary that computes what is missing and never holds more than ``most`` entries."""

    def __init__(self, compute: Callable, most: int):
        super().__init__()
        self.compute, self.most = compute, most

    def __missing__(self, key):
        value = self.compute(key)
        if len(self) >= self.most:
            for _ in range(self.most // 2):
                self.popitem()
        self[key] = value
        return value


class PieceSplitter:
    """Packed ids (32-bit little-endian) of whole texts, from the ids of split tokens.

    Between two words of a text without odd white space a token always starts at the single space, so words are
    looked up whole, the unknown ones of many texts together; other texts are split by the pattern. ``token_ids`` turns a
    split token into packed ids.
    """

    def __init__(self, token_ids: Callable[[str], bytes], specials: dict[str, int], words: int = WORDS, tokens: int = TOKENS):
        self.token_ids, self.tokens, self.words, self.most = token_ids, Remembered(token_ids, tokens), {}, words
        self.split = regex.compile(PATTERN).findall
        self.specials = {k: np.int32(v).tobytes() for k, v in specials.items()}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None

    def plain(self, text: str) -> bytes:
        """Ids of a text without special tokens, by the pattern."""
        return b"".join([self.tokens[t] if len(t) <= LONGEST else self.token_ids(t) for t in self.split(text)])

    def whole(self, text: str) -> bytes:
        """Ids of any text, by the pattern."""
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        return b"".join(self.specials[t] if t in self.specials else self.plain(t) for t in self.special.split(text) if t)

    def encoded_words(self, words: list[str]) -> Iterable[bytes]:
        """Ids of a space and a word, for each of some words that neither start nor end with white space."""
        return [self.plain(" " + w) for w in words]

    def learn(self, words: set[str]) -> None:
        """Take unknown words up; those that do not stand for themselves as None."""
        alone = [w for w in words if w and not w[0].isspace() and not w[-1].isspace()]
        self.words.update(dict.fromkeys(words))
        self.words.update(zip(alone, self.encoded_words(alone)))

    def __call__(self, text: str | None) -> bytes:
        return self.many([text])[0]

    def many(self, texts: list[str | None], at_once: int = 1 << 20) -> list[bytes]:
        """Packed ids of many texts; words are collected over about ``at_once`` characters."""
        out, group, held = [], [], 0
        for text in texts:
            group.append(text or "")
            held += len(group[-1])
            if held >= at_once:
                out += self._group(group)
                group, held = [], 0
        return out + self._group(group)

    def _group(self, texts: list[str]) -> list[bytes]:
        split = [None if self.special is not None and self.special.search(t) else t.split(" ") for t in texts]
        if len(self.words) > self.most:
            for _ in range(self.most // 2):
                self.words.popitem()
        unknown: set[str] = set()
        for words in split:
            if words:
                unknown.update(words[1:])
        unknown = unknown.difference(self.words)
        self.learn(unknown)
        ids = self.words.__getitem__
        out = []
        for text, words in zip(texts, split):
            if words is None or (words[0] and words[0][-1].isspace()):
                out.append(self.whole(text))
                continue
            try:
                out.append(self.plain(words[0]) + b"".join(map(ids, words[1:])))
            except TypeError:  # a None among them
                out.append(self.whole(text))
        for word in unknown:
            if len(word) > LONGEST:
                del self.words[word]
        return out


class BytePairs:
    """A vocabulary file's merges and tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        vocab, merges = data["model"]["vocab"], data["model"]["merges"]
        self.specials = {t["content"]: t["id"] for t in data["added_tokens"]}
        characters = byte_characters()
        of = {c: b for b, c in enumerate(characters)}
        self.strings = [b""] * (max([*vocab.values(), *self.specials.values()]) + 1)
        for token, i in vocab.items():
            self.strings[i] = bytes(of[c] for c in token)
        for token, i in self.specials.items():
            self.strings[i] = token.encode()
        self.first = [vocab.get(c, -1) for c in characters]
        # by rank: the pair that a merge takes and what it makes; by left symbol: the ranks of its right ones, none for a missing symbol
        self.left, self.right, self.made = [], [], []
        self.ranks: list[dict[int, int]] = [{} for _ in range(len(self.strings) + 1)]
        for rank, pair in enumerate(merges):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.left.append(vocab[left])
            self.right.append(vocab[right])
            self.made.append(vocab[left + right])
            self.ranks[vocab[left]].setdefault(vocab[right], rank)

    def merge(self, data: bytes) -> list[int]:
        """Ids of one split token's bytes.

        The queue holds ranks with places, in one number each; an entry is stale if its place or the next one holds other symbols by now.
        """
        first, ranks, left, right, made = self.first, self.ranks, self.left, self.right, self.made
        symbols = [first[b] for b in data]
        n = len(symbols)
        symbols.append(-1)  # an end that merges with nothing
        before, after, shift = list(range(-1, n)), list(range(1, n + 1)), n.bit_length()
        place = (1 << shift) - 1
        queue = [rank << shift | i for i in range(n - 1) if (rank := ranks[symbols[i]].get(symbols[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            rank, i = entry >> shift, entry & place
            j = after[i]
            if symbols[i] != left[rank] or symbols[j] != right[rank]:
                continue
            new = symbols[i] = made[rank]
            symbols[j] = -1
            k = after[i] = after[j]
            before[k] = i
            if (rank := ranks[new].get(symbols[k])) is not None:
                heapq.heappush(queue, rank << shift | i)
            p = before[i]
            if p >= 0 and (rank := ranks[symbols[p]].get(new)) is not None:
                heapq.heappush(queue, rank << shift | p)
        return [s for s in symbols if s >= 0]

    def token_ids(self, token: str) -> bytes:
        return np.array(self.merge(token.encode()), dtype="<i4").tobytes()

    def decode(self, ids: Iterable[int]) -> str:
        strings = self.strings
        return b"".join([strings[i] for i in ids]).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> BytePairs:
    return BytePairs(path)


@functools.lru_cache(maxsize=2)
def splitter(path: str, words: int = WORDS) -> PieceSplitter:
    pairs = vocabulary(path)
    return PieceSplitter(pairs.token_ids, pairs.specials, words, TOKENS * words // WORDS)


def id_lists(packed: list[bytes]) -> pa.Array:
    """A list<int> array from packed ids."""
    ends = np.cumsum([0, *(len(p) // 4 for p in packed)])
    if ends[-1] >= 1 << 31:
        raise ValueError("too many ids for one batch: lower spark.sql.execution.arrow.maxRecordsPerBatch")
    values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(packed))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def ids_of(text: Column, tokenizer: str) -> Column:
    """array<int>: the ids of a text."""

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        ids = splitter(tokenizer)
        return id_lists([packed for k in range(0, len(texts), ROWS) for packed in ids.many(texts.slice(k, ROWS).to_pylist())])

    return encode(text)


def text_of(ids: Column, tokenizer: str) -> Column:
    """string: the text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""

    @F.arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        pairs = vocabulary(tokenizer)
        values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        parts = [pa.array([], pa.string())]
        for k in range(0, len(lists), ROWS):
            own = ends[k : k + ROWS + 1]
            parts.append(pa.array([pairs.decode(values[a:b].tolist()) for a, b in zip(own[:-1], own[1:])], pa.string()))
        return pa.concat_arrays(parts)

    return decode(ids)


def encode(df: DataFrame, tokenizer: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with the token ids of its texts."""
    return df.withColumn(ids_col, ids_of(F.col(text_col), tokenizer))


def decode(df: DataFrame, tokenizer: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with the texts of its token ids."""
    return df.withColumn(text_col, text_of(F.coalesce(F.col(ids_col), F.array().cast("array<int>")), tokenizer))


def round_trips(df: DataFrame, tokenizer: str, words: int = WORDS) -> DataFrame:
    """doc_id, ids (array<int>) and decoded (their text) of documents; a worker holds ``ROWS`` of them at once, and ``words`` remembered words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, pairs = splitter(tokenizer, words), vocabulary(tokenizer)
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                own = batch.slice(k, ROWS)
                packed = ids.many(own["text"].to_pylist())
                decoded = pa.array([pairs.decode(np.frombuffer(p, "<i4").tolist()) for p in packed], pa.string())
                yield pa.RecordBatch.from_arrays([own["doc_id"], id_lists(packed), decoded], names=["doc_id", "ids", "decoded"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, ids array<int>, decoded string")


def digests(df: DataFrame, tokenizer: str, words: int = WORDS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of documents, encoded and decoded; a worker remembers ``words`` words."""
    return round_trips(df, tokenizer, words).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
