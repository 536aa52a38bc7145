"""Quality classifier by compression.

Two zstandard dictionaries hold text of documents labelled good and bad. A text is compressed in blocks with either; where the
good dictionary saves more than the bad one, the text is likelier good. The difference of the two sizes, divided by the
length, is turned into a probability by an isotonic calibration on labelled documents that the dictionaries don't hold,
weighted by the shares of the classes among all labels that may be learnt from.

Blocks (``BLOCK`` bytes each) are compressed apart, so the dictionary counts alike in all parts of long texts; every
block of a text is used. Learning takes a bounded, documented sample: ``PER_CLASS`` labelled documents of each class
for the dictionaries and as many for the calibration, those with the smallest hash of doc_id; of a longer text a slice of
``SAMPLE_CHARACTERS`` at a place by hash. A dictionary holds an equal part of each of its texts, ``DICTIONARY_BYTES`` in all.
Scoring covers all documents and shuffles nothing.

Labels that are null or that contradict each other for one doc_id are left out. Null and empty texts get the score of
texts without evidence (difference 0). Where a class has no labelled document, every score is the share of good
labels (0.5 without any). Rows that repeat are scored alike, an empty table gives an empty result, and very long texts are scored
whole. Other columns are kept and never read; columns named held_out, score or predicted are replaced.
"""

from __future__ import annotations

import bisect
import zlib
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PER_CLASS = 1500
SAMPLE_CHARACTERS = 1 << 14
DICTIONARY_BYTES = 1 << 17
BLOCK = 1024
LEVEL = 9
THRESHOLD = 0.3
#: Rows with crc32(doc_id) mod FOLDS = 0 are held out.
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


@dataclass
class Model:
    good: bytes
    bad: bytes
    points: list[float]  # differences, ascending
    scores: list[float]  # the calibrated score at each point

    def difference(self, text: str | None) -> float:
        return difference(compressors(self.good, self.bad), (text or "").encode())

    def score(self, d: float) -> float:
        """Between two points the score runs straight."""
        if not self.points:
            return self.scores[0]
        k = bisect.bisect_right(self.points, d)
        if k == 0 or k == len(self.points):
            return self.scores[min(k, len(self.points) - 1)]
        a, b = self.points[k - 1], self.points[k]
        return self.scores[k - 1] + (self.scores[k] - self.scores[k - 1]) * (d - a) / (b - a)


_held: dict[int, tuple] = {}


def compressors(good: bytes, bad: bytes) -> tuple:
    key = zlib.crc32(good) << 32 | zlib.crc32(bad)
    if key not in _held:
        _held.clear()
        made = []
        for data in (good, bad):
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        _held[key] = tuple(made)
    return _held[key]


def difference(both: tuple, data: bytes) -> float:
    """(bytes with the bad dictionary - bytes with the good one) / length: above 0 where the text is like good ones."""
    if not data:
        return 0.0
    good, bad = both
    blocks = [data[k : k + BLOCK] for k in range(0, len(data), BLOCK)]
    return (sum(len(bad.compress(b)) for b in blocks) - sum(len(good.compress(b)) for b in blocks)) / len(data)


def isotonic(pairs: list[tuple[float, int]], odds: float = 1.0, groups: int = 60) -> tuple[list[float], list[float]]:
    """Points and non-decreasing scores: shares of 1 in up to ``groups`` runs of equal size, pooled where they fall.

    odds: how much more a pair with label 1 weighs than one with label 0.
    """
    pairs = sorted(pairs)
    size = max(1, -(-len(pairs) // groups))
    pools: list[list[float]] = []  # sum of d, sum of labels, count
    for k in range(0, len(pairs), size):
        part = pairs[k : k + size]
        pools.append([sum(d for d, _ in part), sum(y for _, y in part), len(part)])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    points, scores = [], []
    for d, y, n in pools:
        if not points or d / n > points[-1]:
            points.append(d / n)
            scores.append((y + 0.5) * odds / ((y + 0.5) * odds + n - y + 0.5))
    return points, scores


def learnable(labels: DataFrame) -> DataFrame:
    """(doc_id, quality), one row for each doc_id that is not held out and whose labels agree."""
    known = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id")))
    return known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_q")).filter("quality = _q").drop("_q")


def sample(docs: DataFrame, known: DataFrame, per_class: int) -> list:
    """Rows (doc_id, text, quality) of up to 2 * per_class documents a class, in the order of a hash."""
    chosen = {}
    for q in (0, 1):
        chosen |= {r["doc_id"]: q for r in known.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * per_class).collect()}
    if not chosen:
        return []
    wanted = docs.sparkSession.createDataFrame(list(chosen.items()), "doc_id long, quality int")  # 4 * per_class ids at most
    at = F.lit(1) + F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.length("text") - (SAMPLE_CHARACTERS - 1), F.lit(1))).cast("int")
    texts = docs.select("doc_id", F.substring("text", at, F.lit(SAMPLE_CHARACTERS)).alias("text")).join(F.broadcast(wanted), "doc_id")
    return texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, dictionary_bytes: int = DICTIONARY_BYTES) -> Model:
    known = learnable(labels)
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    rows = sample(docs, known, per_class)
    of = {q: [r["text"].encode() for r in rows if r["quality"] == q and r["text"]] for q in (0, 1)}
    if not of[0] or not of[1]:
        good, bad = counts.get(1, 0), counts.get(0, 0)
        return Model(b"", b"", [], [(good + 0.5) / (good + bad + 1)])
    halves = {q: (texts[::2], texts[1::2] or texts) for q, texts in of.items()}
    contents = {q: dictionary(halves[q][0], dictionary_bytes) for q in (0, 1)}
    both = compressors(contents[1], contents[0])
    odds = counts[1] / counts[0] * len(halves[0][1]) / len(halves[1][1])
    points, scores = isotonic([(difference(both, t), q) for q in (0, 1) for t in halves[q][1]], odds)
    return Model(contents[1], contents[0], points, scores)


def dictionary(texts: list[bytes], most: int) -> bytes:
    """An equal part of each text, one after another, ``most`` bytes at the most."""
    parts, left = [], most
    for k, text in enumerate(sorted(texts, key=len)):  # what short texts leave goes to the longer ones
        each = left // (len(texts) - k)
        at = (k * 7919) % max(1, len(text) - each + 1)
        parts.append(text[at : at + each])
        left -= len(parts[-1])
    return b"".join(parts)


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with held_out, score and predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of bounded size

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        m = sent.value
        return pa.array([m.score(m.difference(t) if m.points else 0.0) for t in texts.to_pylist()], pa.float64())

    rows = docs.withColumns({"held_out": held_out(F.col("doc_id")), "score": score(F.col("text"))})
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
