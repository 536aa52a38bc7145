r"""Line dedup by content-defined chunks of lines, with DataFrame functions only.

A text's units are its lines and, as lines can be whole paragraphs, the sentences in them; concatenated they are the text. Units are
hashed; a rolling hash over two neighbouring unit hashes ends a chunk where it is divisible by ``DIVISOR``, so the same units
give the same chunks wherever they stand. Where a chunk of two or more units stands more than once in the corpus, its first
occurrence (smallest doc_id, then MD5 of the text, then place) stays and the others go, those in exact copies of a text too.
``copies=True`` leaves copies alone: documents with one and the same text count as one, for near-duplicate removal to settle.

Only a hash and a length of each chunk are shuffled to find those that may be repeated; the bytes of these are fetched, grouped and
compared, and a chunk goes only if its bytes are those of the first occurrence. Counts are combined before the shuffle, so a
chunk that a third of all documents hold reaches its task as one row a map task; the joins back have one row a chunk on one side,
so Spark can split the other. A repeated passage loses its chunks but for what shares a chunk with its neighbours at either end.

``without_repeats``, for the pipeline, closes that gap: beside the chunks, every passage of ``PASSAGE`` words or more of whole units that
stands elsewhere goes, whatever its neighbours. At each unit the shortest run of units with ``PASSAGE`` words that starts
there, and the one that ends there, are looked at; all such runs within a repeated passage are repeated too and cover it. To
find them without shuffling them all, a run is first stood for by the least hash of its units (of two equal runs it is the same),
which neighbouring runs mostly share; only runs whose least hash stands in different places are hashed themselves (SHA-256 of their
bytes) and grouped; there, equal digests count as equal bytes, unlike in ``deduplicate``. A unit that goes always has an equal one at an earlier place, so some occurrence stays; units that stand in
a first occurrence and overlap a later one of the same text stay as well.

Null texts stay null and have no units, empty texts have none; a text all of which goes becomes empty. A null doc_id counts as the
smallest. Rows that repeat doc_id and text are one occurrence and get equal results. Texts of any length are cut as a whole.
An empty table gives an empty result. Other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgeline.llm.common import saved

#: Units in a chunk, about.
DIVISOR = 2
FACTOR = 31
#: Words of the shortest passage that goes wherever it stands.
PASSAGE = 50
#: Where a unit ends, and a unit with its end as a pattern that engines without look-behind know.
ENDS = ("\n", ". ", "! ", "? ")
UNIT = r"(?s).*?(?:\n|[.!?] )|.+"
#: A character to split at; texts that hold it are split by a slower pattern.
MARK = "\x01"
#: A unit counts at least one word for so many bytes, for scripts without spaces.
WORD_BYTES = 16


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once for each row."""
    return F.element_at(F.transform(F.array(value), then), 1)


def units(text: Column) -> Column:
    cut = text
    for end in ENDS:
        cut = F.replace(cut, F.lit(end), F.lit(end + MARK))
    return F.array_remove(F.when(F.contains(text, F.lit(MARK)), F.split(text, r"(?<=\n)|(?<=[.!?] )", -1)).otherwise(F.split(cut, MARK, -1)), "")


def unit_hash(unit: Column) -> Column:
    """A small number; SQL engines agree on it."""
    return F.ascii(F.md5(unit))


def counted(size: Column) -> Column:
    """The numbers from 0 up to before ``size``."""
    return F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))


def spans_of_chunks(pieces: Column, divisor: int = DIVISOR) -> Column:
    """array<struct<start, stop>> of the chunks of units, in order."""

    def cut(hashes: Column) -> Column:
        def ends(i: Column) -> Column:
            before = F.when(i > 0, F.get(hashes, i - 1)).otherwise(F.lit(0))
            return (i == F.size(hashes) - 1) | ((before * FACTOR + F.get(hashes, i)) % divisor == 0)

        def spans(stops: Column) -> Column:
            return F.transform(stops, lambda stop, k: F.struct(F.when(k > 0, F.get(stops, k - 1) + 1).otherwise(F.lit(0)).alias("start"), stop.alias("stop")))

        return let(F.filter(counted(F.size(hashes)), ends), spans)

    return let(F.transform(pieces, unit_hash), cut)


def content(pieces: Column, span: Column) -> Column:
    return F.array_join(F.slice(pieces, span["start"] + 1, span["stop"] - span["start"] + 1), "")


def chunks(text: Column, divisor: int = DIVISOR) -> Column:
    """array<struct<units, text>> of a text's chunks; null of a null text."""
    made = lambda p: F.transform(spans_of_chunks(p, divisor), lambda s: F.struct((s["stop"] - s["start"] + 1).alias("units"), content(p, s).alias("text")))
    return F.when(text.isNotNull(), let(units(text), made))


def digest_of(text: Column) -> Column:
    """What tells texts apart that share a doc_id."""
    return F.substring(F.unhex(F.md5(text)), 1, 8)


def of_document(df: DataFrame, more: DataFrame, how: str) -> DataFrame:
    """``df`` (with text and doc_id) joined to ``more`` (_id, _digest and its own columns) by doc_id and text."""
    return df.join(more, F.col("doc_id").eqNullSafe(F.col("_id")) & (digest_of(F.col("text")) == F.col("_digest")), how).drop("_id", "_digest")


def several_places(at: str) -> Column:
    """Whether rows (_digest, at) are of different texts or different places of one."""
    return (F.min("_digest") != F.max("_digest")) | (F.min(at) != F.max(at))


def hashed(docs: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """(_id, _digest, no, key, bytes) of all chunks with two or more units, written: a hash and a length stand for each."""
    marks = F.transform(chunks(F.col("text"), divisor), lambda c, k: F.struct(k.alias("no"), c["units"].alias("units"), F.xxhash64(c["text"]).alias("key"), F.octet_length(c["text"]).alias("bytes")))
    rows = docs.select(F.col("doc_id").alias("_id"), digest_of(F.col("text")).alias("_digest"), F.filter(marks, lambda m: m["units"] > 1).alias("_m"))
    each = saved(rows, "chunk-hashes").select("_id", "_digest", F.explode("_m").alias("_m"))
    return each.select("_id", "_digest", "_m.no", "_m.key", "_m.bytes")


def removals(docs: DataFrame, divisor: int = DIVISOR, copies: bool = False) -> DataFrame:
    """(_id, _digest, _removed): the numbers of the chunks that go from a document; one row for each that loses any."""
    found = hashed(docs, divisor)
    several = several_places("no") if copies else F.count("*") > 1
    maybe = saved(found.groupBy("key", "bytes").agg(several.alias("_several")).filter("_several").select("key", "bytes"), "repeated")  # a written side lets Spark split a hot key of the other
    wanted = found.join(maybe, ["key", "bytes"], "left_semi").groupBy("_id", "_digest").agg(F.collect_set("no").alias("_nos"))
    there = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (digest_of(F.col("text")) == F.col("_digest")))
    bytes_of = let(chunks(F.col("text"), divisor), lambda own: F.transform("_nos", lambda no: F.struct(no.alias("no"), F.get(own, no)["text"].alias("chunk"))))
    texts = there.select("_id", "_digest", F.explode(bytes_of).alias("_c")).select("_id", "_digest", "_c.no", F.xxhash64("_c.chunk").alias("key"), F.octet_length("_c.chunk").alias("bytes"), "_c.chunk")
    place = F.struct("_id", "_digest", "no")
    contents = texts.groupBy("key", "bytes", "chunk").agg(F.min(place).alias("first"))  # grouped by their bytes
    of_key = saved(contents.groupBy("key", "bytes").agg(F.count("*").alias("contents"), F.min("first").alias("first")), "chunk-firsts")
    again = found.join(of_key.filter("contents = 1"), ["key", "bytes"]).select("_id", "_digest", "no", "first")
    if of_key.filter("contents > 1").limit(1).count():  # a hash of different contents: their bytes tell which is which
        mixed = texts.join(of_key.filter("contents > 1").select("key", "bytes"), ["key", "bytes"], "left_semi").withColumnRenamed("chunk", "_chunk")
        same = mixed.join(contents, (mixed["key"] == contents["key"]) & (mixed["_chunk"] == contents["chunk"]))
        again = again.union(same.select("_id", "_digest", "no", "first"))
    other = (F.col("no") != F.col("first.no")) | (F.col("_digest") != F.col("first._digest"))
    other = other if copies else other | ~F.col("_id").eqNullSafe(F.col("first._id"))
    return again.filter(other).groupBy("_id", "_digest").agg(F.collect_set("no").alias("_removed"))


def cleaned(docs: DataFrame, divisor: int = DIVISOR, copies: bool = False) -> DataFrame:
    """(_row: the whole row, text, doc_id, _kept: the chunks that stay, null if all do, _removed: how many went)."""
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"))

    def rest(own: Column) -> Column:
        return F.transform(F.array_except(counted(F.size(own)), F.col("_removed")), lambda k: F.get(own, k))

    joined = of_document(rows, removals(rows, divisor, copies), "left")
    return joined.withColumn("_kept", F.when(F.col("_removed").isNotNull(), let(chunks(F.col("text"), divisor), rest)))


def with_texts(rows: DataFrame, text: Column, columns: list[str]) -> DataFrame:
    """The rows in ``_row`` with a new text (and n_chars, where there is one, set anew)."""
    new = {"text": text} | ({"n_chars": F.length(text).cast("long")} if "n_chars" in columns else {})
    return rows.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in columns])


def deduplicate(docs: DataFrame, divisor: int = DIVISOR, copies: bool = False) -> DataFrame:
    """``docs`` with repeated chunks taken out of their texts (and n_chars, where there is one, set anew)."""
    rows = cleaned(docs, divisor, copies)
    return with_texts(rows, F.when(F.col("_kept").isNull(), F.col("text")).otherwise(F.array_join(F.transform("_kept", lambda c: c["text"]), "")), docs.columns)


def report(docs: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """doc_id, n_units, n_units_left, n_chunks_removed, text_md5 (of what is left) of documents."""
    rows = cleaned(docs.select("doc_id", "text"), divisor)
    n = F.coalesce(F.size(units(F.col("text"))), F.lit(0))
    left = F.when(F.col("_kept").isNull(), n).otherwise(F.aggregate("_kept", F.lit(0), lambda a, c: a + c["units"]))
    text = F.when(F.col("_kept").isNull(), F.col("text")).otherwise(F.array_join(F.transform("_kept", lambda c: c["text"]), ""))
    n = F.when(F.col("text").isNull(), 0).otherwise(n)
    return rows.select("doc_id", n.cast("long").alias("n_units"), F.when(F.col("text").isNull(), 0).otherwise(left).cast("long").alias("n_units_left"), F.coalesce(F.size("_removed"), F.lit(0)).cast("long").alias("n_chunks_removed"), F.md5(text).alias("text_md5"))


def bare(unit: Column) -> Column:
    return F.trim(unit, F.lit(" \t\r\n"))


def words(unit: Column) -> Column:
    """Words of a unit (none: white space only), not fewer than there are between spaces."""
    spaced = F.octet_length(unit) - F.octet_length(F.replace(unit, F.lit(" "))) + 1
    return let(bare(unit), lambda t: F.when(t == "", F.lit(0)).otherwise(F.greatest(spaced, F.ceil(F.octet_length(t) / WORD_BYTES).cast("int"))))


def runs(pieces: Column, passage: int = PASSAGE) -> Column:
    """array<long> of start * 2^32 + stop: at each unit the shortest run of ``passage`` words from it and up to it."""

    def of(owner: Column) -> Column:
        """``owner``: the unit of each word of the text."""
        n = F.size(owner)
        span = lambda a, b: F.shiftleft(F.get(owner, a).cast("long"), 32) + F.get(owner, b)

        def ends(firsts: Column) -> Column:
            ahead = F.transform(F.filter(firsts, lambda w: w + passage <= n), lambda w: span(w, w + (passage - 1)))
            lasts = F.concat(F.transform(F.filter(firsts, lambda w: w > 0), lambda w: w - 1), F.array(n - 1))
            behind = F.transform(F.filter(lasts, lambda w: w >= passage - 1), lambda w: span(w - (passage - 1), w))
            return F.array_distinct(F.concat(ahead, behind))

        firsts = F.filter(counted(n), lambda w: (w == 0) | (F.get(owner, w) != F.get(owner, w - 1)))
        return F.when(n < passage, F.array().cast("array<long>")).otherwise(let(firsts, ends))

    return let(F.flatten(F.transform(pieces, lambda u, i: F.array_repeat(i, words(u)))), of)


def start_of(run: Column) -> Column:
    return F.shiftright(run, 32).cast("int")


def stop_of(run: Column) -> Column:
    return run.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")


def ranks(pieces: Column) -> Column:
    """array<long>: a hash of each unit; those of very short units are larger than all others."""
    return F.transform(pieces, lambda u: let(bare(u), lambda t: F.shiftrightunsigned(F.xxhash64(t), 2) + F.when(F.length(t) < 16, 1 << 62).otherwise(0)))


def least(hashes: Column, run: Column) -> Column:
    """The unit of a run that has the least hash."""
    return let(F.slice(hashes, start_of(run) + 1, stop_of(run) - start_of(run) + 1), lambda own: start_of(run) + F.array_position(own, F.array_min(own)).cast("int") - 1)


def multiple(pieces: Column, divisor: int) -> Column:
    """The spans of the chunks that have two or more units."""
    return F.filter(spans_of_chunks(pieces, divisor), lambda s: s["stop"] > s["start"])


def marks(text: Column, divisor: int, passage: int) -> Column:
    """array<struct<mark, at>>: a hash and the first unit of each such chunk, and the least hash of each run with its unit."""

    def both(pieces: Column) -> Column:
        mark = lambda hash_, at: F.struct(hash_.alias("mark"), at.alias("at"))
        whole = F.transform(multiple(pieces, divisor), lambda s: mark(F.xxhash64(content(pieces, s), F.lit(1)), s["start"]))
        of_runs = lambda hashes: F.transform(F.array_distinct(F.transform(runs(pieces, passage), lambda r: least(hashes, r))), lambda at: mark(F.get(hashes, at), at))
        return F.concat(whole, let(ranks(pieces), of_runs))

    return F.when(text.isNotNull(), let(units(text), both))


def spans(text: Column, at: Column, divisor: int, passage: int) -> Column:
    """array<struct<key, start, stop>> of the chunks and runs whose mark is at one of the units ``at``."""

    def of(pieces: Column) -> Column:
        n = F.size(pieces)
        no = lambda k: F.array_repeat(F.lit(False), k)

        def chosen(flags: Column) -> Column:
            span = lambda a, b: F.struct(F.unhex(F.sha2(F.array_join(F.transform(F.slice(pieces, a + 1, b - a + 1), bare), "\n"), 256)).alias("key"), a.alias("start"), b.alias("stop"))
            whole = F.transform(F.filter(multiple(pieces, divisor), lambda s: F.get(flags, s["start"])), lambda s: span(s["start"], s["stop"]))
            of_runs = lambda hashes: F.transform(F.filter(runs(pieces, passage), lambda r: F.get(flags, least(hashes, r))), lambda r: span(start_of(r), stop_of(r)))
            return F.concat(whole, let(ranks(pieces), of_runs))

        flags = lambda a: F.flatten(F.concat(F.array(no(F.coalesce(F.get(a, F.lit(0)), n))), F.transform(a, lambda x, k: F.concat(F.array(F.lit(True)), no(F.coalesce(F.get(a, k + 1), n) - x - 1)))))
        return let(let(F.array_sort(at), flags), chosen)

    return let(units(text), of)


def without_repeats(docs: DataFrame, divisor: int = DIVISOR, passage: int = PASSAGE) -> DataFrame:
    """``docs`` with repeated chunks and repeated passages taken out of their texts (and n_chars, where there is one, set anew).

    Documents with one and the same text count as one, so exact copies stay copies of each other.
    """
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"))
    each = saved(rows.select(F.col("doc_id").alias("_id"), digest_of(F.col("text")).alias("_digest"), marks(F.col("text"), divisor, passage).alias("_m")), "marks")
    every = each.select("_id", "_digest", F.explode("_m").alias("_m")).select("_id", "_digest", "_m.mark", "_m.at")
    twice = saved(every.groupBy("mark").agg(several_places("at").alias("_several")).filter("_several").select("mark"), "repeated")
    wanted = every.join(twice, "mark", "left_semi").groupBy("_id", "_digest").agg(F.collect_set("at").alias("_at"))
    there = rows.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (digest_of(F.col("text")) == F.col("_digest")))
    found = saved(there.select("_id", "_digest", F.explode(spans(F.col("text"), F.col("_at"), divisor, passage)).alias("_s")).select("_id", "_digest", "_s.*"), "spans")
    firsts = found.groupBy("key").agg(F.min(F.struct("_id", "_digest", "start", "stop")).alias("first"), several_places("start").alias("_several")).filter("_several").drop("_several")
    later = found.join(saved(firsts, "firsts"), "key").filter((F.col("_digest") != F.col("first._digest")) | (F.col("start") != F.col("first.start")))
    own = F.when(F.col("_digest") == F.col("first._digest"), F.greatest("start", F.col("first.stop") + 1)).otherwise(F.col("start"))
    gone = later.select("_id", "_digest", own.alias("start"), "stop").filter("start <= stop").groupBy("_id", "_digest").agg(F.collect_set(F.struct("start", "stop")).alias("_gone"))
    joined = of_document(rows, gone, "left")

    def rest(pieces: Column) -> Column:
        kept = F.array_except(counted(F.size(pieces)), F.flatten(F.transform("_gone", lambda g: F.sequence(g["start"], g["stop"]))))
        left = lambda k: F.array_join(F.transform(k, lambda i: F.get(pieces, i)), "")
        return let(kept, lambda k: F.when(F.array_contains(k, F.size(pieces) - 1), left(k)).otherwise(F.rtrim(left(k), F.lit(" \n"))))

    return with_texts(joined, F.when(F.col("_gone").isNull(), F.col("text")).otherwise(let(units(F.col("text")), rest)), docs.columns)


REPORT_SQL = f"""
WITH d AS (SELECT doc_id, text, md5(text) AS digest FROM documents), t AS (SELECT DISTINCT doc_id, digest, text FROM d WHERE text IS NOT NULL),
l AS (SELECT doc_id, digest, len(regexp_extract_all(text, '{UNIT}')) AS n, unnest(regexp_extract_all(text, '{UNIT}')) AS unit, generate_subscripts(regexp_extract_all(text, '{UNIT}'), 1) AS i FROM t),
h AS (SELECT *, ascii(md5(unit)) AS h FROM l),
r AS (SELECT *, (i = n OR (coalesce(lag(h) OVER w, 0) * {FACTOR} + h) % {DIVISOR} = 0)::INT AS e FROM h WINDOW w AS (PARTITION BY doc_id, digest ORDER BY i)),
c AS (SELECT *, coalesce(sum(e) OVER (PARTITION BY doc_id, digest ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS no FROM r),
k AS (SELECT doc_id, digest, no, count(*) AS units, string_agg(unit, '' ORDER BY i) AS chunk FROM c GROUP BY doc_id, digest, no),
g AS (SELECT doc_id, digest, no, row_number() OVER (PARTITION BY chunk ORDER BY doc_id NULLS FIRST, digest, no) AS place FROM k WHERE units > 1),
x AS (SELECT doc_id, digest, no FROM g WHERE place > 1),
a AS (SELECT k.doc_id, k.digest, sum(units)::BIGINT AS n_units, coalesce(sum(units) FILTER (WHERE x.no IS NULL), 0)::BIGINT AS n_units_left, count(x.no)::BIGINT AS n_chunks_removed, coalesce(string_agg(chunk, '' ORDER BY k.no) FILTER (WHERE x.no IS NULL), '') AS t
  FROM k LEFT JOIN x ON k.doc_id IS NOT DISTINCT FROM x.doc_id AND k.digest = x.digest AND k.no = x.no GROUP BY k.doc_id, k.digest)
SELECT d.doc_id, coalesce(n_units, 0) AS n_units, coalesce(n_units_left, 0) AS n_units_left, coalesce(n_chunks_removed, 0) AS n_chunks_removed, md5(coalesce(t, text)) AS text_md5
FROM d LEFT JOIN a ON d.doc_id IS NOT DISTINCT FROM a.doc_id AND d.digest = a.digest
"""
