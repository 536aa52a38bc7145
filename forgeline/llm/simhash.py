"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints have 64 bits: words of a text (ASCII letters lower-cased), shingles of ``words`` words, the XXH64 (seed
42) of each, and a bit where over half of the hashes have it. Candidates come from structured bit masks: each bit
position has a vector of radius + 1 bits, and table v keeps the positions whose vector has an odd product with v.
At most ``radius`` differing positions span no more than ``radius`` dimensions, so some v other than 0 is orthogonal to
all of them: that table keeps none of them, and the pair shares its key there, with certainty.

Equal fingerprints are one node from the start, so copies cost nothing. Rows of (table, key, fingerprint) are sorted
by key and streamed; a key's members are searched from one member to those not yet reached, and only the links of
that search are kept, one for each member at most, which leaves the components as they are. A key with more than
``MEMBERS`` fingerprints is covered again by the masks within the bits that are still free, where at most 2^16
different fingerprints can share a key. So no task holds an unbounded group and no case is dropped.

Null texts are empty; texts without words have fingerprint 0, linked like any other. Rows with equal doc_ids are
separate documents; null doc_ids take part but never name a component unless all of it is null. Empty tables give
empty results. Other columns are kept by ``deduplicate`` and never read.

``near_copies`` asks for a Jaccard similarity of shingle sets: the SimHash fingerprints of the sets are searched as above, and what they link is
verified with the shingles of both texts. A radius of 4 bits is far from reaching all texts of which most shingles are shared, so that more candidates
come from ``BANDS`` independent MinHash fingerprints, each of ``ROWS`` minima (a pair at 0.8 shares one with probability 0.9998), and are verified likewise. Of a key with up to ``PAIRS`` members all
pairs are verified that share enough of all minima. Members of larger keys are passed on as they come; what the links found so far
join is one group, and where a key still has several of them, its members' shingle sets are searched exactly, in blocks of about ``BLOCK`` sets
and every pair of blocks, smallest groups first, so that a member which is linked to a large group is settled by one look. No pair of different groups
in a key is left out.

Sets of shingles are equal where two 64-bit hashes of them are. Long texts are sets like others and count for blocks by their size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgeline.llm.common import checkpointed, saved
from forgeline.llm.components import components

#: Most fingerprints of a key that are searched as they stand.
MEMBERS = 1 << 15
#: Tasks that share a component's fingerprints when it is named.
SALTS = 32
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: MinHash fingerprints of a text, and minima in each.
BANDS, ROWS = 16, 4
#: Minima that pairs worth verifying share, of BANDS * ROWS: four deviations below what 0.8 gives.
LIKELY = 38
#: Most members of a MinHash key of which all likely pairs are verified; sets and shingles of a block of larger keys, about.
PAIRS, BLOCK, BLOCK_SHINGLES = 32, 2048, 1 << 21
#: Shingles that are counted at once, so that long texts need no more memory.
AT_ONCE = 1 << 16


def fingerprint(text: str | None, words: int = 4) -> int:
    parts = (text or "").encode().translate(LOWER).split()  # bytes split at exactly the ASCII white space
    if not parts:
        return 0
    size = min(words, len(parts))
    joined, ends = b" ".join(parts), np.cumsum([len(p) + 1 for p in parts])
    stops = (ends[size - 1 :] - 1).tolist()
    starts = [0, *ends[: len(parts) - size].tolist()]
    h, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, len(starts), AT_ONCE):
        hashes = np.array([h(joined[a:b], 42) for a, b in zip(starts[k : k + AT_ONCE], stops[k : k + AT_ONCE])], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(starts), bitorder="little")
    return int.from_bytes(bits.tobytes(), "little", signed=True)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of hashes: the bits that over half of them have."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), AT_ONCE):
        counts += np.unpackbits(hashes[k : k + AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little", signed=True)


def fingerprint_of(text: Column, words: int = 4) -> Column:
    """long: the bits of a text's fingerprint."""

    @F.arrow_udf("long")
    def compute(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t, words) for t in texts.to_pylist()], pa.int64())

    return compute(text)


def masks(radius: int, free: int = (1 << 64) - 1) -> list[int]:
    """The covering masks within the ``free`` bits (others are left out of every mask), as unsigned numbers."""
    size = 1 << (radius + 1)
    positions = [i for i in range(64) if free >> i & 1]
    vector = {p: k % (size - 1) + 1 for k, p in enumerate(positions)}
    return [sum(1 << p for p in positions if (vector[p] & v).bit_count() % 2) for v in range(1, size)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def keys(fingerprints: DataFrame, radius: int) -> DataFrame:
    """(table, key, f) of the first covering."""
    under = [F.col("f").bitwiseAND(F.lit(signed(m))) for m in masks(radius)]
    return fingerprints.select(F.posexplode(F.array(*under)).alias("table", "key"), "f")


def keys_again(rows: DataFrame, radius: int) -> DataFrame:
    """The second covering: (table, key, f) with the first key's bits and half of those free under it."""
    full, size = (1 << 64) - 1, (1 << (radius + 1)) - 1
    both = [[signed(m | n) for n in masks(radius, full & ~m)] for m in masks(radius)]
    literal = F.expr("array(" + ", ".join("array(" + ", ".join(f"{x}L" for x in row) + ")" for row in both) + ")")  # one constant in the plan
    under = F.transform(F.element_at(literal, F.col("table") + 1), lambda m: F.col("f").bitwiseAND(m))
    again = rows.select("f", "table", F.posexplode(under).alias("_at", "key"))
    return again.select(((F.col("table") + 1) * size + F.col("_at")).cast("int").alias("table"), "key", "f")


def spanning(members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links between members within the radius that connect what all such links connect."""
    values, rest, found = members.view(np.uint64), np.arange(len(members)), []
    while len(rest):
        frontier, rest = [int(rest[0])], rest[1:]
        while frontier and len(rest):
            at = frontier.pop()
            near = np.bitwise_count(values[rest] ^ values[at]) <= radius
            reached = rest[near]
            found += [(int(members[at]), int(members[k])) for k in reached]
            frontier += reached.tolist()
            rest = rest[~near]
    return found


def search(rows: DataFrame, radius: int, most: int | None) -> DataFrame:
    """Links (a, b) of all keys; with ``most``, members of larger keys come back as (table, key, f) instead."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, large, at, links, over = [], 0, False, None, [], []

        def close():
            nonlocal held, n, large
            if held and (large or n > 1):
                group = np.concatenate(held)
                if large:
                    over.append((at, group))
                else:
                    links.extend(spanning(group, radius))
            held, n, large = [], 0, False

        def add(members: np.ndarray) -> None:
            """Hold members of the present key; from ``most`` on they are passed on as they come."""
            nonlocal held, n, large
            held.append(members)
            n += len(members)
            if most and n > most:
                over.append((at, np.concatenate(held)))
                held, large = [], True

        def made() -> pa.RecordBatch:
            pairs_n, m = len(links), sum(len(g) for _, g in over)
            pairs = np.array(links, np.int64).reshape(-1, 2)
            tables = np.concatenate([np.zeros(pairs_n, np.int32), *[np.full(len(g), t, np.int32) for (t, _), g in over]])
            key = np.concatenate([np.zeros(pairs_n, np.int64), *[np.full(len(g), k, np.int64) for (_, k), g in over]])
            f = np.concatenate([np.zeros(pairs_n, np.int64), *[g for _, g in over]])
            gone = np.arange(pairs_n + m) >= pairs_n
            out = pa.RecordBatch.from_arrays([pa.array(np.concatenate([pairs[:, 0], np.zeros(m, np.int64)]), mask=gone), pa.array(np.concatenate([pairs[:, 1], np.zeros(m, np.int64)]), mask=gone), pa.array(tables), pa.array(key), pa.array(f)], names=["a", "b", "table", "key", "f"])
            links.clear()
            over.clear()
            return out

        for batch in batches:
            table, key, f = (batch[c].to_numpy(zero_copy_only=False) for c in ("table", "key", "f"))
            if not len(f):
                continue
            cuts = np.flatnonzero((table[1:] != table[:-1]) | (key[1:] != key[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(f)]):
                now = (int(table[a]), int(key[a]))
                if now != at:
                    close()
                    at = now
                add(f[a:b].copy())
            if links or over:
                yield made()
        close()
        if links or over:
            yield made()

    dealt = rows.repartition("table", "key").sortWithinPartitions("table", "key")
    return dealt.mapInArrow(solve, "a long, b long, table int, key long, f long")


def links(fingerprints: DataFrame, radius: int = 4, most: int = MEMBERS) -> DataFrame:
    """Links (a, b) between different fingerprints (f: long, each once) that connect all pairs within ``radius``.

    The radius is at most 6: beyond it the second covering no longer bounds a key's members by 2^16 or so.
    """
    if not 0 < radius <= 6:
        raise ValueError("radius must be from 1 to 6")
    first = checkpointed(search(keys(fingerprints, radius), radius, most))
    over = first.filter("a is null").select("table", "key", "f")
    second = search(keys_again(over, radius), radius, None)
    return first.filter("a is not null").select("a", "b").union(second.select("a", "b")).distinct()


def groups(df: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, digest (of the text), f (long) and component_id (the smallest doc_id reachable) of documents (doc_id, text)."""
    prints = checkpointed(df.select("doc_id", F.xxhash64("text").alias("digest"), fingerprint_of(F.col("text"), words).alias("f")))
    return prints.join(labelled(prints, radius), "f")


def labelled(prints: DataFrame, radius: int) -> DataFrame:
    """(f, component_id), each fingerprint once; ``prints`` has doc_id and f."""
    nodes = prints.groupBy("f").agg(F.min("doc_id").alias("least"))
    roots = components(links(nodes.select("f"), radius))
    rooted = checkpointed(nodes.join(roots, nodes.f == roots.node, "left").select("f", "least", "root"))
    linked = rooted.filter("root IS NOT NULL").withColumn("_salt", F.pmod(F.xxhash64("f"), F.lit(SALTS)))
    named = linked.groupBy("root").agg(F.min("least").alias("component_id")).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    # a component of very many fingerprints is met by SALTS tasks; fingerprints without links need no join
    both = linked.join(named, ["root", "_salt"]).select("f", "component_id")
    return checkpointed(both.union(rooted.filter("root IS NULL").select("f", F.col("least").alias("component_id"))))


def fingerprints(df: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return groups(df, words, radius).select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """One document of each group, with all its columns: the one with the smallest doc_id (then digest of its text).

    Of rows that repeat doc_id and text one stays. Only ids, digests and fingerprints are shuffled by group; whole rows are joined
    back by id and digest.
    """
    found = groups(docs, words, radius).withColumn("_root", F.struct("component_id", F.when(F.col("component_id").isNull(), F.col("f"))))
    return first_of_each(docs, found)


def first_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents with the smallest doc_id, then digest, of each ``_root`` of ``found`` (doc_id, digest, _root), with all their columns."""
    kept = found.groupBy("_root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "digest")).alias("k"))
    rows = docs.select(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("digest"), F.struct(*docs.columns).alias("row"))
    wanted = kept.select(F.col("k.n").alias("none"), F.coalesce("k.doc_id", F.lit(0)).alias("id"), F.col("k.digest").alias("digest"))
    keys = ["none", "id", "digest"]
    return rows.join(wanted, keys, "left_semi").dropDuplicates(keys).select("row.*")


FACTORS, OFFSETS = (np.random.default_rng(8).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(k) for k in (1, 0))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The different hashes of a text's shingles, ascending; a text of fewer words is one shingle."""
    parts = (text or "").encode().translate(LOWER).split()
    size = min(words, len(parts))
    joined, ends = b" ".join(parts), np.cumsum([0, *[len(p) + 1 for p in parts]]).tolist()
    h = xxhash.xxh64_intdigest
    return np.unique(np.array([h(joined[a : b - 1], 42) for a, b in zip(ends, ends[size:])] if parts else [], np.uint64))


def minima(hashes: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, (1 << 32) - 1, np.uint32)
    for k in range(0, len(hashes), 1024):
        least = np.minimum(least, ((hashes[k : k + 1024, None] * FACTORS + OFFSETS) >> np.uint64(32)).astype(np.uint32).min(axis=0))
    return least


def likely(sketches: np.ndarray) -> list[tuple[int, int]]:
    """Positions (a, b) of the links to verify between a key's members."""
    found = []
    for a in range(len(sketches) - 1):
        found += [(a, a + 1 + int(k)) for k in np.flatnonzero((sketches[a + 1 :] == sketches[a]).sum(axis=1) >= LIKELY)]
    return found


def candidates(nodes: DataFrame, most: int) -> DataFrame:
    """From nodes (node, keys, sketch): (a, b) of pairs that share a key of up to ``most`` members and are likely near copies; (key, node) of larger keys."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sketches, at, large = [], [], None, False
        pairs, over = [], []

        def close() -> None:
            nonlocal held, sketches, large
            if len(held) > 1 and not large:
                marks = np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, BANDS * ROWS)
                pairs.extend((min(held[a], held[b]), max(held[a], held[b])) for a, b in likely(marks))
            held, sketches, large = [], [], False

        def made() -> pa.RecordBatch:
            a, b, key, node = [*[p[0] for p in pairs], *[None] * len(over)], [*[p[1] for p in pairs], *[None] * len(over)], [*[None] * len(pairs), *[o[0] for o in over]], [*[None] * len(pairs), *[o[1] for o in over]]
            pairs.clear()
            over.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (a, b, key, node)], names=["a", "b", "key", "node"])

        for batch in batches:
            for key, node, sketch in zip(batch["key"].to_pylist(), batch["node"].to_pylist(), batch["sketch"].to_pylist()):
                if key != at:
                    close()
                    at = key
                if not large:
                    held.append(node)
                    sketches.append(sketch)
                    if len(held) > most:
                        over.extend((at, n) for n in held)
                        held, sketches, large = [], [], True
                else:
                    over.append((at, node))
            yield made()
        close()
        yield made()

    rows = nodes.select(F.explode("keys").alias("key"), "node", "sketch")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(solve, "a long, b long, key long, node long")


def sketched(df: DataFrame, words: int) -> DataFrame:
    """doc_id, digest, h1, h2 (hashes of the set of shingles), f (its SimHash), keys, sketch (a byte of each minimum) of documents."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, bits, keys, marks = [], [], [], []
            for text in batch["text"].to_pylist():
                own = shingles(text, words)
                least = minima(own)
                hashes.append([xxhash.xxh64_intdigest(own.tobytes(), seed) for seed in (42, 43)])
                bits.append(majority(own))
                keys.append([xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)])
                marks.append((least & 255).astype(np.uint8).tobytes())
            keys = pa.array(np.array(keys, np.uint64).view(np.int64).reshape(-1, BANDS).tolist(), pa.list_(pa.int64()))
            h1, h2 = np.array(hashes, np.uint64).view(np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["digest"], pa.array(h1), pa.array(h2), pa.array(bits, pa.int64()), keys, pa.array(marks, pa.binary())], names=["doc_id", "digest", "h1", "h2", "f", "keys", "sketch"])

    return df.select("doc_id", F.xxhash64("text").alias("digest"), "text").mapInArrow(compute, "doc_id long, digest long, h1 long, h2 long, f long, keys array<long>, sketch binary")


def set_of(text: Column, words: int) -> Column:
    """binary: the hashes of a text's shingles, ascending."""

    @F.arrow_udf("binary")
    def compute(texts: pa.Array) -> pa.Array:
        return pa.array([shingles(t, words).tobytes() for t in texts.to_pylist()], pa.binary())

    return compute(text)


def similar(x: int, y: int, both: int | np.ndarray, similarity: float):
    """Whether sets of x and y members that share ``both`` have that Jaccard similarity."""
    return both / np.maximum(1, x + y - both) >= similarity


def verified(left: Column, right: Column, similarity: float) -> Column:
    @F.arrow_udf("boolean")
    def compute(ones: pa.Array, others: pa.Array) -> pa.Array:
        out = []
        for one, other in zip(ones, others):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (one, other))
            out.append(bool(similar(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True)), similarity)))
        return pa.array(out, pa.bool_())

    return compute(left, right)


def connect(sets: list[np.ndarray], groups: list[int], similarity: float, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between sets of different ``groups`` that join all groups which any such link joins; with ``sides``, only links from one side to the other.

    Groups are taken up smallest first: each member of a group is compared with all sets outside it, and what is linked comes in with
    its whole group. A group that nothing is linked to any more has been compared with everything left and is done.
    """
    sizes = np.array([len(x) for x in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    begins = np.cumsum([0, *sizes])
    members: dict[int, list[int]] = {}
    for k, g in enumerate(groups):
        members.setdefault(g, []).append(k)
    rest, found, mark = sizes > 0, [], np.zeros(int(ids.max(initial=-1)) + 1, bool)
    # the sets that are looked at, one after another; built anew when half of them have gone
    at, flat, starts = np.empty(0, np.int64), ids[:0], begins[:0]
    for group in sorted(members, key=lambda g: len(members[g])):
        if group not in members:
            continue
        frontier = members.pop(group)
        rest[frontier] = False
        while frontier and rest.any():
            if not len(at) or 2 * np.count_nonzero(rest[at]) < len(at) or np.count_nonzero(rest) > len(at):
                at = np.flatnonzero(rest)
                flat, starts = np.concatenate([ids[begins[k] : begins[k + 1]] for k in at]), np.cumsum([0, *sizes[at][:-1]])
            a = frontier.pop()
            own = ids[begins[a] : begins[a + 1]]
            mark[own] = True
            near = similar(len(own), sizes[at], np.add.reduceat(mark[flat], starts, dtype=np.int64), similarity) & rest[at]
            mark[own] = False
            if sides is not None:
                near &= sides[at] != sides[a]
            for k in at[near].tolist():
                if rest[k]:
                    found.append((a, k))
                    joined = members.pop(groups[k])
                    rest[joined] = False
                    frontier += joined
    return found


def searched(rows: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) of each part (key, i, j) of rows (key, i, j, side, node, root, hashes)."""

    def solve(part: pa.Table) -> pa.Table:
        nodes, sides = part["node"].to_numpy(), part["side"].to_numpy()
        sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in part["hashes"]]
        found = connect(sets, part["root"].to_pylist(), similarity, sides if sides.any() else None)
        pairs = nodes[np.array(found, np.int64).reshape(-1, 2)]
        return pa.table({"a": pairs.min(axis=1, initial=(1 << 63) - 1), "b": pairs.max(axis=1, initial=-(1 << 63))})

    return rows.groupBy("key", "i", "j").applyInArrow(solve, "a long, b long")


def of_large_keys(large: DataFrame, sets: DataFrame, links: DataFrame, similarity: float, block: int, between: bool) -> DataFrame:
    """Links inside the blocks of large keys (key, node), or ``between`` any two of them, where a key's members are not yet one group."""
    rooted = large.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node")).join(sets, "node")
    rooted = rooted.withColumn("_n", (F.octet_length("hashes") / 8).cast("long"))
    stats = rooted.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("_n") / BLOCK_SHINGLES)).alias("blocks"), F.min("root").alias("_a"), F.max("root").alias("_b"))
    several = checkpointed(stats.filter(F.col("_a") != F.col("_b")).filter(F.col("blocks") > int(between)).select("key", "blocks"))  # a row a key: Spark can split the other side
    rows = rooted.join(several, "key").withColumn("_own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    if not between:
        return searched(rows.select("key", F.col("_own").alias("i"), F.col("_own").alias("j"), F.lit(0).alias("side"), "node", "root", "hashes"), similarity)
    other = F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: x != F.col("_own")))
    paired = rows.withColumn("_other", other).select("key", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), (F.col("_own") > F.col("_other")).cast("int").alias("side"), "node", "root", "hashes")
    return searched(paired, similarity)


def by_fingerprint(nodes: DataFrame, radius: int) -> DataFrame:
    """(a, b) of nodes (node, f) that SimHash links: each with the first node of its fingerprint, and those of fingerprints that ``links`` connects."""
    firsts = checkpointed(nodes.groupBy("f").agg(F.min("node").alias("first")))
    one, other = (firsts.select(F.col("f").alias(c), F.col("first").alias(f"_{c}")) for c in "ab")
    across = links(firsts.select("f"), radius).join(one, "a").join(other, "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
    same = nodes.select("node", "f").join(firsts, "f").filter("node <> first")  # a row a fingerprint on one side: Spark can split the other
    return checkpointed(across.union(same.select(F.col("first").alias("a"), F.col("node").alias("b"))))


def near_links(docs: DataFrame, nodes: DataFrame, words: int, similarity: float, most: int = PAIRS, block: int = BLOCK, radius: int = 4) -> DataFrame:
    """(a, b) of nodes (node, digest, f, keys, sketch): links of at least that similarity among those by SimHash, and all it takes to connect the pairs that share a key."""
    found = checkpointed(candidates(nodes, most))
    pairs, large = found.filter("a IS NOT NULL").select("a", "b").union(by_fingerprint(nodes, radius)).distinct(), found.filter("a IS NULL").select("key", "node")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(large.select("node")).distinct().join(nodes.select("node", "digest"), "node")
    texts = docs.select(F.xxhash64("text").alias("digest"), "text").join(wanted, "digest").dropDuplicates(["node"])
    sets = saved(texts.select("node", set_of(F.col("text"), words).alias("hashes")), "shingles")
    left, right = (sets.select(F.col("node").alias(c), F.col("hashes").alias(f"h_{c}")) for c in "ab")
    links = checkpointed(pairs.join(left, "a").join(right, "b").filter(verified(F.col("h_a"), F.col("h_b"), similarity)).select("a", "b"))
    for between in (False, True) if not large.isEmpty() else ():
        links = checkpointed(links.union(of_large_keys(large, sets, links, similarity, block, between)))
    return links


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, most: int = PAIRS, block: int = BLOCK) -> DataFrame:
    """One document of each group that links of that Jaccard similarity connect, chosen as by ``deduplicate``."""
    prints = checkpointed(sketched(docs, words))
    # numbered once and for all: the checkpoint keeps the numbers
    nodes = checkpointed(prints.groupBy("h1", "h2").agg(F.min("digest").alias("digest"), F.first("f").alias("f"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")).withColumn("node", F.monotonically_increasing_id()))
    roots = components(near_links(docs, nodes.drop("h1", "h2"), words, similarity, most, block))
    known = nodes.select("h1", "h2", "node").join(roots, "node", "left").select("h1", "h2", F.coalesce("root", "node").alias("_root"))
    return first_of_each(docs, prints.select("doc_id", "digest", "h1", "h2").join(known, ["h1", "h2"]))
