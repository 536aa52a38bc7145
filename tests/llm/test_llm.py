"""Training-data operators against brute force on small fixtures, with nulls, empty texts, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
import xxhash
from pyspark.sql import functions as F

from forgeline.llm import bpe, components, knn, licences, line_dedup, media, mixing, quality, queries, sharding, simhash, token_files
from forgeline.llm.common import prefix_sums, shared_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, ids string, score string"
WORDS = "the quick brown fox jumps over lazy dogs and runs away from every big bear in town today".split()


def texts(seed: int, n: int) -> list[str]:
    rnd = random.Random(seed)
    return [" ".join(rnd.choice(WORDS) + str(rnd.randint(0, 9)) for _ in range(rnd.randint(5, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    """(doc_id, text, source): odd texts, copies and repeated rows."""
    base = texts(1, 40)
    odd = [None, "", " ", "\n\n", "é" * 300, "  two  spaces ", "tab\tand\x0bmore\r\n", "<|endoftext|> x <|endoftext|>", "a" * 5000, "😀 漢字 ß", "x " * 3000, "word"]
    out = [(i, t, random.Random(i).choice([None, "", "a", "b", "a", "a"])) for i, t in enumerate(odd + base + base[:10])]
    return [*out, (3, odd[3], "a"), (3, odd[3], "a"), (None, "no id", "b")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y", "z") for i, t, s in rows], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


# --- 1 BPE ---------------------------------------------------------------------------------------------------------


def test_bpe_equals_the_library(docs, rows, tokenizer):
    want = Counter()
    for i, t, _ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        want[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())] += 1
    assert Counter(map(tuple, bpe.digests(docs, queries.tokenizer_path()).collect())) == want


def test_bpe_equals_the_library_on_random_text(tokenizer):
    rnd, encode = random.Random(4), bpe.splitter(queries.tokenizer_path())
    parts = [" ", "  ", "\n", "\t", "a", "é", "1", "²", "\x1c", "\x85", "\xa0", " ", "　", "́", "漢", "😀", "!", "'s", "'S", "<|endoftext|>", "_", "\x00", "The", "﻿"]
    for _ in range(3000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        assert np.frombuffer(encode(t), "<i4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_long_words_are_not_remembered(tokenizer):
    for splitter in (bpe.PieceSplitter(bpe.vocabulary(queries.tokenizer_path()).token_ids, {}), token_files.LibrarySplitter(queries.tokenizer_path())):
        for t in ("a " + "QUJD" * 5000 + " b " + "QUJD" * 5000, "x" * 65, "y " + "1" * 64, "z " + "é,;" * 40 + " z"):
            assert np.frombuffer(splitter(t), "<i4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids
        assert max(map(len, [*splitter.words, *splitter.tokens])) <= bpe.LONGEST + 1


def test_bpe_columns_and_empty(docs, none):
    assert bpe.encode(docs, queries.tokenizer_path()).columns == docs.columns
    assert bpe.digests(none, queries.tokenizer_path()).count() == 0
    small = bpe.Remembered(lambda k: k * 2, 4)
    assert [small[k] for k in range(20)] == [k * 2 for k in range(20)] and len(small) <= 4


# --- 2 mixing ------------------------------------------------------------------------------------------------------


def size(t):
    return len(re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()))


def iterated_targets(sizes: dict) -> dict:
    """The rule step by step: cap, reshare the excess by weight, again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    total, target, capped = sum(sizes.values()), {}, set()
    for _ in range(len(order) + 1):
        free = [s for s in order if s not in capped]
        rest = total - sum(3 * sizes[s] for s in capped)
        target = {s: 3 * sizes[s] if s in capped else rest * weight[s] / sum(weight[x] for x in free) for s in order}
        if not (over := {s for s in free if target[s] > 3 * sizes[s]}):
            break
        capped |= over
    return target


def test_mixing_equals_the_rule(docs, rows):
    sizes: dict = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    want, got = iterated_targets(sizes), mixing.mixed(docs).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, size(t)) for i, t, _ in rows)
    for s, n in sizes.items():
        of = [r for r in mixing.taken(docs.select("doc_id", "source", F.col("n_chars").alias("size"))).collect() if r["source"] == s]
        assert sum(r["taken"] for r in of) == round(of[0]["target"]) or of[0]["source_size"] == 0
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in of)
        assert any(abs(r["target"] - want[s]) < 1e-6 and r["source_size"] == n for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed(docs.repartition(3)).collect()))


def test_mixing_levels(spark):
    rnd = random.Random(2)
    for n in (1, 2, 3, 7, 20):
        sizes = {f"s{k:02d}": rnd.choice([0, 1, 5, 100, 10_000, 1_000_000]) for k in range(n)}
        got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        want = iterated_targets(sizes)
        assert all(got[s] == pytest.approx(want[s], abs=1e-6) for s in sizes), (sizes, got, want)


def test_mixed_documents(docs, none):
    got = mixing.repeated(docs)
    assert got.columns == docs.columns and mixing.repeated(none).count() == mixing.mixed(none).count() == 0
    copies = Counter(r["doc_id"] for r in got.collect())
    taken = {(r["doc_id"], r["size"]): r["taken"] for r in mixing.mixed(docs).collect()}
    assert all(copies[i] >= -(-t // s) for (i, s), t in taken.items() if s)


def test_prefix_sums(spark):
    df = spark.range(100).select(F.col("id").alias("p"), (F.col("id") % 7).alias("v"))
    got = {r["p"]: r["s"] for r in prefix_sums(df, "p", {"s": "v"}, chunk=8).collect()}
    assert all(got[p] == sum(x % 7 for x in range(p)) for p in range(100))


# --- 3 SimHash -----------------------------------------------------------------------------------------------------


def plain_fingerprint(t, k=4):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w]
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints: list[tuple[int, int]], radius=4):
    """(doc_id, fingerprint) pairs to component ids."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= radius:
                parent[find(a)] = find(b)
    least: dict = {}
    for k, (i, _) in enumerate(prints):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [least.get(find(k)) for k in range(len(prints))]


def test_fingerprints_equal_the_rule(rows):
    for _, t, _ in [*rows, (0, "The QUICK É brown fox jumped", None)]:
        assert simhash.fingerprint(t) & (2**64 - 1) == plain_fingerprint(t)


def test_masks_cover():
    rnd = random.Random(8)
    for radius in (1, 3, 4):
        tables = simhash.masks(radius)
        assert len(tables) == 2 ** (radius + 1) - 1
        for _ in range(2000):
            odd = sum(1 << b for b in rnd.sample(range(64), radius))
            assert any(m & odd == 0 for m in tables)
            m = rnd.choice(tables)
            inner = odd & ~m
            assert any(n & inner == 0 for n in simhash.masks(radius, (2**64 - 1) & ~m))


@pytest.mark.parametrize("most", [2, simhash.MEMBERS])
def test_simhash_components(spark, most):
    rnd = random.Random(6)
    prints = []
    for _ in range(30):
        x = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 6)):
            prints.append(x)
            for b in rnd.sample(range(64), rnd.randint(0, 5)):
                x ^= 1 << b
    data = [(k, simhash.signed(p)) for k, p in enumerate(prints)]
    df = spark.createDataFrame(data, "doc_id long, f long")
    nodes = df.select("f").distinct()
    links = simhash.links(nodes, 4, most).collect()
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 4 for a, b in links)
    got = {r["f"]: r["component_id"] for r in simhash.labelled(df, 4).collect()}
    assert [got[f] for _, f in data] == plain_components(list(enumerate(prints)))
    roots = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links or [(0, 0)], "a long, b long")).collect()}
    groups: dict = defaultdict(set)
    for k, (_, f) in enumerate(data):
        groups[roots.get(f, f)].add(plain_components(list(enumerate(prints)))[k])
    assert all(len(g) == 1 for g in groups.values())


def test_simhash_query(docs, rows, none):
    prints = [(i, plain_fingerprint(t)) for i, t, _ in rows]
    want = Counter(zip((i for i, _ in prints), (f"{f:016x}" for _, f in prints), plain_components(prints)))
    assert Counter(map(tuple, simhash.fingerprints(docs).collect())) == want
    assert simhash.fingerprints(none).count() == 0


@pytest.mark.parametrize(("most", "block"), [(simhash.PAIRS, simhash.BLOCK), (1, 2), (2, 4)])
def test_near_copies_from_four_fifths(spark, docs, none, most, block):
    rnd = random.Random(4)

    def sets(t):
        w = t.lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    data = []
    for k in range(40):
        base = [f"w{rnd.randint(0, 9999)}" for _ in range(200)]
        data.append(base)
        for changes in (1, 2, 3, 4, 5, 8):
            copy = list(base)
            for at in rnd.sample(range(200), changes):
                copy[at] = "other"
            data.append(copy)
    data = [(i, " ".join(w)) for i, w in enumerate(data)] + [(900, "one two"), (901, "one  TWO"), (902, "one two three"), (903, None), (904, "")]
    root = {i: i for i, _ in data}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    grams, near = {i: sets(t or "") for i, t in data}, 0
    for n, (i, t) in enumerate(data):
        for j, u in data[:n]:
            if len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]):
                near += 1
                root[max(top(i), top(j))] = min(top(i), top(j))
    kept = simhash.near_copies(spark.createDataFrame(data, "doc_id long, text string"), most=most, block=block)
    assert near > 200 and sorted(r["doc_id"] for r in kept.collect()) == sorted({top(i) for i, _ in data})
    assert simhash.near_copies(none).count() == 0 and simhash.near_copies(docs).columns == docs.columns


def hub(n, seed=1, words=200, changes=4):
    """A text and ``n`` others, each near to it and far from one another."""
    rnd = random.Random(seed)
    base = [f"v{rnd.randint(0, 10**6)}" for _ in range(words)]
    out = [list(base) for _ in range(n)]
    for copy in out:
        for at in rnd.sample(range(5, words - 5, 6), changes):
            copy[at] = f"n{rnd.randint(0, 10**9)}"
    return [" ".join(w) for w in out[: n // 2]] + [" ".join(base)] + [" ".join(w) for w in out[n // 2 :]]


def test_near_copies_by_simhash_alone(spark, monkeypatch):
    """Texts whose fingerprints are within 4 bits are joined without any MinHash key; close fingerprints of unlike texts are not."""
    rnd = random.Random(17)
    base = [rnd.choice("abcdefgh") + str(rnd.randrange(10**6)) for _ in range(600)]
    texts = [" ".join(base)] + [" ".join([*base[:k], "new", *base[k + 1 :]]) for k in (5, 300, 595)] + [" ".join(rnd.sample(base, 600))]
    bits = [simhash.majority(simhash.shingles(t, 5)) for t in texts]
    near = [k for k in range(5) if ((bits[0] ^ bits[k]) & (1 << 64) - 1).bit_count() <= 4]
    monkeypatch.setattr(simhash, "candidates", lambda nodes, most: nodes.sparkSession.createDataFrame([], "a long, b long, key long, node long"))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    linked = {(r["a"], r["b"]) for r in simhash.by_fingerprint(spark.createDataFrame([(k, b) for k, b in enumerate([*bits, bits[4]])], "node long, f long"), 4).collect()}
    assert (4, 5) in linked and len(near) > 1
    kept = {r["doc_id"] for r in simhash.near_copies(df).collect()}
    assert 0 in kept and 4 in kept and not kept & set(near) - {0, 4}


def test_near_copies_around_a_hub(spark):
    data = [(i, t, "a", "b", "c") for i, t in enumerate(hub(800))]
    df = spark.createDataFrame(data, "doc_id long, text string, _id string, _none string, _digest string").repartition(4)
    for block in (simhash.BLOCK, 150):  # one block, and pairs of blocks
        kept = simhash.near_copies(df, block=block)
        assert [tuple(r) for r in kept.collect()] == [data[0]] and kept.columns == df.columns


def test_simhash_keeps_clashing_columns(spark):
    rows = [(1, "a b", "x", "y", "z", 5), (None, "c d e", None, "y", "z", 6), (2, "a b", "x", "y", "z", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id string, _none string, _digest string, row long")
    for kept in (simhash.deduplicate(df), simhash.near_copies(df)):
        assert sorted(map(tuple, kept.collect()), key=repr) == sorted(rows[:2], key=repr) and kept.columns == df.columns


def test_groups_of_sets_are_connected():
    rnd = random.Random(9)
    for trial in range(30):
        n = rnd.randint(1, 40)
        bases = [rnd.sample(range(1000), 20) for _ in range(4)]
        sets = [np.unique(np.array(rnd.choice(bases)[: rnd.randint(14, 20)] + rnd.sample(range(1000), rnd.randint(0, 2)), np.uint64)) if rnd.random() > 0.05 else np.empty(0, np.uint64) for _ in range(n)]
        groups = [rnd.choice([k, rnd.randint(0, n)]) for k in range(n)]
        sides = np.array([rnd.randint(0, 1) for _ in range(n)]) if trial % 2 else None
        near = lambda a, b: len(sets[a]) and len(sets[b]) and len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))  # noqa: B023, E731

        def classes(links):
            root = {("g", g): ("g", g) for g in groups}  # noqa: B023

            def top(x):
                while root[x] != x:
                    x = root[x]
                return x

            for a, b in links:
                root[top(("g", groups[a]))] = top(("g", groups[b]))  # noqa: B023
            return [[top(("g", g)) == top(("g", h)) for h in groups] for g in groups]  # noqa: B023

        found = simhash.connect(sets, groups, 0.8, sides)
        assert all(near(a, b) and groups[a] != groups[b] and (sides is None or sides[a] != sides[b]) for a, b in found)
        assert classes(found) == classes([(a, b) for a in range(n) for b in range(a) if near(a, b) and (sides is None or sides[a] != sides[b])])


def test_simhash_keeps_one_of_each_group(docs, rows, none):
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns and simhash.deduplicate(none).count() == 0
    prints = [(i, plain_fingerprint(t)) for i, t, _ in rows]
    assert kept.count() == len(set(plain_components(prints)))


def test_long_chain_settles(spark):
    chain = spark.range(200).select((F.col("id") * 7 % 201).alias("a"), ((F.col("id") + 1) * 7 % 201).alias("b"))
    assert {r["root"] for r in components.components(chain).collect()} == {0}


# --- 4 media -------------------------------------------------------------------------------------------------------


def test_media(docs, rows, none):
    got = media.round_trip(docs).collect()
    want = Counter()
    for i, t, _ in rows:
        data, n = media.payload_of(t)
        assert len(data) % 192 == 0 and data and data[:n] == (t or "").encode() and media.samples(media.png(data)) == data
        image = media.png(data)
        want[(i, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(image), hashlib.sha256(image).hexdigest(), media.feature(data))] += 1
    assert Counter(map(tuple, got)) == want
    assert media.round_trip(none).count() == 0


def plain_pixels(image: bytes) -> list[bytes]:
    """Rows of a grey image, read by hand."""
    import struct

    at, body, shape = 8, b"", None
    while at < len(image):
        size, kind = int.from_bytes(image[at : at + 4], "big"), image[at + 4 : at + 8]
        content = image[at + 8 : at + 8 + size]
        assert int.from_bytes(image[at + 8 + size : at + 12 + size], "big") == zlib.crc32(kind + content)
        shape = struct.unpack(">IIBBBBB", content) if kind == b"IHDR" else shape
        body += content if kind == b"IDAT" else b""
        at += 12 + size
    width, height, depth, colour, *_ = shape
    lines = zlib.decompress(body)
    assert (depth, colour, len(lines)) == (8, 0, height * (width + 1)) and not any(lines[:: width + 1])
    return [lines[k + 1 : k + 1 + width] for k in range(0, len(lines), width + 1)]


def test_media_by_another_reader(docs, rows, spark):
    """Stored bytes read by another decoder, features by plain sums."""
    folder = shared_dir(spark, "media")
    media.store(docs, folder)
    read = media.load(spark, folder).select("doc_id", "n_bytes", "media").collect()
    texts_of = Counter((i, (t or "").encode()) for i, t, _ in rows)
    assert Counter((r["doc_id"], b"".join(plain_pixels(r["media"]))[: r["n_bytes"]]) for r in read) == texts_of
    got = {(r["payload_sha256"], r["feature"]) for r in media.features(media.load(spark, folder)).collect()}
    for r in read:
        grid = plain_pixels(r["media"])
        flat = b"".join(grid)
        assert set(flat[r["n_bytes"] :]) <= {32} and len(grid[0]) == 192
        n, total = len(flat), sum(flat)
        cells = []
        for a in range(8):
            a0, a1 = len(grid) * a // 8, len(grid) * (a + 1) // 8
            own = grid[a0 : max(a1, a0 + 1)]
            cells += [sum(sum(line[24 * b : 24 * b + 24]) for line in own) * n > total * 24 * len(own) for b in range(8)]
        steps = sum(abs(x - y) for x, y in zip(flat, flat[1:]))
        feature = f"rows={len(grid)};mean={(2 * total + n) // (2 * n)};step={1000 * steps // max(1, n - 1)};ahash={int(''.join(str(int(c)) for c in cells), 2):016x}"
        assert (hashlib.sha256(flat).hexdigest(), feature) in got, feature


def test_media_ranges_and_retries(spark, docs, rows):
    folder = shared_dir(spark, "m")
    manifest = media.store(docs, folder, archive_bytes=20_000)
    assert manifest.count() > 3
    for size_ in (512, 5000, 1 << 20):
        assert media.load(spark, folder, range_bytes=size_).count() == len(rows)
    system, path = pafs.FileSystem.from_uri(f"{folder}/{manifest.orderBy('archive').first()['archive']}")
    with system.open_input_file(f"{path}.idx") as f:
        member = pa.ipc.open_file(f).read_all().to_pylist()[0]
    with system.open_input_file(path) as f:
        data = bytearray(f.read())
    data[member["offset"] + member["length"] // 2] ^= 1
    with system.open_output_stream(path) as f:
        f.write(bytes(data))
    got = media.load(spark, folder, tries=2).collect()
    assert len(got) == len(rows) and sum(r["error"] is not None for r in got) == 1 == sum(r["media"] is None for r in got)


def test_media_member_is_tried_again():
    class Flaky:
        calls = 0

        def read_at(self, n, at):
            self.calls += 1
            if self.calls < 3:
                raise OSError("gone")
            return b"abc"

    reader = media.ArchiveReader({"path": "/x"})
    assert reader.member(Flaky(), {"offset": 0, "length": 3, "crc32": zlib.crc32(b"abc")}) == (b"abc", None)


# --- 5 licences ----------------------------------------------------------------------------------------------------


#: Paraphrases that are no template and no frame with a name, by family.
PARAPHRASES = {
    "apache-2.0": ("The source is made available under Apache License 2.0", "Code in this folder: Apache 2.0 license", "Use is permitted under the Apache License, version 2.0 only", "apache license 2.0", "You may copy it under the terms of the Apache 2.0 licence."),
    "bsd": ("This file is covered by the BSD license", "The library is released under a 3-clause BSD licence", "bsd 2-clause license", "Redistribution in source and binary forms with or without modification is permitted provided that these conditions are met"),
    "cc-by-4.0": ("This article is distributed under CC BY 4.0", "Text available under a Creative Commons Attribution 4.0 license", "The work is published under the CC BY 4.0 licence"),
    "cc-by-nc-4.0": ("This article is distributed under CC BY-NC 4.0", "Pictures are licensed under a Creative Commons Attribution-NonCommercial 4.0 license", "You may use the work under CC BY-NC 4.0."),
    "cc-by-sa-4.0": ("This article is distributed under CC BY-SA 4.0", "Text is available under the Creative Commons Attribution-ShareAlike License", "licensed CC BY-SA 4.0"),
    "gpl-3.0": ("Distributed under the GNU GPL v3 or later", "The program is licensed under the GNU General Public License version 3", "This is free software under the terms of the GPL v3", "You can redistribute it and modify it under the GNU General Public License, version 3 or any later version", "gpl version 3"),
    "mit": ("MIT License", "This project is made available under the MIT license.", "The software is licensed under MIT License", "Code: MIT licence", "Use of this code is under the terms of the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in it without restriction"),
    "public-domain": ("The work is in the public domain", "Released to the public domain by the authors", "This file is released under CC0 1.0", "The text of this work is public domain"),
    "rights-reserved": ("all rights reserved", "All rights are reserved by the authors", "Copyright (c) 2019. All rights reserved.", "Copyright the authors, all rights reserved"),
}
#: Sentences with words of licences that state none.
OTHERS = (
    "All rights reserved by the hotel for late guests", "My driving license was renewed and the copyright office is closed today", "The driver showed a license at the border", "The public domain of the king was a large forest",
    "Permission to enter was granted by the guard at noon", "MIT researchers released a paper on the brain", "The Apache helicopter landed near version 2 of the bridge", "Copyright law is taught at the school in town", "The commons were open to the public all year",
    "The court gave permission to use the road", "She has a fishing licence from the county", "A table was reserved for four people", "The human rights group met in Geneva", "He released the dog under the tree", "The software crashed again after the update", "General public opinion changed in version after version",
    "He studied law at MIT and has a license to fly", "The creative commons room is on the second floor", "The conditions of the road were bad without warranty of help", "This work is hard and the pay is low", "You may not use this door", "The authors of this report were paid by the city",
    "A licensed plumber must sign here", "The restaurant is licensed to sell beer", "Free of charge: any person can enter the museum", "Public transport is free of charge on Sunday", "Redistribution of wealth and use of land were debated", "All people have equal rights", "Domain names are sold on the public market", "The copy of the book is in the library",
    "GNU are large animals of the African plains", "Their attribution of the painting to him is wrong", "International flights are 4 hours late", "The general reserved his opinion on the rights of soldiers", "The word licence has two spellings", "The disclaimer was read aloud before the show",
)


@pytest.fixture(scope="module")
def scanner(spark, docs):
    others = spark.createDataFrame([(i, t) for i, t in enumerate(texts(3, 200))], "doc_id long, text string")
    return licences.train(others.union(docs.select("doc_id", "text")))


def test_licences_of_held_out_paraphrases(spark, scanner):
    stated = {tuple(licences.word_list(t)) for f in licences.FAMILIES for t in licences.stated(f)}
    cases = [(f, t) for f, own in PARAPHRASES.items() for t in own] + [("", t) for t in OTHERS]
    new = [(f, t) for f, t in cases if tuple(licences.word_list(t)) not in stated]
    got = {r["doc_id"]: r["licences"] for r in licences.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(new)], "doc_id long, text string"), scanner).collect()}
    right = sum(f == got[i] for i, (f, _) in enumerate(new) if f)
    named = sum(got[i] != "" for i in range(len(new)))
    assert right >= 0.9 * sum(f != "" for f, _ in new) and right >= 0.9 * named, [(f, got[i], t) for i, (f, t) in enumerate(new) if f != got[i]]
    for text, family in (("MIT License", "mit"), ("Apache License 2.0", "apache-2.0"), ("Distributed under the GNU GPL v3 or later", "gpl-3.0"), ("All rights reserved by the hotel for late guests", "")):
        assert [r["licences"] for r in licences.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), scanner).collect()] == [family]


#: Neighbouring licences, real paragraphs, denials and licences that no template is of.
NEIGHBOURS = (
    ("Licensed under the Mozilla Public License 2.0.", "mpl-2.0"), ("Licensed under the Eclipse Public License 2.0.", "epl-2.0"), ("This program is licensed under the GNU General Public License, version 2.", "gpl-2.0"),
    ("This library is licensed under the GNU Lesser General Public License, version 3.", "lgpl-3.0"), ("Licensed under the GNU Affero General Public License, version 3.", "agpl-3.0"), ("This work is licensed under CC BY-ND 4.0.", "cc-by-nd-4.0"),
    ("This work is licensed under CC BY 3.0.", "cc-by-3.0"), ("This work is licensed under CC BY-NC-SA 4.0.", "cc-by-nc-sa-4.0"), ("This project is not licensed under the MIT License.", ""), ("The code isn't available under the Apache License, Version 2.0.", ""),
    (licences.STATEMENTS["mit"][0], "mit"), (licences.STATEMENTS["mit"][3], "mit"), (licences.STATEMENTS["bsd"][2], "bsd"), (licences.STATEMENTS["bsd"][4], "bsd"), (licences.STATEMENTS["gpl"][0], "gpl"), (licences.STATEMENTS["isc"][0], "isc"),
    ("Licensed under the GNU General Public License.", "gpl"), ("This text is licensed under CC BY-NC-ND 4.0", "cc-by-nc-nd-4.0"), ("Creative Commons Attribution-ShareAlike 3.0 Unported License", "cc-by-sa-3.0"),
)
UNSEEN = ("Academic Free License version 3.0", "Q Public License 1.0", "Eiffel Forum License 2.0", "Open Software License 3.0", "CeCILL License 2.1", "Universal Permissive License 1.0", "Nokia Open Source License", "Apple Public Source License 2.0", "Apache License 1.1", "GNU Free Documentation License 1.3")


def test_licences_told_apart(spark, scanner):
    import textwrap

    cases = [*NEIGHBOURS, *((frame.format(name), "") for name in UNSEEN for frame in licences.FRAMES)]
    cases += [("\n".join(textwrap.wrap(licences.STATEMENTS["mit"][0], 72)) + "\n\nThe story goes on.", "mit"), ("Copyright (c) 2019 A. Person\n\n" + "\n".join(textwrap.wrap(licences.STATEMENTS["mpl-2.0"][0], 60)), "mpl-2.0")]
    got = {r["doc_id"]: r["licences"] for r in licences.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string"), scanner).collect()}
    wrong = [(t[:80], f, got[i]) for i, (t, f) in enumerate(cases) if got[i] != f]
    named = [i for i in got if got[i]]
    assert not [w for w in wrong if w[0] in {t[:80] for t, _ in NEIGHBOURS}], wrong
    assert len([i for i in named if got[i] != cases[i][1]]) <= 0.1 * len(named) and len(wrong) <= 3, wrong


def test_licence_scores_equal_plain_ones(spark, scanner):
    """Scores by hand from the coefficients; paragraphs without a telling word are unknown by them too."""
    lines = [t for own in PARAPHRASES.values() for t in own] + list(OTHERS) + texts(8, 60) + ["", "the", "1.0 2"]
    at = {g: k for k, g in enumerate(scanner.vocabulary.vocabulary)}
    weights, start = scanner.regression.coefficientMatrix.toArray(), scanner.regression.interceptVector.toArray()
    got = {r["line"]: r for r in scanner.named(spark.createDataFrame([(t,) for t in lines], "line string").withColumn("tokens", licences.words(F.col("line")))).withColumn("told", licences.tells(F.col("line"), scanner.telling)).collect()}
    assert scanner.telling
    for t in lines:
        there = sorted({at[g] for g in licences.gram_list(licences.word_list(t)) if g in at})
        z = start + weights[:, there].sum(axis=1)
        share = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[t]["_family"] == scanner.families[int(share.argmax())] and abs(got[t]["_probability"] - share.max()) < 1e-9
        assert got[t]["told"] or share.argmax() == 0
    assert not all(r["told"] for r in got.values())


def test_licences(spark, none, scanner):
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\nany later version."
    cases = {
        1: ("A story.\nReleased under the MIT License.\nThe end.", "mit"), 2: ("Licensed under the Apache License, Version 2.0.\nAll rights reserved.", "apache-2.0,rights-reserved"),
        3: ("My driving license was renewed and the copyright office is closed today", ""), 4: ("this work is licensed under the GNU general public license, version 3", "gpl-3.0"),
        5: ("", ""), 6: (None, ""), 7: ("no such thing", ""), 8: ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"), 9: ("word " * 30_000 + "end. Released under the MIT License. " + "more " * 30_000, "mit"),
        10: ("Intro line\n" + gpl + "\n\nLast line", "gpl-3.0"), 11: (f"See the notes. {licences.STATEMENTS['apache-2.0'][0]} Thanks.", "apache-2.0"),
    }
    rows = [(i, t, "x", 7) for i, (t, _) in cases.items()] + [(1, cases[1][0], "x", 7), (None, cases[1][0], "x", 7), (None, None, "x", 7)] + [(100 + i, t, "x", 7) for i, t in enumerate(texts(3, 60))]
    df = spark.createDataFrame(rows, "doc_id long, text string, family string, paragraph int")
    got = licences.scan(df, scanner).collect()
    assert Counter((r["doc_id"], r["licences"]) for r in got) == Counter((i, next((w for t, w in cases.values() if t == x), "")) for i, x, _, _ in rows)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_paragraphs"] == 3 and by[1]["n_licences"] == 1 <= by[10]["n_licences"] and by[2]["n_licences"] == 2 and by[5]["n_paragraphs"] == by[6]["n_paragraphs"] == 0
    assert licences.scan(none, scanner).count() == 0 and licences.train(none).telling


# --- 6 sharding ----------------------------------------------------------------------------------------------------


def test_min_cost_flow_is_optimal():
    rnd = random.Random(7)
    for _ in range(40):
        n, m = rnd.randint(1, 3), rnd.randint(1, 3)
        supply = [rnd.randint(0, 3) for _ in range(n)]
        room = [rnd.randint(0, 4) for _ in range(m)]
        cost = [[rnd.randint(0, 4) for _ in range(m)] for _ in range(n)]
        if sum(supply) > sum(room):
            with pytest.raises(ValueError):
                sharding.min_cost_flow(supply, room, cost)
            continue
        flow = sharding.min_cost_flow(supply, room, cost)
        assert [sum(r) for r in flow] == supply and all(sum(flow[i][j] for i in range(n)) <= room[j] for j in range(m))
        best: dict = {tuple(room): 0}
        for i in range(n):
            for _ in range(supply[i]):
                step: dict = {}
                for left, c in best.items():
                    for j in range(m):
                        if left[j]:
                            key = (*left[:j], left[j] - 1, *left[j + 1 :])
                            step[key] = min(step.get(key, 10**9), c + cost[i][j])
                best = step
        assert sum(flow[i][j] * cost[i][j] for i in range(n) for j in range(m)) == min(best.values())


def test_sharding(spark, docs, rows, none):
    got = sharding.resharded(docs).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert sharding.resharded(none).count() == 0


def test_sharding_balances_and_keeps_equal_texts(spark):
    some = texts(5, 900)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(some + some[:300])], "doc_id long, text string")
    got = sharding.resharded(df).collect()
    sums = Counter()
    for r in got:
        sums[r["shard"]] += r["size"]
    assert len(sums) == 8 and max(sums.values()) < 1.05 * min(sums.values())
    at = defaultdict(set)
    for r in got:
        at[(some + some[:300])[r["doc_id"]]].add(r["shard"])
    assert all(len(s) == 1 for s in at.values())


def plain_placement(rows, old=6, new=8):
    """(doc_id, text) rows to new shards by the rule, in plain Python: order, flow, cuts beside texts or inside heavy ones."""
    signed = lambda x: x - 2**64 if x >> 63 else x
    h = lambda t: signed(xxhash.xxh64_intdigest((t or "").encode(), 42))
    d = lambda i: signed(xxhash.xxh64_intdigest((1).to_bytes(4, "little"), xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), 42) if i is not None else 42))
    size = lambda t: len((t or "").encode()) + 1
    lines: dict = defaultdict(list)
    for i, t in rows:
        lines[h(t) % old].append((h(t), d(i), size(t)))
    total = sum(size(t) for _, t in rows)
    room = [total // new + (j < total % new) for j in range(new)]
    olds = sorted(lines)
    flow = sharding.min_cost_flow([sum(x[2] for x in lines[i]) for i in olds], room, [[int(i != j) for j in range(new)] for i in olds])
    ends: dict = defaultdict(list)
    for i, row in zip(olds, flow):
        at, texts_ = 0, Counter()
        for x in lines[i]:
            texts_[x[0]] += x[2]
        js = [j for j in sorted(range(new), key=lambda j: (j != i, j)) if row[j]]
        for j in js[:-1]:
            at += row[j]
            start = 0
            for text in sorted(texts_):
                if start <= at < start + texts_[text]:
                    break
                start += texts_[text]
            left, right = at - start, start + texts_[text] - at
            if min(left, right) <= total / new / 32:
                ends[i].append((j, (text, -(2**63)) if left <= right else (text, 2**63)))
            else:
                sums: dict = defaultdict(int)
                for own, doc, n in lines[i]:
                    if own == text:
                        sums[(doc + 2**63) >> 52] += n
                for part in sorted(sums):
                    if left < sums[part]:
                        break
                    left -= sums[part]
                ends[i].append((j, (text, (part + (2 * left > sums[part]) << 52) - 2**63)))
        ends[i].append((js[-1], (2**63, 0)))
    return Counter((i, size(t), next(j for j, end in ends[h(t) % old] if (h(t), d(i)) < end)) for i, t in rows)


@pytest.mark.parametrize("heavy", [0, 1, 900])
def test_sharding_equals_the_rule(spark, heavy):
    some = texts(5, 400)
    data = [(i, t) for i, t in enumerate(some + some[:100] + ["the same text again and again " * 20] * heavy)] + [(None, "x"), (None, None), (3, ""), (3, "")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("shard", F.lit("clash")).withColumn("h", F.lit(1))
    got = sharding.resharded(df).collect()
    assert Counter((r["doc_id"], r["size"], r["shard"]) for r in got) == plain_placement(data)
    sums, at = Counter(), defaultdict(set)
    for r in got:
        sums[r["shard"]] += r["size"]
        at[r["text_crc32"]].add(r["shard"])
    assert len(sums) == 8 and max(sums.values()) - min(sums.values()) < 0.07 * sum(sums.values()) / 8
    assert sum(len(s) > 1 for s in at.values()) == (1 if heavy == 900 else 0)


def test_only_affected_parts_are_rewritten(spark, docs):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts(5, 600))], "doc_id long, text string")
    folder = shared_dir(spark, "s")
    sharding.first_layout(df, folder, 6)
    was = sharding.read_layout(spark, folder).cache()
    total = was.agg(F.sum("size")).first()[0]
    plan = sharding.pieces(was, None, 8)
    moving = was.filter(sharding.destination(plan) != F.col("shard")).agg(F.sum("size")).first()[0]
    assert moving < 0.3 * total and was.filter(~sharding.affected(plan, 3) & (sharding.destination(plan) != F.col("shard"))).count() == 0
    now = sharding.reshard(spark, folder).collect()
    spark.createDataFrame([(1, "lost", 5, 0, 0, 0, "attempt", 0, 0)], f"{sharding.STORED}, {sharding.PLACE}").write.partitionBy("generation", "shard", "part").mode("append").parquet(f"{folder}/data")
    again = sharding.read_layout(spark, folder)  # as a reader that starts anew, beside an attempt that did not end
    assert again.count() == 600 and sorted(again.collect()) == sorted(now) and again.select("generation").distinct().count() == 2
    third = sharding.reshard(spark, folder, shards=3)
    assert third.count() == 600 and {r["shard"] for r in third.collect()} == {0, 1, 2}


# --- 7 quality -----------------------------------------------------------------------------------------------------


def test_quality(spark, docs, none):
    rnd = random.Random(1)
    good = [(i, " ".join(rnd.choice(WORDS) for _ in range(80)), 1) for i in range(300)]
    bad = [(1000 + i, " | ".join(rnd.choice(WORDS).upper() + "!!" for _ in range(80)), 0) for i in range(300)]
    df = spark.createDataFrame([(i, t) for i, t, _ in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in good + bad] + [(0, 0), (5, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(df, labels, 50, 1 << 14)
    got = {r["doc_id"]: r for r in quality.scored(df, model).collect()}
    assert all(got[i]["predicted"] == q for i, _, q in good + bad)
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= got[i]["score"] <= 1 for i in got)
    assert quality.learnable(labels).filter("doc_id = 0 OR doc_id IS NULL").count() == 0
    assert quality.scored(docs, model).count() == docs.count() and quality.scored(none, model).count() == 0
    assert {r["score"] for r in quality.scored(docs, quality.train(none, labels.limit(0))).collect()} == {0.5}


def test_quality_scores_equal_plain_ones(spark, docs, rows):
    """Scores from the model's dictionaries and points by a compressor and an interpolation of their own."""
    import zstandard

    rnd = random.Random(2)
    data = [(i, " ".join(rnd.choice(WORDS) if rnd.random() < (0.9 if i % 7 == 0 else 0.3 + 0.6 * ((i // 2) % 5) / 5) - 0.1 * (i % 2) else f"#{rnd.randint(0, 99)}$" for _ in range(rnd.randint(3, 400)))) for i in range(400)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i, _ in data], "doc_id long, quality int")
    model = quality.train(spark.createDataFrame(data, "doc_id long, text string"), labels, 60, 1 << 14)
    assert len(model.points) > 2 and len(set(model.scores)) > 2

    def size(text, content):
        with_it = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
        raw = text.encode()
        return sum(len(with_it.compress(raw[k : k + quality.BLOCK])) for k in range(0, len(raw), quality.BLOCK))

    def plain(text):
        d = (size(text, model.bad) - size(text, model.good)) / len(text.encode()) if text else 0.0
        return float(np.interp(d, model.points, model.scores))

    for df, texts_of in ((docs, {i: t for i, t, _ in rows}), (spark.createDataFrame(data, "doc_id long, text string"), dict(data))):
        for r in quality.scored(df.dropDuplicates(["doc_id"]).select("doc_id", "text"), model).collect():
            assert r["score"] == pytest.approx(plain(r["text"] if r["doc_id"] in texts_of else None), abs=0.02), r["doc_id"]
            assert r["predicted"] == int(r["score"] >= 0.3)


def test_isotonic_rises():
    rnd = random.Random(3)
    points, scores = quality.isotonic([(d := rnd.random(), int(rnd.random() < d)) for _ in range(500)])
    assert points == sorted(points) and scores == sorted(scores)


# --- 8 line dedup --------------------------------------------------------------------------------------------------


def plain_chunks(t):
    units = re.findall(line_dedup.UNIT, t)
    assert "".join(units) == t
    h = [ord(hashlib.md5(x.encode()).hexdigest()[0]) for x in units]
    out, own = [], []
    for i, x in enumerate(units):
        own.append(x)
        if i == len(units) - 1 or ((h[i - 1] if i else 0) * line_dedup.FACTOR + h[i]) % line_dedup.DIVISOR == 0:
            out.append(own)
            own = []
    return out


def plain_line_dedup(rows, copies=False):
    where = defaultdict(set)
    digest = lambda t: hashlib.md5(t.encode()).hexdigest()
    for i, t in rows:
        for k, c in enumerate(plain_chunks(t) if t is not None else []):
            if len(c) > 1:
                where["".join(c)].add((i is not None, i or 0, digest(t), k))
    first = {c: min(p) for c, p in where.items()}
    stays = lambda c, i, t, k: len(c) < 2 or first["".join(c)][2 * copies :] == (i is not None, i or 0, digest(t), k)[2 * copies :]
    return Counter((i, t if t is None else "".join("".join(c) for k, c in enumerate(plain_chunks(t)) if stays(c, i, t, k))) for i, t in rows)


def test_line_dedup(spark, docs, rows, none):
    rnd = random.Random(2)
    pool = [" ".join(rnd.choice(WORDS) for _ in range(6)) for _ in range(60)]
    passage = pool[:9]
    data = [(i, "\n".join(rnd.sample(pool[9:], 5) + passage + rnd.sample(pool[9:], 5))) for i in range(12)]
    data += [(20, "\n".join(passage * 3)), (21, data[0][1]), (21, data[0][1]), (21, data[1][1]), (None, data[3][1] + "\nend"), (None, None), (22, None), (23, ""), (24, "\n\n\n")]
    data += [(30 + i, f"Some start {i}. " + ". ".join(passage) + f". {'x' * 50_000} end {i}") for i in range(3)]
    df = spark.createDataFrame([(*r, len(r[1] or ""), 1, "k", 2) for r in data], "doc_id long, text string, n_chars long, no int, chunk string, _id int")
    for copies in (False, True):
        got = line_dedup.deduplicate(df, copies=copies)
        assert got.columns == df.columns and Counter((r["doc_id"], r["text"]) for r in got.collect()) == plain_line_dedup(data, copies)
        assert got.filter("n_chars <> length(text)").count() == 0
        assert Counter((r["doc_id"], r["text"]) for r in line_dedup.deduplicate(docs, copies=copies).collect()) == plain_line_dedup([(i, t) for i, t, _ in rows], copies)
    assert line_dedup.report(none).count() == line_dedup.deduplicate(none).count() == 0
    con = duckdb.connect()
    table = pa.table({"doc_id": [i for i, _ in data], "text": [t for _, t in data]})
    con.register("documents", table)
    assert Counter(map(tuple, line_dedup.report(df).collect())) == Counter(con.sql(line_dedup.REPORT_SQL).fetchall())


def test_line_dedup_compares_bytes(spark, monkeypatch):
    """With a hash that is the same for all chunks of a length only the bytes tell them apart."""
    monkeypatch.setattr(line_dedup.F, "xxhash64", lambda *c: F.length(c[0]).cast("long"))
    data = [(i, f"first {k}.\nsecond {k}.\nthird {k}.\nfourth {k}.\n") for i, k in enumerate([1, 2, 3, 1, 4, 2])]
    got = line_dedup.deduplicate(spark.createDataFrame(data, "doc_id long, text string"))
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == plain_line_dedup(data)


def test_share_of_planted_passages_that_chunks_find(spark):
    rnd = random.Random(11)
    sentence = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(n)) + "."
    planted = ["\n".join(sentence(rnd.randint(9, 12)) for _ in range(rnd.randint(6, 14))) for _ in range(60)]
    data = [(k, planted[k % 60] if k < 60 else "\n".join([sentence(9), planted[k % 60], sentence(9)])) for k in range(180)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.deduplicate(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    there = sum(len(planted[k % 60].split()) for k in range(60, 180))
    left = sum(len(got[k].split()) - 18 for k in range(60, 180))
    assert all(got[k] == planted[k] for k in range(60)) and 0.45 < 1 - left / there < 1
    all_gone = {r["doc_id"]: r["text"] for r in line_dedup.without_repeats(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert all(len(all_gone[k].split()) == 18 for k in range(60, 180))


def test_repeated_passages_go_whatever_their_neighbours(spark, docs, none):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(6))
    sentence = lambda n: " ".join(word() for _ in range(n)) + "."
    planted = [sentence(60)]  # a paragraph of one line
    planted += ["\n".join(sentence(9) for _ in range(k)) for k in (6, 7, 20)]  # runs of lines
    planted += [" ".join(sentence(8) for _ in range(7)), "\n".join([sentence(49), sentence(1), sentence(3)])]
    data = [(0, "\n".join(planted))]
    for k, p in enumerate(planted):
        data += [(10 * k + d, sentence(12) + "\n" + p + "\n" + sentence(12)) for d in (1, 2)]
        data += [(10 * k + 3, p), (10 * k + 4, sentence(12) + " " + p + " " + sentence(12))]
    unique = [(200, "\n".join(sentence(9) for _ in range(30))), (201, None), (202, ""), (203, "\n\n")]
    copies = [(300, data[1][1]), (301, data[1][1]), (None, "\n".join(planted[0:1] * 3))]
    df = spark.createDataFrame(data + unique + copies[:2], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.without_repeats(df).collect()}
    assert len(got) == len(data) + 6 and got[0] == data[0][1] and all(got[i] == t for i, t in unique)
    first_words = [p.split()[k] for p in planted for k in range(len(p.split()))]
    assert not [(i, w) for i, _ in data[1:] for w in first_words if w in got[i].split()]
    assert all(len(got[10 * k + d].split()) == 24 for k in range(len(planted)) for d in (1, 2, 4)) and got[300] == got[301] == got[1]
    one = line_dedup.without_repeats(spark.createDataFrame(copies[2:], "doc_id long, text string")).collect()
    assert one[0]["text"] == planted[0]
    same = lambda f, **a: Counter((r["doc_id"], (r["text"] or "").rstrip("\n ")) for r in f(docs.unionByName(none), **a).select("doc_id", "text").collect())
    assert same(line_dedup.without_repeats, passage=10**6) == same(line_dedup.deduplicate, copies=True)
    assert line_dedup.without_repeats(docs).columns == docs.columns and line_dedup.without_repeats(none).count() == 0


def test_chunks_resist_shifts():
    lines = texts(9, 200)
    a, b = ({"".join(c) for c in plain_chunks("\n".join(x))} for x in (lines, ["one more", *lines]))
    assert len(a & b) >= len(a) - 2


# --- 9 kNN ---------------------------------------------------------------------------------------------------------


def plain_top(data, k=10):
    out = []
    for at, (q, a) in enumerate(data):
        if q % 7 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for n, (i, b) in enumerate(data) if n != at)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


ASKS = "vec_id % 7 = 0"


def exact_rows(vectors):
    return [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in vectors]


@pytest.mark.parametrize("n,groups", [(3, 1), (150, 1), (150, 4)])
def test_knn(spark, n, groups, monkeypatch):
    monkeypatch.setattr(knn, "QUERIES", 512 if groups == 1 else 4)
    monkeypatch.setattr(knn, "SEEDS", 1024 if groups == 1 else 8)
    monkeypatch.setattr(knn, "BLOCK", 40)
    rnd = random.Random(n)
    vectors = [(i, [rnd.choice([0.5, -0.25, rnd.gauss(0, 1)]) for _ in range(6)]) for i in range(n)]
    vectors += [(n + 1, vectors[0][1]), (n + 2, vectors[1][1])]
    vectors += [(0, vectors[2][1]), (0, vectors[0][1]), (1, vectors[1][1]), (7, [0.0] * 6)]  # ids that repeat, and the zero vector as a query
    odd = [(1000, None), (1001, [float("nan")] * 6), (1002, [float("inf")] + [0.0] * 5), (1003, [None] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame([(*v, 1, "x") for v in vectors + odd], "vec_id long, embedding array<float>, row int, cell string")
    got = sorted(map(tuple, knn.top_k(knn.integers(df), F.expr(ASKS)).collect()))
    assert got == sorted(plain_top(exact_rows(vectors)))


def test_knn_of_clusters_sends_less(spark, monkeypatch):
    monkeypatch.setattr(knn, "QUERIES", 20)
    rnd = np.random.default_rng(5)
    middles = rnd.normal(size=(24, 8)) * 20
    vectors = [(i, (middles[i % 24] + rnd.normal(size=8) * 0.2).tolist()) for i in range(1600)] + [(5000 + i, middles[3].tolist()) for i in range(500)]
    data = knn.integers(spark.createDataFrame(vectors, "vec_id long, embedding array<float>"))
    sent, groups = knn.replication(data, F.expr(ASKS))
    assert groups >= 8 and sent < 0.3 * groups, (sent, groups)
    exact = exact_rows(vectors)
    x, ids = np.array([v for _, v in exact]), np.array([i for i, _ in exact])
    want = []
    for q, i in enumerate(ids):
        if i % 7 == 0:
            score = x @ x[q]
            best = sorted(np.delete(np.arange(len(ids)), q), key=lambda k: (-score[k], ids[k]))[:10]
            want += [(int(i), r + 1, int(ids[k]), int(score[k])) for r, k in enumerate(best)]
    for at_once in (None, 100):  # 100: a few rows against the pivots at once
        assert sorted(map(tuple, knn.top_k(data, F.expr(ASKS), at_once=at_once).collect())) == sorted(want)


def test_knn_large_values_and_empty(spark):
    df = spark.createDataFrame([(i, [1e5 * (i + 1), 3.0]) for i in range(12)], "vec_id long, embedding array<double>")
    data = knn.integers(df)
    exact = [(i, [102_400_000 * (i + 1), 3072]) for i in range(12)]
    assert sorted(map(tuple, knn.top_k(data, F.expr(ASKS)).collect())) == sorted(plain_top(exact))
    assert knn.top_k(data.limit(0), F.expr(ASKS)).count() == knn.top_k(data, F.lit(False)).count() == 0


# --- 10 token files ------------------------------------------------------------------------------------------------


def test_blocks_hold_any_ids():
    rnd = np.random.default_rng(1)
    for ids in (np.zeros(2048), np.full(2048, 2**32 - 1), rnd.integers(0, 50257, 2048), np.where(rnd.random(2048) < 0.05, 2**32 - 1, 7), np.where(rnd.random(2048) < 0.5, 0, 2**31)):
        ids = ids.astype("<u4")
        assert (token_files.unpack_block(memoryview(token_files.pack_block(ids)), 0) == ids).all()


def test_token_files(spark, docs, rows, none, tokenizer):
    got = token_files.round_trip(docs, queries.tokenizer_path()).collect()
    want, at = [], 0
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_files.round_trip(none, queries.tokenizer_path()).count() == 0


def test_token_files_are_closed_at_a_size(spark, docs, rows, tokenizer):
    whole = sorted(map(tuple, token_files.round_trip(docs, queries.tokenizer_path()).collect()), key=lambda r: r[1])
    for options in ({"file_ids": 500}, {"file_documents": 7}):
        manifest = token_files.write(docs, queries.tokenizer_path(), shared_dir(spark, "token-files"), rows=3, **options)
        assert manifest.count() > 4 and manifest.agg(F.sum("documents")).first()[0] == len(rows)
        assert sorted(map(tuple, token_files.read(manifest).collect()), key=lambda r: r[1]) == whole
    nulls = spark.createDataFrame([(None, f"text {i % 50} and {i}") for i in range(400)], "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as small tables are joined to one task again
    try:
        manifest = token_files.write(nulls, queries.tokenizer_path(), shared_dir(spark, "token-files"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert manifest.filter("documents < 300").count() > 1  # one doc_id in several tasks


def test_media_partitions_hold_several_archives(spark, docs, rows):
    folder = shared_dir(spark, "media")
    media.store(docs.repartition(9), folder)
    reader = media.ArchiveReader({"path": folder, "ranges": "1"})
    few, many = reader.partitions(), media.ArchiveReader({"path": folder, "range_bytes": "2000"}).partitions()
    assert len(few) == 1 and len(few[0].ranges) > 4 and len(many) > len(few[0].ranges)
    for options in ({"ranges": 1}, {"range_bytes": 2000}):
        assert media.load(spark, folder, **options).filter("error IS NULL").count() == len(rows)


def test_token_file_slices(tmp_path):
    with pa.OSFile(str(tmp_path / "x"), "wb") as f:
        w = token_files.Writer(f)
        all_ids = np.arange(10_000, dtype="<u4") * 7919 % 50257
        for k in range(0, 10_000, 1000):
            w.add([k, None], [all_ids[k : k + 300].tobytes(), all_ids[k + 300 : k + 1000].tobytes()])
        w.close()
    reader = token_files.Reader(pafs.LocalFileSystem().open_input_file(str(tmp_path / "x")))
    for a, b in ((0, 10_000), (2047, 2049), (9_999, 10_000), (5, 5)):
        assert (reader.ids(a, b) == all_ids[a:b]).all()
    assert reader.doc_ids[:2] == [0, None] and len(list(token_files.rows_of(reader, 0, 1500))) == 10


# --- queries and pipeline ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(name, spark, small):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    df = queries.QUERIES[name](spark, small)
    rel = con.sql(queries.SQL[name])
    at = [rel.columns.index(c) for c in df.columns]
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    assert sorted(map(repr, ([plain(v) for v in r] for r in df.collect()))) == sorted(map(repr, ([plain(r[i]) for i in at] for r in rel.fetchall())))


def test_pipeline(spark, small):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["quality", "line_dedup", "simhash", "mixing", "bpe"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, small).cache()
        assert docs.columns == columns, name
        assert name != "quality" or 0.7 * n < docs.count() < n
        assert name != "line_dedup" or docs.filter("n_chars <> length(text)").count() == 0
    assert P.run(spark, small).count() == docs.count() > 0


def test_pipeline_of_odd_rows(spark, tmp_path, rows):
    """Nulls, empty and very long texts, repeated rows, copies, ties, clashing columns and empty tables, through each stage and through all."""
    import corpus_pipeline as P

    rnd = random.Random(6)
    good = [(2000 + i, " ".join(rnd.choice(WORDS) for _ in range(60)), rnd.choice(["a", None])) for i in range(80)]
    bad = [(3000 + i, " | ".join(rnd.choice(WORDS).upper() + "!!" for _ in range(60)), "b") for i in range(80)]
    every = [*rows, *good, *bad, *good[:5], (4000, good[0][1], None), (4001, good[0][1], "c"), (4002, None, None), (4003, "long " * 60_000, "c")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row string, digest long, size string, node int, score string, text_a string"
    df = spark.createDataFrame([(i, t, None, s, len(t or ""), "r", 1, None, 2, "x", "y") for i, t, s in every], schema)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _, _ in good] + [(i, 0, 0) for i, _, _ in bad] + [(None, 1, 0), (4003, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    odd = spark.read.parquet(f"{tmp_path}/documents.parquet")
    counts = {}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, odd, str(tmp_path)).cache()
        counts[name] = out.count()
        assert out.columns == odd.columns, name
        assert stage(spark, odd.limit(0), str(tmp_path)).count() == 0, name
    assert counts["line_dedup"] == len(every) and 80 < counts["quality"] < len(every)
    kept = {(r["doc_id"], r["text"]) for r in P.one_of_near_copies(spark, odd, str(tmp_path)).collect()}
    assert (2000, good[0][1]) in kept and not {4000, 4001} & {i for i, _ in kept}
    assert P.encoded(spark, odd, str(tmp_path)).count() == len(every) and P.encoded(spark, odd.limit(0), str(tmp_path)).count() == 0
    got = P.run(spark, str(tmp_path)).collect()
    assert got and all(r["n_tokens"] >= 0 for r in got)
    odd.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{tmp_path}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/none/labels.parquet")
    assert P.run(spark, f"{tmp_path}/none").count() == 0
