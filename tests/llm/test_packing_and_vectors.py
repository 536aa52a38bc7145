"""Packing, clustering and vector codes against brute force, with nulls, ties, repeats, odd vectors and clashing columns."""

from __future__ import annotations

import bisect
import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from forgeline.llm import centroids, packing, queries, vector_codes

TEXTS = "doc_id long, text string, start string, sequence_id string, offset string, ids string, _group string"
VECTORS = "vec_id long, embedding array<float>, label int, v string, cluster string, block string, kind string"


# --- 11 packing ----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def path():
    return queries.tokenizer_path(queries.WORD_TOKENIZER)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(3)
    words = ["don't", "STOP", "naïve", "été", "漢字", "x1y22", "😀", "a\tb", "c\nd", "--", "we'll!", "<|endoftext|>", "́alone", "ß", "z" * 90, "\x1d"]
    odd = [None, "", " ", "\n\n", "<|startoftext|>", "one", "  two  spaces ", "word " * 9000, "q" * 5000]
    out = [(i, t) for i, t in enumerate(odd)]
    out += [(100 + i, " ".join(rnd.choice(words) if rnd.random() < 0.1 else f"w{rnd.randint(0, 500)}" for _ in range(rnd.randint(1, 900)))) for i in range(150)]
    return [*out, (100, out[-1][1]), (101, out[20][1]), (101, out[20][1]), (None, "no id"), (None, "no id"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "a", "b", "c", "d", "e") for i, t in texts], TEXTS).repartition(4).cache()


def test_packing_cuts_and_fills(spark, docs, texts, path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    rows = packing.packed(docs, path, group=60).collect()
    want = []
    for i, t in texts:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want += [(i, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes()), len(ids)) for a in range(0, len(ids), 4096)]
    assert sorted([(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows], key=repr) == sorted(want, key=repr)
    windows = defaultdict(list)
    for r in rows:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for found in windows.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 4096
    groups = {i >> 32 for i in windows}
    assert len(groups) > 1
    # nothing can be fuller than this: whole windows, and at most one half-empty one a group beyond them
    assert len(windows) <= -(-sum(w[2] for w in want) // 4096) + 2 * len(groups)


def test_packed_windows_hold_the_documents(docs, path):
    placed = packing.packed(docs, path, window=256, end_id=7, with_ids=True, group=500).cache()
    found = {r["sequence_id"]: r["ids"] for r in packing.sequences(placed).collect()}
    for r in placed.collect():
        assert found[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"]
    sizes = [len(v) for v in found.values()]
    one = packing.padding(placed, 256).first()
    assert (one["sequences"], one["tokens"], one["padding"]) == (len(sizes), sum(sizes), sum(256 - n for n in sizes if n & (n - 1)))
    assert one["padding"] < 0.02 * one["tokens"]


def test_packing_without_rows(spark, path):
    empty = spark.createDataFrame([], TEXTS)
    assert packing.packed(empty, path).collect() == []
    assert packing.padding(packing.packed(empty, path)).first()["padding"] == 0


def test_best_fit_takes_the_tightest_window():
    rnd = random.Random(1)
    for window in (1, 7, 64, 100):
        lengths = sorted((rnd.randint(1, window) for _ in range(400)), reverse=True)
        numbers, offsets = packing.best_fit(np.array(lengths), window)
        open_windows: list[int] = []  # remaining capacities, in order
        left: dict[int, int] = {}
        for n, k, at in zip(lengths, numbers.tolist(), offsets.tolist()):
            best = bisect.bisect_left(open_windows, n)
            if best == len(open_windows):
                assert k not in left and at == 0
                left[k] = window
            else:
                assert left[k] == open_windows.pop(best)
                assert at == window - left[k]
            left[k] -= n
            if left[k]:
                bisect.insort(open_windows, left[k])


def test_words_are_forgotten_within_bounds(path, texts):
    encoder = packing.WordEncoder(path, most=50)
    whole = packing.WordEncoder(path)
    for _, t in texts:
        assert list(encoder.many([t])) == [whole.encode(t or "").tobytes()]
    assert max(map(len, encoder.words)) <= packing.LONGEST


def test_word_parts_equal_the_library(path):
    """Plain and odd words, put together at random."""
    from tokenizers import Tokenizer

    library, encoder, rnd = Tokenizer.from_file(path), packing.WordEncoder(path), random.Random(8)
    assert encoder.by_parts and encoder.words is not None
    parts = ["a", "The", "ING", "x9", "07", ".", ",", "--", "$$$", "'s", "'", "'LL", "é", "İ", "ß", "ǅ", "漢字", "²", "½", "Ⅷ", "_", "\t", "\x1d", "\u00a0", "\u0301", "\u200d", "😀", "<|", "|>", "\n", " ", " "]
    for _ in range(1500):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        assert np.frombuffer(next(encoder.many([t])), "<i4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)
    many = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(800)]
    for t, packed in zip(many, encoder.many(many)):
        assert np.frombuffer(packed, "<i4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


# --- vectors -------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vectors():
    """(vec_id, embedding, label): clusters, ties on a grid, copies, and vectors that take no part."""
    rnd = np.random.default_rng(5)
    middles = rnd.normal(0, 0.5, (6, 64))
    out = [(i, (middles[i % 6] + rnd.normal(0, 0.05, 64)).astype(np.float32).tolist(), [None, 1, 2, 1][i % 4]) for i in range(500)]
    out += [(500 + i, (rnd.integers(-1, 2, 64) / 256).astype(np.float32).tolist(), 3) for i in range(60)]
    out += [(500 + i, out[500][1], 3) for i in range(40)] + [(7, out[7][1], None), (None, out[3][1], 1), (None, out[4][1], None)]
    nan, inf = float("nan"), float("inf")
    return [*out, (900, None, 1), (901, [1.0] * 63 + [nan], 1), (902, [-inf] + [1.0] * 63, 2), (903, [None] + [0.0] * 63, 2)]


@pytest.fixture(scope="module")
def table(spark, vectors):
    return spark.createDataFrame([(i, e, la, "a", "b", "c", "d") for i, e, la in vectors], VECTORS).repartition(3).cache()


def integers(vectors, width=None):
    fine = [(i, e, la) for i, e, la in vectors if e is not None and all(x is not None and np.isfinite(x) for x in e) and (width is None or len(e) == width)]
    return [(i, np.floor(np.array(e, np.float32).astype(np.float64) * 256).astype(np.int64), la) for i, e, la in fine]


def lloyd(rows, k, rounds):
    """Plain rounds: (vec_id, cluster, distance) and centroids."""
    order = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1].tolist()))
    middles = np.array([r[1] for r in order[:k]])
    v = np.array([r[1] for r in rows])
    near = lambda: ((v[:, None] - middles) ** 2).sum(2)
    for _ in range(rounds):
        own = near().argmin(1)
        middles = np.array([v[own == c].sum(0) // (own == c).sum() if (own == c).any() else m for c, m in enumerate(middles)])
    d = near()
    return [(r[0], int(c), int(d[i, c])) for i, (r, c) in enumerate(zip(rows, d.argmin(1)))], middles


@pytest.mark.parametrize(("k", "rounds", "block"), [(40, 5, 64), (1, 2, 4096), (9, 12, 100), (2000, 2, 50)])
def test_clusters_equal_plain_rounds(table, vectors, k, rounds, block):
    more = table.union(table.limit(1).selectExpr("950L", "array(1f, 2f)", "1", "'a'", "'b'", "'c'", "'d'"))  # another width
    found, middles, rescanned = centroids.clustered(centroids.kept(more), k, rounds, block=block, buckets=3)
    want, plain = lloyd(integers(vectors, 64), k, rounds)
    assert middles.tolist() == plain.tolist()
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    assert rescanned[0] == len(want)
    if k == 9:  # what has settled is not looked at again
        assert rescanned[-1] < 0.2 * len(want)


def test_rounds_of_clustering_shuffle_nothing(spark, table):
    name = centroids.bucketed(centroids.blocks(centroids.kept(table), 64, 50).repartition(3, "block"), "vectors", 3)
    data, middles = spark.table(name), centroids.first_centroids(centroids.kept(table), 5)
    heaps = centroids.bucketed(centroids.one_round(centroids.with_heaps(data, None), middles, np.zeros(5)), "heaps", 3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = centroids.one_round(centroids.with_heaps(data, heaps), middles, np.ones(5))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Join" in plan and "Exchange" not in plan


def test_clustering_report_and_its_sql(spark, small, table, vectors):
    rows = centroids.report(table).collect()
    want, middles = lloyd(integers(vectors, 64), 40, 5)
    assert sorted([(r["vec_id"], r["cluster"], r["distance"]) for r in rows], key=repr) == sorted(want, key=repr)
    for r in rows:
        assert r["cluster_inertia"] == sum(d for _, c, d in want if c == r["cluster"]) and r["inertia"] == sum(d for _, _, d in want)
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, middles[r["cluster"]].tolist())).encode()).hexdigest()
    assert centroids.report(table.limit(0)).collect() == []
    duckdb_rows(spark, small, "op12_centroids")


def duckdb_rows(spark, small, name):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{small}/embeddings.parquet'")
    df = queries.QUERIES[name](spark, small)
    rel = con.sql(queries.SQL[name])
    at = [rel.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in at) for r in rel.fetchall())


def test_large_components_are_exact_or_an_error():
    v, c = np.array([[2**28, -(2**28)]]), np.array([[2**28 - 1, -(2**28)], [-(2**28), 2**28]])
    assert centroids.distances(v, c).tolist() == [[1, 2**59]]
    with pytest.raises(OverflowError):
        centroids.distances(np.array([[2**40]]), np.array([[0]]))


def plain_codes(rows, parts, entries, rounds):
    width = -(-max(len(r[1]) for r in rows) // parts) * parts
    v = np.array([np.pad(r[1], (0, width - len(r[1]))) for r in rows])
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][1].tolist()))[:entries]
    x = v.reshape(len(v), parts, -1)
    books = x[order].transpose(1, 0, 2).copy()
    near = lambda p: ((x[:, p, None] - books[p]) ** 2).sum(2)
    for _ in range(rounds):
        for p in range(parts):
            own = near(p).argmin(1)
            books[p] = [x[own == e, p].sum(0) // (own == e).sum() if (own == e).any() else b for e, b in enumerate(books[p])]
    codes = np.stack([near(p).argmin(1) for p in range(parts)], 1)
    error = sum(near(p).min(1) for p in range(parts))
    return [(r[0], r[2], "".join(f"{c:02x}" for c in code), int(e)) for r, code, e in zip(rows, codes, error)], books


@pytest.mark.parametrize(("parts", "entries", "rounds", "chunk", "block"), [(16, 64, 2, 128, 16), (4, 5, 3, 8192, 64), (64, 256, 1, 50, 7), (1, 3, 2, 100, 1)])
def test_codes_equal_plain_rounds(table, vectors, parts, entries, rounds, chunk, block):
    codes, books = vector_codes.compressed(vector_codes.kept(table), parts, entries, rounds, chunk, block)
    want, plain = plain_codes(integers(vectors), parts, entries, rounds)
    assert books.tolist() == plain.tolist()
    assert sorted([tuple(r) for r in codes.collect()], key=repr) == sorted(want, key=repr)


def test_short_vectors_are_filled_up(spark):
    rows = [(2, [0.5, 0.25, 1.0], 1), (1, [0.1], None), (3, [], 1), (4, [9.0] * 5, None)]
    codes, books = vector_codes.compressed(vector_codes.kept(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")), 2, 3, 1)
    want, plain = plain_codes([(i, np.floor(np.array(e) * 256).astype(np.int64), la) for i, e, la in rows], 2, 3, 1)
    assert books.tolist() == plain.tolist() and sorted([tuple(r) for r in codes.collect()], key=repr) == sorted(want, key=repr)


def test_codes_report_and_its_sql(spark, small, table, vectors):
    rows = vector_codes.report(table).collect()
    want, books = plain_codes(integers(vectors), 16, 64, 2)
    by_label = defaultdict(int)
    for _, label, _, e in want:
        by_label[label] += e
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    assert sorted(map(tuple, rows), key=repr) == sorted([(i, code, e, by_label[label], digest) for i, label, code, e in want], key=repr)
    assert vector_codes.report(table.limit(0)).collect() == []
    duckdb_rows(spark, small, "op13_vector_codes")


def test_codes_are_read_back(table, vectors):
    codes, books = vector_codes.compressed(vector_codes.kept(table))
    originals = {i: v for i, v, _ in integers(vectors) if i is not None and i < 500 and i != 7}
    for r in vector_codes.decoded(codes, books).filter("vec_id < 500 AND vec_id <> 7").collect():
        assert ((np.array(r["approximation"]) - originals[r["vec_id"]]) ** 2).sum() == r["error"]


def test_the_curve_visits_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(1 << 10, step=1 << 8)] * 3), -1).reshape(-1, 3) // 256
    x = np.concatenate([grid, grid])  # ties have one place
    place = vector_codes.curve(x)
    assert np.array_equal(place[: len(grid)], place[len(grid) :]) and len(set(place.tolist())) == len(grid)
    steps = np.abs(np.diff(grid[np.argsort(vector_codes.curve(grid))], axis=0)).sum(1)
    assert (steps == 1).all()


def test_boxes_keep_the_nearest_entries():
    rnd = np.random.default_rng(2)
    x, entries = rnd.integers(-50, 50, (40, 1, 4)) + rnd.integers(-5, 5, (40, 8, 4)), rnd.integers(-50, 50, (30, 4))
    listed = vector_codes.shortlists(x.min(1), x.max(1), entries)
    d = ((x[:, :, None] - entries) ** 2).sum(3)
    for b in range(40):
        assert listed[b][np.unique(np.nonzero(d[b] == d[b].min(1, keepdims=True))[1])].all()
    assert listed.mean() < 0.5
