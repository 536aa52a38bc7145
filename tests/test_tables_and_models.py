"""Versioned tables, rare combinations, exact sweeps and regressions against plain Python."""

from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from forgeline.operators import modelling, quality
from forgeline.sources import versioned
from forgeline.sources.scratch import shared_dir


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_readers_of_an_old_version_finish(spark):
    path = shared_dir(spark, "versioned")
    first = [(f"k{i}", i, "a") for i in range(200)] + [(None, 1, "x"), (None, 1, "x")]
    schema = "k string, v int, s string"
    versioned.create(spark.createDataFrame(first, schema), path, ["k"], 16)
    old = versioned.read(spark, path)
    new = [("k3", 30, "b"), ("k3", 31, None), ("k500", 5, "b"), (None, 2, "y")]
    written = versioned.upsert(spark.createDataFrame(new, schema), path, ["k"], "v")
    touched = {r[0] for r in spark.createDataFrame(new, schema).select(versioned.bucket_of(["k"], 16)).collect()}
    assert set(written) == touched and len(touched) <= 3  # the other buckets' files stay as they are
    want = [r for r in first if r[0] != "k3"] + [("k3", 31, None), ("k500", 5, "b"), (None, 2, "y")]
    assert rows_of(versioned.read(spark, path)) == sorted(want, key=repr)
    assert rows_of(old) == sorted(first, key=repr) == rows_of(versioned.read(spark, path, 1))
    kept = {r["bucket"]: r["folder"] for r in versioned.manifest(spark, path, 1)}
    assert all(r["folder"] == kept[r["bucket"]] for r in versioned.manifest(spark, path, 2) if r["bucket"] not in touched and r["bucket"] is not None)
    versioned.refresh(spark.createDataFrame(new[:1], schema), path, ["k"])
    assert rows_of(versioned.read(spark, path)) == [("k3", 30, "b")] and rows_of(old) == sorted(first, key=repr)
    assert versioned.expire(spark, path, 1) == 2
    assert rows_of(versioned.read(spark, path)) == [("k3", 30, "b")]
    with pytest.raises(ValueError, match="no version 9"):
        versioned.read(spark, path, 9)


def test_versioned_table_without_rows(spark):
    path, empty = shared_dir(spark, "versioned"), spark.createDataFrame([], "k string, v int")
    versioned.create(empty, path, ["k"])
    assert versioned.upsert(empty, path, ["k"]) == [] and versioned.read(spark, path).collect() == []
    versioned.upsert(spark.createDataFrame([("a", 1)], "k string, v int"), path, ["k"])
    assert rows_of(versioned.read(spark, path)) == [("a", 1)]


def test_an_upsert_without_its_manifest_is_not_seen(spark, monkeypatch):
    path, schema = shared_dir(spark, "versioned"), "k string, v int"
    versioned.create(spark.createDataFrame([("a", 1)], schema), path, ["k"])
    monkeypatch.setattr(versioned, "MANIFEST", "wrong int")  # the writer is lost after the data, before the manifest
    with pytest.raises(Exception):  # noqa: B017
        versioned._put(spark.createDataFrame([("a", 2)], schema), path, ["k"], 16, 2, [])
    monkeypatch.undo()
    assert rows_of(versioned.read(spark, path)) == [("a", 1)]


@pytest.mark.parametrize(("k", "most"), [(1, None), (2, None), (4, 2), (100, None)])
def test_minimal_identifying_combinations(spark, k, most):
    rnd = random.Random(4)
    names = ["a", "b", "c", "d"]
    rows = [(rnd.choice(["x", "y", None]), rnd.choice([1, 2, 3, 4]), rnd.choice("pqrs"), rnd.choice([None, True])) for _ in range(60)]
    df = spark.createDataFrame(rows, "a string, b int, c string, d boolean")
    want, rare = [], set()
    for size in range(1, (most or 4) + 1):
        for at in combinations(range(4), size):
            for key, n in Counter(tuple(r[i] for i in at) for r in rows).items():
                if n < k:
                    if not any((sub, tuple(key[at.index(i)] for i in sub)) in rare for s in range(1, size) for sub in combinations(at, s)):
                        want.append(("+".join(names[i] for i in at), size, *[key[at.index(i)] if i in at else None for i in range(4)], n))
                    rare.add((at, key))
    assert rows_of(quality.minimal_identifying(df, names, k, most)) == sorted(want, key=repr)
    assert quality.minimal_identifying(df.limit(0), names, k, most).collect() == []


def test_exact_sweep_with_ties(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice([0, 0, 1]), rnd.choice([0.0, -0.0, 0.5, 0.5 + 2**-53, 1e-300, -3.0, rnd.random()])) for _ in range(400)] + [(1, None), (0, None)]
    df = spark.createDataFrame(rows, "label int, score double").repartition(4)
    known = [(y, s) for y, s in rows if s is not None]
    positives = sum(y for y, _ in known)
    got = {r["threshold"]: (r["above"], r["precision"], r["recall"]) for r in modelling.thresholds(df).collect()}
    assert set(got) == {s for _, s in known}
    for t, found in got.items():
        above = [y for y, s in known if s >= t]
        assert found == (len(above), sum(above) / len(above), sum(above) / positives)
    pairs = [(a > b) + (a == b) / 2 for y, a in known if y for z, b in known if not z]
    assert modelling.area_under_curve(df).first()["auc"] == pytest.approx(sum(pairs) / len(pairs), abs=1e-12)
    best = max((r, t) for t, (_, p, r) in got.items() if p >= 0.4)
    assert tuple(modelling.recall_at(df, 0.4).first()) == best
    assert modelling.area_under_curve(df.filter("label = 1")).first()["auc"] is None
    assert modelling.thresholds(df.limit(0)).collect() == []


def test_regression_from_moments(spark):
    rnd = np.random.default_rng(7)
    x = rnd.normal(0, 1, (300, 3)) * [1, 100, 0.01]
    y = 5 + x @ [2.0, -0.5, 30.0] + rnd.normal(0, 0.1, 300)
    df = spark.createDataFrame([(*map(float, r), float(v), i % 3) for i, (r, v) in enumerate(zip(x, y))], "a double, b double, c double, y double, part int").repartition(3)
    found = modelling.moments(df, {"y": (F.col("part") > 0, F.col("y"), [F.col(c) for c in "abc"]), "a": (F.lit(True), F.col("a"), [F.col("b")])})
    use = np.arange(300) % 3 > 0
    assert modelling.least_squares(found["y"]) == pytest.approx(np.linalg.lstsq(np.c_[np.ones(200), x[use]], y[use], rcond=None)[0].tolist(), rel=1e-6)
    assert found["a"][0, 0] == 300
    assert modelling.least_squares(np.zeros((4, 4))).tolist() == [0, 0, 0]  # no rows


def test_imputation_takes_what_fits(spark):
    rnd = random.Random(8)
    rows = [(i, "A", float(i), (x := rnd.uniform(0, 9)), 3 * x + 1, "train" if i < 300 else "test") for i in range(400)]
    df = spark.createDataFrame(rows, "line_id long, machine_id string, h double, u double, v double, split_set string").withColumn("observed_at", F.timestamp_seconds(F.col("h") * 3600))
    errors = modelling.imputation_errors(df, ["u", "v"])
    assert {r["column_name"]: r["method"] for r in modelling.best_imputation(errors).collect()} == {"u": "regression", "v": "regression"}
    assert max(r["rmse"] for r in errors.filter("method = 'regression'").collect()) < 1e-6


def test_classifier_on_features_made_once(spark):
    from pyspark.ml import Pipeline

    df = spark.createDataFrame([(float(i % 7), None if i % 5 == 0 else float(i), i % 3 == 0) for i in range(60)], "a double, b double, y boolean").withColumn("label", F.col("y").cast("int"))
    once = Pipeline(stages=modelling.prepared(["a", "b"])).fit(df).transform(df).select("label", "features")
    each = [[r["score"] for r in modelling.scored(modelling.classifier("logistic", rows, columns), rows).collect()] for rows, columns in ((df, ["a", "b"]), (once, None))]
    assert each[0] == pytest.approx(each[1])
