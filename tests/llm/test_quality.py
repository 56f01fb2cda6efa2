"""Quality scores: held-out accuracy and order, the parts against plain forms, defined cases."""

import zlib

import numpy as np
import pytest

from beamgrid.llm import quality


def test_held_out(spark):
    d = "/root/testdata/sf0.01"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = quality.query(spark, d).collect()
    assert len(rows) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [(r.score, label[r.doc_id]) for r in rows if r.held_out and r.doc_id in label]
    good, bad = ([s for s, y in held if y == k] for k in (1, 0))
    order = np.mean([(a > b) + (a == b) / 2 for a in good for b in bad])
    assert order > 0.93
    assert np.mean([(s >= 0.5) == y for s, y in held]) > 0.93


def test_isotonic():
    rng = np.random.default_rng(5)
    x = np.arange(30.0)
    y, n = rng.random(30), rng.integers(1, 9, 30).astype(float)
    cx, cy = quality.isotonic(x, y, n)
    assert (np.diff(cy) > 0).all() and (np.diff(cx) > 0).all()
    for i in range(30):  # min-max formula of isotonic regression
        want = max(min(np.average(y[a : b + 1], weights=n[a : b + 1]) for b in range(i, 30)) for a in range(i + 1))
        assert np.isclose(cy, want).any()


def test_features_approximate_the_kernel():
    rng = np.random.default_rng(2)
    m = quality.Model(np.zeros(4), np.ones(4), features=4000, gamma=0.15)
    z = rng.normal(size=(6, 4))
    f = m.features(z)[:, :4000]
    near = np.exp(-((z[:, None] - z[None]) ** 2).sum(-1) * (0.15 * 2 * 4 / 4) / 2)
    assert np.abs(f @ f.T - near).max() < 0.08


@pytest.mark.parametrize("labelled", [True, False])
def test_cases(spark, labelled):
    rows = [(i, "Good plain words in a line. " * 9 if i % 2 else "BAD!! #$% BAD!! " * 9, 1, "x") for i in range(60)]
    rows += [(100, None, 1, "x"), (101, "", 1, "x"), (None, "no id", 1, "x"), (102, "long " * 100_000, 1, "x"), (102, "twice", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int, y string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60) if labelled] + [(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    stats = quality.table(docs)
    out = quality.score(stats, quality.train(stats, labels)).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    if labelled:
        assert all(r.predicted == r.doc_id % 2 for r in out if r.doc_id is not None and r.doc_id < 60)
    else:
        assert {r.score for r in out} == {0.5}
    empty = quality.table(docs.limit(0))
    assert quality.score(empty, quality.train(empty, labels)).count() == 0


def test_query_against_plain_form(spark):
    """Every score, from sums over all rows at once."""
    from pyspark.sql import functions as F

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(quality.FOLDS))).collect()
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    stats = np.array([quality.statistics(r.text) for r in docs])
    learn = np.array([r.doc_id in label and zlib.crc32(str(r.doc_id).encode()) % 3 != 1 for r in docs])
    y = np.array([float(label.get(r.doc_id, 0)) for r in docs])[learn]
    fold = np.array([r.fold for r in docs])[learn]
    model = quality.Model(stats[learn].mean(axis=0), np.maximum(stats[learn].std(axis=0), 1e-6))
    z = model.features(stats[learn])
    amount = 1e-2 * max(1.0, np.trace(z.T @ z) / (z.shape[1] + 1))
    solve = lambda own: np.linalg.solve(z[own].T @ z[own] + amount * np.eye(z.shape[1]), z[own].T @ y[own])
    raw = np.zeros(len(y))
    for k in range(quality.FOLDS):
        raw[fold == k] = z[fold == k] @ solve(fold != k)
    at = np.clip(((raw + 1) / 3 * quality.BINS).astype(int), 0, quality.BINS - 1)
    bins = np.unique(at)
    model.weights = solve(np.ones(len(y), bool))
    model.x, model.y = quality.isotonic(*(np.array([f(at == b) for b in bins]) for f in (lambda m: raw[m].mean(), lambda m: y[m].mean(), lambda m: float(m.sum()))))
    wanted = dict(zip((r.doc_id for r in docs), np.clip(model.score(stats), 0, 1), strict=True))
    got = {r.doc_id: r.score for r in quality.query(spark, d).collect()}
    assert got.keys() == wanted.keys()
    assert max(abs(got[k] - wanted[k]) for k in got) < 1e-6
