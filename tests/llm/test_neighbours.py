"""Nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from beamgrid.llm import neighbours


def brute(rows, k, dim=None):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in ok:
        if q % 50 == 0:
            near = [(-(x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())), i) for i, y in ok if i != q and len(y) == len(x)]
            out[q] = [(i, -s) for s, i in sorted(near)[:k]]
    return out


def got(rows, k=5, **more):
    out = {}
    for r in sorted(neighbours.nearest(rows, F.col("vec_id") % 50 == 0, k, **more).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def same(a, b):
    assert a.keys() == b.keys()
    for q in a:
        assert [i for i, _ in a[q]] == [i for i, _ in b[q]]
        assert np.allclose([s for _, s in a[q]], [s for _, s in b[q]], rtol=0, atol=1e-12)


@pytest.mark.parametrize("dim", [1, 7, 64, 1500])
def test_bounds_hold(dim):
    rng = np.random.default_rng(dim)
    a, b = (neighbours.Block(list(range(40)), rng.standard_t(2, (40, dim)).tobytes(), dim) for _ in range(2))
    near = neighbours.product(a.q, b.q)
    assert (near == a.q.astype(np.int64) @ b.q.astype(np.int64).T).all()
    near = near * a.scale[:, None] * b.scale
    slack = a.kept[:, None] * b.lost + a.lost[:, None] * b.kept + a.lost[:, None] * b.lost
    assert (np.abs(near - a.unit @ b.unit.T) <= slack).all()


@pytest.mark.parametrize(("query_block", "block"), [(1024, 4096), (3, 17)])
def test_against_brute_force(spark, query_block, block):
    rng = np.random.default_rng(block)
    base = rng.normal(size=(30, 16))
    rows = [(i, (base[i % 30] + (i % 3) * rng.normal(size=16) * 0.2).tolist()) for i in range(400)]
    rows += [(i, [1.0] * 16) for i in range(400, 560)]  # copies: ties by id
    rows += [(600, None), (601, [0.0] * 16), (650, [float("nan")] * 16), (602, [None, *[1.0] * 15]), (None, [1.0] * 16), (700, [2.0, 1.0]), (603, [1.0, 2.0]), (750, [])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, score string, rank int")
    same(got(df, query_block=query_block, block=block), brute(rows, 5))
    assert got(df.limit(0)) == {}


def test_few_and_repeated(spark):
    rows = [(50, [1.0, 0.0]), (3, [1.0, 1.0]), (3, [0.0, -1.0]), (50, [0.5, 0.5]), (100, [1e200, 1e200]), (7, [1e-200, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = neighbours.nearest(df, F.col("vec_id") % 50 == 0).collect()
    assert all(r.query_id != r.vec_id and -1 - 1e-12 <= r.score <= 1 + 1e-12 for r in out)
    assert [r.vec_id for r in sorted(out, key=lambda r: r.rank) if r.query_id == 100] == [3, 50, 7, 50, 3]


def test_query(spark):
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").collect()]
    out = {}
    for r in sorted(neighbours.query(spark, d).collect(), key=lambda r: r.rank):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    same(out, brute(rows, 5))
