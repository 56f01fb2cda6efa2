"""Decontamination against all windows and all items."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from beamgrid.llm import decontaminate
from beamgrid.llm.decontaminate import WORD, Index, _shingles, leaks


def brute(items, text):
    """Best similarity over windows of the item's size, which may reach over the ends by a quarter."""
    w = WORD.findall((text or "").lower())
    out = {}
    for i, t in items:
        own = WORD.findall((t or "").lower())
        n = len(own)
        if not own or not w:
            continue
        best = 0
        for s in range(-(n // 4) - 1, max(1, len(w) - n + n // 4 + 2)):
            held = _shingles(w[max(s, 0) : s + n]) if s + n > 0 else Counter()
            both = (held & _shingles(own)).total()
            best = max(best, both / (held.total() + _shingles(own).total() - both))
        if best >= 0.75:
            out[i] = round(best, 9)
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([2, 4, 5, 9, 20, 40, 64])))) for k in range(25)]
    texts = []
    for _ in range(90):
        p = rng.choice(items)[1].split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            p[rng.randrange(len(p))] = "edit"
        p = p[rng.choice([0, 0, 1, 3]) :]
        a, b = (rng.choices(words + ["other"] * 40, k=rng.choice([0, 3, 50])) for _ in range(2))
        texts.append(" ".join([*a, *(x.upper() if rng.random() < 0.2 else x + "," for x in p), *b]))
    return items, texts


@pytest.mark.parametrize("seed", range(4))
def test_against_all_windows(seed):
    items, texts = corpus(seed)
    got = Index(items).search(texts)
    wanted = [brute(items, t) for t in texts]
    assert sum(map(len, wanted)) > 15
    missed = sum(len(w.keys() - {x[0] for x in g}) for g, w in zip(got, wanted, strict=True))
    for g, w in zip(got, wanted, strict=True):
        for item, _, _, alike in g:
            assert w[item] >= round(alike, 9) >= 0.75
    assert missed <= 0.03 * sum(map(len, wanted))  # beyond 15 bits nothing is promised
    exact = [(i, t) for i, t in items for x in texts if f" {' '.join(WORD.findall(t))} " in f" {' '.join(WORD.findall(x.lower()))} "]
    assert {i for i, _ in exact} <= {x[0] for g in got for x in g}


def test_radius_is_guaranteed():
    rng = random.Random(3)
    items = [(k, " ".join(rng.choices([f"w{i}" for i in range(90)], k=30))) for k in range(40)]
    index = Index(items)
    _, _, prints, near = index.groups[30]
    for _ in range(300):
        j = rng.randrange(40)
        v = int(prints[j])
        for b in rng.sample(range(64), 15):
            v ^= 1 << b
        _, found = Index._near(near, prints, np.array([v], np.uint64))
        assert j in found.tolist()


def test_column_and_cases(spark):
    rows = [(1, None), (2, ""), (3, "One two three four five six seven!"), (4, "zero one TWO three four five six seven eight"), (5, "a b"), (6, "xx a b yy"), (7, "word " * 40_000), (3, "One two three four five six seven!")]
    docs = spark.createDataFrame([(*r, "k", 0) for r in rows], "doc_id long, text string, item_id string, leaks int")
    items = [(10, "one two three four five six seven"), (10, "one two three four five six seven"), (11, "a b"), (12, None), (13, " !"), (None, "a b")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for part in (1 << 20, 8):
        out = docs.select("doc_id", leaks(bench, part_bytes=part).alias("found")).collect()
        got = sorted((r.doc_id, sorted(str(x.item_id) for x in r.found)) for r in out)
        assert got == [(1, []), (2, []), (3, ["10", "10"]), (3, ["10", "10"]), (4, ["10", "10"]), (5, ["11", "None"]), (6, ["11", "None"]), (7, [])]
    assert docs.select(F.size(leaks(bench.limit(0))).alias("n")).filter("n > 0").count() == 0
    assert docs.limit(0).select(leaks(bench)).count() == 0


def test_stage(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    bad = {r.doc_id for r in decontaminate.query(spark, d).collect()}
    held = {r.doc_id: WORD.findall(r.text.lower()) for r in docs.collect()}
    planted = {k for k, w in held.items() if any(f" {' '.join(WORD.findall(t.lower()))} " in f" {' '.join(w)} " for _, t in bench)}
    assert planted and planted <= bad and len(bad) <= 2 * len(planted)
    out = decontaminate.stage(spark, docs, d)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == held.keys() - bad


def test_query_against_all_windows(spark):
    """The query on the small tables: every pair that shares a shingle, by the best of all its windows."""
    d = "/root/testdata/sf0.01"
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    holders = {}
    for i, t in items:
        for s in _shingles(WORD.findall((t or "").lower())):
            holders.setdefault(s, set()).add(i)
    text_of, wanted = dict(items), {}
    for k, t in docs:
        near = set().union(*(holders.get(s, set()) for s in _shingles(WORD.findall((t or "").lower())))) if t else set()
        for i, alike in brute([(i, text_of[i]) for i in near], t).items():
            wanted[k, i] = alike
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.query(spark, d).collect()}
    assert len(wanted) > 20 and got.keys() <= wanted.keys()
    assert len(got) >= 0.95 * len(wanted) and all(0.75 <= got[x] <= round(wanted[x], 6) for x in got)


def test_parts_change_nothing(spark, monkeypatch):
    """Many small parts, texts gathered over several batches: the same leaks as with one part."""
    items, texts = corpus(7)
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(i, t if i % 11 else None) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(2)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = []
        for part_bytes, gathered in ((1 << 21, 64 << 20), (300, 64 << 20), (300, 2000)):
            monkeypatch.setattr(decontaminate, "GATHERED", gathered)
            found.append({r.doc_id: r.l for r in docs.select("doc_id", leaks(bench, part_bytes=part_bytes).alias("l")).collect()})
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(found[0]) == len(texts) and sum(map(len, found[0].values())) > 15
    assert found[0] == found[1] == found[2]


def test_tables_give_all_pairs_within_the_radius():
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 2**63, 40, dtype=np.uint64)
    windows = np.concatenate([rng.integers(0, 2**63, 50, dtype=np.uint64), *(np.bitwise_xor(prints, np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (n, 40)).astype(np.uint64), axis=0)) for n in (1, 8, 14, 15, 16, 17))])
    tables = [Index._table(b) for b in prints.view(np.uint16).reshape(-1, 4).T]
    row, item = Index._near(tables, prints, windows)
    wanted = np.nonzero(np.bitwise_count(windows[:, None] ^ prints[None, :]) <= decontaminate.RADIUS)
    assert sorted(zip(row.tolist(), item.tolist(), strict=True)) == sorted(zip(*(x.tolist() for x in wanted), strict=True)) and len(row) > 150
