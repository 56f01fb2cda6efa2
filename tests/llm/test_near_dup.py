"""Near-duplicates against a comparison of all pairs."""

import random
import re
from fractions import Fraction

import pytest

from beamgrid.llm import near_dup
from beamgrid.llm.graph import components

SCHEMA = "doc_id long, text string, node string, n int, sig int"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and Fraction(len(sets[i] & sets[j]), len(sets[i] | sets[j])) >= Fraction(3, 4):
                root[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(sets[i]), c := low.get(find(i)) if sets[i] else r[0], r[0] == c) for i, r in enumerate(rows)), key=str)


def got(spark, rows, **more):
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs, **more).collect()), key=str)


def texts(seed, groups=12, copies=9):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    out = []
    for _ in range(groups):
        base = rng.choices(words, k=rng.choice([3, 5, 12, 60, 200]))
        for _ in range(rng.randint(1, copies)):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                t[rng.randrange(len(t))] = rng.choice(words)
            out.append(rng.choice([" ", " ", "\n "]).join(t))
    return out


@pytest.mark.parametrize(("seed", "cell"), [(1, 1024), (2, 3), (3, 1)])
def test_against_all_pairs(spark, seed, cell):
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts(seed))]
    random.Random(seed).shuffle(rows)
    assert got(spark, rows, cell=cell) == brute(rows)


def test_chain_of_copies(spark):
    """Neighbours in the chain are linked, ends are not: one component, found through other members of the buckets."""
    base = [f"t{i}" for i in range(120)]
    rows = []
    for k in range(14):
        t = list(base)
        for j in range(k):
            t[8 * j + 3] = f"new{j}"
        rows.append((100 - k, " ".join(t)))
    assert len({r[2] for r in brute(rows)}) == 1
    assert got(spark, rows, cell=2) == brute(rows)


def test_edges(spark):
    rows = [(4, None), (2, ""), (3, " \n"), (None, "a b c d e f"), (None, "lone text"), (7, "A b c d e f"), (7, "a b c d e f"), (7, "other words here"), (9, "é É"), (10, "é É"), (11, "É É"), (5, "long " * 30_000), (6, "long " * 20_000)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 3), (20, 21), (21, 22), (30, 30), (None, 4)] + [(100 + i, 101 + i) for i in range(40)]
    c = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert c == {1: 1, 2: 1, 3: 1, 9: 1, 20: 20, 21: 20, 22: 20} | {100 + i: 100 for i in range(41)}


def test_stage(spark):
    rows = [(1, "a b c d e f g", "x", 1, 2), (1, "a b c d e f g", "x", 1, 2), (2, "a b c d e f g", "x", 1, 2), (3, "", "x", 1, 2)]
    out = near_dup.stage(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(map(tuple, out.collect())) == [rows[0], rows[3]]


def test_query_on_table(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    out = sorted(map(tuple, near_dup.query(spark, d).collect()), key=str)
    assert out == brute([tuple(r) for r in docs])


def test_stage_keeps_columns_of_any_name(spark):
    rows = [(1, "a b c d e f", 1, "p", 2), (2, "a b c d e f", 3, "q", 4), (None, None, 5, "r", 6), (3, "", 7, None, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id int, hash string, _near_id int")
    out = near_dup.stage(spark, docs, "")
    assert out.columns == docs.columns
    assert {tuple(r) for r in out.collect()} == {rows[0], rows[2], rows[3]}
