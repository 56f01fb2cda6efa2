"""Term shares of sources against a plain form, and the pointer sort against sorted words."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from beamgrid.llm import divergence


def plain(rows, least_docs, top=50):
    docs, count, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = ["".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        docs[lang].update(set(words))
        count[lang, source].update(words)
    out = []
    for lang in {g[0] for g in groups}:
        terms = [t for t, n in docs[lang].items() if n >= least_docs]
        own = sorted(s for g, s in groups if g == lang)
        v = len(terms)

        def shares(c, terms=terms, v=v):
            total = sum(c[t] for t in terms)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * v) for t in terms}

        p = {s: shares(count[lang, s]) for s in own}
        q = shares(sum((count[lang, s] for s in own), Counter()))
        for s in own:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in terms), o) for o in own if o != s]
            more = [(q[t] - p[s][t], t) for t in terms if count[lang, s][t] and p[s][t] > q[t]]
            for part, listed in (("pair", sorted(pairs)), ("term", sorted(more, key=lambda x: (x[0], x[1].encode()))[:top])):
                out += [(lang, s, part, item, -value, i) for i, (value, item) in enumerate(listed, 1)]
    return sorted(out)


def made(seed, n):
    r = random.Random(seed)
    words = ["a", "Ab", "abcdefgh", "abcdefghi", "abcdefghij", "Straße", "日本語", "naïve", "it's", "x1y2", "ñ" * 20, "ñ" * 20 + "a", "q" * 100, *("".join(r.choices("abcdef", k=r.randint(1, 12))) for _ in range(200))]
    return [(r.choice([None, "", *[" ".join(r.choices(words, k=r.randint(1, 60))) for _ in range(6)]]), r.choice(["en", "en", "en", "de", None, ""]), r.choice(["s1", "s2", "S", "", None, "ü"])) for _ in range(n)]


@pytest.mark.parametrize(("least", "terms", "slice_bytes"), [(3, 8192, 1 << 21), (10, 7, 500)])
def test_audit(spark, monkeypatch, least, terms, slice_bytes):
    monkeypatch.setattr(divergence, "TERMS", terms)
    rows = made(1, 200) + [("only here " * 3, "xx", "alone"), ("words", "yy", "a"), (None, "yy", "b")]
    table = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    monkeypatch.setattr(divergence, "count_terms", lambda *a, f=divergence.count_terms: f(*a, slice_bytes=slice_bytes))
    assert sorted(map(tuple, divergence.audit(table, least_docs=least).collect())) == plain(rows, least)


def test_long_text_counts_once(spark):
    long = "Alpha beta gamma " * 3000 + "é" * 5000
    rows = [(long, "en", "a"), ("alpha", "en", "b"), ("z" * 9000, "en", "b")]
    table = spark.createDataFrame(rows, "text string, lang string, source string").coalesce(1)
    got = {(r.source, r.term): (r.n, r.docs) for r in divergence.count_terms(table, slice_bytes=1000).collect()}
    assert got[("a", "alpha")] == (3000, 1) and got[("b", "alpha")] == (1, 1)
    assert got[("a", "é" * 5000)] == (1, 1) and got[("b", "z" * 9000)] == (1, 1) and len(got) == 6


def test_sort_pointers():
    r = random.Random(5)
    words = [("".join(r.choices("ab", k=r.randint(1, 40)))).encode() for _ in range(3000)] + [b"a" * 8, b"a" * 9, b"a" * 16, b"a" * 17] * 3
    data = np.frombuffer(b" ".join(words), np.uint8)
    size = np.array([len(w) for w in words])
    at = np.cumsum(size + 1) - size - 1
    run, one = divergence.sort_pointers(data, at, size)
    assert len(one) == len(set(words)) and all(words[one[k]] == w for k, w in zip(run.tolist(), words, strict=True))


def test_shares_do_not_overflow(spark):
    from pyspark.sql import functions as F

    for n, total, terms in ((10**12, 3 * 10**13, 10**6), (0, 0, 3), (7, 9, 1)):
        got = spark.range(1).select(divergence._share(F.lit(n), F.lit(total), F.lit(terms))).first()[0]
        assert got == 1 + 10**9 * (n + 5) // (total + 5 * terms)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "text string, lang string, source string, term string, n long, part int, value int")
    assert divergence.audit(empty).collect() == []
    clash = spark.createDataFrame([("word", "en", "a", 1, 2), ("word", "en", "b", 1, 2)], "text string, lang string, source string, n long, term int")
    assert sorted(map(tuple, divergence.audit(clash, least_docs=1).select("source", "item", "value").collect())) == [("a", "b", 0), ("b", "a", 0)]
