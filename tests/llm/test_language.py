"""Language identification: n-grams against a plain count, held-out accuracy, defined cases."""

import random
import zlib
from collections import Counter

import pytest

from beamgrid.llm import language
from beamgrid.llm.language import NOT_LETTERS, Profiles, grams, ranked


def plain(text):
    c = Counter()
    for w in NOT_LETTERS.sub(" ", text.lower()).split():
        w = f" {w} "
        for n in (1, 2, 3):
            for i in range(len(w) - n + 1):
                g = w[i : i + n]
                if g.strip() and " " not in g[1:-1]:
                    c[g] += 1
    return c


def key(g):
    return sum(ord(x) << 21 * (len(g) - 1 - i) for i, x in enumerate(g))


@pytest.mark.parametrize("text", ["Hello, wörld! a", "x", "", "1 2 !", "the cat and the dog " * 50, "ÉÈ é  b\n\nc_d"])
def test_grams(text, monkeypatch):
    wanted = plain(text)
    got = dict(zip(*(x.tolist() for x in grams(text)), strict=True))
    assert got == {key(g): n for g, n in wanted.items()}
    order = sorted(wanted, key=lambda g: (-wanted[g], key(g)))[:7]
    assert ranked(*grams(text), 7).tolist() == [key(g) for g in order]


def test_distance_by_hand():
    a, b = [key("a"), key("b"), key("c")], [key("c"), key("a"), key("z")]
    p = Profiles({"x": a, "y": b}, size=3)
    own = ranked(*grams("a"), 3).tolist()  # " a", " a ", "a", "a " tie: by value
    want = [sum(abs(r.index(g) - i) if g in r else 3 for i, g in enumerate(own)) / 9 for r in (a, b)]
    assert p.distances("a").tolist() == pytest.approx(want)
    assert p.predict(None) == p.predict("12 !") == ("und", 0.0)
    assert Profiles({}).predict("word") == ("und", 0.0)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = language.query(spark, d).collect()
    assert {r.doc_id for r in rows} == lang.keys() and len(rows) == len(lang)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.95


def test_cases_and_stage(spark):
    rng = random.Random(1)
    syllables = {"aa": ["ka", "ro", "ti"], "bb": ["schu", "berg", "ein"]}
    rows = [(i, " ".join("".join(rng.choices(syllables[x], k=2)) for _ in range(40)), x, "s", 5, 1.5) for i in range(30) for x in ("aa", "bb")]
    rows = [(2 * i + (r[2] == "bb"), *r[1:]) for i, r in enumerate(rows)]
    odd = [(900, None, "aa", "s", 0, 1.5), (901, "", "bb", None, 0, 1.5), (902, "123 !?", None, "s", 0, 1.5), (903, "karo", None, "s", 0, 1.5), (None, "schuberg ein", "bb", "s", 0, 1.5), (904, "ei" + "n" * 10 + " schu" * 400_000, None, "s", 0, 1.5), (904, "ein berg", None, "s", 0, 1.5)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string, n_chars int, score double")
    out = language.identify(docs, language.train(docs)).collect()
    got = {(r.doc_id, None if r.text is None else len(r.text)): r.lang_pred for r in out}
    assert len(out) == len(rows) + len(odd)
    assert [got[k, None if k == 900 else len(dict((a, b) for a, b, *_ in odd)[k] or "")] for k in (900, 901, 902, 903)] == ["und", "und", "und", "aa"]
    assert got[None, 12] == got[904, 8] == "bb" and all(r.lang_pred == "bb" for r in out if r.doc_id == 904)
    assert all(r.lang_pred == r.lang for r in out if r.doc_id is not None and r.doc_id < 900)
    kept = language.stage(spark, docs, "")
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in rows + odd} - {900, 901, 902}
    assert language.stage(spark, docs.limit(0), "").count() == 0


@pytest.mark.parametrize("text", ["½ ²", "Ⅷ ①", "٣٤ _", "🙂 —"])
def test_no_letter(text):
    assert not any(c.isalpha() for c in text)
    assert Profiles({"x": [key("a")], "y": [key("b")]}).predict(text) == ("und", 0.0)


def test_long_text_is_counted_whole(monkeypatch):
    rng = random.Random(2)
    text = " ".join("".join(rng.choices("abcdé½", k=rng.randint(1, 30))) for _ in range(300))
    whole = [x.tolist() for x in grams(text)]
    for size in (1, 7, 100):
        monkeypatch.setattr(language, "SLICE", size)
        assert [x.tolist() for x in grams(text)] == whole


def test_query_against_plain_form(spark):
    """Every prediction and score, from profiles counted with dictionaries."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    counts = {}
    for r in docs:
        if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            counts.setdefault(r.lang, {})
            for g, n in plain(r.text).items():
                counts[r.lang][g] = counts[r.lang].get(g, 0) + n
    top = lambda c: [g for g in sorted(c, key=lambda g: (-c[g], key(g)))[: language.SIZE]]
    place = {x: {g: i for i, g in enumerate(top(c))} for x, c in sorted(counts.items())}
    got = {r.doc_id: r for r in language.query(spark, d).collect()}
    for r in docs:
        own = top(plain(r.text or ""))
        if not own:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        far = {x: sum(abs(p[g] - i) if g in p else language.SIZE for i, g in enumerate(own)) / language.SIZE / len(own) for x, p in place.items()}
        best = min(far, key=far.get)
        assert got[r.doc_id].lang_pred == best
        mean = sum(far.values()) / len(far)
        assert got[r.doc_id].score == pytest.approx(0.0 if far[best] >= 1 else min(1.0, max(0.0, 2 * (1 - far[best] / mean))), abs=1e-9)


def test_clashing_names(spark):
    rows = [(1, "the cat", "aa", "x", 0.5, 1, 2), (2, "12", "aa", "y", 0.25, 3, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double, d int, found int")
    out = language.identify(docs, language.train(docs))
    assert out.columns == ["doc_id", "text", "lang", "d", "found", "lang_pred", "score"] and {(r.d, r.found) for r in out.collect()} == {(1, 2), (3, 4)}
    kept = language.stage(spark, docs, "").collect()
    assert [tuple(r) for r in kept] in ([rows[0]], [])
