"""Spelling variants against plain forms: every pair of words compared, every text counted."""

import random
import re
import zlib
from collections import Counter

import pytest
from beamgrid.llm import spelling

LETTERS = "abcdefghijklmnopqrstuvwxyzàéñöüß×÷ÿ"


def one_apart(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def made_words(seed: int, roots: int) -> list[str]:
    r = random.Random(seed)
    out = set()
    for _ in range(roots):
        w = "".join(r.choices(LETTERS if r.random() < 0.3 else "abc", k=r.randint(6, 14)))
        out.add(w)
        for _ in range(r.randint(0, 5)):
            i, c = r.randrange(len(w) + 1), r.choice(LETTERS)
            out.add(r.choice([w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w[:i] + w[i + 1 :]]))
    return sorted(w for w in out if len(w) >= 6)


@pytest.mark.parametrize("most_words", [32768, 3])
def test_all_near_pairs(spark, most_words):
    words = made_words(1, 150)
    table = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long")
    got = {(r.word, r.near, r.near_n) for r in spelling.near_words(table, most_words=most_words).collect()}
    assert got == {(a, b, j) for a in words for j, b in enumerate(words) if one_apart(a, b)}


def test_index_in_blocks(monkeypatch):
    words = made_words(2, 60)
    import pyarrow as pa

    rows = [(k, w, i) for k in (0, 1, 2) for i, w in enumerate(words)]
    table = pa.table({"kind": [r[0] for r in rows], "word": [r[1] for r in rows], "n": [r[2] for r in rows]})
    want = {(a, b) for a in words for b in words if one_apart(a, b)}
    for block, searches in ((1 << 18, 1 << 14), (100, 7), (1, 1)):
        monkeypatch.setattr(spelling, "BLOCK", block)
        monkeypatch.setattr(spelling, "SEARCHES", searches)
        out = spelling._search_shard(table)
        assert set(zip(out["word"].to_pylist(), out["near"].to_pylist(), strict=True)) == want


def test_index_of_repeats_and_long_words():
    words = [b"aaaaaa", b"aaaaaaa", b"aaaaaab", b"baaaaaa", b"a" * 5000, b"a" * 4999 + b"b", b"a" * 2000 + b"c" + b"a" * 3000]
    index = spelling.Index(words)
    found = set()
    for right in (True, False):
        x, y = index.search(words, right)
        found |= set(zip(x.tolist(), y.tolist(), strict=True))
    named = [w.decode() for w in words]
    assert found == {(i, j) for i, a in enumerate(named) for j, b in enumerate(named) if one_apart(a, b)}


def counted(rows: list[tuple], least_length: int = 6) -> Counter:
    out: Counter = Counter()
    for key, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in w)
            h = zlib.crc32(f"{key}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least_length:
                out[w] += 1
    return out


def test_counts(spark, monkeypatch):
    r = random.Random(3)
    words = [*made_words(4, 80), "Straße", "ÉCOLES", "naïveté", "ab", "Übermaß", "x" * 300, "word’s", "日本語", "a_b-c9defghij"]
    rows = [(i % 40, " ".join(r.choices(words, k=r.randint(0, 300)))) for i in range(80)] + [(7, None), (8, ""), (9, "é" * 70), (10, "abcdefg " * 200000)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x.word: x.n for x in spelling.count_words(table).collect()}
    assert got == counted(rows)


def test_long_text_in_parts(monkeypatch):
    monkeypatch.setattr(spelling, "PART", 50)
    pattern = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){6,}")
    text = ("Wörter andere " * 40 + "x" * 200 + " éééééé,éééééé " * 9).encode()
    assert spelling._words(text, pattern) == Counter(pattern.findall(text.lower()))


def test_forms_and_roots(spark):
    n = {"receive": 1000, "recieve": 3, "receives": 200, "receivez": 40, "receivezz": 8, "abcdef": 10, "abcdeg": 10, "abcdex": 2, "zzzzzz": 5}
    out = {r.word: r for r in spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long")).collect()}
    assert set(out) == set(n)
    assert (out["receivezz"].form, out["receivezz"].root) == ("receivez", "receive")
    assert (out["receivez"].form, out["receives"].form, out["receives"].form_n) == ("receive", "receive", 1000)
    assert out["receive"].form is None and out["receive"].root == "receive" and out["receive"].n_near == 2
    assert out["abcdef"].form is None and out["abcdef"].n_near == 2
    assert out["abcdex"].form == "abcdef"  # a tie goes to the smaller word
    assert out["zzzzzz"].n_near == 0 and out["zzzzzz"].form_n is None and out["recieve"].form is None


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, word string, n int, key int, kind int")
    assert spelling.group(empty).collect() == []
    rows = [(None, "letters letters", "x", 1, 1, 2)] * 3 + [(None, None, "x", 1, 1, 2)]
    clash = spark.createDataFrame(rows, "doc_id long, text string, word string, n int, key int, shard int")
    assert [tuple(r) for r in spelling.group(clash).collect()] == [("letters", None, "letters", 6, 0, None)]
    text_keys = spark.createDataFrame([("a/1", "letters " * 5)], "doc_id string, text string")
    assert spelling.group(text_keys, drop_one_in=0).first().n == 5
