"""Packing by local search: ids against the library's, the rules of sequences, and the number of sequences."""

import itertools
import random

import numpy as np
import pytest
from beamgrid.llm import best_fit
from beamgrid.llm.tokens import default_tokenizer


def check(out, docs, length):
    """All rules that a packing keeps; returns the number of its sequences and the fewest there could be."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_tokenizer())
    ids = sorted(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes() for _, t in docs)
    rows = sorted(out, key=lambda r: (r.doc_id is None, r.doc_id, r.piece))
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, len(r.ids) // 4))
    for placed in bins.values():
        placed.sort()
        assert [o for o, _ in placed] == [0, *itertools.accumulate(n for _, n in placed)][:-1]
        assert sum(n for _, n in placed) <= length
    if len({k for k, _ in docs}) == len(docs):
        whole = {}
        for r in rows:
            assert r.start == len(whole.get(r.doc_id, b"")) // 4 and (r.piece == 0 or len(r.ids) == 4 * length)
            whole[r.doc_id] = whole.get(r.doc_id, b"") + bytes(r.ids)
        assert sorted(whole.values()) == ids
    return len(bins), -(-sum(len(i) for i in ids) // (4 * length))


def texts(seed, n):
    r = random.Random(seed)
    return ["", None, *(" ".join(r.choices(["alpha", "beta", "gamma,", "Delta.", "naïve", "9"], k=int(r.lognormvariate(3.5, 1.2)) + 1)) for _ in range(n))]


@pytest.mark.parametrize(("length", "parts", "block"), [(64, 5, 4), (128, 1, 4096), (2048, 3, 4096)])
def test_rules_and_count(spark, monkeypatch, length, parts, block):
    monkeypatch.setattr(best_fit, "BLOCK_BINS", block)
    docs = list(enumerate(texts(1, 400)))
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    found, least = check(best_fit.pack(table, length=length, carried=8, fan_in=2).collect(), docs, length)
    assert found <= least * 1.01 + 1


def test_exact_lengths_long_texts_and_repeats(spark):
    docs = [(1, "a " * 31 + "a"), (2, "a " * 62 + "a"), (3, "a " * 5000), (3, "a"), (None, "a"), (None, None), (None, "a")]
    table = spark.createDataFrame([(*d, "x", 9) for d in docs], "doc_id long, text string, ids string, part int")
    out = best_fit.pack(table, length=32).collect()
    check(out, docs, 32)
    assert sum(r.doc_id is None for r in out) == 3
    assert best_fit.pack(table.limit(0), length=32).collect() == []


def fewest(lengths, cap):
    """Exact number of bins of a few pieces."""
    best = len(lengths)

    def place(i, fills):
        nonlocal best
        if len(fills) >= best:
            return
        if i == len(lengths):
            best = len(fills)
            return
        for k in {f: j for j, f in enumerate(fills) if f + lengths[i] <= cap}.values():
            place(i + 1, [f + lengths[i] if j == k else f for j, f in enumerate(fills)])
        place(i + 1, [*fills, lengths[i]])

    place(0, [])
    return best


def test_search_against_all_packings():
    r = random.Random(2)
    off = 0
    for _ in range(150):
        lengths = [r.randint(1, 20) for _ in range(r.randint(1, 11))]
        bins = best_fit.pack_lengths(np.array(lengths), 20)
        assert (np.bincount(bins, lengths) <= 20).all() and sorted(set(bins.tolist())) == list(range(bins.max() + 1))
        off += int(bins.max()) + 1 - fewest(sorted(lengths, reverse=True), 20)
    assert off <= 2


def test_search_raises_squared_fill_and_saves_bins():
    r = random.Random(3)
    for low, high in ((500, 1100), (300, 700)):
        search = best_fit.Search([r.randint(low, high) for _ in range(3000)], 2048)
        bins, squares = len(search.fill), sum(f * f for f in search.fill)
        search.improve()
        assert sum(f * f for f in search.fill) > squares and sum(f > 0 for f in search.fill) < bins
        assert sorted(p for b in search.held for own in b.values() for p in own) == list(range(3000))
