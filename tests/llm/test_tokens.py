"""Token store, packing: exact round trips against the library's own ids."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from beamgrid.llm import packing, token_store
from beamgrid.llm.tokens import Encoder, default_tokenizer

ROWS = [(3, "Ab cd, ef!", "x"), (1, None, "y"), (2, "", "z"), (7, "two  spaces \n and\ttabs " * 30, "x"), (5, "word " * 5000 + "end", None), (None, "no key", "a"), (3, "Ab cd, ef!", "x"), (3, "other text é ß", "q"), (9, "<|endoftext|> x", "b")]
SCHEMA = "doc_id long, text string, shard string"


def own():
    t = Tokenizer.from_file(default_tokenizer())
    return lambda x: [*t.encode(x or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab ÄZ0.,'!\n\t ½é_-")), max_size=60), max_size=12))
def test_encoder_equals_library(texts):
    ids = own()
    got = Encoder(default_tokenizer(), cache_words=3)(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [ids(t) for t in texts]


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_perfect_hash(n):
    keys = np.random.default_rng(n).permutation(10 * n + 1)[:n].astype(np.int64) - 5
    table = token_store.PerfectHash.build(keys)
    assert sorted(table.find(keys)) == list(range(n))
    strange = np.arange(10**6, 10**6 + 500)
    assert (table.find(strange) == -1).mean() > 0.99


def test_store_round_trip(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    store, manifest = token_store.TokenStore.write(docs, f"file://{tmp_path}/s")
    ids = own()
    rows = store.get(docs).join(token_store.shard_starts(manifest), "shard").collect()
    got = sorted(((r.doc_key, r.shard_start + r.first_id, np.frombuffer(r.ids, "<u4").tolist()) for r in rows), key=lambda r: r[1])
    assert [g[0] for g in got] == sorted(token_store.NULL_KEY if k is None else k for k, *_ in ROWS)
    assert sorted((g[0], g[2]) for g in got) == sorted((token_store.NULL_KEY if k is None else k, ids(t)) for k, t, _ in ROWS)
    at = 0
    for _, start, own_ids in got:
        assert start == at
        at += len(own_ids)
    assert store.get(spark.createDataFrame([(4,), (5,)], "doc_id long")).count() == 1
    empty, _ = token_store.TokenStore.write(docs.limit(0), f"file://{tmp_path}/e")
    assert empty.get(docs).count() == 0


def test_pack(spark):
    ids = own()
    rows = packing.pack(spark.createDataFrame(ROWS, SCHEMA), length=16).collect()
    whole = {}
    for r in rows:
        assert r.length & (r.length - 1) == 0 and r.length <= 16 and r.offset == 0 and len(r.ids) == 4 * r.length
        whole.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    for k, t, _ in ROWS:
        pieces = sorted(whole[k, len(ids(t))])
        copies = sum((a, b) == (k, t) for a, b, _ in ROWS)
        assert [x for _, p in pieces[::copies] for x in p] == ids(t)
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    order = sorted(rows, key=lambda r: r.sequence_id)
    assert [r.length for r in order] == sorted((r.length for r in rows), reverse=True)
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame(ROWS, SCHEMA), length=12)


def test_queries(spark):
    d = "/root/testdata/sf0.001"
    ids = own()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    start = {}
    at = 0
    for k in sorted(docs):
        start[k] = at
        at += len(ids(docs[k]))
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_store.query(spark, d).collect()}
    assert got == {k: (start[k], len(ids(t)), crc(ids(t))) for k, t in docs.items()}
    for r in packing.query(spark, d).collect():
        assert crc(ids(docs[r.doc_id])[r.start : r.start + r.length]) == r.ids_crc32


def test_encoder_long_text_and_other_kinds(monkeypatch):
    """Texts beyond a block, pieces beyond the table's keys, a table that fills up, a tokenizer that can't be cut."""
    import random

    import public_tokenizers

    from beamgrid.llm import tokens

    monkeypatch.setattr(tokens, "BLOCK", 300)
    rng, ids = random.Random(3), own()
    parts = [*"ab ÄZ0.,'!\n\t ½é_-\x0b\u00a0\u3000中|<>", "<|endoftext|>", " the", "'s", "x" * 30, "à "]
    texts = ["".join(rng.choices(parts, k=n)) for n in (5, 0, 4000, 60, 9000, 1)] + [None, "z" * 5000]
    e = Encoder(default_tokenizer(), cache_words=40)
    for _ in range(3):
        assert [np.frombuffer(g, "<u4").tolist() for g in e(texts)] == [ids(t) for t in texts]
        assert [np.frombuffer(g, "<u4").tolist() for g in e(texts, None)] == [ids(t)[:-1] for t in texts]
    path = public_tokenizers.path("word_bpe_49k.json")
    other, whole = Encoder(path), Tokenizer.from_file(path)
    assert not other.cuttable
    assert [np.frombuffer(g, "<u4").tolist() for g in other(texts, 7)] == [[*whole.encode(t or "", add_special_tokens=False).ids, 7] for t in texts]
