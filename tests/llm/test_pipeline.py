"""The pipeline: its stages' decisions, each on its own input, and the registered queries."""

import numpy as np
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from beamgrid.llm.decontaminate import WORD
from beamgrid.llm.tokens import default_tokenizer

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, held = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        held[name] = docs.collect()
        assert name == "pack" or docs.columns == columns
    ids = {k: [r.doc_id for r in v] for k, v in held.items()}
    for a, b in [("language", "line_dedup"), ("line_dedup", "near_dup"), ("near_dup", "decontaminate"), ("decontaminate", "pack")]:
        assert set(ids[b]) <= set(ids[a])
        assert b == "pack" or len(ids[b]) == len(set(ids[b]))
    texts = {r.doc_id: r.text for r in held["decontaminate"]}
    assert 50 < len(texts) < len(ids["line_dedup"]) and set(ids["pack"]) == set(texts)
    bench = [" ".join(WORD.findall(r.text.lower())) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(f" {b} " in f" {' '.join(WORD.findall(t.lower()))} " for t in texts.values() for b in bench)
    own = Tokenizer.from_file(default_tokenizer())
    whole = {}
    for r in held["pack"]:
        whole.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    for k, t in texts.items():
        assert [x for _, p in sorted(whole[k]) for x in p] == [*own.encode(t, add_special_tokens=False).ids, 0]


def test_run_equals_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    key = ["doc_id", "start", "length", "ids"]
    assert sorted(map(tuple, out.select(*key).collect())) == sorted(map(tuple, docs.select(*key).collect()))


def test_registered():
    names = __spark_entry__.queries()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14)) and "pipeline" in names
    assert __spark_entry__.oracle_sql().keys() <= names.keys()
