"""Line dedup against a plain restatement of its rule, and its defined cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from beamgrid.llm import line_dedup

SCHEMA = "doc_id long, text string, lines_deleted string, n_chars long, pos int"


def cut(text):
    return [x for x in re.split(r"(?<=\n)|(?<=[.!?] )|(?<= )(?=[A-ZÄÖÜÉ][a-zäöüßé ])", text) if x]


def sentence(rng, n):
    w = ["".join(rng.choices("abcdeé", k=rng.randint(4, 8))) for _ in range(n)]
    return " ".join(w).capitalize() + "."


def run(spark, rows, **more):
    docs = spark.createDataFrame([(*r, "x", 5, 1) for r in rows], SCHEMA)
    out = line_dedup.dedup(docs.drop("lines_deleted"), **more).collect()
    return {(r.doc_id, r.lines_deleted): r.text for r in out}, out


def test_cut_keeps_text(spark):
    texts = ["", "a", "\n\n a. B c! D", "x. y. Zé  Ü a\nÖ", "end \n", "A b C d. E"]
    out = spark.createDataFrame([(t,) for t in texts], "text string").select("text", line_dedup._lines(F.col("text")).alias("l")).collect()
    for r in out:
        assert "".join(r.l) == r.text
        assert [x for x in r.l if x] == cut(r.text)


@pytest.mark.parametrize("seed", range(3))
def test_planted_passages(spark, seed):
    rng = random.Random(seed)
    shapes = [[60], [30, 30], [7] * 8, [3, 40, 9], [1, 12, 12, 12, 12, 4], [19, 19, 19]]
    passages = [" ".join(sentence(rng, n) for n in shape) for shape in shapes]
    rows, places = [], {}
    for k in range(40):
        parts = [" ".join(sentence(rng, rng.randint(2, 15)) for _ in range(rng.randint(1, 6))) for _ in range(2)]
        p = rng.randrange(len(passages))
        sep = rng.choice(["\n", " "])
        # in the middle of a line the words around may be lower case
        text = parts[0].rstrip(".") + sep + passages[p] + sep + parts[1].lower()
        rows.append((k, text))
        places.setdefault(p, []).append(k)
    out = {k: t for (k, _), t in run(spark, rows)[0].items()}
    for p, ks in places.items():
        assert passages[p] in out[min(ks)]
        for k in ks[1:]:
            assert passages[p] not in out[k]
            rest = dict(rows)[k].replace(passages[p], "")
            assert re.sub(r"\s+", "", out[k]) == re.sub(r"\s+", "", rest)
    for k in (min(ks) for ks in places.values()):
        assert out[k] == dict(rows)[k]


def test_cases(spark):
    rng = random.Random(9)
    long = " ".join(sentence(rng, 9) for _ in range(6))
    short = sentence(rng, 12)
    header = f"{short}\n"
    rows = [(1, long), (2, f"{header}{long}"), (3, header + sentence(rng, 30)), (4, None), (5, ""), (None, long), (6, f"{long}\n{sentence(rng, 8)}\n{long}"), (7, f"{short}\n" * 600), (8, sentence(rng, 300)), (9, "x y z " * 20_000)]
    out, held = run(spark, rows)
    assert {k for k, _ in out} == {r[0] for r in rows} and len(held) == len(rows)
    assert out[1, 0] == long and out[3, 0] == dict(rows)[3] and out[4, 0] is None and out[5, 0] == "" and out[8, 0] == dict(rows)[8]
    assert out[2, 6] == header and out[None, 6] == "" and out[9, 0] == dict(rows)[9]
    assert [t.strip().count(".") for (k, n), t in out.items() if k == 6] == [1]
    assert out[7, 599] == header  # the rest repeats the run from its own start
    twice, _ = run(spark, [(1, long), (1, long), (2, long), (2, long)])
    assert twice == {(1, 0): long, (2, 6): ""}
    assert run(spark, [])[1] == []


def test_stage_and_plan(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = line_dedup.stage(spark, docs, d)
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    before = {r.doc_id: r for r in docs.collect()}
    assert 0 < len(got) <= len(before)
    for k, r in got.items():
        assert r.text == before[k].text or r.n_chars == len(r.text) < len(before[k].text)
    plan = out._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    # no run of 50 words is left whole in two places, lines taken as the operator cuts them
    lines = [x.strip() for r in got.values() for x in cut(r.text) if len(x.split()) >= 50]
    assert len(lines) == len(set(lines))


def words(rng, n):
    return ["".join(rng.choices("abcdeéklmnrst", k=rng.randint(2, 10))) for _ in range(n)]


def test_lines_seen_apart_before(spark):
    rng = random.Random(4)
    lines = [sentence(rng, 25) for _ in range(8)]
    apart = "\n".join(f"{sentence(rng, 6)}\n{x}" for x in lines)
    passage = "\n".join(lines) + "\n"
    one, two = sentence(rng, 50), sentence(rng, 50)
    out, _ = run(spark, [(1, apart), (2, f"{one}\n{passage}"), (3, f"{two}\n{passage}")])
    got = {k: t for (k, _), t in out.items()}
    assert got[1] == apart and got[2] == f"{one}\n{passage}" and got[3] == f"{two}\n"
    # each place of a passage, where it runs on longer than before: the last short line goes with it
    a, b, c = sentence(rng, 30), sentence(rng, 30), sentence(rng, 5)
    out, _ = run(spark, [(1, f"{a}\n{b}\n{one}"), (2, f"{a}\n{b}\n{c}\n{two}"), (3, f"{two[::-1]}\n{a}\n{b}\n{c}\n")])
    assert [t for (k, _), t in out.items() if k == 3] == [f"{two[::-1]}\n"]


@pytest.mark.parametrize("join", [" ", "\t", " | ", "|", "\u3000", "  "])
def test_passage_inside_a_line(spark, join):
    rng = random.Random(5)
    passage = words(rng, 90)
    rows = [(k, join.join(words(rng, 30) + passage + words(rng, 30))) for k in range(3)]
    got = {k: t for (k, _), t in run(spark, rows)[0].items()}
    assert got[0] == rows[0][1]
    for k in (1, 2):
        own = rows[k][1].split(join)
        left = re.findall(r"[^\s|]+", got[k])
        assert left[:30] == own[:30] and left[-30:] == own[-30:]
        assert len(left) <= 60 + 20  # some words at each end stay


def test_unspaced_script(spark):
    rng = random.Random(6)
    for low, high in ((0x4E00, 0x5200), (0x0E01, 0x0E45)):
        han = lambda n: "".join(chr(rng.randint(low, high)) for _ in range(n))
        passage = "".join(han(9) + rng.choice("的了เ、") for _ in range(60))
        rows = [(k, han(50) + passage + han(50)) for k in range(2)]
        got = {k: t for (k, _), t in run(spark, rows)[0].items()}
        assert got[0] == rows[0][1] and 100 <= len(got[1]) < 300


def test_against_every_run(spark):
    rng = random.Random(7)
    pool = [" ".join(words(rng, rng.randint(1, 9))) + ".\n" for _ in range(12)]
    rows = []
    for k in range(25):
        parts = [" ".join(words(rng, 12)) + ".\n", *(x for a in rng.sample(range(12), 4) for x in pool[a : a + rng.randint(1, 9)])]
        rows.append((k, "".join(parts)))
    table = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", line_dedup._pieces(F.col("text")).alias("p")).orderBy("doc_id").collect()
    seen, wanted = set(), {}
    for r in table:
        w, gone = [len(x.split()) for x in r.p], set()
        for i in range(len(w)):
            for j in range(i + 1, len(w) + 1):
                if sum(w[i:j]) >= 40:
                    run_ = tuple(x.strip() for x in r.p[i:j])
                    gone |= set(range(i, j)) if run_ in seen else set()
                    seen.add(run_)
        wanted[r.doc_id] = "".join(x for i, x in enumerate(r.p) if i not in gone)
    assert {k: t for (k, _), t in run(spark, rows)[0].items()} == wanted
    assert sum(wanted[k] != t for k, t in rows) > 5


def test_repeats_first_seen_in_other_pairs(spark):
    """The places of a passage's parts lie in different documents; the whole run stands in one of them only."""
    rng = random.Random(8)
    a, b, c, d, e = (sentence(rng, 12) + "\n" for _ in range(5))
    pad = [sentence(rng, 20) + "\n" for _ in range(6)]
    rows = [(k + 1, pad[k] + x) for k, x in enumerate([a + b, b + c, c + d, d + e, a + b + c + d + e, a + b + c + d + e])]
    got = {k: t for (k, _), t in run(spark, rows)[0].items()}
    assert got == dict(rows) | {6: pad[5]}


def test_nulls_apart_and_clashing_names(spark):
    rng = random.Random(10)
    long, other = (" ".join(sentence(rng, 9) for _ in range(6)) for _ in range(2))
    rows = [(None, long, 1, "p", 2, 3, 4), (None, other, 5, "q", 6, 7, 8), (None, f"{other} {long}", 9, "r", 10, 11, 12), (1, long, 13, None, 14, 15, 16)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id int, tag string, d int, lines_deleted int, hit int")
    out = line_dedup.dedup(docs)
    assert out.columns == [*(c for c in docs.columns if c != "lines_deleted"), "lines_deleted"]
    got = {r["_id"]: r for r in out.collect()}
    assert {k: (r.tag, r.d, r.hit) for k, r in got.items()} == {r[2]: (r[3], r[4], r[6]) for r in rows}
    assert got[13].text == long and got[1].text == ""  # a null doc_id comes after 1
    assert [got[k].lines_deleted for k in (13, 1)] == [0, 6] and {got[5].text, got[9].text.strip()} >= {""}
    kept = line_dedup.stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert {r["_id"]: r.lines_deleted for r in kept.collect()}.items() <= {r[2]: r[5] for r in rows}.items()


def test_very_long_text(spark):
    rng = random.Random(11)
    parts = [" ".join(words(rng, 50)) + ".\n" for _ in range(60)]
    mixed = "".join(x + sentence(rng, 11) + "\n" for x in rng.sample(parts, 60))
    big = "".join(" ".join(words(rng, 13)) + ".\n" for _ in range(20_000))
    got = {k: t for (k, _), t in run(spark, [(1, "".join(parts)), (2, mixed + big), (3, big + mixed)])[0].items()}
    assert not any(x in got[2] for x in parts) and got[2].endswith(big)
    assert len(got[3]) < 200


def test_runs_are_hashed_only_around_matches(spark, monkeypatch):
    rng = random.Random(12)
    parts = [" ".join(words(rng, 50)) + ".\n" for _ in range(120)]
    alone = {k: "".join(parts[10 * k : 10 * k + 10]) for k in range(10)}
    both = {10: parts[100] + parts[101] + parts[102], 11: "".join(parts[103:110]) + parts[101] + "".join(parts[110:120])}
    made, write = {}, line_dedup.materialize
    monkeypatch.setattr(line_dedup, "materialize", lambda df, name: made.setdefault(name, write(df, name)))
    got = {k: t for (k, _), t in run(spark, sorted((alone | both).items()))[0].items()}
    assert got == alone | both | {11: both[11].replace(parts[101], "")}
    # a row a selected fingerprint, without hashes of runs; these are made of documents that share one, next to it
    assert made["fingerprints"].columns == ["doc", "chosen", "print"]
    runs = made["runs"].groupBy("id").count().collect()
    assert {r.id for r in runs} == {10, 11}
    assert sum(r["count"] for r in runs if r.id == 11) < 60


@pytest.mark.parametrize("extra", ["", "\t", "\r\n", "|", "\x85", "\xa0", "  ", "\x0b", "\f", " ", "’", "　", "的", "é", "\n", "෿", "\x00"])
def test_odd_characters(spark, extra):
    odd = re.search("  |[\t|\r\x0b\f\x85\xa0฀-￿]", f"ab {extra} c".replace(" ", "") if extra != "  " else extra)
    text = f"ab{extra}c d\nE" if extra != "  " else "ab  c"
    row = spark.createDataFrame([(text,)], "body string").select(line_dedup._odd(F.col("body")).alias("x")).first()
    assert row.x == bool(odd)
