"""Audit of how the sources of a language differ in their use of terms.

Each task sorts pointers, not terms: the starts of the words of a slice of texts are pointers into the Arrow buffer, and a
multikey quicksort orders them eight bytes at a time, going on only with equal runs that hold longer words. A run of equal
pointers is a term; the documents along it give its document frequency and its counts by source at once. Slices end
between documents, and Spark adds up what they give.

A term is kept in a language if at least `least_docs` of its documents have it. Every group (language, source) and every
language then has a smoothed share of each kept term, p = 1 + floor(10**9 (n + 5) / (N + 5 V)), in whole numbers throughout.

Defined cases: null text, language and source are the empty string; rows that repeat a doc_id are documents of their own, and
no other column is read; groups without a kept term have p from N = 0; a language without kept terms has distance 0
between its sources; an empty table gives no row. Ties go to the smaller item in UTF-8 order. A text longer than a slice is
cut between words, and its terms are remembered so that each counts as one document. Exact while a language has fewer than
9 * 10**13 occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read, sent

#: Bytes of text whose words are sorted together.
SLICE = 1 << 21
#: Kept terms of a language whose shares are compared in one group.
TERMS = 8192
_BYTE = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)
_WORD = (_BYTE >= 128) | ((_LOWER >= 97) & (_LOWER <= 122))
_KEEP = np.array([0, *((0xFFFFFFFFFFFFFFFF << 8 * (8 - k)) & 0xFFFFFFFFFFFFFFFF for k in range(1, 9))], np.uint64)


def _first(sorted_values: np.ndarray) -> np.ndarray:
    """True where a value differs from the one before it."""
    out = np.ones(len(sorted_values), bool)
    out[1:] = sorted_values[1:] != sorted_values[:-1]
    return out


def sort_pointers(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of its run for each pointer, a pointer's place in `at` for each run); runs in no particular order.

    data: bytes, at: where the words start, size: their lengths in bytes. Words hold no byte 0.
    """
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), ">u8", padded, 0, (1,))

    def chunk(of: np.ndarray, depth: int) -> np.ndarray:
        left = np.clip(size[of] - depth, 0, 8)
        return eight[np.minimum(at[of] + depth, len(data))].astype(np.uint64) & _KEEP[left]

    key = chunk(np.arange(len(at)), 0)
    order = np.argsort(key)
    first = _first(key[order])
    run = np.empty(len(at), np.int64)
    run[order] = np.cumsum(first) - 1
    runs, depth = int(first.sum()), 8
    left = np.flatnonzero(size > depth)
    # runs that hold a longer word go on with the next eight bytes; a word that ended sorts first
    if len(left):
        long = np.zeros(runs, bool)
        long[run[left]] = True
        left = np.flatnonzero(long[run])
    while len(left):
        own, key = run[left], chunk(left, depth)
        order = np.lexsort((key, own))
        left, own, key = left[order], own[order], key[order]
        old = _first(own)
        new = _first(key) & ~old
        # the first part of a run keeps its number, the others get new ones
        number = own.copy()
        fresh = np.cumsum(new)
        since = np.maximum.accumulate(np.where(old, fresh, 0))
        moved = fresh > since
        number[moved] = runs - 1 + fresh[moved]
        run[left] = number
        runs += int(fresh[-1])
        depth += 8
        part = np.cumsum(old | new) - 1
        go_on = np.maximum.reduceat(size[left], np.flatnonzero(old | new)) > depth
        alone = np.bincount(part) == 1
        left = left[(go_on & ~alone)[part]]
    one = np.empty(runs, np.int64)
    one[run] = np.arange(len(at))
    return run, one


def _words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of the words of texts that begin at `starts`."""
    word = np.concatenate([[False], _WORD[data], [False]])
    apart = np.zeros(len(data) + 1, bool)
    apart[starts] = True
    begin = word[1:] & (~word[:-1] | apart)
    end = word[:-1] & (~word[1:] | apart)
    at = np.flatnonzero(begin)
    return at, np.flatnonzero(end) - at


def _terms(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> pa.Array:
    """The words as strings."""
    ends = np.cumsum(size)
    gathered = data[np.repeat(at - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(gathered)]).cast(pa.string())


def _count(data: np.ndarray, starts: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(group, term, occurrences, documents) of texts whose groups are given."""
    data = _LOWER[data]
    at, size = _words(data, starts)
    if not len(at):
        return np.zeros(0, np.int64), pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    run, one = sort_pointers(data, at, size)
    # documents in the order of their groups, so that one more sort gives runs by term, group and document
    by_group = np.argsort(group, kind="stable")
    place = np.empty(len(group), np.int64)
    place[by_group] = np.arange(len(group))
    doc = np.repeat(place, np.diff(np.append(np.searchsorted(at, starts), len(at))))
    both = np.sort((run << 32) | doc)
    doc_first = np.flatnonzero(_first(both))
    held = both[doc_first]
    run_of, group_of = held >> 32, group[by_group][held & 0xFFFFFFFF]
    first = np.flatnonzero(_first(run_of) | _first(group_of))
    occurrences = np.diff(np.append(doc_first, len(both)))
    chosen = one[run_of[first]]
    return group_of[first], _terms(data, at[chosen], size[chosen]), np.add.reduceat(occurrences, first), np.diff(np.append(first, len(held)))


def count_terms(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", slice_bytes: int = SLICE) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, sources = (batch.column(k).dictionary_encode() for k in (0, 1))
            kinds = len(sources.dictionary) or 1
            group = langs.indices.to_numpy().astype(np.int64) * kinds + sources.indices.to_numpy()

            def shown(of, term, n, documents, langs=langs, sources=sources, kinds=kinds):
                names = [langs.dictionary.take(pa.array(of // kinds)), sources.dictionary.take(pa.array(of % kinds)), term]
                return pa.RecordBatch.from_arrays([x.cast(pa.string()) for x in names] + [pa.array(n, pa.int64()), pa.array(documents, pa.int64())], names=["lang", "source", "term", "n", "docs"])

            texts = batch.column(2).cast(pa.large_string())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            i = 0
            while i < len(texts):
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + slice_bytes, "right")) - 1)
                own = data[offsets[i] : offsets[j]]
                if len(own) <= 2 * slice_bytes:
                    yield shown(*_count(own, offsets[i:j] - offsets[i], group[i:j]))
                else:
                    for of, term, n in _long(own, slice_bytes):
                        k = len(term)
                        yield shown(np.full(k, group[i]), term, n, of)
                i = j

    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang, source, text)))
    return rows.mapInArrow(count, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _long(data: np.ndarray, slice_bytes: int) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
    """(1 where the term is new in this text, term, occurrences) for slices of one long text."""
    known: set[bytes] = set()
    a = 0
    while a < len(data):
        b = min(a + slice_bytes, len(data))
        while b < len(data) and _WORD[data[b]] and _WORD[data[b - 1]]:  # not inside a word
            more = np.flatnonzero(~_WORD[data[b : b + slice_bytes]])
            b = b + int(more[0]) if len(more) else min(b + slice_bytes, len(data))
        _, term, n, _ = _count(data[a:b], np.zeros(1, np.int64), np.zeros(1, np.int64))
        new = []
        for t in term.cast(pa.binary()).to_pylist():
            new.append(t not in known)
            known.add(t)
        yield np.array(new, np.int64), term, n
        a = b


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10**9 (n + 5) / (total + 5 terms)) by long division, so that nothing overflows; null where there is no term."""
    base = total + 5 * terms
    parts = {"a": (n + 5) * 100000, "b": F.when(base > 0, base)}
    held = F.struct(*(c.cast("long").alias(k) for k, c in parts.items()))
    return F.transform(F.array(held), lambda s: 1 + F.call_function("div", s["a"], s["b"]) * 10000 + F.call_function("div", (s["a"] % s["b"]) * 10000, s["b"]))[0]


def _distances(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: sums of the differences of shares of every two sources of a language, over all kept terms.

    Terms are dealt into groups of bounded size, each with all sources of its language; a source without the term has the
    share of no occurrence there. The result has a row for each two sources, so their number is taken to be far smaller
    than that of terms; a group compares one source at a time with blocks of terms.
    """
    parts = F.greatest(F.lit(1), F.ceil(F.col("terms") / TERMS)).cast("int")
    left = shares.select("lang", F.pmod(F.xxhash64("term"), parts).cast("int").alias("part"), "term", "source", "p")
    right = groups.select("lang", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "source", "base")

    def compare(key: tuple, terms: pa.Table, own: pa.Table) -> pa.Table:
        own = own.sort_by("source")
        names = own["source"].combine_chunks()
        base = own["base"].fill_null(0).to_numpy()
        out = np.zeros((len(base), len(base)), np.int64)
        row = terms["term"].combine_chunks().dictionary_encode().indices.to_numpy()
        col = pc.index_in(terms["source"].combine_chunks(), value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)
        p = terms["p"].to_numpy()
        order = np.argsort(row, kind="stable")
        row, col, p = row[order], col[order], p[order]
        count = int(row[-1]) + 1 if len(row) else 0
        block = max(1, (1 << 20) // max(1, len(base)))
        for a in range(0, count, block):
            b = min(a + block, count)
            i, j = np.searchsorted(row, (a, b))
            dense = np.tile(base, (b - a, 1))
            dense[row[i:j] - a, col[i:j]] = p[i:j]
            for k in range(len(base)):
                out[k] += np.abs(dense - dense[:, k : k + 1]).sum(axis=0)
        x, y = np.nonzero(~np.eye(len(base), dtype=bool))
        return pa.table({"lang": pa.array([key[0].as_py()] * len(x), pa.string()), "source": names.take(pa.array(x)), "item": names.take(pa.array(y)), "value": pa.array(out[x, y])})

    found = left.groupBy("lang", "part").cogroup(right.groupBy("lang", "part")).applyInArrow(compare, "lang string, source string, item string, value long")
    return found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank.

    pair: every other source of the language by the distance to it; term: the kept terms that the source has a larger share of
    than its language, by that difference, the first `top`.
    """
    term = Window.partitionBy("lang", "term")
    counted = count_terms(docs, text, lang, source)
    marked = counted.withColumns({"in_docs": F.sum("docs").over(term), "n_lang": F.sum("n").over(term), "first": F.row_number().over(term.orderBy("source")) == 1})
    kept = materialize(marked.filter(F.col("in_docs") >= least_docs).select("lang", "source", "term", "n", "n_lang", "first"), "kept_terms")
    every = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source")))).distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    whole = kept.groupBy("lang").agg(F.sum("n").alias("total_lang"), F.sum(F.col("first").cast("long")).alias("terms"))
    groups = every.join(own, ["lang", "source"], "left").join(whole, "lang", "left").na.fill(0, ["total", "total_lang", "terms"])
    groups = sent(groups.withColumn("base", _share(F.lit(0), F.col("total"), F.col("terms"))))
    shares = kept.join(groups, ["lang", "source"]).withColumns({"p": _share(F.col("n"), F.col("total"), F.col("terms")), "q": _share(F.col("n_lang"), F.col("total_lang"), F.col("terms"))})
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    pairs = _distances(shares, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(terms)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: the sources of documents."""
    return audit(read(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT id, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
a AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS n_lang FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
t AS (SELECT lang, source, sum(n) AS n FROM a GROUP BY ALL),
p AS (SELECT a.lang, a.source, a.term, a.n, 1 + (1000000000::HUGEINT * (a.n + 5)) // (t.n + 5 * v.v) AS p, 1 + (1000000000::HUGEINT * (a.n_lang + 5)) // (v.n + 5 * v.v) AS q FROM a JOIN t USING (lang, source) JOIN v USING (lang)),
s AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(z.f, 0) AS BIGINT) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN (SELECT m.lang, m.source AS a, o.source AS b, sum(abs(m.p - o.p)) AS f FROM p m JOIN p o ON m.lang = o.lang AND m.term = o.term AND m.source <> o.source GROUP BY ALL) z ON z.lang = x.lang AND z.a = x.source AND z.b = y.source
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM s)
SELECT * FROM r WHERE part = 'pair' OR rank <= 50
"""
