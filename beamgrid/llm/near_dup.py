"""MinHash near-duplicates: a multi-index Hamming join of b-bit signatures, exact confirmation, components.

Method. A document's set holds its distinct five-word shingles. Documents with equal sets make a class, found by a hash
of the set, so copies cost one row each. A class has a signature of 50 symbols, 16 bits of a minimum each, in 10
chunks of 5. Two signatures that differ in at most 19 symbols have, by the pigeonhole, a chunk with at most one
error; so each chunk gives five keys, each leaving one symbol out, and all pairs under that distance meet in a
bucket (and at a similarity of 0.75 nearly all others: a pair misses all ten chunks with a chance of 0.00004).

Buckets never emit all their pairs. First every member is compared with the bucket's smallest; links are confirmed on
full shingle sets and joined into components. Where a bucket still holds several components, its members outside the
component that most of it belongs to are compared with all its members of other components, by signatures of 1024
symbols, in cells of about a thousand by a thousand, so a large bucket is dealt to many tasks; each pair is looked at
in the first bucket that it shares. A pair comes out, and is confirmed on full sets too, if its signatures differ in at
most 318 symbols (4.5 standard deviations beyond the mean at a similarity of 0.75) and if the shingles that each of the two
shares with any open member at all would be enough, which is exact and ends most comparisons of copies with many changes.

Defined cases: null or empty texts and texts without words have no shingles and link with nothing; a null doc_id is
never a component's name while another exists, else the component is null; rows that repeat a doc_id are documents of
their own. An empty table gives no row. Columns beside doc_id and text are not read. Ids are whole numbers; others need a
number of their own first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read, sent
from .graph import components
from .shingles import batches_of, mix, shingle_sets

CHUNKS, CHUNK = 10, 5
SYMBOLS = CHUNKS * CHUNK
#: Symbols of the long signatures and the most that may differ: of the first quarter, of all.
LONG, NEAR, FAR, CELL = 1024, 95, 318, 1024
_RNG = np.random.default_rng(1315423911)
_XOR = _RNG.integers(0, 2**63, SYMBOLS + LONG, dtype=np.uint64)
_ODD = _RNG.integers(0, 2**63, SYMBOLS + LONG, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_KEY = _RNG.integers(0, 2**63, (CHUNKS, CHUNK, CHUNK), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minima(sets: list[np.ndarray], functions: range) -> np.ndarray:
    """(sets, functions): mixed least value of each hash function over each set; sets must not be empty."""
    every = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), len(functions)), np.uint64)
    for k, f in enumerate(functions):
        out[:, k] = np.minimum.reduceat((every ^ _XOR[f]) * _ODD[f], starts)
    return mix(out)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """50 symbols of 16 bits for each set."""
    return (minima(sets, range(SYMBOLS)) >> np.uint64(48)).astype("<u2")


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, node (hash of the set; null without shingles), sig."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch.column(0), batch.column(1)
            for first, texts in batches_of(batch.column(2).to_pylist()):
                sets = shingle_sets(texts)
                n = np.array([len(s) for s in sets], np.int64)
                some = np.flatnonzero(n)
                node, sig = [None] * len(sets), [None] * len(sets)
                if len(some):
                    held = [sets[i] for i in some]
                    starts = np.cumsum([0, *(len(s) for s in held[:-1])])
                    sums = np.add.reduceat(mix(np.concatenate(held)), starts)
                    names = mix(sums + n[some].astype(np.uint64) * _ODD[0]).view(np.int64).tolist()
                    for i, name, s in zip(some.tolist(), names, signatures(held), strict=True):
                        node[i], sig[i] = name, s.tobytes()
                m = len(sets)
                yield pa.RecordBatch.from_arrays([ids.slice(first, m), hashes.slice(first, m), pa.array(n), pa.array(node, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "text_hash", "n_shingles", "node", "sig"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(profile, "doc_id long, text_hash long, n_shingles long, node long, sig binary")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, sig -> bucket key, slot, node: a slot for each chunk and each symbol left out."""
    for batch in batches:
        for rows in (batch.slice(i, 20_000) for i in range(0, batch.num_rows, 20_000)):
            node = rows.column(0).to_numpy()
            sig = np.frombuffer(b"".join(rows.column(1).to_pylist()), "<u2").reshape(-1, CHUNKS, CHUNK).astype(np.uint64)
            keys = np.empty((len(node), CHUNKS, CHUNK), np.uint64)
            for c in range(CHUNKS):
                for j in range(CHUNK):
                    kept = [i for i in range(CHUNK) if i != j]
                    keys[:, c, j] = mix((sig[:, c, kept] * _KEY[c, j, kept]).sum(axis=1, dtype=np.uint64) + _KEY[c, j, j])
            slots = np.tile(np.arange(SYMBOLS, dtype=np.int8), len(node))
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(slots), pa.array(np.repeat(node, SYMBOLS))], names=["key", "slot", "node"])


def _long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, text -> node, long: 1024 symbols of 8 bits."""
    for batch in batches:
        for first, texts in batches_of(batch.column(1).to_pylist()):
            sig = (minima(shingle_sets(texts), range(SYMBOLS, SYMBOLS + LONG)) >> np.uint64(56)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sig)), pa.array([r.tobytes() for r in sig], pa.binary())], names=["node", "long"])


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, text -> node, shingle: a row per distinct shingle."""
    for batch in batches:
        for first, texts in batches_of(batch.column(1).to_pylist(), 1 << 20):
            sets = shingle_sets(texts)
            nodes = np.repeat(batch.column(0).slice(first, len(sets)).to_numpy(), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.concatenate(sets).view(np.int64))], names=["node", "shingle"])


def _first_slot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The first bucket slot that each pair of signatures shares."""
    wrong = (x != y).reshape(-1, CHUNKS, CHUNK)
    chunk = (wrong.sum(axis=2) <= 1).argmax(axis=1)
    return chunk * CHUNK + wrong[np.arange(len(x)), chunk].argmax(axis=1)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a cell, its stray members (role 0) first, then all members (role 1) -> pairs (a, b) that may be similar."""
    cell, stray, ready = None, [], None

    def arrays(rows):
        node, component, low = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        short = np.frombuffer(b"".join(r[5] for r in rows), "<u2").reshape(-1, SYMBOLS)
        long = np.frombuffer(b"".join(r[6] for r in rows), np.uint8).reshape(-1, LONG)
        n, common = (np.array([r[k] for r in rows], np.int64) for k in (7, 8))
        return node, component, low, np.array([r[3] for r in rows]), np.array([r[4] for r in rows]), short, long, n, common

    def compare(rows):
        node, component, low, slot, main, short, long, n_set, common = arrays(rows)
        own, own_component, _, _, _, own_short, own_long, own_n, own_common = ready
        for k in range(len(own)):
            # of two stray members the pair comes from the smaller one; the bucket's smallest has been compared before
            may = (component != own_component[k]) & ((component == main) | (own[k] < node)) & (node != low) & (own[k] != low)
            # the intersection can't be larger than what either shares with any open member
            may &= 175 * np.minimum(common, own_common[k]) >= 75 * (n_set + own_n[k])
            at = np.flatnonzero(may)
            at = at[(long[at, : LONG // 4] != own_long[k, : LONG // 4]).sum(axis=1) <= NEAR]
            at = at[(long[at] != own_long[k]).sum(axis=1) <= FAR]
            at = at[_first_slot(short[at], np.broadcast_to(own_short[k], (len(at), SYMBOLS))) == slot[at]]
            for n in node[at].tolist():
                yield (min(int(own[k]), n), max(int(own[k]), n))

    for batch in batches:
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
        rows = list(zip(*(batch.column(i).to_pylist() for i in range(4, 13)), strict=True))
        found, i = [], 0
        while i < len(rows):
            key, role = keys[i][:3], keys[i][3]
            j = i
            while j < len(rows) and keys[j] == keys[i]:
                j += 1
            if key != cell:
                cell, stray, ready = key, [], None
            if role == 0:
                stray += rows[i:j]
            elif stray:
                ready = ready or arrays(stray)
                found += compare(rows[i:j])
            i = j
        a, b = zip(*found, strict=True) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, chunk, role, b, text in that order -> the pairs that are similar; a centre's text comes before its members'."""
    centre, own = None, None
    for batch in batches:
        a, role, b = (batch.column(i).to_numpy() for i in (0, 2, 3))
        found = []
        for first, texts in batches_of(batch.column(4).to_pylist()):
            for i, s in enumerate(shingle_sets(texts), first):
                if role[i] == 0:
                    centre, own = a[i], s
                elif centre == a[i]:
                    if len(s) * 100 < len(own) * 75 or len(own) * 100 < len(s) * 75:
                        continue
                    at = np.searchsorted(own, s)
                    both = int((own[np.minimum(at, len(own) - 1)] == s).sum())
                    if 100 * both >= 75 * (len(own) + len(s) - both):
                        found.append(i)
        yield pa.RecordBatch.from_arrays([pa.array(a[found]), pa.array(b[found])], names=["a", "b"])


def confirm(pairs: DataFrame, texts: DataFrame, members: int = 256) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets have 100 * intersection >= 75 * union; texts: node, text.

    A centre with many partners is dealt to several groups of about `members` of them, each with the centre's text.
    """
    n = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    # sent to all tasks where it is small, so that a hot centre's pairs stay where they are; else written, so that they can be split
    dealt = materialize(pairs.join(sent(n), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / members)).cast("int").alias("chunk")), "dealt")
    member = dealt.join(texts.withColumnRenamed("node", "b"), "b").select("a", "chunk", F.lit(1).alias("role"), "b", "text")
    centre = dealt.select("a", "chunk").distinct().join(texts.withColumnRenamed("node", "a"), "a").select("a", "chunk", F.lit(0).alias("role"), F.col("a").alias("b"), "text")
    rows = centre.union(member).repartition("a", "chunk").sortWithinPartitions("a", "chunk", "role")
    return rows.mapInArrow(_compare, "a long, b long")


def open_pairs(buckets: DataFrame, found: DataFrame, classes: DataFrame, texts: DataFrame, cell: int = CELL) -> DataFrame:
    """Pairs (a, b) of different components, near by their long signatures, in buckets that hold several components."""
    placed = buckets.filter("n > 2").join(found, "node", "left").select("key", "slot", "node", "low", F.coalesce("component", "node").alias("component"))
    share = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("m")).groupBy("key")
    share = share.agg(F.max(F.struct("m", "component")).alias("most"), F.sum("m").alias("n"), F.count(F.lit(1)).alias("components")).filter("components > 1")
    share = share.select("key", F.col("most.component").alias("main"), F.ceil((F.col("n") - F.col("most.m")) / cell).alias("rows"), F.ceil(F.col("n") / cell).alias("columns"))
    held = placed.join(sent(share), "key")
    wanted = held.select("node").distinct()
    own = materialize(texts.join(wanted, "node", "left_semi").select("node", "text"), "texts")
    alone = own.mapInArrow(_spread, "node long, shingle long").groupBy("shingle").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("m")).filter("m = 1")
    alone = alone.groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    described = classes.select("node", "sig", "n_shingles").join(own.mapInArrow(_long, "node long, long binary"), "node").join(alone, "node", "left")
    described = described.select("node", "sig", "long", "n_shingles", (F.col("n_shingles") - F.coalesce("alone", F.lit(0))).alias("common"))
    held = materialize(held, "open").join(materialize(described, "described"), "node")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    of = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    rest = ["node", "component", "low", "slot", "main", "sig", "long", "n_shingles", "common"]
    strays = held.filter("component != main").select("key", of("rows").alias("i"), every("columns").alias("j"), F.lit(0).alias("role"), *rest)
    members = held.select("key", every("rows").alias("i"), of("columns").alias("j"), F.lit(1).alias("role"), *rest)
    cells = strays.union(members).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "role")
    return cells.mapInArrow(_cells, "a long, b long")


def near_duplicates(docs: DataFrame, cell: int = CELL) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id (the smallest doc_id reachable), kept."""
    held = materialize(profiles(docs), "profiles")
    classes = held.filter("node is not null").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("one"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"))
    classes = materialize(classes.select("node", "one.doc_id", "one.text_hash", "sig", "n_shingles"), "classes")
    keys = classes.select("node", "sig").mapInArrow(_keys, "key long, slot byte, node long")
    shared = keys.groupBy("key").agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    buckets = materialize(keys.join(materialize(shared, "shared"), "key"), "buckets")  # key, slot, node, low, n
    wanted = classes.join(buckets.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "text_hash")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"), "text")
    texts = rows.join(wanted, rows["id"].eqNullSafe(wanted["doc_id"]) & (rows["hash"] == wanted["text_hash"])).select("node", "text")
    texts = materialize(texts.dropDuplicates(["node"]), "texts")

    links = materialize(confirm(buckets.filter("node != low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct(), texts), "links")
    found = materialize(components(links), "components")
    pairs = materialize(open_pairs(buckets, found, classes, texts, cell), "pairs")
    more = materialize(confirm(pairs, texts), "links")
    if more.head(1):
        found = materialize(components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)), "components")

    named = classes.join(found, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    names = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.join(names, "component").select("node", "component_id")
    out = held.join(named, "node", "left").withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "text_hash", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays; of rows equal in doc_id and text, one. All columns stay, whatever their names."""
    kept = near_duplicates(docs.select("doc_id", "text")).filter("kept").select(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("k_id"), F.col("text_hash").alias("k_hash"))
    marked = docs.select(F.struct(*docs.columns).alias("d"), F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("id"), F.xxhash64("text").alias("hash"))
    left = marked.join(kept, (F.col("id") == F.col("k_id")) & (F.col("hash") == F.col("k_hash")), "left_semi").dropDuplicates(["id", "hash"])
    return left.select(*(F.col("d")[c].alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: the component of every document."""
    return near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


#: All pairs that share a shingle, on whole tables.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh
  FROM w),
t AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS shingle FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb, count(*) AS c FROM t x JOIN t y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * c >= 75 * (na + nb - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept
FROM s JOIN m ON s.doc_id = m.a
"""
