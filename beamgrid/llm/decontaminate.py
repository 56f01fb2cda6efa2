"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle similarity.

Words are runs of letters, digits and underscores, lower-cased. For each item of L words every window of L words of a
document is compared, one for each word. A window has a 64-bit SimHash of its words, weighted by how rare they are
among the items. The items' fingerprints are in four tables, one for each 16-bit block, under every value within three
bits of their own; a window looks its four blocks up and visits these buckets only, which by the
pigeonhole finds every item within 15 bits. Pairs within 15 bits are confirmed exactly: the weighted similarity of
the five-word shingles (a shingle's weight is how often it occurs: sum of minima over sum of maxima) must be 0.75 or
more. Windows of which so few words occur in any item that they can't reach it are passed over before hashing; that
loses nothing. A window may reach over an end of its document by up to a quarter of its words.

The benchmark is dealt to parts of about part_bytes and written to the shared folder; a task gathers GATHERED bytes of texts, then
reads one part after another and makes its tables, so neither the driver nor a task ever holds the whole, and a part is
made once for that many texts. A task keeps a benchmark of one part. Words are counted over all items, and a word's signs
follow from the word alone, so the parts change no result.

Defined cases: null and empty texts have no leak; items that are null, empty or without words match nothing; items of
fewer than five words match equal word sequences; equal items are all reported; of several windows the best counts, then
the first. An empty benchmark or table gives no leak. Other columns are kept as they are.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, materialize, read, scratch_path

WORD = re.compile(r"\w+")
RADIUS, K = 15, 5
LEAKS = "array<struct<item_id:long,start_word:int,n_words:int,similarity:double>>"
_NOISE = 4096
#: Bytes of texts that a task searches with one part of the benchmark before it makes the next.
GATHERED = 64 << 20
#: All values of a block that differ from another in three bits at most.
_BLOCKS, _ERRORS = 4, RADIUS // 4
_MASKS = np.flatnonzero(np.bitwise_count(np.arange(1 << 16, dtype=np.uint16)) <= _ERRORS).astype(np.uint16)
_PAIRS = 1 << 22


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Place of a pair of neighbouring words in a table of fixed size; pairs that share one only let more windows through."""
    return (a * 2654435761 + b * 40503 + (b >> 3) * 97) & (_PAIRS - 1)


def _shingles(ids: list) -> Counter:
    return Counter(tuple(ids[i : i + K]) for i in range(max(1, len(ids) - K + 1))) if ids else Counter()


def _signs(words: list[str]) -> np.ndarray:
    """64 signs for each word, from a hash of it."""
    data = b"".join(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest() for w in words)
    return np.unpackbits(np.frombuffer(data, np.uint8)).reshape(-1, 64).astype(np.float32) * 2 - 1


class Index:
    """Items of a benchmark, by their number of words.

    spread: in how many items each word is, of n_items in all; counted over these items where it is not given.
    """

    def __init__(self, items: list[tuple[int, str | None]], spread: dict[str, int] | None = None, n_items: int | None = None):
        split = [(i, WORD.findall((t or "").lower())) for i, t in items]
        split = [(i, w) for i, w in split if w]
        spread = Counter(x for _, w in split for x in set(w)) if spread is None else spread
        n_items = len(split) if n_items is None else n_items
        self.vocabulary = {w: k for k, w in enumerate(sorted({x for _, w in split for x in w}), 1)}
        signs = np.concatenate([np.zeros((1, 64), np.float32), _signs(list(self.vocabulary)), _signs([f"noise {k}" for k in range(_NOISE)])])
        weight = np.ones(len(signs), np.float32)
        weight[1 : len(self.vocabulary) + 1] = [1 + np.log(max(1.0, n_items / spread[w])) for w in self.vocabulary]
        self.signs = signs * weight[:, None]
        self.signs[0] = 0
        self.groups = {}
        by_size: dict[int, list] = {}
        for i, w in split:
            by_size.setdefault(len(w), []).append((i, [self.vocabulary[x] for x in w]))
        for size, own in by_size.items():
            prints = self.fingerprints(np.array([ids for _, ids in own]))
            self.groups[size] = ([i for i, _ in own], [_shingles(ids) for _, ids in own], prints, [self._table(b) for b in prints.view(np.uint16).reshape(-1, _BLOCKS).T])
        self.pairs = np.zeros(_PAIRS, bool)
        for own in by_size.values():
            for _, ids in own:
                self.pairs[_pair(np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64))] = True
        self.pad = max(by_size, default=0) // 4 + 2

    @staticmethod
    def _table(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sorted values, item of each) of all values near the items' values of one block."""
        values = (block[:, None] ^ _MASKS).ravel()
        order = np.argsort(values, kind="stable")
        return values[order], (order // len(_MASKS)).astype(np.int32)

    @staticmethod
    def _near(tables: list[tuple[np.ndarray, np.ndarray]], prints: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all pairs within the radius, by the buckets of the windows' blocks."""
        rows, items = [], []
        for (values, item), block in zip(tables, windows.view(np.uint16).reshape(-1, _BLOCKS).T, strict=True):
            low, high = np.searchsorted(values, block, "left"), np.searchsorted(values, block, "right")
            n = high - low
            row = np.repeat(np.arange(len(block)), n)
            own = item[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(len(row))]
            within = np.bitwise_count(prints[own] ^ windows[row]) <= RADIUS
            rows.append(row[within])
            items.append(own[within])
        pairs = np.unique(np.concatenate(rows) * len(prints) + np.concatenate(items))
        return pairs // len(prints), pairs % len(prints)

    def fingerprints(self, windows: np.ndarray) -> np.ndarray:
        bits = self.signs[windows].sum(axis=1) > 0
        return np.packbits(bits, axis=1).view(np.uint64).ravel()

    def ids(self, text: str) -> list[int]:
        """A word's place in the vocabulary; beyond it a place among the noise."""
        get, base = self.vocabulary.get, len(self.vocabulary) + 1
        return [k if (k := get(w)) else base + zlib.crc32(w.encode()) % _NOISE for w in WORD.findall(text.lower())]

    def search(self, texts: list[str | None]) -> list[list[tuple]]:
        """(item, first word, words, similarity) of the best window for each text and item."""
        rows = [self.ids(t) if t else [] for t in texts]
        found: list[dict] = [{} for _ in rows]
        pads = [0] * self.pad
        flat = list(pads)
        begin = []
        for r in rows:
            begin.append(len(flat))
            flat += r
            flat += pads
        at, begin = np.array(flat, np.int64), np.array(begin)
        sizes = np.array([len(r) for r in rows])
        total = np.concatenate([[0], np.cumsum(self.pairs[_pair(at[:-1], at[1:])], dtype=np.int32)])
        for size, (names, sets, prints, near) in self.groups.items():
            if len(at) < size:
                continue
            if size == 1:
                starts = np.flatnonzero((at > 0) & (at <= len(self.vocabulary)))
            else:
                enough = -(-3 * (size - K + 1) // 4) + K - 2 if size >= K else size - 1
                starts = np.flatnonzero(total[size - 1 :] - total[: len(total) - size + 1] >= enough)
            for part in (starts[i : i + 512] for i in range(0, len(starts), 512)):
                windows = self.fingerprints(at[part[:, None] + np.arange(size)])
                row, item = self._near(near, prints, windows)
                for start, j in zip(part[row].tolist(), item.tolist(), strict=True):
                    doc = int(np.searchsorted(begin, start + size // 2, "right")) - 1
                    first = max(start - int(begin[doc]), 0)
                    own = rows[doc][first : max(0, min(start + size - int(begin[doc]), int(sizes[doc])))]
                    held = _shingles(own)
                    both = (held & sets[j]).total()
                    alike = both / (held.total() + sets[j].total() - both)
                    key = (names[j], j, size)
                    if alike >= 0.75 and alike > found[doc].get(key, (0, 0, 0.0))[2]:
                        found[doc][key] = (first, len(own), alike)
        return [[(k[0], *v) for k, v in sorted(f.items(), key=lambda x: (x[0][0] is None, x[0][0] or 0, x[0][1:]))] for f in found]


_index: dict[str, Index] = {}


def _load(path: str, part: int, n_items: int) -> Index:
    """The index of one part, which a worker keeps until it needs another."""
    key = f"{path} {part}"
    if key not in _index:
        import pyarrow.parquet as pq

        fs, root = filesystem(path)
        table = pq.read_table(f"{root}/part={part}", filesystem=fs, partitioning=None)
        items = list(zip(*(table.column(c).to_pylist() for c in ("item_id", "text")), strict=True))
        spread = {w: n for row in table.column("words").to_pylist() for w, n in row or ()}
        _index.clear()
        _index[key] = Index(items, spread, n_items)
    return _index[key]


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, text -> row, word: the distinct words of each item."""
    for batch in batches:
        pairs = [(r, w) for r, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for w in sorted(set(WORD.findall(t.lower())))]
        r, w = zip(*pairs, strict=True) if pairs else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(w, pa.string())], names=["row", "word"])


def leaks(benchmark: DataFrame, text: Column | str = "text", part_bytes: int = 2 << 20) -> Column:
    """For each text the items that it holds, as LEAKS. benchmark: item_id, text."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null").withColumn("row", F.monotonically_increasing_id())
    items = materialize(items, "items")
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    parts = max(1, -(-total // part_bytes))
    words = items.select("row", "text").mapInArrow(_words_of, "row long, word string")
    n_items = words.select(F.count_distinct("row")).first()[0]
    spread = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counted = words.join(spread, "word").groupBy("row").agg(F.collect_list(F.struct("word", "n")).alias("words"))
    held = items.join(counted, "row").select("item_id", "text", F.map_from_entries("words").alias("words"), F.pmod(F.xxhash64("text"), F.lit(parts)).alias("part"))
    path = scratch_path(spark, "benchmark")
    held.repartition("part").write.partitionBy("part").parquet(path)
    filled = [r[0] for r in spark.read.parquet(path).select("part").distinct().orderBy("part").collect()] if n_items else []

    def gathered(texts: list) -> list[list]:
        out: list[list] = [[] for _ in texts]
        for part in filled:
            index, held, size, first = _load(path, part, n_items), [], 0, 0
            for k, t in enumerate(texts):
                held.append(t)
                size += len(t or "")
                if size > 1 << 20 or k + 1 == len(texts):
                    for j, found in enumerate(index.search(held), first):
                        out[j] += found
                    held, size, first = [], 0, k + 1
        return [[{"item_id": a, "start_word": b, "n_words": c, "similarity": d} for a, b, c, d in sorted(x, key=lambda f: (f[0] is None, f[0] or 0, *f[1:]))] for x in out]

    @F.pandas_udf(LEAKS)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held, size = [], 0
        for texts in batches:
            held.append(texts)
            size += sum(len(t or "") for t in texts)
            if size >= GATHERED or len(filled) < 2:
                yield pd.Series(gathered([t for own in held for t in own]))
                held, size = [], 0
        if held:
            yield pd.Series(gathered([t for own in held for t in own]))

    return find(text)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return docs.filter(F.size(leaks(read(spark, sf_dir, "benchmark"))) == 0)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: every item found in every document."""
    held = read(spark, sf_dir, "documents").select("doc_id", F.explode(leaks(read(spark, sf_dir, "benchmark"))).alias("leak"))
    return held.select("doc_id", "leak.item_id", "leak.start_word", "leak.n_words", F.round("leak.similarity", 6).alias("similarity"))
