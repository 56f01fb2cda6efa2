"""Grouping of spelling variants by search schemes in bidirectional FM-indexes.

Words are counted in the tasks and summed by Spark. Two words are near if one inserted, deleted or replaced code point
makes one of the other; then they share the first or the second half of either exactly. So the delimited vocabulary is
dealt into shards by halves: a word is indexed under the halves that near words of its length, one more or one less would look for,
and searched for under its own two. Each shard joins its words to one text, every word followed by a delimiter, and builds a
bidirectional FM-index of it: occurrence tables of the text and of its reverse, whose suffix-rank intervals move
together. A search starts at a delimiter, matches one half exactly, extends across the other with at most one error and ends
at a delimiter; all searches of a shard advance at once, a code point a step. Halves that more than `most_words` words share are
split over several shards, and are searched for in each.

A word's form is its most frequent near word, if that is at least `ratio` times as frequent; forms are followed to the root by
pointer doubling. As n grows with every step, there are no cycles, and few rounds.

Defined cases: null text has no word, a null key is written as nothing; rows that repeat a key are documents of their own, no
other column is read; ties of forms go to the smaller word in code-point order; no text or no frequent word gives no row. A
shard takes its words in blocks of about `BLOCK` code points, so memory is bounded but for a single longer word, of which it
grows with the length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read, sent

#: Code points of an index that is built at once, searches that advance together, distinct words that a task counts at once.
BLOCK, SEARCHES, COUNTED = 1 << 18, 1 << 14, 1 << 17
#: Bytes of a text whose words are listed at once.
PART = 1 << 20


def _words(text: bytes, pattern: re.Pattern) -> Counter:
    """Counts of the words of a text, lower-cased in ASCII; long texts are taken in parts that end at a space or other mark."""
    text = text.lower()
    if len(text) <= PART:
        return Counter(pattern.findall(text))
    out: Counter = Counter()
    a = 0
    while a < len(text):
        cut = _MARK.search(text, a + PART)
        b = cut.end() if cut else len(text)
        out.update(pattern.findall(text[a:b]))
        a = b
    return out


_MARK = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]")


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = 6, drop_one_in: int = 199) -> DataFrame:
    """word, n of all texts. Where drop_one_in divides the checksum of key and word, the word loses a code point (0: never)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % least_length)
        table: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(table.keys(), pa.string()), pa.array(table.values(), pa.int64())], names=["word", "n"])
            table.clear()
            return batch

        for batch in batches:
            for k, t in zip(batch.column(0), batch.column(1).cast(pa.large_binary()), strict=True):
                start = zlib.crc32(f"{k.as_py()}:".encode())
                for word, n in _words(t.as_py(), pattern).items():
                    if drop_one_in and (h := zlib.crc32(word, start)) % drop_one_in == 0:
                        letters = word.decode()
                        at = h % len(letters)
                        letters = letters[:at] + letters[at + 1 :]
                        if len(letters) < least_length:
                            continue
                    else:
                        letters = word.decode()
                    table[letters] = table.get(letters, 0) + n
                if len(table) >= COUNTED:
                    yield out()
        yield out()

    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(text).cast("string").alias("t")).filter("t IS NOT NULL")
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _rotations(text: np.ndarray) -> np.ndarray:
    """Starts of the sorted rotations of a text of codes below 256, by doubling from eight codes on."""
    n = len(text)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | np.roll(text, -k).astype(np.uint64)
    width = 8
    while True:
        order = np.argsort(key, kind="stable")
        new = np.ones(n, bool)
        new[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.uint64)
        rank[order] = (np.cumsum(new) - 1).astype(np.uint64)
        if new.all() or width > 2 * n:
            return order
        key = rank * np.uint64(n) + np.roll(rank, -(width % n))
        width *= 2


class Index:
    """A bidirectional FM-index of distinct words of code points 1 to 255, each followed by the delimiter 0."""

    def __init__(self, words: list[bytes]):
        raw = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
        used = np.flatnonzero(np.bincount(raw, minlength=256))
        self.code = np.full(256, -1, np.int64)
        self.code[used] = np.arange(len(used))
        text = self.code[raw].astype(np.uint8)
        self.start = np.cumsum(np.bincount(text, minlength=len(used))) - np.bincount(text, minlength=len(used))
        self.place = _rotations(text)
        self.word_at = np.cumsum(raw == 0)  # of a delimiter: the word behind it
        self.words = len(words)
        # ranks of each code before each place, for steps to the left (the text) and to the right (its reverse)
        self.before = [self._ranks(text, self.place, len(used)), self._ranks(text[::-1], _rotations(text[::-1]), len(used))]

    @staticmethod
    def _ranks(text: np.ndarray, place: np.ndarray, codes: int) -> np.ndarray:
        last = text[place - 1]
        out = np.zeros((len(text) + 1, codes), np.int32)
        np.cumsum(last[:, None] == np.arange(codes, dtype=np.uint8), axis=0, out=out[1:], dtype=np.int32)
        return out

    def search(self, words: list[bytes], right: bool) -> tuple[np.ndarray, np.ndarray]:
        """(number of the searched word, number of the indexed word) for all that differ by one error outside the exact half.

        right: the first half of each is matched exactly, from the delimiter before it on; else the second, from the one behind it.
        """
        ranks = self.before[1 if right else 0]
        sizes = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(w + b"\0" if right else w[::-1] + b"\0" for w in words), np.uint8)
        letters = self.code[raw]
        first = np.cumsum(sizes + 1) - sizes - 1
        exact = sizes // 2 if right else sizes - sizes // 2
        n = len(words)
        # state: word, interval in the index that is stepped, the same in the other one, length, place in the word, errors
        state = np.zeros((n, 6), np.int64)
        state[:, 0] = np.arange(n)
        state[:, 3] = ranks[-1, 0]
        found = []
        while len(state):
            word, low, other, size, at, errors = state.T
            part = ranks[low + size] - ranks[low]
            smaller = np.cumsum(part, axis=1) - part
            c = letters[first[word] + at]
            inside = at < sizes[word]
            branch = (errors == 0) & (at >= exact[word])

            def step(rows: np.ndarray, codes: np.ndarray, move: np.ndarray | int, error: int, state=state, part=part, smaller=smaller) -> np.ndarray:
                out = state[rows]
                out[:, 2] += smaller[rows, codes]
                out[:, 1] = self.start[codes] + ranks[out[:, 1], codes]
                out[:, 3] = part[rows, codes]
                out[:, 4] += move
                out[:, 5] += error
                return out

            go = np.flatnonzero(c >= 0)
            go = go[part[go, c[go]] > 0]
            nexts = [step(go, c[go], 1, 0)]
            rows = np.flatnonzero(branch)
            i, codes = np.nonzero(part[rows, 1:])
            i, codes = rows[i], codes + 1
            other_code = codes != c[i]
            i, codes = i[other_code], codes[other_code]
            nexts.append(step(i, codes, 0, 1))
            replaced = inside[i]
            nexts.append(step(i[replaced], codes[replaced], 1, 1))
            gone = state[rows[inside[rows]]]
            gone[:, 4] += 1
            gone[:, 5] += 1
            nexts.append(gone)
            state = np.concatenate(nexts)
            ended = state[:, 4] > sizes[state[:, 0]]
            done = state[ended]
            found.append(done[done[:, 5] == 1])
            state = state[~ended]
        hits = np.concatenate(found) if found else np.zeros((0, 6), np.int64)
        place = self.place[hits[:, 2 if right else 1]]
        pairs = np.unique(hits[:, 0] * self.words + self.word_at[place] % self.words) if len(hits) else np.zeros(0, np.int64)
        return pairs // self.words, pairs % self.words


def _search_shard(table: pa.Table) -> pa.Table:
    """word, near, near_n of one shard: rows of kind 0 are indexed, those of kind 1 (2) searched for to the right (left)."""
    kind = table["kind"].to_numpy()
    words = table["word"].to_pylist()
    own = {words[i]: i for i in np.flatnonzero(kind == 0)}
    n = table["n"].to_numpy()
    out: list[tuple[list[int], list[int]]] = [([], [])]
    indexed = list(own.items())
    coded = [w.encode("latin-1") for w, _ in indexed]
    ends = np.cumsum([len(w) + 1 for w in coded]) if coded else np.zeros(0, np.int64)
    a = 0
    while a < len(indexed):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + BLOCK, "right")))
        index = Index(coded[a:b])
        for direction in (1, 2):
            rows = np.flatnonzero(kind == direction)
            rows = rows[np.argsort([len(words[i]) for i in rows], kind="stable")] if len(rows) else rows
            for k in range(0, len(rows), SEARCHES):
                some = rows[k : k + SEARCHES]
                x, y = index.search([words[i].encode("latin-1") for i in some], direction == 1)
                out.append((some[x].tolist(), [indexed[a + j][1] for j in y.tolist()]))
        a = b
    x, y = ([i for part in out for i in part[k]] for k in (0, 1))
    return pa.table({"word": pa.array([words[i] for i in x], pa.string()), "near": pa.array([words[i] for i in y], pa.string()), "near_n": pa.array(n[y] if y else [], pa.int64())})


def near_words(words: DataFrame, shard_words: int = 8192, most_words: int = 32768) -> DataFrame:
    """word, near, near_n: all pairs, both ways, of words (word, n) that one code point tells apart. No word is empty."""
    size = F.length("word")

    def keys(mark: str, cut, lengths) -> list:
        return [F.xxhash64(F.lit(mark), cut(lengths(size + d))) for d in (-1, 0, 1)]

    def head(k):
        return F.substring(F.col("word"), F.lit(1), k)

    def tail(k):
        return F.substring(F.col("word"), size - k + 1, k)

    def half(m):
        return F.floor(m / 2).cast("int")

    def rest(m):
        return (m - F.floor(m / 2)).cast("int")

    first, second = keys("first", head, half), keys("second", tail, rest)
    indexed = words.select("word", "n", F.explode(F.array_distinct(F.array(*first, *second))).alias("key"))
    searched = words.select("word", "n", F.explode(F.array(F.struct(first[1].alias("key"), F.lit(1).alias("kind")), F.struct(second[1].alias("key"), F.lit(2).alias("kind")))).alias("s")).select("word", "n", "s.key", "s.kind")
    crowded = indexed.groupBy("key").count().filter(F.col("count") > most_words).select("key", F.ceil(F.col("count") / most_words).cast("int").alias("parts"))
    crowded = sent(crowded)
    indexed = indexed.join(crowded, "key", "left").select("word", "n", F.lit(0).alias("kind"), "key", F.pmod(F.xxhash64("word"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    searched = searched.join(crowded, "key", "left").select("word", "n", "kind", "key", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    shards = max(16, 4 * words.count() // shard_words)
    dealt = indexed.union(searched).select(F.pmod(F.xxhash64("key", "part"), F.lit(shards)).alias("shard"), "kind", "word", "n")
    return dealt.groupBy("shard").applyInArrow(_search_shard, "word string, near string, near_n long").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: the last form of each word that has one, by doubling the steps."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = materialize(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if not now.filter("moved").limit(1).count():
            return now.drop("moved")
        now = now.drop("moved")


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word, n)."""
    own = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best"))
    likely = F.col("best.n") * -1 >= ratio * F.col("n")
    marked = words.join(own, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(likely, F.col("best.word")).alias("form"), F.when(likely, -F.col("best.n")).alias("form_n"))
    marked = materialize(marked, "forms")
    roots = _roots(marked.filter("form IS NOT NULL"))
    return marked.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = 6, least: int = 5, ratio: int = 5, drop_one_in: int = 199) -> DataFrame:
    """The variants of all words of at least least_length code points that occur `least` times or more."""
    words = materialize(count_words(docs, key, text, least_length, drop_one_in).filter(F.col("n") >= least), "words")
    return variants(words, ratio)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: the vocabulary of documents."""
    return group(read(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE t AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
r AS (SELECT doc_id, row_number() OVER () AS row, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
c AS (SELECT doc_id, w, count(*) AS n FROM r WHERE length(w) >= 6 GROUP BY doc_id, w),
b AS (SELECT w, n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [195, unicode(x) - 64] END)) AS bytes FROM c),
h AS (SELECT w, n, xor(list_reduce([4294967295] || bytes, lambda a, y: xor(a >> 8, t[(xor(a, y) & 255) + 1])), 4294967295) AS h FROM b, t),
d AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM d WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
p AS MATERIALIZED (SELECT word, n, k, substr(word, 1, k) || substr(word, k + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS k FROM v)),
e AS (SELECT DISTINCT p.word AS a, v.word AS b FROM p JOIN v ON v.word = p.rest),
near AS (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT x.word, y.word FROM p x JOIN p y ON x.rest = y.rest AND x.k = y.k AND x.word <> y.word),
best AS (SELECT a AS word, count(*) AS n_near, arg_min(b, {'n': -v.n, 'w': b}) AS form, max(v.n) AS form_n FROM near JOIN v ON v.word = b GROUP BY a),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * v.n THEN form END AS form, CASE WHEN form_n >= 5 * v.n THEN form_n END AS form_n FROM v LEFT JOIN best USING (word)),
w AS (SELECT word, word AS here, 0 AS steps FROM f UNION ALL SELECT w.word, f.form, steps + 1 FROM w JOIN f ON f.word = w.here WHERE f.form IS NOT NULL)
SELECT f.word, f.form, z.here AS root, f.n, f.n_near, f.form_n FROM f JOIN (SELECT word, arg_max(here, steps) AS here FROM w GROUP BY word) z USING (word)
"""
