"""Language identification by rank-order profiles.

A profile is a language's most frequent character n-grams (one to three characters of lower-cased words, word ends
marked), ranked. A text's own most frequent n-grams are ranked alike, and its distance to a language is the sum of how
far each n-gram is out of place there; one that the profile lacks counts as the profile's length. The nearest language
wins. The score is 1 minus its distance over the mean of all languages' distances, doubled and held to 0..1, so it is
near 0 when the languages are equally far.

Profiles are counted over at most `texts_per_language` texts of each language on average (drawn by a hash of the key,
whole texts; the bound keeps fitting cheap), without the held-out fold. The counts are combined in Spark; only the
ranked n-grams, at most `size` for each language, reach the driver.

Defined cases: a text that is null or has no letter is `und` with score 0; languages tied in distance: the first in
alphabetical order; n-grams tied in frequency: by code point. Without any labelled text all texts are `und`. Columns
beside doc_id, text and lang are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held_out, read, sent

#: Candidates for word ends: digits, marks, white space, and a few characters that count as words but not as letters.
NOT_LETTERS = re.compile(r"[\W\d_]+")
SIZE = 400
#: Characters of a text that are counted at once; counts of the parts are summed, so a part may end anywhere between words.
SLICE = 1 << 20


def _letters(text: str) -> str:
    """Lower-cased words parted by single spaces; letters are what str.isalpha says, so that no number sign is one."""
    words = NOT_LETTERS.sub(" ", text.lower())
    if not words.isascii():
        odd = {c for c in set(words) if c != " " and not c.isalpha()}
        if odd:
            words = " ".join(words.translate(dict.fromkeys(map(ord, odd), " ")).split())
    return words.strip()


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams as integers, how often) of a whole text; 21 bits for each character, marks between words are spaces."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    words = _letters(text)
    a = 0
    while a < len(words):  # bounded memory for very long texts
        b = words.find(" ", a + SLICE)
        b = len(words) if b < 0 else b
        c = np.frombuffer(f" {words[a:b].strip()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        a = b
        if len(c) < 3:
            continue
        letter = c != 32
        two = (c[:-1] << 21) | c[1:]
        three = (two[:-1] << 21) | c[2:]
        # spaces stand only at the ends of an n-gram
        k, n = np.unique(np.concatenate([c[letter], two[letter[:-1] | letter[1:]], three[letter[1:-1]]]), return_counts=True)
        keys.append(k)
        counts.append(n)
    if len(keys) < 3:
        return keys[-1], counts[-1]
    k, at = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(at, np.concatenate(counts)).astype(np.int64)


def ranked(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by value."""
    return keys[np.lexsort((keys, -counts))[:size]]


class Profiles:
    """Ranked n-grams of each language, and the distances of texts to them."""

    def __init__(self, ranks: dict[str, list[int]], size: int = SIZE):
        self.size, self.languages = size, sorted(ranks)
        self.keys = np.unique(np.array([g for r in ranks.values() for g in r] or [-1], np.int64))
        self.place = np.full((len(self.keys) + 1, len(self.languages)), -1, np.int64)
        for k, lang in enumerate(self.languages):
            own = np.array(ranks[lang], np.int64)
            self.place[np.searchsorted(self.keys, own), k] = np.arange(len(own))

    def distances(self, text: str | None) -> np.ndarray | None:
        """As a share of the largest possible distance; None without a letter."""
        own = ranked(*grams(text), self.size)
        if not len(own) or not self.languages:
            return None
        at = np.searchsorted(self.keys, own)
        at[self.keys[np.minimum(at, len(self.keys) - 1)] != own] = len(self.keys)
        places = self.place[at]
        out = np.where(places < 0, self.size, np.abs(places - np.arange(len(own))[:, None]))
        return out.sum(axis=0) / (self.size * len(own))

    def predict(self, text: str | None) -> tuple[str, float]:
        d = self.distances(text)
        if d is None:
            return "und", 0.0
        best, mean = int(d.argmin()), float(d.mean())
        if mean <= 0 or d[best] >= 1:
            return self.languages[best], 0.0 if d[best] >= 1 else 1.0
        return self.languages[best], float(min(1.0, max(0.0, 2 * (1 - d[best] / mean))) if len(d) > 1 else 1 - d[best])


def train(docs: DataFrame, texts_per_language: int = 4000, size: int = SIZE) -> Profiles:
    """Profiles from docs: doc_id, text, lang; rows of the held-out fold, and rows without text or lang, are not used."""
    rows = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)).alias("draw"))
    n = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = n.select(F.col("lang").alias("name"), F.least(F.lit(1 << 20), F.ceil(F.lit(float(texts_per_language << 20)) / F.col("n"))).alias("most"))
    drawn = rows.join(sent(share), (F.col("lang") == F.col("name")) & (F.col("draw") < F.col("most"))).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, text = (c.to_pylist() for c in batch.columns)
            for name in dict.fromkeys(lang):
                held = [grams(t) for x, t in zip(lang, text, strict=True) if x == name]
                k, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
                n = np.bincount(at, np.concatenate([h[1] for h in held]), len(k)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(k), pa.string()), pa.array(k), pa.array(n)], names=["lang", "gram", "n"])

    counts = drawn.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = [F.desc("n"), F.asc("gram")]
    # the best of 16 parts of each language first, so that no task ranks all of a language's n-grams
    part = counts.withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(16)))
    part = part.withColumn("r", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("r") <= size)
    best = part.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("r") <= size)
    ranks: dict[str, list[int]] = {}
    for lang, gram in best.orderBy("lang", "r").select("lang", "gram").toLocalIterator():
        ranks.setdefault(lang, []).append(gram)
    return Profiles(ranks, size)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """docs with lang_pred and score; columns of these names are replaced."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([profiles.predict(t) for t in texts], columns=["lang_pred", "score"])

    found = docs.select(F.struct(*docs.columns).alias("d"), predict("text").alias("found"))
    return found.select(*(F.col("d")[c].alias(c) for c in docs.columns if c not in ("lang_pred", "score")), "found.lang_pred", "found.score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are und, or share nothing with any profile, go."""
    out = identify(docs.select(F.struct(*docs.columns).alias("d"), "text"), train(docs))
    return out.filter((F.col("lang_pred") != "und") & (F.col("score") > 0)).select(*(F.col("d")[c].alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: the language of every document."""
    docs = read(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), train(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
