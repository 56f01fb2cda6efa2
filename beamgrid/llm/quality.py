"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

A whole text gives a vector of statistics. They are standardised and mapped to random Fourier features of a Gaussian
kernel; the sums of the normal equations are made in the tasks and added up in Spark, so the driver only gets a matrix of fixed
size. Four folds are summed apart: each fold is scored by the ridge fit of the other three, these scores are counted in
bins of fixed number, and pool-adjacent-violators on the bins calibrates the fit of all.

Defined cases: null and empty texts have the statistics of an empty text and get a score; rows without a label, with a null
label or with a null doc_id, and the held-out fold, teach nothing; repeated labels count as rows; without labels every
score is 0.5. Columns beside doc_id and text are not read. Ids are whole numbers; others need a number of their own first.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, materialize, read

FEATURES, FOLDS, BINS = 128, 4, 1024
_CLASS = np.zeros((256, 6), np.float64)  # upper, lower or beyond ASCII, digit, sentence mark, other mark, white space
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b, 0 if "A" <= _c <= "Z" else 1 if "a" <= _c <= "z" or _b > 127 else 2 if "0" <= _c <= "9" else 3 if _c in ".,;:'\"-" else 5 if _c.isspace() or _b < 32 else 4] = 1


def statistics(text: str | None) -> list[float]:
    text = text or ""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    shares = (np.bincount(data, minlength=256) @ _CLASS) / max(1, len(data))
    words, lines = text.split(), [x for x in text.split("\n") if x]
    n = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    distinct = Counter(words)
    marked = sum(k for w, k in distinct.items() if not w[-1].isalnum())
    capital = sum(k for w, k in distinct.items() if w[0].isupper())
    upper = sum(k for w, k in distinct.items() if len(w) > 1 and w.isupper())
    odd = sum(k for w, k in distinct.items() if not w.strip(".,;:!?'\"()-").isalpha())
    line_counts = Counter(lines)
    return [
        np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(lines)), *shares,
        float(sizes.mean()), float(sizes.std()), float((sizes <= 3).mean()), float(np.log1p(sizes.max())),
        len(distinct) / n, (distinct.most_common(1)[0][1] / n) if words else 0.0,
        marked / n, capital / n, upper / n, odd / n,
        len(line_counts) / max(1, len(lines)), (max(line_counts.values()) / len(lines)) if lines else 0.0, len(words) / max(1, len(lines)) / 100,
    ]


def table(docs: DataFrame) -> DataFrame:
    """doc_id, stats: the statistics of every text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [statistics(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(stats, pa.list_(pa.float64()))], names=["doc_id", "stats"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(count, "doc_id long, stats array<double>")


class Model:
    """The fixed random features, the ridge weights and the calibration."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int = FEATURES, gamma: float = 0.15, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(0, np.sqrt(2 * gamma / len(mean)) * 2, (len(mean), features))
        self.b = rng.uniform(0, 2 * np.pi, features)
        self.weights = self.x = self.y = None

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.hstack([np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b)), z / 10, np.ones((len(z), 1))])

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), 0.5)
        raw = self.features(stats) @ self.weights
        ramp = np.clip((raw + 1) / 3, 0, 1)  # keeps the order of texts that share a calibrated value
        return 0.998 * np.interp(raw, self.x, self.y) + 0.002 * ramp


def _solve(a: np.ndarray, c: np.ndarray, ridge: float) -> np.ndarray:
    return np.linalg.solve(a + ridge * np.eye(len(a)), c)


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators of means y with weights n at ascending x: (weighted centre, mean) of each pool."""
    pools: list[list[float]] = []
    for a, b, c in zip(x, y, n, strict=True):
        pools.append([a * c, b * c, c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [u + v for u, v in zip(pools[-1], last, strict=True)]
    p = np.array(pools)
    return p[:, 0] / p[:, 2], p[:, 1] / p[:, 2]


def train(stats: DataFrame, labels: DataFrame, ridge: float = 1e-2) -> Model:
    """stats: doc_id, stats; labels: doc_id, quality. Learns from all labelled rows outside the held-out fold."""
    marks = labels.filter(F.col("quality").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y"))
    rows = stats.filter(~held_out()).join(marks, "doc_id").select("stats", "y", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold"))
    rows = materialize(rows, "labelled")
    width = len(statistics(""))
    parts = [f(F.element_at("stats", k + 1)) for k in range(width) for f in (F.avg, F.stddev_pop)]
    seen = rows.agg(F.count(F.lit(1)), *parts).first()
    if not seen[0]:
        return Model(np.zeros(width), np.ones(width))
    model = Model(np.array(seen[1::2]), np.maximum(np.array(seen[2::2]), 1e-6))

    def columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
        return model.features(flat.reshape(-1, width)), batch.column(1).to_numpy(), batch.column(2).to_numpy()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            z, y, fold = columns(batch)
            z = np.hstack([z, y[:, None]])
            for k in np.unique(fold):
                total[k] = total.get(k, 0) + z[fold == k].T @ z[fold == k]
        for k, a in total.items():
            i, j = np.triu_indices(len(a))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), k, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(a[i, j])], names=["fold", "i", "j", "v"])

    size = FEATURES + width + 2
    grams = np.zeros((FOLDS, size, size))
    for fold, i, j, v in rows.mapInArrow(sums, "fold int, i int, j int, v double").groupBy("fold", "i", "j").agg(F.sum("v")).collect():
        grams[fold, i, j] = grams[fold, j, i] = v
    every = grams.sum(axis=0)
    amount = ridge * max(1.0, np.trace(every[:-1, :-1]) / size)
    others = [_solve((every - g)[:-1, :-1], (every - g)[:-1, -1], amount) for g in grams]

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                z, y, fold = columns(batch)
                raw = (z * np.array(others)[fold]).sum(axis=1)
                at = np.clip(((raw + 1) / 3 * BINS).astype(np.int64), 0, BINS - 1)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw), pa.array(y)], names=["bin", "raw", "y"])

    bins = rows.mapInArrow(binned, "bin long, raw double, y double").groupBy("bin").agg(F.avg("raw"), F.avg("y"), F.count(F.lit(1))).orderBy("bin").collect()
    model.weights = _solve(every[:-1, :-1], every[:-1, -1], amount)
    model.x, model.y = isotonic(*(np.array(c, float) for c in list(zip(*bins, strict=True))[1:]))
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (probability of label 1), predicted."""

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            s = np.clip(model.score(flat.reshape(batch.num_rows, -1)), 0, 1) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], names=["doc_id", "score"])

    out = stats.select("doc_id", "stats").mapInArrow(rate, "doc_id long, score double")
    return out.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: the quality of every document."""
    stats = materialize(table(read(spark, sf_dir, "documents")), "statistics")
    out = score(stats, train(stats, read(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")
