"""Nearest neighbours of stated queries by a block matrix join of int8 products.

Vectors are scaled to length one and rounded to int8 with a scale each; the length of what rounding left out is kept. They
are dealt by a hash to blocks of bounded size, queries and candidates apart, and each block of queries meets each block of
candidates in one tile. A tile multiplies the int8 matrices (exactly) and bounds every cosine by the lengths left out:
|x.y - x'.y'| <= |x'||ry| + |rx||y'| + |rx||ry|. A pair survives if its upper bound reaches the k-th largest lower bound
of its query in the tile. Survivors are computed again in double precision from the original vectors, and the k best of each
query and tile, held in heaps, are merged over the tiles. No pair is lost: a true neighbour's upper bound is at least
its cosine, which at least equals the k-th largest lower bound in any tile that holds it.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, neither do vectors of
another length than the query's; rows with a null id take no part; ties go to the smaller id; rows that repeat an id are
candidates of their own, but none for a query of the same id. Fewer than k candidates: all of them. An empty table gives no
row. Columns beside id and vector are not read. Ids are whole numbers; others need a number of their own first.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read, sent

RESULT = "query_id long, vec_id long, score double"


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 rows, scale, length of the rounded rows, length of what rounding left out) of rows of length one."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    # lengths a little enlarged, so that the bounds hold beyond their own rounding
    return q, scale, np.linalg.norm(back, axis=1) * (1 + 1e-12), np.linalg.norm(x - back, axis=1) + 1e-12


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows: sums of 1024 terms stay below 2**24, where floats are exact."""
    out = np.zeros((len(a), len(b)))
    for i in range(0, a.shape[1], 1024):
        out += a[:, i : i + 1024].astype(np.float32) @ b[:, i : i + 1024].astype(np.float32).T
    return out


class Block:
    def __init__(self, ids: list[int], vectors: bytes, size: int):
        self.ids = np.array(ids, np.int64)
        self.x = np.frombuffer(vectors, np.float64).reshape(len(ids), size)
        self.norm = np.sqrt((self.x * self.x).sum(axis=1))
        # huge or tiny components: the length of the row scaled by its largest one
        top = np.abs(self.x).max(axis=1)
        unit = self.x / top[:, None]
        unit = unit / np.sqrt((unit * unit).sum(axis=1))[:, None]
        self.unit = unit
        self.q, self.scale, self.kept, self.lost = quantise(unit)


def tile(a: Block, b: Block, k: int, components: int = 1 << 22) -> Iterator[tuple[int, int, float]]:
    """(query, candidate, cosine) of the k best candidates in b of each query in a; survivors of so many components at once."""
    pairs = max(k, components // max(1, a.x.shape[1]))
    near = product(a.q, b.q) * a.scale[:, None] * b.scale[None, :]
    slack = a.kept[:, None] * b.lost[None, :] + a.lost[:, None] * b.kept[None, :] + a.lost[:, None] * b.lost[None, :]
    other = a.ids[:, None] != b.ids[None, :]
    low = np.where(other, near - slack, -np.inf)
    least = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(a.ids), -np.inf)
    rows, columns = np.nonzero(other & (near + slack >= least[:, None]))
    heaps: dict[int, list] = {}
    for i in range(0, len(rows), pairs):
        r, c = rows[i : i + pairs], columns[i : i + pairs]
        score = cosine(a, r, b, c)
        # the best of each query in this part only
        order = np.lexsort((b.ids[c], -score, r))
        first = np.searchsorted(r[order], np.unique(r))
        for s in first.tolist():
            for j in order[s : s + k].tolist():
                if r[j] != r[order[s]]:
                    break
                heap = heaps.setdefault(int(r[j]), [])
                entry = (float(score[j]), -int(b.ids[c[j]]))
                if len(heap) < k:
                    heapq.heappush(heap, entry)
                else:
                    heapq.heappushpop(heap, entry)
    for r, heap in heaps.items():
        for score, negative in heap:
            yield int(a.ids[r]), -negative, score


def cosine(a: Block, r: np.ndarray, b: Block, c: np.ndarray) -> np.ndarray:
    """Cosines of pairs in double precision, from the original vectors; scaled ones where these would overflow."""
    with np.errstate(over="ignore", invalid="ignore", under="ignore", divide="ignore"):
        out = (a.x[r] * b.x[c]).sum(axis=1) / (a.norm[r] * b.norm[c])
        odd = ~((a.norm[r] > 1e-100) & (a.norm[r] < 1e100) & (b.norm[c] > 1e-100) & (b.norm[c] < 1e100))
    if odd.any():
        out[odd] = (a.unit[r[odd]] * b.unit[c[odd]]).sum(axis=1)
    return out


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """block, dim, ids, vectors (64-bit floats): rows dealt to blocks of about `size`, none of more."""
    n = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    dealt = rows.join(sent(n), "dim").withColumn("block", F.pmod(F.xxhash64("id", F.col("v")), F.ceil(F.col("n") / size)).cast("int"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "dim", "ids", "vectors"]
        types = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary()]

        def out(key, ids, data):
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*key, ids, b"".join(data)), types, strict=True)], names=names)

        key, ids, data = None, [], []
        for batch in batches:
            flat = batch.column(3).flatten().to_numpy(zero_copy_only=False)
            at = 0
            for b, d, i in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if (b, d) != key or len(ids) >= size:
                    if ids:
                        yield out(key, ids, data)
                    key, ids, data = (b, d), [], []
                ids.append(i)
                data.append(flat[at : at + d].astype(np.float64).tobytes())
                at += d
        if ids:
            yield out(key, ids, data)

    ordered = dealt.select("block", "dim", "id", "v").repartition("dim", "block").sortWithinPartitions("dim", "block", "id")
    return ordered.mapInArrow(pack, "block int, dim int, ids array<long>, vectors binary")


def nearest(rows: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", query_block: int = 1024, block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each query by cosine, all rows but the query's own."""
    v = F.col(vector).cast("array<double>")
    sound = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    held = rows.filter(F.col(vector).isNotNull() & F.col(key).isNotNull() & sound)
    held = held.select(F.col(key).cast("long").alias("id"), v.alias("v"), F.size(v).alias("dim"), is_query.alias("is_query"))
    candidates = _blocks(held.drop("is_query"), block).select(F.monotonically_increasing_id().alias("tile"), "dim", F.col("ids").alias("b_ids"), F.col("vectors").alias("b"))
    candidates = materialize(candidates, "candidates")
    queries = _blocks(held.filter("is_query").drop("is_query"), query_block).select("dim", F.col("ids").alias("a_ids"), F.col("vectors").alias("a"))
    # each block of queries goes to each block of candidates of the same length: whole blocks are joined, not rows
    places = candidates.groupBy("dim").agg(F.collect_list("tile").alias("tiles"))
    queries = queries.join(sent(places), "dim").select(F.explode("tiles").alias("tile"), "a_ids", "a")
    tiles = queries.join(candidates.select("tile", "dim", "b_ids", "b"), "tile").select("dim", "a_ids", "a", "b_ids", "b")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim, a_ids, a, b_ids, b = (batch.column(c)[i].as_py() for c in range(5))
                found = list(tile(Block(a_ids, a, dim), Block(b_ids, b, dim), k))
                q, c, s = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(c, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])

    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id")))
    return tiles.mapInArrow(multiply, RESULT).withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: the five nearest of every fiftieth vector."""
    rows = read(spark, sf_dir, "embeddings")
    return nearest(rows.select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


