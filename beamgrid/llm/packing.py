"""Packing by power-of-two decomposition: every sequence lies in one document.

A document of n ids is cut into n // L pieces of the full length L (a power of two) and one piece for each bit that
is set in the rest, longest first. Pieces of equal length make a bucket, each piece is a sequence of its own, so
nothing is padded and no sequence crosses documents; batches are drawn from one bucket at a time. sequence_id is
gapless from 0: buckets in descending length, in each the order in which the documents were written.

Defined cases: a null or empty text has the end id alone, one piece of length 1; rows that repeat a doc_id are
documents of their own; a null doc_id stays null; an empty table gives no piece. Columns beside key and text are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read
from .tokens import default_tokenizer, encoder, payloads


def _encoded(docs: DataFrame, key: str, text: str, tokenizer: str, end_id: int, length: int) -> DataFrame:
    """doc_id, ids, part (the task that wrote it), before (pieces of each length in that task before it), totals at n = -1."""
    levels = length.bit_length()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(levels, np.int64)
        call = encoder(tokenizer)
        for batch in batches:
            for first, ids, bounds in call.blocks(batch.column(1), end_id):
                n = np.diff(bounds)
                counts = (n[:, None] >> np.arange(levels)) & 1
                counts[:, -1] = n // length
                before = seen + np.cumsum(counts, axis=0) - counts
                seen = before[-1] + counts[-1]
                nested = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * levels), pa.array(before.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(n)), payloads(ids, bounds), pa.array(n), pa.array(np.full(len(n), part, np.int32)), nested], names=["doc_id", "ids", "doc_tokens", "part", "before"])

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(encode, f"doc_id {kind}, ids binary, doc_tokens long, part int, before array<long>")


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 1024, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Pieces: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset (0)."""
    if length < 1 or length & (length - 1):
        raise ValueError("length must be a power of two")
    levels = length.bit_length()
    held = materialize(_encoded(docs, key, text, tokenizer or default_tokenizer(), end_id, length), "encoded")
    full = levels - 1

    def count(n, k: int):
        return F.floor(n / length) if k == full else F.shiftright(n, k).bitwiseAND(1)

    n = F.col("doc_tokens")
    parts = held.groupBy("part").agg(*(F.sum(count(n, k)).cast("long").alias(f"n{k}") for k in range(levels)))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # one row per task that wrote: sequences that come before this task's first of each length
    longer = [sum((F.sum(f"n{j}").over(every) for j in range(k + 1, levels)), F.lit(0)) for k in range(levels)]
    bases = parts.select("part", F.array(*(F.coalesce(F.sum(f"n{k}").over(earlier), F.lit(0)) + longer[k] for k in range(levels))).alias("base"))

    fulls = F.transform(F.sequence(F.lit(0), F.floor(n / length)), lambda i: F.struct((i * length).cast("long").alias("start"), F.lit(full).alias("k"), i.cast("long").alias("i")))
    fulls = F.slice(fulls, F.lit(1), F.floor(n / length).cast("int"))
    rest = F.filter(
        F.array(*(F.struct((n - n % (1 << (k + 1))).cast("long").alias("start"), F.lit(k).alias("k"), F.lit(0).cast("long").alias("i")) for k in reversed(range(full)))),
        lambda p: F.shiftright(n, 0).bitwiseAND(F.element_at(F.array(*(F.lit(1 << k).cast("long") for k in range(full + 1))), p["k"] + 1)) != 0,
    )
    pieces = F.transform(F.concat(fulls, rest), lambda p: F.struct(p["start"].alias("start"), p["k"].alias("k"), (F.element_at("base", p["k"] + 1) + F.element_at("before", p["k"] + 1) + p["i"]).alias("sequence_id")))
    size = F.expr("cast(shiftleft(1, p.k) as int)")
    # a row of eleven numbers per writing task: sent to all tasks while that is at most 20 MB, else joined by a shuffle
    bases = F.broadcast(bases) if bases.count() <= 200_000 else bases
    return (
        held.join(bases, "part")
        .select("doc_id", "ids", "doc_tokens", F.explode(pieces).alias("p"))
        .select("doc_id", F.col("p.start").alias("start"), size.cast("long").alias("length"), F.substring(F.col("ids"), F.col("p.start").cast("int") * 4 + 1, size * 4).alias("ids"), "doc_tokens", F.col("p.sequence_id").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces with their ids."""
    return pack(docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: all documents packed to 1024; a digest of each piece's ids."""
    return pack(read(spark, sf_dir, "documents")).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
