"""Token-id shards with a minimal perfect hash index.

Ids of documents lie one after another in binary shards, in ascending key order, without headers: 2 bytes an id where
the vocabulary allows it, else 4. An index maps a key to its place: keys are dealt by hash to buckets of bounded
size, and each bucket has a file with a minimal perfect hash (bit arrays by level, a key's slot is the rank of its
bit), a stored 32-bit fingerprint a slot that tells unknown keys, and the key's runs (shard, first id, documents).
A lookup reads one bucket and a fixed number of words in it, whatever the number of keys.

Defined cases: a null text is empty (the end id alone); rows that repeat a key are stored one after another, by the
hash of their text, and the index gives them all; rows with a null key come first and are found under NULL_KEY;
an empty table gives no shard and an empty index. Columns beside key and text are not read.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import filesystem, materialize, read, scratch_path
from .tokens import default_tokenizer, encoder

NULL_KEY = -(2**63)
#: A row per document; a row per run of equal documents of a key.
MANIFEST = "doc_key long, text_hash long, shard int, first_id long, n_tokens long"
RUNS = "doc_key long, shard int, first_id long, n_tokens long, n_docs long"
RUN_COLUMNS = ["shard", "first_id", "n_tokens", "n_docs"]
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of 64-bit keys, one function for each seed."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.int64).view(np.uint64) + np.uint64(seed + 1) * _MIX[2]
        x = (x ^ (x >> np.uint64(30))) * _MIX[0]
        x = (x ^ (x >> np.uint64(27))) * _MIX[1]
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct keys: at each level the keys that are alone at their bit stop there."""

    FINGERPRINT = 1_000_003

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, fingerprints: np.ndarray):
        self.bits, self.sizes, self.fingerprints = bits, sizes, fingerprints
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        words = np.frombuffer(np.packbits(bits, bitorder="little").tobytes() + b"\0" * 8, np.uint8)
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(words))]).astype(np.int64)
        self.words = words

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0) -> PerfectHash:
        left, bits, sizes = keys, [], []
        while len(left):
            m = int(gamma * len(left)) + 1
            at = (mix(left, len(sizes)) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            bits.append(alone)
            sizes.append(m)
            left = left[~alone[at]]
        out = cls(np.concatenate(bits) if bits else np.zeros(0, bool), np.array(sizes, np.int64), np.zeros(len(keys), np.uint32))
        out.fingerprints[out._slots(keys)] = cls._print(keys)
        return out

    @classmethod
    def _print(cls, keys: np.ndarray) -> np.ndarray:
        return (mix(keys, cls.FINGERPRINT) >> np.uint64(32)).astype(np.uint32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        slots, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, m in enumerate(self.sizes):
            at = self.starts[level] + (mix(keys[left], level) % np.uint64(m)).astype(np.int64)
            hit = self.bits[at]
            below = np.bitwise_count(self.words[at[hit] >> 3] & ((1 << (at[hit] & 7)) - 1).astype(np.uint8))
            slots[left[hit]] = self.rank[at[hit] >> 3] + below
            left = left[~hit]
        return slots

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where the fingerprint tells that the key was not built in."""
        slots = self._slots(keys)
        known = slots >= 0
        known[known] = self.fingerprints[slots[known]] == self._print(keys[known])
        return np.where(known, slots, -1)


def _replace(uri: str, payload: bytes) -> None:
    """A whole file or none: written beside its place and moved, so a task that runs again does no harm."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(tmp) as f:
        f.write(payload)
    fs.move(tmp, path)


def write_shards(docs: DataFrame, out: str, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Encode and write the shards; returns the manifest (MANIFEST): a row per document with its place."""
    tokenizer = tokenizer or default_tokenizer()
    width = id_bytes(tokenizer, end_id)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, n, sink, path, tmp = encoder(tokenizer), 0, None, "", ""
        kind = np.dtype(f"<u{width}")
        number = TaskContext.get().partitionId()
        for batch in batches:
            for first, ids, bounds in encode.blocks(batch.column("text"), end_id):
                if sink is None:
                    fs, path = filesystem(f"{out}/shard-{number:06d}.ids")
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
                    sink = fs.open_output_stream(tmp)
                sink.write(ids.astype(kind).tobytes())
                sizes = np.diff(bounds)
                starts = n + bounds[:-1]
                n += int(bounds[-1])
                part = batch.slice(first, len(sizes))
                yield pa.RecordBatch.from_arrays([part.column("doc_key"), part.column("text_hash"), pa.array(np.full(len(sizes), number, np.int32)), pa.array(starts), pa.array(sizes)], names=["doc_key", "text_hash", "shard", "first_id", "n_tokens"])
        if sink is not None:
            sink.close()
            fs.move(tmp, path)

    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)).alias("doc_key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    order = ["doc_key", "text_hash"]
    return materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(shard, MANIFEST), "manifest")


def build_index(manifest: DataFrame, out: str, keys_per_bucket: int = 16_384) -> int:
    """Write the index files of a manifest; returns their number."""
    buckets = max(1, -(-manifest.count() // keys_per_bucket))
    runs = manifest.groupBy("doc_key", "shard", "text_hash", "n_tokens").agg(F.min("first_id").alias("first_id"), F.count(F.lit(1)).alias("n_docs"))

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_key", "shard", "first_id"], ignore_index=True)
        keys, first, counts = np.unique(pdf.doc_key.to_numpy(np.int64), return_index=True, return_counts=True)
        table = PerfectHash.build(keys)
        slots = table.find(keys)
        start, length = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        start[slots], length[slots] = first, counts
        held = io.BytesIO()
        np.savez(held, bits=np.packbits(table.bits), n_bits=len(table.bits), sizes=table.sizes, fingerprints=table.fingerprints, start=start, length=length, shard=pdf["shard"].to_numpy(np.int32), first_id=pdf.first_id.to_numpy(np.int64), n_tokens=pdf.n_tokens.to_numpy(np.int64), n_docs=pdf.n_docs.to_numpy(np.int64))
        _replace(f"{out}/index-{key[0]:06d}.npz", held.getvalue())
        return pd.DataFrame({"bucket": [key[0]], "n_keys": [len(keys)]})

    runs.withColumn("bucket", bucket_of("doc_key", buckets)).groupBy("bucket").applyInPandas(build, "bucket long, n_keys long").agg(F.sum("n_keys")).collect()
    return buckets


def bucket_of(key: str, buckets: int):
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("long")


class Bucket:
    """One index file, as read back."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        with fs.open_input_file(path) as f:
            held = np.load(io.BytesIO(f.read()))
            self.data = {k: held[k] for k in held.files}
        bits = np.unpackbits(self.data["bits"])[: int(self.data["n_bits"])].astype(bool)
        self.table = PerfectHash(bits, self.data["sizes"], self.data["fingerprints"])

    @classmethod
    def open(cls, uri: str) -> Bucket | None:
        """None for a bucket that no key fell into: it has no file."""
        from pyarrow.fs import FileType

        fs, path = filesystem(uri)
        return cls(uri) if fs.get_file_info(path).type == FileType.File else None

    def runs(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position of the key in keys, row of the runs) for each run found."""
        slots = self.table.find(keys)
        known = np.flatnonzero(slots >= 0)
        n = self.data["length"][slots[known]]
        at = np.repeat(self.data["start"][slots[known]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(known, n), at


def look_up(keys: DataFrame, out: str, buckets: int, key: str = "doc_id") -> DataFrame:
    """The runs of each distinct key through the index; unknown keys give no row."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded, index = None, None
        for batch in batches:
            held, ks = batch.column("bucket").to_numpy(), batch.column("doc_key").to_numpy()
            for b in np.unique(held):
                if loaded != b:
                    loaded, index = b, Bucket.open(f"{out}/index-{b:06d}.npz")
                if index is None:
                    continue
                own = ks[held == b]
                who, at = index.runs(own)
                yield pa.RecordBatch.from_arrays([pa.array(own[who]), *(pa.array(index.data[c][at]) for c in RUN_COLUMNS)], names=["doc_key", *RUN_COLUMNS])

    wanted = keys.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)).alias("doc_key")).distinct().withColumn("bucket", bucket_of("doc_key", buckets))
    return wanted.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(find, RUNS)


def fetch(runs: DataFrame, out: str, id_bytes: int) -> DataFrame:
    """Read the documents of runs from the shards: doc_key, shard, first_id, n_tokens, ids (little-endian unsigned 32-bit, with the end id)."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, f = None, None
        for batch in batches:
            rows, size = [], 0
            for key, shard, first, n, docs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if opened != shard:
                    fs, path = filesystem(f"{out}/shard-{shard:06d}.ids")
                    opened, f = shard, fs.open_input_file(path)
                for k in range(docs):
                    ids = np.frombuffer(f.read_at(n * id_bytes, (first + k * n) * id_bytes), f"<u{id_bytes}").astype("<u4").tobytes()
                    rows.append((key, shard, first + k * n, n, ids))
                    size += len(ids)
                    if size > 8 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
            if rows:
                yield _batch(rows)

    ordered = runs.select("doc_key", *RUN_COLUMNS).repartition("shard").sortWithinPartitions("shard", "first_id")
    return ordered.mapInArrow(load, "doc_key long, shard int, first_id long, n_tokens long, ids binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_key", "shard", "first_id", "n_tokens", "ids"])


class TokenStore:
    """Shards and index of a table, in a folder that all executors reach."""

    def __init__(self, out: str, buckets: int, id_bytes: int):
        self.out, self.buckets, self.id_bytes = out, buckets, id_bytes

    @classmethod
    def write(cls, docs: DataFrame, out: str, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = 0) -> tuple[TokenStore, DataFrame]:
        """The store and its manifest."""
        tokenizer = tokenizer or default_tokenizer()
        manifest = write_shards(docs, out, key, text, tokenizer, end_id)
        return cls(out, build_index(manifest, out), id_bytes(tokenizer, end_id)), manifest

    def get(self, keys: DataFrame, key: str = "doc_id") -> DataFrame:
        """The documents of keys, through the index, as fetch() gives them."""
        return fetch(look_up(keys, self.out, self.buckets, key), self.out, self.id_bytes)


def id_bytes(tokenizer: str, end_id: int = 0) -> int:
    return 2 if encoder(tokenizer).vocab_size <= 1 << 16 and end_id < 1 << 16 else 4


def shard_starts(manifest: DataFrame) -> DataFrame:
    """shard, shard_start: the ids in the shards before; one row per shard."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: every document written, then read back by its key; digests of what was read."""
    docs = read(spark, sf_dir, "documents")
    store, manifest = TokenStore.write(docs, scratch_path(spark, "tokens"))
    back = store.get(docs).join(shard_starts(manifest), "shard")
    return back.select(
        F.when(F.col("doc_key") != NULL_KEY, F.col("doc_key")).alias("doc_id"),
        (F.col("shard_start") + F.col("first_id")).alias("start"),
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )
