"""Shared helpers of the training-data operators: scratch tables, files, folds."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where all tasks run in the driver it may be unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="beamgrid-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts lineage and fixes what was computed."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(uri: str):
    """(pyarrow filesystem, path in it) of a URI; usable in tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """True for the fold that nothing may learn from: crc32(doc_id as text) mod 3 = 1."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def sent(df: DataFrame, most_bytes: int = 8 << 20) -> DataFrame:
    """df to be joined by broadcast if its rows, written as JSON, have at most so many bytes; else to be joined by a shuffle.

    For tables that don't grow with the documents: counts by language, by length, tiles by length.
    """
    held = materialize(df, "sent")
    size = held.agg(F.sum(F.octet_length(F.to_json(F.struct(*held.columns))))).first()[0] or 0
    return F.broadcast(held) if size <= most_bytes else held
