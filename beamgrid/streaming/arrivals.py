"""Volumes that keep arriving: each new table file is quality-controlled and gridded once.

A volume is complete in itself: a file stream hands over the gates that arrived, and each batch is processed by the same
functions as a table at rest. Volumes whose sweeps arrive apart are put together first (state.assemble_sweeps). A volume that
arrives in two batches is an error: the stream stops before it writes, so nothing of the first part is lost. Which volumes
came is kept in a ledger of their names, dealt into folders, of which a batch reads only its own.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def grid_arrivals(spark: SparkSession, source: str, schema: StructType, sink: str, checkpoint: str, process: Callable[[DataFrame], DataFrame], once: bool = False) -> StreamingQuery:
    """Start a query that applies `process` to the gates of new Parquet files and appends the result, by volume, to `sink`.

    A batch that runs again after a failure replaces the volumes it had written; batch_id in the ledger and the sink tells which one that was.
    """

    ledger = f"{sink.rstrip('/')}_ledger"
    parts = 256

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        came = batch.select(F.col("volume_id").cast("string").alias("name")).distinct().withColumn("part", F.pmod(F.xxhash64("name"), F.lit(parts)).cast("int"))
        own = [r.part for r in came.select("part").distinct().collect()]
        spark = batch.sparkSession
        held = []
        for part in own:
            try:
                held.append(spark.read.parquet(f"{ledger}/part={part}").filter(F.col("batch_id") != number).select("name"))
            except AnalysisException:  # nothing came in this part yet
                continue
        if held:
            earlier = reduce(DataFrame.union, held)
            twice = came.join(earlier, "name", "left_semi").first()
            if twice:
                raise ValueError(f"volume {twice[0]} has arrived in an earlier batch")
        came.withColumn("batch_id", F.lit(number).cast("long")).write.mode("append").partitionBy("part").parquet(ledger)
        out = process(batch).withColumn("batch_id", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("volume_id")
        out.parquet(sink)
        batch.unpersist()

    stream = spark.readStream.schema(schema).parquet(source).writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (stream.trigger(availableNow=True) if once else stream).start()
