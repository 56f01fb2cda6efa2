"""Streams that keep state by key: the routing of scans, and the assembly of volumes from sweeps that arrive apart.

State lives in the state store, so a query that is started again from its checkpoint goes on where it was; a key's state is
ended by a timer on event time. Only numbers of files and rays are kept; gates stay in the files they came in.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


def start(spark: SparkSession, writer: DataStreamWriter) -> StreamingQuery:
    """Start a stateful query with the store that such state needs; the session's own setting is as before afterwards."""
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:
        return writer.start()
    finally:
        spark.conf.set(_STORE, before)


ROUTED = "site string, day date, file_order long, scan_name string, product string"


class Routing(StatefulProcessor):
    """For a site and day: the smallest number of a file of the second volume, known until the watermark has passed the day."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.second = handle.getValueState("second", "file_order long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        files = pd.concat(list(rows))
        seen = files.file_order[files.scan_name.str.contains("VOL2")]
        first = self.second.get()[0] if self.second.exists() else None
        if len(seen) and (first is None or seen.min() < first):
            first = int(seen.min())
            self.second.update((first,))
        # the day's state goes when nothing of it can arrive any more
        self.handle.registerTimer(int(pd.Timestamp(key[1]).timestamp() * 1000) + DAY_MS)
        out = files.assign(site=key[0], day=key[1])
        volume = out.scan_name.str.contains("PICCOLO_LONG|CIRL|CIRC|PICO_LONGVOL|VOL2")
        later = out.file_order >= first if first is not None else out.file_order < out.file_order
        out["product"] = "none"
        out.loc[volume, "product"] = "volume1"
        out.loc[volume & later, "product"] = "volume2"
        out.loc[out.scan_name.str.contains("RHI"), "product"] = "rhi"
        yield out[["site", "day", "file_order", "scan_name", "product"]]

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.second.clear()
        return iter(())

    def close(self) -> None:
        pass


def route_arrivals(files: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream of files (site, time, file_order, scan_name) with their product, by the rules of qc.route_scans for each site and day.

    Files are routed as they arrive, by what has been seen of the second volume until then; those of one micro-batch know
    of each other. A file that arrives after later ones is compared by its number. Null sites are a site, null names are "".
    """
    known = files.withWatermark("time", delay).select(F.coalesce("site", F.lit("")).alias("site"), F.to_date("time").alias("day"), "time", F.col("file_order").cast("long").alias("file_order"), F.coalesce("scan_name", F.lit("")).alias("scan_name"))
    return known.groupBy("site", "day").transformWithStateInPandas(Routing(), ROUTED, "Append", "EventTime")


ASSEMBLED = "merged string, volume_id string, ray_idx int, new_ray int, new_sweep int, state string"


class Assembly(StatefulProcessor):
    """For a volume: the rays of the sweeps that came. Complete when `n_sweeps` have come, or when the watermark passes the patience."""

    def __init__(self, patience_ms: int):
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sweeps = handle.getListState("sweeps", "volume_id string, rays array<int>, times array<bigint>")
        self.due = handle.getValueState("due", "at bigint, done boolean")

    def _numbered(self, key: Any, state: str) -> pd.DataFrame:
        rows = [(t, v, r) for v, rays, times in self.sweeps.get() for r, t in zip(rays, times, strict=True)]
        rows.sort()
        out = pd.DataFrame({"merged": key[0], "volume_id": [v for _, v, _ in rows], "ray_idx": [r for *_, r in rows], "new_ray": range(len(rows))})
        out = out.astype({"ray_idx": "int32", "new_ray": "int32"})
        out["new_sweep"] = (out.groupby("volume_id").new_ray.transform("min").rank(method="dense") - 1).astype("int32")
        return out.assign(state=state)

    def _late(self, key: Any, files: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"merged": key[0], "volume_id": files.volume_id, "ray_idx": files.ray_idx.astype("int32"), "new_ray": None, "new_sweep": None, "state": "late"})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        came = pd.concat(list(rows))
        at, done = self.due.get() if self.due.exists() else (None, False)
        if done:
            yield self._late(key, came)
            return
        known = {s[0] for s in self.sweeps.get()} if self.sweeps.exists() else set()
        for name, own in came.groupby("volume_id"):
            self.sweeps.appendValue((name, own.ray_idx.tolist(), own.micros.tolist()))
            known.add(name)
        wanted = came.n_sweeps.max()
        until = int(came.micros.max() // 1000) + self.patience
        if at is None or until > at:
            if at is not None:
                self.handle.deleteTimer(at)
            self.handle.registerTimer(until)
            at = until
        complete = not pd.isna(wanted) and len(known) >= wanted
        self.due.update((at, bool(complete)))
        if complete:
            yield self._numbered(key, "complete")
            self.sweeps.clear()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.due.exists() and not self.due.get()[1] and self.sweeps.exists():
            yield self._numbered(key, "overdue")
        self.sweeps.clear()
        self.due.clear()

    def close(self) -> None:
        pass


def assemble_sweeps(rays: DataFrame, delay: str = "10 minutes", patience_ms: int = 1_200_000) -> DataFrame:
    """The numbering of model.merge_volumes for a stream of rays whose sweeps (volume_id) arrive apart, a sweep whole at a time.

    rays: merged (the volume it belongs to), n_sweeps (how many that has; null: not known), volume_id, ray_idx, time. A volume
    is given out once, when it is complete or when the watermark has passed its last ray by the patience (state overdue). A
    sweep that comes between that and the end of the volume's state is given out with state late and no numbers; later ones
    are behind the watermark and dropped by it. Join the gates, which stay where they are, with the numbering.
    """
    known = rays.withWatermark("time", delay).select(F.coalesce(F.col("merged").cast("string"), F.lit("")).alias("merged"), "time", F.col("n_sweeps").cast("int").alias("n_sweeps"), "volume_id", "ray_idx", F.unix_micros("time").alias("micros"))
    return known.groupBy("merged").transformWithStateInPandas(Assembly(patience_ms), ASSEMBLED, "Append", "EventTime")
