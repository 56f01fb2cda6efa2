"""Data source `radarvol`: files of radar volumes read by ranges of rays, and files written in two phases.

Reading: a file is one or more splits of its rays, by its size; a split's header is read and then only the bytes of its rays
and of the variables in the requested schema. Where there are many small splits a task reads several, one after the other. Equal and range conditions on volume_id, sweep_idx and ray_idx choose
files and rays before anything of a field is read (spark.sql.python.filterPushdown.enabled). Fields are dense (time, range), or
ragged: one row of points, of which each ray holds ray_n_gates from ray_start_index on.

Writing: rows are pieces of files in order (PIECES); a task appends them to hidden files, whatever the size of a file, and
the commit of the job moves all of them to their names and lists them in a manifest. A task or job that fails leaves no file in
sight.

    register(spark)
    spark.read.format("radarvol").option("table", "gates").option("moments", "DBZ,VEL").load(folder)
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from beamgrid.model import RAYS, SWEEPS, gates_schema
from beamgrid.sources import netcdf

#: Bytes of a file that one task reads at most, about, and values of a field that it decodes at once.
SPLIT, BLOCK = 32 << 20, 1 << 20
#: Tasks to which small splits are dealt before one gets several.
TASKS = 128

#: A piece of a file: the header has field -1 and a plan; field and piece tell the place of the others.
PIECES = "volume_id string, field int, piece int, payload binary, plan string"


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and uri.startswith("file:"):
        uri = uri.removeprefix("file:")
    where, path = fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
    return where, path.rstrip("/")


@dataclass
class Split:
    path: str
    volume_id: str
    part: int
    parts: int


@dataclass
class Splits(InputPartition):
    """What one task reads."""

    held: list[Split]


def together(splits: list[tuple[int, Split]]) -> list[Splits]:
    """(bytes, split) in order, as tasks: of a share of all bytes each, but of no more than SPLIT where a split is smaller."""
    share = min(SPLIT, sum(size for size, _ in splits) / TASKS)
    out: list[Splits] = []
    held = 0
    for size, split in splits:
        if not out or held + size > share:
            out.append(Splits([]))
            held = 0
        out[-1].held.append(split)
        held += size
    return out


def ray_blocks(head: netcdf.Header, a: int, b: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first ray, ray behind the last, numbers of gates of each, places of their first values) of blocks of the rays a to b."""
    if "n_points" in head.dims:
        counts, starts = (head.get(v, a=a, b=b).astype(np.int64) for v in ("ray_n_gates", "ray_start_index"))
    else:
        n = head.dims["range"]
        counts, starts = np.full(b - a, n), np.arange(a, b) * n
    k = 0
    while k < b - a:
        end = k + max(1, int(np.searchsorted(np.cumsum(counts[k:]), BLOCK, "right")))
        yield a + k, min(a + end, b), counts[k:end], starts[k:end]
        k = end


def read_gates(head: netcdf.Header, volume: str, moments: list[str], a: int, b: int) -> Iterator[pa.RecordBatch]:
    """Gates of the rays a to b of a file, as model.gates_schema, a block at a time."""
    if absent := [m for m in moments if m not in head.variables]:
        raise KeyError(f"{volume}: no variable {absent[0]}")
    ranges = head.get("range").astype(np.float32)
    for first, end, counts, starts in ray_blocks(head, a, b):
        n = int(counts.sum())
        ray = np.repeat(np.arange(first, end, dtype=np.int32), counts)
        gate = (np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)
        columns = [pa.array([volume]).take(pa.array(np.zeros(n, np.int32))), pa.array(ray), pa.array(gate), pa.array(ranges[gate])]
        for m in moments:
            if "n_points" in head.variables[m].dims:
                low, high = int(starts.min()), int((starts + counts).max())
                values = head.get(m, a=low, b=high)[np.repeat(starts - low, counts) + gate]
            else:
                values = head.get(m, a=first, b=end).ravel()
            columns.append(pa.array(values.astype(np.float32).astype(np.float64), from_pandas=True))
        yield pa.RecordBatch.from_arrays(columns, names=["volume_id", "ray_idx", "gate_idx", "range_m", *moments])


class VolumeReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.folder, self.table, self.schema = options["path"], options.get("table", "gates"), schema
        self.split = int(options.get("split_bytes", SPLIT))
        self.volumes: set[str] | None = None
        self.rays = [0, 2**31 - 1]
        self.sweeps: set[int] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Conditions on volume_id, ray_idx and sweep_idx; all are tested by Spark again."""
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if column == "volume_id" and values is not None:
                self.volumes = values if self.volumes is None else self.volumes & values
            elif column == "sweep_idx" and values is not None:
                self.sweeps = values if self.sweeps is None else self.sweeps & values
            elif column == "ray_idx":
                if values is not None:
                    own = [v for v in values if v is not None]
                    self.rays = [max(self.rays[0], min(own, default=0)), min(self.rays[1], max(own, default=-1))]
                elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                    self.rays[0] = max(self.rays[0], f.value + isinstance(f, GreaterThan))
                elif isinstance(f, LessThan | LessThanOrEqual):
                    self.rays[1] = min(self.rays[1], f.value - isinstance(f, LessThan))
            yield f

    def partitions(self) -> list[Splits]:
        where, root = filesystem(self.folder)
        out = []
        for info in where.get_file_info(fs.FileSelector(root, recursive=True)):
            inside = info.path[len(root) :].strip("/")
            hidden = any(p[0] in "._" for p in inside.split("/"))
            name = inside.removesuffix(".nc")
            if info.type != fs.FileType.File or hidden or name == inside or (self.volumes is not None and name not in self.volumes):
                continue
            parts = max(1, -(-info.size // self.split)) if self.table == "gates" else 1
            out += [(-(-info.size // parts), Split(info.path, name, k, parts)) for k in range(parts)]
        return together(out)

    def _open(self, path: str):
        where, _ = filesystem(self.folder)
        return where.open_input_file(path)

    def read(self, splits: Splits) -> Iterator[pa.RecordBatch]:
        for split in splits.held if splits is not None else ():
            yield from self._read(split)

    def _read(self, split: Split) -> Iterator[pa.RecordBatch]:
        with self._open(split.path) as file:

            def fetch(at: int, n: int) -> bytes:
                file.seek(at)
                return file.read(n)

            head = netcdf.Header(fetch)
            if self.table == "sweeps":
                from beamgrid.sources.volumes import sweeps_batch

                yield self._chosen(sweeps_batch(split.volume_id, head))
                return
            n = head.dims["time"]
            a, b = n * split.part // split.parts, n * (split.part + 1) // split.parts
            a, b = max(a, self.rays[0]), min(b, self.rays[1] + 1)
            spans = [(a, b)]
            if self.sweeps is not None:
                first, last = (head.get(f"sweep_{x}_ray_index").astype(int) for x in ("start", "end"))
                spans = [(max(a, int(first[s])), min(b, int(last[s]) + 1)) for s in sorted(self.sweeps) if 0 <= s < len(first)]
            for low, high in spans:
                if low >= high:
                    continue
                if self.table == "rays":
                    from beamgrid.sources.volumes import rays_batch

                    yield self._chosen(rays_batch(split.volume_id, head, low, high))
                else:
                    moments = [f.name for f in self.schema if f.name not in ("volume_id", "sweep_idx", "ray_idx", "gate_idx", "range_m")]
                    for batch in read_gates(head, split.volume_id, moments, low, high):
                        yield self._chosen(self._with_sweep(head, batch))

    def _with_sweep(self, head: netcdf.Header, batch: pa.RecordBatch) -> pa.RecordBatch:
        if "sweep_idx" not in self.schema.names:
            return batch
        last = head.get("sweep_end_ray_index").astype(int)
        return batch.append_column("sweep_idx", pa.array(np.searchsorted(last, batch.column("ray_idx").to_numpy()).astype(np.int32)))

    def _chosen(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.select(self.schema.names)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str, str]]


class PieceWriter(DataSourceArrowWriter):
    """Appends pieces to hidden files; a partition holds all pieces of its volumes, sorted by volume_id, field and piece."""

    def __init__(self, options: dict):
        self.folder, self.job = options["path"], options.get("job") or uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, root = filesystem(self.folder)
        hidden = f"{root}/.{self.job}/{uuid.uuid4().hex}"
        where.create_dir(hidden, recursive=True)
        done: list[tuple[str, str, str]] = []
        out = plan = None
        volume: str | None = None
        at = [0, 0]

        def fill_up(field: int, piece: int) -> None:
            """Write fill values for pieces that no row brought, up to a place."""
            while at < [field, piece]:
                own = plan[at[0]]
                size = min(own["piece"], own["bytes"] - at[1] * own["piece"])
                if size > 0:
                    pattern = bytes.fromhex(own["fill"])
                    out.write(pattern * (size // len(pattern)))
                    at[1] += 1
                else:
                    out.write(b"\0" * (-own["bytes"] % 4))
                    at[0], at[1] = at[0] + 1, 0

        def close() -> None:
            if out is not None:
                fill_up(len(plan), 0)
                out.close()

        for batch in iterator:
            for row in batch.to_pylist():
                if row["volume_id"] != volume:
                    close()
                    if row["field"] != -1:
                        raise ValueError(f"volume {row['volume_id']} has no header")
                    volume, plan, at = row["volume_id"], json.loads(row["plan"]), [0, 0]
                    done.append((volume, f"{hidden}/{len(done)}", f"{root}/{volume}.nc"))
                    out = where.open_output_stream(done[-1][1])
                    out.write(row["payload"])
                    continue
                fill_up(row["field"], row["piece"])
                if at != [row["field"], row["piece"]]:
                    raise ValueError(f"volume {volume} has piece {row['piece']} of field {row['field']} twice")
                out.write(row["payload"])
                at[1] += 1
        close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        where, root = filesystem(self.folder)
        files = [f for m in messages if m for f in m.files]
        for _, hidden, path in files:
            where.create_dir(path.rpartition("/")[0], recursive=True)
            where.move(hidden, path)
        where.create_dir(f"{root}/_jobs", recursive=True)
        with where.open_output_stream(f"{root}/_jobs/{self.job}.json") as out:
            for volume, _, path in files:
                out.write((json.dumps({"volume_id": volume, "path": path}) + "\n").encode())
        self._clear(where, root)

    def abort(self, messages: list[Written | None]) -> None:
        where, root = filesystem(self.folder)
        self._clear(where, root)

    def _clear(self, where: fs.FileSystem, root: str) -> None:
        if where.get_file_info(f"{root}/.{self.job}").type == fs.FileType.Directory:
            where.delete_dir(f"{root}/.{self.job}")


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with the pushing of conditions that its reader relies on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RadarVolumes)


class RadarVolumes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "radarvol"

    def schema(self) -> T.StructType | str:
        table = self.options.get("table", "gates")
        if table in ("rays", "sweeps"):
            return RAYS if table == "rays" else SWEEPS
        return gates_schema([m.strip() for m in self.options.get("moments", "").split(",") if m.strip()])

    def reader(self, schema: T.StructType) -> VolumeReader:
        return VolumeReader(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> PieceWriter:
        return PieceWriter(dict(self.options))
