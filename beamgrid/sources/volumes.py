"""Radar volume files and grid files as tables, and tables as files.

Files are read as binary rows, from any store that Spark reads, and decoded in the tasks that hold them, or by the data source
radarvol in parts. Only the variables that the caller names are decoded. The canonical storage for repeated use is Parquet
partitioned by volume_id; writers of files give one file per volume, put together from pieces of bounded size.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from beamgrid.model import FIELDS, RAYS, SWEEPS, UNSEEN, field_metadata, gates_schema
from beamgrid.sources import netcdf, radarvol
from beamgrid.sources.profiles import AIRBORNE, PROFILES, Field, apply_profile, georeference

_PER_RAY = {"azimuth": "azimuth", "elevation": "elevation", "latitude": "latitude", "longitude": "longitude", "altitude": "altitude", "ew_platform": "eastward_velocity", "ns_platform": "northward_velocity", "w_platform": "vertical_velocity", "nyquist_velocity": "nyquist_velocity", "heading": "heading", "pitch": "pitch", "roll": "roll"}
_DEFAULTS = {"eastward_velocity": 0.0, "northward_velocity": 0.0, "vertical_velocity": 0.0, "heading": np.nan, "pitch": np.nan, "roll": np.nan}


def _files(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.nc").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content")


def _plain(uri: str) -> str:
    """A path without its scheme and the slashes around it."""
    return (uri.partition("://")[2] if "://" in uri else uri.removeprefix("file:")).strip("/")


def _volume_id(path: str, folder: str) -> str:
    """The path inside the folder, so that files of one name in different folders are different volumes."""
    return _plain(path).removeprefix(_plain(folder)).strip("/").removesuffix(".nc")


def _times(head: netcdf.Header, a: int = 0, b: int | None = None) -> np.ndarray:
    """Microseconds since 1970, from seconds since the base date in the units."""
    base = str(head.variables["time"].attrs.get("units", "seconds since 1970-01-01T00:00:00Z")).partition("since ")[2].strip().replace("Z", "")
    zero = datetime.fromisoformat(base or "1970-01-01").replace(tzinfo=UTC).timestamp()
    return np.rint((head.get("time", a=a, b=b) + zero) * 1e6).astype(np.int64)


def _decoded(spark: SparkSession, folder: str, schema, decode) -> DataFrame:
    """Files as Spark reads them, whole, from any store; the data source radarvol reads parts of them."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from decode(_volume_id(path, folder), netcdf.Header(lambda at, n, content=content: content[at : at + n]))

    return _files(spark, folder).mapInArrow(each, schema)


def _float(v: np.ndarray, kind=pa.float64()) -> pa.Array:
    return pa.array(v, kind, from_pandas=True)


def rays_batch(volume: str, head: netcdf.Header, a: int, b: int) -> pa.RecordBatch:
    """The rays a to b of a file, as model.RAYS."""
    n = b - a
    columns = {"volume_id": pa.array([volume] * n), "scan_name": pa.array([str(head.attrs["scan_name"])] * n), "ray_idx": pa.array(np.arange(a, b, dtype=np.int32)), "time": pa.array(_times(head, a, b), pa.timestamp("us", "UTC"))}
    for name, source in _PER_RAY.items():
        v = head.variables.get(source)
        if v is None and source not in _DEFAULTS:
            raise KeyError(f"{volume}: no variable {source}")
        if v is None:
            values = np.full(n, _DEFAULTS[source])
        elif int(np.prod(v.shape)) == 1:
            values = np.broadcast_to(np.ravel(v.unpacked(head.fetch)), n)
        else:
            values = v.unpacked(head.fetch, a, b)
        attitude = name in ("heading", "pitch", "roll")
        columns[name] = pa.array(values) if attitude else _float(values.astype(np.float32), pa.float32())
    order = [x.partition(" ")[0] for x in RAYS.split(", ")]
    return pa.RecordBatch.from_arrays([columns[c] for c in order], names=order)


def read_rays(spark: SparkSession, folder: str) -> DataFrame:
    """A row per ray, as model.RAYS. A fixed platform's place is repeated; platform velocities absent from the file are 0, angles of
    attitude NaN."""
    return _decoded(spark, folder, RAYS, lambda volume, head: [rays_batch(volume, head, 0, head.dims["time"])])


def sweeps_batch(volume: str, head: netcdf.Header) -> pa.RecordBatch:
    angle, a, b = (head.get(v) for v in ("fixed_angle", "sweep_start_ray_index", "sweep_end_ray_index"))
    n = len(angle)
    return pa.RecordBatch.from_arrays([pa.array([volume] * n), pa.array(np.arange(n, dtype=np.int32)), _float(angle.astype(np.float32), pa.float32()), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=["volume_id", "sweep_idx", "fixed_angle", "start_ray", "end_ray"])


def read_sweeps(spark: SparkSession, folder: str) -> DataFrame:
    return _decoded(spark, folder, SWEEPS, lambda volume, head: [sweeps_batch(volume, head)])


def read_gates(spark: SparkSession, folder: str, moments: list[str]) -> DataFrame:
    """A row per gate with the moments named, missing where the file holds its fill value; each must be in every file.

    Rays may hold different numbers of gates. Where tasks can open files themselves, radarvol reads less.
    """
    return _decoded(spark, folder, gates_schema(moments), lambda volume, head: radarvol.read_gates(head, volume, moments, 0, head.dims["time"]))


#: What a volume file holds beside its gates: a row per variable, and one without a name for the global attributes (JSON).
EXTRAS = "volume_id string, name string, dims array<string>, shape array<int>, type string, numbers array<double>, text binary, attributes string"


def read_extras(spark: SparkSession, folder: str) -> DataFrame:
    """Global attributes and all variables that aren't fields of gates: calibration, georeference, sweeps, instrument."""

    def decode(volume: str, head: netcdf.Header) -> list[pa.RecordBatch]:
        rows = [(volume, None, None, None, None, None, None, json.dumps(head.attrs))]
        for name, variable in head.variables.items():
            dims, attrs = variable.dims, variable.attrs
            if {"time", "range"} <= set(dims) or "n_points" in dims:
                continue
            v = variable.rows(head.fetch)
            text = v.dtype.kind == "S"
            rows.append((volume, name, list(dims), list(v.shape), v.dtype.str[1:], None if text else v.astype(np.float64).ravel().tolist(), v.tobytes() if text else None, json.dumps(attrs)))
        types = [pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.string(), pa.list_(pa.float64()), pa.binary(), pa.string()]
        names = [x.partition(" ")[0] for x in EXTRAS.split(", ")]
        return [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)]

    return _decoded(spark, folder, EXTRAS, decode)


#: Axis variables of each layout of grid file, outermost first, as (name here, name in the file).
LAYOUTS = {
    "volume": [("z", "Z"), ("y", "Y"), ("x", "X")],
    "ppi": [("y", "Y"), ("x", "X")],
    "rhi": [("z", "Z"), ("r", "R")],
    "column": [("z", "Z")],
    "cartesian": [("z", "z0"), ("y", "y0"), ("x", "x0")],
    "latlon": [("z", "z0"), ("lat", "y0"), ("lon", "x0")],
}
#: Names of the latitudes and longitudes of a layout's cells, and the axes that these depend on. Fixed names of the format.
_PLACES = {"volume": ("latitude", "longitude", ("y", "x")), "ppi": ("latitude", "longitude", ("y", "x")), "rhi": ("latitude", "longitude", ("r",)), "column": ("latitude", "longitude", ()), "cartesian": ("lat0", "lon0", ("y", "x")), "latlon": None}
_AXIS = {"X": "projection_x_coordinate", "Y": "projection_y_coordinate", "Z": "altitude", "R": "projection_range_coordinate"}
_SECONDS = "seconds since 1970-01-01T00:00:00Z"


def _moment(data: netcdf.Header, name: str) -> pa.Scalar:
    """A time of the file in microseconds; missing where the file lacks it."""
    v = data.get(name)
    return pa.scalar(None if v is None or np.isnan(v).all() else int(np.rint(np.ravel(v)[0] * 1e6)), pa.timestamp("us", "UTC"))


def read_grid(spark: SparkSession, folder: str, layout: str, moments: list[str]) -> DataFrame:
    """A row per cell: i<axis>, <axis>, lat and lon of the cell, start and stop of the volume, and the moments.

    Places and times that the file lacks are missing. Cells not seen are missing; NO_VALID stays a value.
    """
    axes, places = LAYOUTS[layout], _PLACES[layout]
    more = [] if places is None else ["lat", "lon"]
    keys = ", ".join(f"i{a} int" for a, _ in axes) + ", " + ", ".join(f"{a} double" for a in [*(a for a, _ in axes), *more])
    schema = f"volume_id string, {keys}, start timestamp, stop timestamp, " + ", ".join(f"{m} double" for m in moments)

    def decode(volume: str, data: netcdf.Header) -> list[pa.RecordBatch]:
        at = [data.get(v) for _, v in axes]
        shape = [len(a) for a in at]
        index = np.indices(shape).reshape(len(at), -1)
        n = index.shape[1]
        columns = [pa.array([volume] * n), *(pa.array(i.astype(np.int32)) for i in index), *(pa.array(a[i]) for a, i in zip(at, index, strict=True))]
        for name in places[:2] if places else ():
            v = data.get(name)
            own = [k for k, (a, _) in enumerate(axes) if a in places[2]]
            columns.append(pa.nulls(n, pa.float64()) if v is None else _float(v.reshape([shape[k] for k in own])[tuple(index[k] for k in own)] if own else np.full(n, np.ravel(v)[0])))
        columns += [pa.array([_moment(data, x).as_py()] * n, pa.timestamp("us", "UTC")) for x in ("start_time", "stop_time")]
        columns += [_float(np.where(data.get(m) == UNSEEN, np.nan, data.get(m)).ravel()) for m in moments]
        return [pa.RecordBatch.from_arrays(columns, names=["volume_id", *(f"i{a}" for a, _ in axes), *(a for a, _ in axes), *more, "start", "stop", *moments])]

    return _decoded(spark, folder, schema, decode)


#: Values in one piece of a field.
PIECE = 8192


def _plan(values: int, dtype: str, fill: float) -> dict:
    """How a field of a file is written: its bytes, those of a piece, and a fill value."""
    kind = np.dtype(dtype)
    return {"bytes": values * kind.itemsize, "piece": PIECE * kind.itemsize, "fill": np.array(fill, kind).tobytes().hex()}


def _pieces(values: DataFrame, fields: list[tuple[int, str, str, float]]) -> DataFrame:
    """PIECES of fields (number, column, type, fill) from rows volume_id, _at (place in the field), _n (values of the field).

    A piece is a group of bounded size; places that no row has get the fill value.
    """

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        piece = key[1].as_py()
        n = min(PIECE, table["_n"][0].as_py() - piece * PIECE)
        at = table["_at"].to_numpy() - piece * PIECE
        out = []
        for _, column, dtype, fill in fields:
            held = np.full(n, fill, dtype)
            held[at] = table[column].to_numpy()
            out.append(held.tobytes())
        count = len(fields)
        return pa.table({"volume_id": pa.array([key[0].as_py()] * count, pa.string()), "field": pa.array([f[0] for f in fields], pa.int32()), "piece": pa.array([piece] * count, pa.int32()), "payload": pa.array(out, pa.binary()), "plan": pa.nulls(count, pa.string())})

    dealt = values.withColumn("_piece", F.floor(F.col("_at") / PIECE).cast("int"))
    return dealt.groupBy("volume_id", "_piece").applyInArrow(pack, radarvol.PIECES)


def _write(spark: SparkSession, heads: DataFrame, pieces: DataFrame, folder: str) -> DataFrame:
    """Write files from their headers and pieces; volume_id, path of each as the job's manifest has them.

    A volume's pieces are sorted by Spark and appended by one task, which holds a batch of them at a time.
    """
    radarvol.register(spark)
    job = uuid.uuid4().hex
    ordered = heads.union(pieces).repartition("volume_id").sortWithinPartitions("volume_id", "field", "piece")
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    spark.conf.set(rows, "512")
    try:
        ordered.write.format("radarvol").mode("append").option("job", job).save(folder)
    finally:
        spark.conf.set(rows, before)
    return spark.read.schema("volume_id string, path string").json(f"{folder}/_jobs/{job}.json")


def _head_row(volume: str, data: netcdf.Dataset, plan: list[dict]) -> dict:
    return {"volume_id": volume, "field": -1, "piece": 0, "payload": netcdf.dumps(data), "plan": json.dumps(plan)}


def _heads(volumes: DataFrame, head) -> DataFrame:
    """A header row for each volume's row, by a function of that row."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame([head(r) for r in pdf.to_dict("records")], columns=["volume_id", "field", "piece", "payload", "plan"])

    return volumes.mapInPandas(each, radarvol.PIECES)


def _told(row: dict, names: list[str]) -> dict:
    return {k: row[k] for k in names if k in row and row[k] is not None and not pd.isna(row[k])}


def write_grid(grid: DataFrame, folder: str, layout: str, moments: list[str], about: DataFrame | None = None, **attributes: str) -> DataFrame:
    """One file per volume_id, which replaces any of that name; returns volume_id, path when all are in place.

    Columns lat and lon of the grid become the places of its cells. about has a row per volume: volume_id and any of start,
    stop (timestamps), lat0, lon0 (the reference of the projection), heading, azimuth. A grid may be larger than a task's memory:
    its cells go to the file in pieces, and cells that the table lacks are not seen.
    """
    axes, places = LAYOUTS[layout], _PLACES[layout]
    names = [a for a, _ in axes]
    grid = grid.withColumn("volume_id", F.col("volume_id").cast("string"))
    points = [F.sort_array(F.collect_set(F.struct(F.col(f"i{a}").alias("i"), F.col(a).cast("double").alias("v")))).alias(f"_{a}") for a in names]
    meta = grid.groupBy("volume_id").agg(*points)
    if about is not None:
        meta = meta.join(about.withColumn("volume_id", F.col("volume_id").cast("string")), "volume_id", "left")
    placed = [(c, n, u) for c, n, u in zip(("lat", "lon"), places[:2] if places else (), ("degrees_north", "degrees_east"), strict=False) if c in grid.columns]
    kept = [a for a in names if places and a in places[2]]

    def head(row: dict) -> dict:
        said = _told(row, ["start", "stop", "lat0", "lon0", "heading", "azimuth"])
        data = netcdf.Dataset()
        data.attrs = {"Conventions": "CF-1.12", **attributes}
        at = {}
        for a in names:
            own = {p["i"]: p["v"] for p in row[f"_{a}"]}
            at[a] = np.array([own.get(k, np.nan) for k in range(max(own) + 1)])
        shape = [len(at[a]) for a in names]
        for name, variable in (("start", "time"), ("start", "start_time"), ("stop", "stop_time")):
            if name in said:
                long = "Data time" if variable == "time" else f"Data {name} time"
                data.put(variable, ("time",), np.array([said[name].timestamp()]), standard_name=variable, long_name=long, units=_SECONDS, **({"axis": "T"} if variable == "time" else {}))
        for a, v in axes:
            more = {"standard_name": _AXIS[v], "axis": v} if v in _AXIS else {}
            data.put(v, (v,), at[a].astype(np.float32), units="degrees" if a in ("lat", "lon") else "m", **more)
        plan = []
        for _, name, units in placed:
            own = [len(at[a]) for a in kept]
            data.put(name, ("time", *(v for a, v in axes if a in kept)), netcdf.Later((1, *own), ">f4"), standard_name={"degrees_north": "latitude", "degrees_east": "longitude"}[units], units=units)
            plan.append(_plan(int(np.prod(own, dtype=np.int64)), ">f4", UNSEEN))
        if {"lat0", "lon0"} <= said.keys():
            data.put("grid_mapping", (), np.int32(UNSEEN), grid_mapping_name="transverse_mercator", scale_factor_at_central_meridian=1.0, longitude_of_central_meridian=float(said["lon0"]), latitude_of_projection_origin=float(said["lat0"]), reference_ellipsoid_name="WGS84", false_easting=0.0, false_northing=0.0)
        for name in ("heading", "azimuth"):
            if name in said:
                data.put(name, ("time",), np.array([said[name]], np.float32), standard_name=name, units="degrees")
        for m in moments:
            mapped = {"grid_mapping": "grid_mapping"} if "grid_mapping" in data.variables else {}
            data.put(m, ("time", *(v for _, v in axes)), netcdf.Later((1, *shape), ">f4"), _FillValue=np.float32(UNSEEN), **field_metadata(m if m in FIELDS else m.upper()), **mapped)
            plan.append(_plan(int(np.prod(shape, dtype=np.int64)), ">f4", UNSEEN))
        return _head_row(row["volume_id"], data, plan)

    sizes = grid.groupBy("volume_id").agg(*((F.max(f"i{a}") + 1).cast("long").alias(f"_n{a}") for a in names))
    cells = grid.join(sizes, "volume_id")

    def at(of: list[str]) -> tuple[Column, Column]:
        place, total = F.lit(0).cast("long"), F.lit(1).cast("long")
        for a in of:
            place, total = place * F.col(f"_n{a}") + F.col(f"i{a}"), total * F.col(f"_n{a}")
        return place, total

    place, total = at(names)
    values = cells.select("volume_id", place.alias("_at"), total.alias("_n"), *(F.coalesce(F.col(m), F.lit(UNSEEN)).cast("float").alias(m) for m in moments))
    pieces = _pieces(values, [(len(placed) + k, m, ">f4", UNSEEN) for k, m in enumerate(moments)])
    if placed:
        place, total = at(kept)
        once = [F.col(f"i{a}") == 0 for a in names if a not in kept]
        edge = cells.filter(reduce(lambda x, y: x & y, once)) if once else cells
        edge = edge.select("volume_id", place.alias("_at"), total.alias("_n"), *(F.coalesce(F.col(c), F.lit(UNSEEN)).cast("float").alias(c) for c, *_ in placed))
        pieces = _pieces(edge, [(k, c, ">f4", UNSEEN) for k, (c, *_) in enumerate(placed)]).union(pieces)
    return _write(grid.sparkSession, _heads(meta, head), pieces, folder)


def write_volumes(gates: DataFrame, rays: DataFrame, sweeps: DataFrame, folder: str, profile: str, extras: DataFrame | None = None) -> DataFrame:
    """One file per volume_id with the fields of a profile; gates hold raw_<name> and <name> columns.

    Where the rays of a volume hold different numbers of gates, its fields are one row of points, else (time, range). extras
    (EXTRAS) brings the attributes and variables of the files that the volumes came from; those that are written here
    anyway win. A header, with all that belongs to rays, is held by a task; fields go to the file in pieces.
    """
    fields: list[Field] = PROFILES[profile]
    own = _PER_RAY | ({v: v for v in AIRBORNE} if profile == "airborne" else {})
    rays = georeference(rays, profile)
    counts = gates.groupBy("volume_id", "ray_idx").agg((F.max("gate_idx") + 1).alias("_k"))
    before = Window.partitionBy("volume_id").orderBy("ray_idx").rowsBetween(Window.unboundedPreceding, -1)
    placed = rays.join(counts, ["volume_id", "ray_idx"], "left").withColumn("_k", F.coalesce("_k", F.lit(0)))
    placed = placed.withColumns({"_start": F.coalesce(F.sum("_k").over(before), F.lit(0)), "_n": F.sum("_k").over(Window.partitionBy("volume_id"))})
    lists = placed.groupBy("volume_id").agg(F.sort_array(F.collect_list(F.struct("ray_idx", F.unix_micros("time").alias("t"), "_k", "scan_name", *own))).alias("rays"))
    lists = lists.join(sweeps.groupBy("volume_id").agg(F.sort_array(F.collect_list(F.struct("sweep_idx", "fixed_angle", "start_ray", "end_ray"))).alias("sweeps")), "volume_id", "left")
    lists = lists.join(gates.groupBy("volume_id").agg(F.sort_array(F.collect_set(F.struct("gate_idx", F.col("range_m").cast("float").alias("r")))).alias("ranges")), "volume_id")
    if extras is not None:
        more = extras.groupBy(F.col("volume_id").alias("of")).agg(F.collect_list(F.struct(*(c for c in extras.columns if c != "volume_id"))).alias("extras"))
        lists = lists.join(more, lists["volume_id"] == more["of"], "left").drop("of")
    else:
        lists = lists.withColumn("extras", F.lit(None).cast("array<struct<name:string>>"))

    def head(row: dict) -> dict:
        rays, sweeps = row["rays"], row["sweeps"]
        more = [] if row["extras"] is None else list(row["extras"])
        data = netcdf.Dataset()
        t = np.array([r["t"] for r in rays]) / 1e6
        said = {k: v for e in more if e["name"] is None for k, v in json.loads(e["attributes"]).items()}
        data.attrs = {"Conventions": "CF-1.7", **said, "scan_name": str(rays[0]["scan_name"])}
        for name, when in (("time_coverage_start", t[0]), ("time_coverage_end", t[-1])):
            data.attrs[name] = f"{datetime.fromtimestamp(np.floor(when), UTC):%Y-%m-%dT%H:%M:%S}Z"
        data.put("time", ("time",), t - np.floor(t[0]), units=f"seconds since {datetime.fromtimestamp(np.floor(t[0]), UTC):%Y-%m-%dT%H:%M:%S}Z")
        ranges = {p["gate_idx"]: p["r"] for p in reversed(list(row["ranges"]))}
        k = np.array([r["_k"] for r in rays], np.int64)
        n_gates = int(k.max())
        r = np.array([ranges.get(g, np.nan) for g in range(n_gates)], np.float32)
        data.put("range", ("range",), r, meters_to_center_of_first_gate=float(r[0]), meters_between_gates=float(r[1] - r[0]) if n_gates > 1 else 0.0)
        for name, variable in own.items():
            words = dict(zip(("long_name", "units"), AIRBORNE.get(name, ()), strict=False))
            data.put(variable, ("time",), np.array([np.nan if x[name] is None else x[name] for x in rays], np.float64), **words)
        if sweeps is not None:
            for name, variable in (("fixed_angle", "fixed_angle"), ("start_ray", "sweep_start_ray_index"), ("end_ray", "sweep_end_ray_index")):
                data.put(variable, ("sweep",), np.array([x[name] for x in sweeps], np.float32 if name == "fixed_angle" else np.int32))
            data.put("sweep_number", ("sweep",), np.array([x["sweep_idx"] for x in sweeps], np.int32))
        data.put("ray_n_gates", ("time",), k.astype(np.int32))
        data.put("ray_start_index", ("time",), (np.cumsum(k) - k).astype(np.int32))
        dense = bool((k == n_gates).all())
        dims, shape = (("time", "range"), (len(k), n_gates)) if dense else (("n_points",), (int(k.sum()),))
        for e in more:
            if e["name"] is not None and e["name"] not in data.variables and e["name"] not in {f.name for f in fields}:
                values = np.frombuffer(e["text"], "S1") if e["type"] == "S1" else np.array(e["numbers"], np.float64).astype(f">{e['type']}")
                data.put(e["name"], tuple(e["dims"]), values.reshape(tuple(e["shape"])), **json.loads(e["attributes"]))
        for f in fields:
            packed = {"scale_factor": f.scale, "add_offset": f.offset} if f.scale is not None else {}
            data.put(f.name, dims, netcdf.Later(shape, f.dtype), _FillValue=np.array(f.fill, f.dtype)[()], **packed, **field_metadata(f.name))
        return _head_row(row["volume_id"], data, [_plan(int(k.sum()), f.dtype, f.fill) for f in fields])

    values = apply_profile(gates, profile).join(placed.select("volume_id", "ray_idx", "_start", "_n"), ["volume_id", "ray_idx"])
    values = values.withColumn("_at", (F.col("_start") + F.col("gate_idx")).cast("long"))
    written = [(k, f.name, f.dtype, f.fill) for k, f in enumerate(fields) if f.column in gates.columns]
    pieces = _pieces(values.select("volume_id", "_at", F.col("_n").cast("long").alias("_n"), *(c for _, c, *_ in written)), written)
    return _write(gates.sparkSession, _heads(lists, head), pieces, folder)
