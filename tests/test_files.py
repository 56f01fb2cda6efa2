"""Files of volumes and grids: round trips; volumes that arrive as a stream."""

import math

import numpy as np
import pytest

from beamgrid.model import NO_VALID, UNSEEN
from beamgrid.operators import grid
from beamgrid.sources import netcdf, radarvol, volumes
from beamgrid.streaming.arrivals import grid_arrivals


def a_file(path, fixed=True):
    d = netcdf.Dataset()
    d.attrs = {"scan_name": "SUR", "n": np.int32(3)}
    d.put("time", ("time",), np.array([0.0, 1.5, 3.0]), units="seconds since 2024-05-01T00:00:10Z")
    d.put("range", ("range",), np.array([100, 200], np.float32))
    for v in ("azimuth", "elevation", "nyquist_velocity"):
        d.put(v, ("time",), np.array([1, 2, 3], np.float32))
    for v in ("latitude", "longitude", "altitude"):
        d.put(v, () if fixed else ("time",), np.array(5.5) if fixed else np.array([5.5, 6.5, 7.5]))
    d.put("fixed_angle", ("sweep",), np.array([0.5, 1.5], np.float32))
    d.put("sweep_start_ray_index", ("sweep",), np.array([0, 2], np.int32))
    d.put("sweep_end_ray_index", ("sweep",), np.array([1, 2], np.int32))
    d.put("DBZ", ("time", "range"), np.array([[100, -32768], [250, 3], [4, 5]], np.int16), scale_factor=0.01, add_offset=0.0, _FillValue=np.int16(-32768))
    d.put("name", ("len",), np.frombuffer(b"abc", "S1"))
    path.write_bytes(netcdf.dumps(d))
    return d


def test_classic_format(tmp_path):
    d = a_file(tmp_path / "a.nc")
    back = netcdf.loads((tmp_path / "a.nc").read_bytes())
    assert back.dims == d.dims and back.attrs == {"scan_name": "SUR", "n": 3} and back.variables.keys() == d.variables.keys()
    for k, (dims, values, _) in d.variables.items():
        assert back.variables[k][0] == dims and (back.variables[k][1] == values).all()
    assert netcdf.loads((tmp_path / "a.nc").read_bytes(), {"DBZ"}).variables.keys() == {"DBZ"}
    with pytest.raises(ValueError):
        netcdf.loads(b"\x89HDF....")
    with pytest.raises(ValueError):
        d.put("bad", ("time",), [1.0])


@pytest.mark.parametrize("fixed", [True, False])
def test_volume_round_trip(spark, tmp_path, fixed):
    (tmp_path / "in").mkdir()
    a_file(tmp_path / "in" / "v1.nc", fixed)
    a_file(tmp_path / "in" / "v2.nc", fixed)
    rays, sweeps = volumes.read_rays(spark, str(tmp_path / "in")), volumes.read_sweeps(spark, str(tmp_path / "in"))
    gates = volumes.read_gates(spark, str(tmp_path / "in"), ["DBZ"])
    own = rays.filter("volume_id = 'v1'").orderBy("ray_idx").collect()
    assert [r.time.second for r in own] == [10, 11, 13] and [r.latitude for r in own] == ([5.5] * 3 if fixed else [5.5, 6.5, 7.5])
    assert own[0].ew_platform == 0 and math.isnan(own[0].roll)
    assert [r.DBZ for r in gates.filter("volume_id = 'v2'").orderBy("ray_idx", "gate_idx").collect()] == pytest.approx([1.0, None, 2.5, 0.03, 0.04, 0.05], abs=1e-6)
    with pytest.raises(Exception, match="no variable ZDR"):
        volumes.read_gates(spark, str(tmp_path / "in"), ["ZDR"]).collect()
    both = gates.selectExpr("*", "DBZ AS raw_DBZ")
    assert volumes.write_volumes(both, rays, sweeps, str(tmp_path / "out"), "packed").count() == 2
    for site in ("a", "b"):  # one file name in two folders
        (tmp_path / "sites" / site).mkdir(parents=True)
        a_file(tmp_path / "sites" / site / "v1.nc", fixed)
    assert {r.volume_id for r in volumes.read_rays(spark, f"file://{tmp_path}/sites").collect()} == {"a/v1", "b/v1"}
    again = volumes.read_gates(spark, str(tmp_path / "out"), ["DBZ", "DBZ_L1", "ZDR"]).orderBy("volume_id", "ray_idx", "gate_idx").collect()
    assert [r.DBZ_L1 for r in again[:6]] == pytest.approx([1.0, None, 2.5, 0.03, 0.04, 0.05], abs=1e-6) and all(r.ZDR is None for r in again)
    assert sorted(volumes.read_sweeps(spark, str(tmp_path / "out")).collect()) == sorted(sweeps.collect())
    assert [r.time for r in volumes.read_rays(spark, str(tmp_path / "out")).filter("volume_id = 'v1'").orderBy("ray_idx").collect()] == [r.time for r in own]


def test_extras_are_copied(spark, tmp_path):
    (tmp_path / "in").mkdir()
    d = a_file(tmp_path / "in" / "v1.nc")
    d.attrs |= {"title": "x", "scan_id": np.float32(1.5), "institution": "é"}
    d.put("r_calib_time", ("r_calib", "string_length"), np.frombuffer(b"2024-01-01ab", "S1").reshape(2, 6))
    d.put("r_calib_noise", ("r_calib",), np.array([1.5, np.nan], np.float32), units="dBm", _FillValue=np.float32(-9999))
    d.put("sweep_mode", ("sweep", "string_length"), np.frombuffer(b"sector" * 2, "S1").reshape(2, 6), long_name="mode")
    d.put("georef_time", ("time",), np.array([1.0, 2.0, 3.0]))
    d.put("volume_number", (), np.int32(7))
    (tmp_path / "in" / "v1.nc").write_bytes(netcdf.dumps(d))
    folder = str(tmp_path / "in")
    gates = volumes.read_gates(spark, folder, ["DBZ"]).selectExpr("*", "DBZ AS raw_DBZ")
    path = volumes.write_volumes(gates, volumes.read_rays(spark, folder), volumes.read_sweeps(spark, folder), str(tmp_path / "out"), "packed", volumes.read_extras(spark, folder)).first().path
    back = netcdf.loads(open(path, "rb").read())
    assert back.attrs.items() >= {"title": "x", "scan_id": 1.5, "institution": "é", "scan_name": "SUR", "time_coverage_start": "2024-05-01T00:00:10Z", "time_coverage_end": "2024-05-01T00:00:13Z"}.items()
    for name in ("r_calib_time", "r_calib_noise", "sweep_mode", "georef_time", "volume_number", "name"):
        dims, values, attrs = d.variables[name]
        assert back.variables[name][0] == dims and back.variables[name][1].tobytes() == np.asarray(values, back.variables[name][1].dtype).tobytes()
        assert back.variables[name][2] == {k: pytest.approx(v) if not isinstance(v, str) else v for k, v in attrs.items()}
    assert back.get("sweep_number").tolist() == [0, 1] and back.get("ray_n_gates").tolist() == [2, 2, 2]


@pytest.mark.parametrize("layout", sorted(volumes.LAYOUTS))
def test_grid_round_trip(spark, tmp_path, layout):
    axes = {a: (10.0 * k, 5.0, k + 2) for k, (a, _) in enumerate(volumes.LAYOUTS[layout])}
    g = grid.regular_grid(spark, **axes)
    first = f"i{next(iter(axes))}"
    g = g.selectExpr("'v' AS volume_id", "*", f"CASE WHEN {first} = 0 THEN {UNSEEN} WHEN {first} = 1 THEN {NO_VALID} ELSE 3.5 END AS DBZ")
    assert volumes.write_grid(g, str(tmp_path), layout, ["DBZ"]).count() == 1
    back = volumes.read_grid(spark, str(tmp_path), layout, ["DBZ"])
    key = [c for c in g.columns if c.startswith("i")]
    wanted = [tuple(r) for r in g.selectExpr(*g.columns[:-1], f"double(nullif(DBZ, {UNSEEN})) AS DBZ").orderBy(*key).collect()]
    assert [tuple(r) for r in back.select(*g.columns).orderBy(*key).collect()] == wanted
    assert all(r.start is None and r.stop is None for r in back.collect())


@pytest.mark.parametrize("layout", ["volume", "ppi", "rhi", "column", "cartesian"])
def test_grid_file_places_and_times(spark, tmp_path, layout):
    from datetime import UTC, datetime

    axes = {a: (10.0 * k, 5.0, k + 2) for k, (a, _) in enumerate(volumes.LAYOUTS[layout])}
    g = grid.regular_grid(spark, **axes)
    lat = {"rhi": "r / 100", "column": "7.5"}.get(layout, "y / 100 + x / 1000")
    g = g.selectExpr("'v' AS volume_id", "*", "1.5 AS DBZ", f"double({lat}) AS lat", f"double(-({lat})) AS lon")
    about = spark.sql("SELECT 'v' AS volume_id, timestamp_micros(1714557600250000) AS start, timestamp_micros(1714557900000000) AS stop, -2.5 AS lat0, -45.25 AS lon0, 12.5 AS heading, double(null) AS azimuth")
    path = volumes.write_grid(g, str(tmp_path), layout, ["DBZ"], about, title="t").first().path
    rows = volumes.read_grid(spark, str(tmp_path), layout, ["DBZ"]).collect()
    wanted = {tuple(r[c] for c in g.columns if c[0] == "i"): (r.lat, r.lon) for r in g.collect()}
    assert len(rows) == len(wanted)
    for r in rows:
        assert (r.lat, r.lon) == pytest.approx(wanted[tuple(r[c] for c in g.columns if c[0] == "i")], abs=1e-6)
        assert r.start.replace(microsecond=0) <= r.start and (r.stop - r.start).total_seconds() == pytest.approx(299.75)
    data = netcdf.loads(open(path, "rb").read())
    assert {"time", "start_time", "stop_time", "grid_mapping", "heading"} <= data.variables.keys() and "azimuth" not in data.variables
    assert data.get("start_time")[0] == datetime(2024, 5, 1, 10, 0, 0, 250000, UTC).timestamp() and data.attrs["title"] == "t"
    assert data.variables["grid_mapping"][2]["latitude_of_projection_origin"] == -2.5 and data.variables["DBZ"][2]["grid_mapping"] == "grid_mapping"


def test_stream(spark, tmp_path):
    rows = [(f"v{v}", r, g, 100.0 * g + 50, 90.0 * r, 1.0, 0.0, 0.0, 0.0, float(v), 1.0) for v in range(3) for r in range(4) for g in range(5)]
    gates = spark.createDataFrame(rows, "volume_id string, ray_idx int, gate_idx int, range_m double, azimuth double, elevation double, altitude double, x0 double, y0 double, dbz double, sqi double")
    run = lambda: grid_arrivals(spark, f"{tmp_path}/in", gates.schema, f"{tmp_path}/out", f"{tmp_path}/check", lambda b: grid.grid_composite(b, ["dbz"], (0, 200, 3), (0, 200, 3), 150.0, 0.0), True).awaitTermination()
    gates.filter("volume_id < 'v2'").write.parquet(f"{tmp_path}/in")
    run()
    gates.filter("volume_id = 'v2'").write.mode("append").parquet(f"{tmp_path}/in")
    run()
    out = spark.read.parquet(f"{tmp_path}/out")
    gates.filter("volume_id = 'v0'").write.mode("append").parquet(f"{tmp_path}/in")
    with pytest.raises(Exception, match="earlier batch"):
        run()
    assert out.count() == 27 and {r.dbz for r in out.filter("volume_id = 'v2'").collect()} <= {2.0, UNSEEN}


def many_rays(path, n_rays=400, n_gates=50, counts=None):
    """A file of rays in four sweeps; counts: gates of each ray, for a file of points. DBZ of a gate is 100 times its ray plus its number."""
    d = netcdf.Dataset()
    d.attrs = {"scan_name": "SUR"}
    d.put("time", ("time",), np.arange(n_rays) * 1.0, units="seconds since 2024-05-01T00:00:00Z")
    for v in ("azimuth", "elevation", "nyquist_velocity", "latitude", "longitude", "altitude"):
        d.put(v, ("time",), np.arange(n_rays, dtype=np.float32))
    d.put("fixed_angle", ("sweep",), np.arange(4, dtype=np.float32))
    edges = np.arange(5) * n_rays // 4
    d.put("sweep_start_ray_index", ("sweep",), edges[:-1].astype(np.int32))
    d.put("sweep_end_ray_index", ("sweep",), (edges[1:] - 1).astype(np.int32))
    if counts is None:
        values, dims = np.arange(n_rays)[:, None] * 100.0 + np.arange(n_gates), ("time", "range")
    else:
        values, dims = np.concatenate([r * 100.0 + np.arange(c) for r, c in enumerate(counts)]), ("n_points",)
        d.put("ray_n_gates", ("time",), np.array(counts, np.int32))
        d.put("ray_start_index", ("time",), (np.cumsum(counts) - counts).astype(np.int32))
    d.put("range", ("range",), (100 * np.arange(n_gates)).astype(np.float32))
    d.put("DBZ", dims, values.astype(np.float32), _FillValue=np.float32(-32768))
    d.put("VEL", dims, -values.astype(np.float32))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(netcdf.dumps(d))


@pytest.mark.parametrize("ragged", [False, True])
def test_source_splits_rays_and_reads_what_it_needs(spark, tmp_path, monkeypatch, ragged):
    counts = [(r * 7) % 51 for r in range(400)] if ragged else None
    for name in ("a", "deep/b"):
        many_rays(tmp_path / f"{name}.nc", counts=counts)
    (tmp_path / ".hidden").mkdir()
    many_rays(tmp_path / ".hidden" / "c.nc")
    radarvol.register(spark)
    source = spark.read.format("radarvol").option("split_bytes", 20_000).option("moments", "DBZ,VEL").load(str(tmp_path))
    assert source.rdd.getNumPartitions() > 4
    at_once = volumes.read_gates(spark, str(tmp_path), ["DBZ", "VEL"])
    rows = source.filter("volume_id = 'deep/b'").orderBy("ray_idx", "gate_idx").collect()
    assert len(rows) == (sum(counts) if ragged else 20_000) and all(r.DBZ == 100.0 * r.ray_idx + r.gate_idx == -r.VEL and r.range_m == 100 * r.gate_idx for r in rows)
    assert rows == at_once.filter("volume_id = 'deep/b'").orderBy("ray_idx", "gate_idx").collect()
    own = source.filter("volume_id = 'a' AND ray_idx >= 100 AND ray_idx < 103").select("ray_idx").distinct().collect()
    assert {r.ray_idx for r in own} == {r for r in (100, 101, 102) if not ragged or counts[r]}
    by_sweep = spark.read.format("radarvol").schema("volume_id string, sweep_idx int, ray_idx int, DBZ double").load(str(tmp_path)).filter("sweep_idx = 2")
    assert {(r.sweep_idx, r.ray_idx // 100) for r in by_sweep.collect()} == {(2, 2)}
    # in this process, counting the bytes: one field of ten rays is a small part of the file
    read = [0]

    class Counting:
        def __init__(self, file):
            self.file = file

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

        def seek(self, at):
            self.file.seek(at)

        def read(self, n):
            read[0] += n
            return self.file.read(n)

    monkeypatch.setattr(netcdf.Header.__init__, "__defaults__", (4096,))
    opened = radarvol.VolumeReader._open
    monkeypatch.setattr(radarvol.VolumeReader, "_open", lambda self, path: Counting(opened(self, path)))
    reader = radarvol.VolumeReader({"path": str(tmp_path)}, radarvol.RadarVolumes({"moments": "DBZ"}).schema())
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

    list(reader.pushFilters([EqualTo(("volume_id",), "a"), GreaterThanOrEqual(("ray_idx",), 200), LessThan(("ray_idx",), 210)]))
    (split,) = reader.partitions()
    got = sum(b.num_rows for b in reader.read(split))
    assert got == (sum(counts[200:210]) if ragged else 500)
    assert read[0] < 4096 + 400 + 16 * 500 < (tmp_path / "a.nc").stat().st_size / 4


def test_rays_of_different_lengths_round_trip(spark, tmp_path):
    counts = [3, 0, 50, 1, 50, 7]
    many_rays(tmp_path / "in" / "v.nc", 6, counts=counts)
    many_rays(tmp_path / "in" / "w.nc", 6)
    folder = str(tmp_path / "in")
    gates = volumes.read_gates(spark, folder, ["DBZ", "VEL"]).selectExpr("*", "DBZ AS raw_DBZ")
    assert volumes.write_volumes(gates, volumes.read_rays(spark, folder), volumes.read_sweeps(spark, folder), str(tmp_path / "out"), "packed").count() == 2
    data = {n: netcdf.loads((tmp_path / "out" / f"{n}.nc").read_bytes()) for n in "vw"}
    assert data["v"].variables["DBZ"][0] == ("n_points",) and data["v"].get("ray_n_gates").tolist() == counts and data["w"].variables["DBZ"][0] == ("time", "range")
    back = volumes.read_gates(spark, str(tmp_path / "out"), ["DBZ_L1", "VEL", "UNKNOWN_ID_82"]).orderBy("volume_id", "ray_idx", "gate_idx").collect()
    wanted = gates.orderBy("volume_id", "ray_idx", "gate_idx").collect()
    assert [(r.volume_id, r.ray_idx, r.gate_idx, r.range_m) for r in back] == [(r.volume_id, r.ray_idx, r.gate_idx, r.range_m) for r in wanted]
    assert all(b.DBZ_L1 == (pytest.approx(w.DBZ, abs=0.006) if w.DBZ <= 327.67 else None) and b.UNKNOWN_ID_82 is None for b, w in zip(back, wanted, strict=True))


def test_failed_job_leaves_no_file(spark, tmp_path):
    g = spark.sql(f"SELECT concat('v', id % 8) AS volume_id, 0 AS iy, 0 AS ix, 0D AS y, 0D AS x, CASE WHEN id = 7 THEN cast(raise_error('lost') AS double) ELSE {NO_VALID} END AS DBZ FROM range(8)")
    with pytest.raises(Exception, match="lost"):
        volumes.write_grid(g, str(tmp_path), "ppi", ["DBZ"])
    assert [p for p in tmp_path.rglob("*") if p.is_file()] == []
    # a task that has written files fails: nothing of it is in sight
    writer = radarvol.PieceWriter({"path": str(tmp_path), "job": "j"})
    head = {"volume_id": "v", "field": -1, "piece": 0, "payload": b"head", "plan": '[{"bytes": 8, "piece": 4, "fill": "00000001"}]'}
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([head])
    message = writer.write(iter([batch]))
    assert volumes.read_rays(spark, str(tmp_path)).count() == 0
    writer.abort([message, None])
    assert list(tmp_path.iterdir()) == []
    message = writer.write(iter([batch]))
    writer.commit([message, None])
    assert (tmp_path / "v.nc").read_bytes() == b"head" + b"\0\0\0\1" * 2  # pieces that no row brought
    with pytest.raises(ValueError, match="no header"):
        writer.write(iter([pa.RecordBatch.from_pylist([head | {"field": 0}])]))


def test_large_grid_in_pieces(spark, tmp_path):
    """A grid of millions of cells: no Python worker holds more than a batch of pieces."""
    import resource

    n = (12, 401, 401)
    g = spark.range(n[0] * n[1] * n[2]).selectExpr("'v' AS volume_id", f"int(id div {n[1] * n[2]}) AS iz", f"int(id div {n[2]} % {n[1]}) AS iy", f"int(id % {n[2]}) AS ix", "float(id % 1000) AS DBZ", "float(id % 77) AS VEL")
    g = g.filter("NOT (iz = 3 AND iy BETWEEN 100 AND 300)").selectExpr("*", "500D * iz AS z", "500D * iy AS y", "500D * ix AS x", "double(iy) AS lat", "double(ix) AS lon")
    before = resource.getrusage(resource.RUSAGE_CHILDREN).ru_maxrss
    path = volumes.write_grid(g, str(tmp_path), "volume", ["DBZ", "VEL"]).first().path
    data = netcdf.loads(open(path, "rb").read())
    values = np.arange(np.prod(n)).reshape(n)
    dbz = data.get("DBZ")[0]
    gap = np.isnan(dbz)
    assert gap[3, 100:301].all() and gap.sum() == 201 * 401 and (dbz[~gap] == (values % 1000)[~gap]).all()
    assert (data.get("VEL")[0][~gap] == (values % 77)[~gap]).all() and (data.get("latitude")[0] == np.arange(401)[:, None]).all() and data.get("X")[-1] == 200_000
    assert resource.getrusage(resource.RUSAGE_CHILDREN).ru_maxrss <= max(before, 1_000_000)


def test_many_small_splits_share_tasks():
    split = lambda k: radarvol.Split(f"{k}.nc", str(k), 0, 1)
    small = [(16_384, split(k)) for k in range(10_000)]
    tasks = radarvol.together(small)
    assert [s for t in tasks for s in t.held] == [s for _, s in small]
    assert radarvol.TASKS <= len(tasks) < 2 * radarvol.TASKS
    many = radarvol.together([(1 << 20, split(k)) for k in range(10_000)])
    assert max(len(t.held) for t in many) == radarvol.SPLIT >> 20
    assert [len(t.held) for t in radarvol.together(small[:100])] == [1] * 100
    assert [len(t.held) for t in radarvol.together([(100 << 20, split(k)) for k in range(300)])] == [1] * 300
    assert radarvol.together([]) == []
