"""Every registered radar query against its SQL in DuckDB, and properties of the operators."""

import math
import random
from datetime import datetime, timedelta
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from beamgrid import model
from beamgrid.functions import geometry as G
from beamgrid.operators import grid, qc, terrain
from beamgrid.plans import radar_queries, registry
from beamgrid.sources import profiles

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, db, name):
    got = registry.queries()[name](spark, SF)
    wanted = db.sql(registry.oracle_sql()[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(wanted.fetchall(), key=repr)


def line(spark, values, **more):
    rows = [("v", 0, i, None if v is None else float(v), 5.0) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "volume_id string, ray_idx int, gate_idx int, dbz double, vel double")


def column(df, name, by="gate_idx"):
    return [r[name] for r in df.orderBy(by).collect()]


def test_despeckle_leaves_the_last_gate(spark):
    assert column(qc.despeckle(line(spark, [1, None, 1, 1, 1, None, 1, 1]), ["dbz"], 2), "dbz") == [None, None, 1, 1, 1, None, None, 1]
    assert column(qc.despeckle(line(spark, [None, None, 1]), ["dbz"], 3), "dbz") == [None, None, 1]
    with pytest.raises(ValueError):
        qc.despeckle(line(spark, [1]), ["dbz"], 0)


@pytest.mark.parametrize("seed", range(3))
def test_despeckle_against_a_loop(spark, seed):
    rng = random.Random(seed)
    n = rng.randint(1, 4)
    values = [rng.choice([None, 1.0]) for _ in range(60)]
    wanted, i = list(values), 0
    while i < 59:
        j = i
        while j < 59 and values[j] is not None:
            j += 1
        if 0 < j - i <= n:
            wanted[i:j] = [None] * (j - i)
        i = max(j, i + 1)
    assert column(qc.despeckle(line(spark, values), ["dbz"], n), "dbz") == wanted


def test_thresholds_and_missing(spark):
    g = line(spark, [1, None, float("nan"), 9])
    assert column(qc.threshold_below(g, ["vel"], F.col("dbz"), 5.0), "vel") == [None, 5, 5, 5]
    assert column(qc.threshold_above(g, ["vel"], F.col("dbz"), 5.0), "vel") == [5, None, None, None]
    once = qc.threshold_below(g, ["vel"], F.col("dbz"), 5.0)
    assert column(qc.threshold_below(once, ["vel"], F.col("dbz"), 5.0), "vel") == column(once, "vel")


def test_phidp_window_with_a_missing_gate(spark):
    g = line(spark, [1, 1, None, 1, 1, 1, 50])
    assert column(qc.phidp_std_mask(g, ["vel"], "dbz", 3, 12.0), "vel") == [5, None, None, None, 5, None, None]
    assert column(qc.phidp_std_mask(g, ["vel"], "dbz", 1, 12.0), "vel") == [None] * 7
    with pytest.raises(ValueError):
        qc.phidp_std_mask(g, ["vel"], "dbz", 4)


def test_folds_once(spark):
    row = spark.createDataFrame([(55.0,), (-55.0,), (None,)], "v double")
    out = row.select(qc.unfold(F.col("v"), *(F.lit(0.0),) * 5, F.lit(20.0)).alias("u")).collect()
    assert [r.u for r in out] == [15.0, -15.0, None]


@pytest.mark.parametrize("lat0", [80.58, 88.02, 89.57, 89.88])
def test_places_next_to_a_pole(spark, lat0):
    """The places of cells around a reference next to the pole, and beyond it, project to their cells again."""
    cells = spark.range(26).crossJoin(spark.range(21).withColumnRenamed("id", "i")).selectExpr("1000D * id AS y", "1000D * i AS x")
    lat, lon = G.tm_inverse(F.col("x"), F.col("y"), F.lit(lat0), F.lit(-113.9))
    x, y = G.tm_forward(F.col("lat"), F.col("lon"), lat0, -113.9)
    far = cells.withColumns({"lat": lat, "lon": lon}).withColumns({"px": x, "py": y}).select(F.max(F.hypot(F.col("px") - F.col("x"), F.col("py") - F.col("y"))), F.max(F.abs("lat"))).first()
    assert far[0] < 0.01 and far[1] <= 90


@pytest.mark.parametrize(("lat0", "lon0"), [(0.0, 0.0), (35.2, -120.4), (-44.9, 170.1)])
def test_projection_round_trip(spark, lat0, lon0):
    rng = random.Random(3)
    rows = [(lat0 + rng.uniform(-2, 2), lon0 + rng.uniform(-2, 2)) for _ in range(50)]
    df = spark.createDataFrame(rows, "lat double, lon double")
    x, y = G.tm_forward(F.col("lat"), F.col("lon"), lat0, lon0)
    held = df.withColumns({"x": x, "y": y})
    lat, lon = G.tm_inverse(F.col("x"), F.col("y"), lat0, lon0)
    for r in held.withColumns({"lat2": lat, "lon2": lon}).collect():
        assert abs(r.lat - r.lat2) < 1e-9 and abs(r.lon - r.lon2) < 1e-9
    # along the meridian y is the arc, here by quadrature
    e2 = G.WGS84_F * (2 - G.WGS84_F)
    n = 20_000
    step = math.radians(lat0 + 1) / n
    arc = sum(G.WGS84_A * (1 - e2) / (1 - e2 * math.sin((k + 0.5) * step) ** 2) ** 1.5 for k in range(n)) * step
    assert abs(G.meridian_arc(lat0 + 1) - arc) < 0.01


def test_constant_field_grids_to_itself(spark):
    rows = [("v", r, g, 300.0 * (g + 1), float(r), 1.0, 0.0, 0.0, 0.0, 12.5, 3.0, 1.0) for r in range(90) for g in range(20)]
    g = spark.createDataFrame(rows, "volume_id string, ray_idx int, gate_idx int, range_m double, azimuth double, elevation double, altitude double, x0 double, y0 double, dbz double, vel double, sqi double")
    for kind in ("linear", "weighted", "nearest"):
        out = grid.grid_volume(g, {"dbz": kind}, (0, 500, 9), (0, 500, 9), (0, 100, 4), 500, 100, 0.01, 0.5)
        values = [r.dbz for r in out.collect()]
        assert len(values) == 324 and any(abs(v - 12.5) < 1e-9 for v in values)
        assert all(abs(v - 12.5) < 1e-9 or v in (model.NO_VALID, model.UNSEEN) for v in values)
    best = grid.grid_composite(g.withColumn("dbz", F.col("gate_idx").cast("double")), ["dbz"], (0, 500, 9), (0, 500, 9), 500, 0.0).collect()
    for r in best:
        near = [q for q in rows if math.hypot(q[3] * math.sin(math.radians(q[4])) - r.x, q[3] * math.cos(math.radians(q[4])) - r.y) < 495]
        assert r.dbz >= max((q[2] for q in near), default=model.UNSEEN)


def flying(spark, n_rays=90, n_gates=30, volumes=2):
    """(gates, rays) of volumes that begin at places of their own and move from ray to ray."""
    rays = [(f"v{v}", r, 4.0 * r, 0.5, 10.0, 10.26 + 0.5 * v + 1e-4 * r, -20.26 - 0.25 * v + 1e-4 * r) for v in range(volumes) for r in range(n_rays)]
    gates = [(f"v{v}", r, g, 100.0 * (g + 1), 7.0 + v, 1.0) for v in range(volumes) for r in range(n_rays) for g in range(n_gates)]
    return spark.createDataFrame(gates, "volume_id string, ray_idx int, gate_idx int, range_m double, dbz double, sqi double"), spark.createDataFrame(rays, "volume_id string, ray_idx int, azimuth double, elevation double, altitude double, latitude double, longitude double")


def test_latlon_volume(spark):
    gates, rays = flying(spark)
    out = grid.radar_latlon_volume(gates, rays, {"dbz": "weighted"}, -0.02, 5, -0.02, 5, 0.01, (0, 100, 2), 0.01, 0.1).collect()
    assert len(out) == 100
    for v, lat, lon in (("v0", 10.24, -20.28), ("v1", 10.74, -20.53)):
        own = [r for r in out if r.volume_id == v]
        assert min(r.lat for r in own) == pytest.approx(lat) and min(r.lon for r in own) == pytest.approx(lon)
        assert any(abs(r.dbz - 7.0 - (v == "v1")) < 1e-9 for r in own)


def test_cut(spark):
    rows = spark.createDataFrame([(12.3456,), (-12.3456,), (0.3,), (-7.0,), (0.004,)], "v double").select(grid.cut(F.col("v"), 0.01).alias("c"), "v").collect()
    assert [round(r.c, 9) for r in rows] == [12.34, -12.34, 0.3, -7.0, 0.0]


def test_reference_is_the_first_ray(spark):
    gates, rays = flying(spark)
    own = {r.volume_id: r for r in grid.reference(rays.orderBy(F.desc("ray_idx"))).collect()}
    assert own["v1"].lat0 == 10.76 and own["v1"].lon0 == -20.51 and own["v1"].az_first == 0
    placed = grid.placed(gates, rays).filter("gate_idx = 0").collect()
    assert all(abs(r.x0) < 1e-6 and abs(r.y0) < 1e-6 for r in placed if r.ray_idx == 0)
    r = next(r for r in placed if r.volume_id == "v1" and r.ray_idx == 80)
    assert r.y0 == pytest.approx(0.008 * 110_620, rel=1e-3) and r.x0 == pytest.approx(0.008 * 109_370, rel=1e-3)


def test_projection_against_a_published_point(spark):
    # 33.3 N 44.4 E in zone 38 (central meridian 45 E, scale 0.9996, false easting 500 km)
    x, y = G.tm_forward(F.lit(33.3), F.lit(44.4), F.lit(0.0), F.lit(45.0))
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert (0.9996 * r.x + 500_000, 0.9996 * r.y) == (pytest.approx(444140.54, abs=0.01), pytest.approx(3684706.36, abs=0.01))
    arc = spark.range(1).select(G.meridian_arc(F.lit(-35.2))).first()[0]
    assert arc == pytest.approx(G.meridian_arc(-35.2), abs=1e-6)


@pytest.mark.parametrize(("inflation", "roi"), [(0.01, 700.0), (0.3, 700.0), (0.0, 400.0), (1.2, 100.0)])
def test_cells_of_a_gate(spark, inflation, roi):
    """Index ranges give every pair that comparing all gates with all cells gives."""
    rng = random.Random(1)
    places = [(k, rng.uniform(-9000, 9000), rng.uniform(-9000, 9000)) for k in range(60)] + [(98, None, 0.0), (99, float("nan"), 0.0)]
    g = spark.createDataFrame(places, "k int, gx double, gy double")
    x, y = (-5000.0, 500.0, 20), (-4000.0, 800.0, 11)
    got = sorted((r.k, r.iy, r.ix) for r in grid.near_cells(g, x, y, roi, inflation).select("k", "iy", "ix").collect())
    wanted = [(k, -1, -1) for k, _, _ in places]
    for k, gx, gy in places[:60]:
        for iy in range(11):
            for ix in range(20):
                cx, cy = -5000 + 500 * ix, -4000 + 800 * iy
                wanted += [(k, iy, ix)] if math.hypot(gx - cx, gy - cy) <= max(roi, inflation * math.hypot(cx, cy)) else []
    assert got == sorted(wanted)


@pytest.mark.parametrize(("lat0", "lon0"), [(0.3, 179.9), (-60.2, 10.0), (88.9, 0.0)])
def test_degree_cells_of_a_gate(spark, lat0, lon0):
    """Ranges of degrees, too: far from the equator, over the date line and near a pole."""
    rng = random.Random(2)
    places = [(k, rng.uniform(-30000, 30000), rng.uniform(-30000, 30000), lat0, lon0) for k in range(40)]
    g = spark.createDataFrame(places, "k int, gx double, gy double, lat0 double, lon0 double")
    lat, lon = (F.col("lat0") - 0.2, 0.05, 9), (F.col("lon0") - 0.4, 0.1, 9)
    pairs = grid.near_degrees(g, lat, lon, F.lit(4000.0), 0.1)
    got = sorted((r.k, r.iy, r.ix) for r in pairs.filter("iy >= 0").select("k", "iy", "ix").collect())
    cells = spark.range(81).selectExpr("cast(id div 9 as int) iy", "cast(id % 9 as int) ix").selectExpr("*", f"{lat0} - 0.2 + 0.05 * iy AS lat", f"{lon0} - 0.4 + 0.1 * ix AS lon")
    cx, cy = G.tm_forward(F.col("lat"), F.col("lon"), lat0, lon0)
    cells = [(r.iy, r.ix, r.x, r.y) for r in cells.withColumns({"x": cx, "y": cy}).collect()]
    wanted = [(k, iy, ix) for k, gx, gy, *_ in places for iy, ix, x, y in cells if math.hypot(gx - x, gy - y) <= max(4000.0, 0.1 * math.hypot(x, y))]
    assert got == sorted(wanted) and len(wanted) > 20


def test_plan_has_one_scan_and_no_join(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").write.parquet(f"{tmp_path}/events.parquet")
    for name, exchanges in (("grid_volume", 2), ("grid_composite", 2), ("grid_ppi_sweeps", 2), ("grid_column", 2)):
        plan = registry.queries()[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and "Join" not in plan and plan.count("Exchange") == exchanges, name


def test_default_volume_grid(spark):
    gates, rays = flying(spark, 20, 200, 1)
    out = grid.radar_volume(gates, rays, {"dbz": "linear"}, model.X, model.Y, model.Z, model.BEAM_INFLATION, model.POWER_THRESHOLD)
    r = out.agg(F.count(F.lit(1)), F.countDistinct("iz", "iy", "ix"), F.count_if(F.col("dbz") > model.UNSEEN), F.max("lat"), F.min("lat")).first()
    assert r[0] == r[1] == 501 * 501 * 37 and r[2] > 0
    assert r[3] == pytest.approx(10.26 + 125 / 110.6, abs=0.01) and r[4] == pytest.approx(10.26 - 125 / 110.6, abs=0.01)


def test_odd_gates(spark):
    """Missing and NaN places reach no cell, repeated gates count twice, volumes keep their grids."""
    one = ("v", 0, 0, 500.0, 0.0, 0.5, 0.0, 0.0, 0.0, 10.0, 1.0)
    rows = [one, one, ("v", 0, 1, None, 0.0, 0.5, 0.0, 0.0, 0.0, 99.0, 1.0), ("v", 0, 2, 500.0, float("nan"), 0.5, 0.0, 0.0, 0.0, 99.0, 1.0), ("w", 0, 0, 9e6, 0.0, 0.5, 0.0, 0.0, 0.0, 99.0, 1.0), (None, 0, 0, 9e6, 0.0, 0.5, 0.0, 0.0, 0.0, 99.0, 1.0)]
    g = spark.createDataFrame(rows, "volume_id string, ray_idx int, gate_idx int, range_m double, azimuth double, elevation double, altitude double, x0 double, y0 double, dbz double, sqi double")
    out = grid.grid_composite(g, ["dbz"], (0, 500, 2), (0, 500, 2), 100, 0.0).collect()
    assert len(out) == 12 and {r.dbz for r in out if r.volume_id == "v" and r.iy == 1 and r.ix == 0} == {10.0}
    assert all(r.dbz == model.UNSEEN for r in out if r.volume_id != "v")
    assert grid.grid_composite(g.limit(0), ["dbz"], (0, 500, 2), (0, 500, 2), 100, 0.0).collect() == []


def test_terrain(spark, tmp_path):
    import numpy as np

    for name, heights in {"N01E002": np.arange(9).reshape(3, 3), "S02W001": np.full((3, 3), -32768)}.items():
        heights.astype(">i2").tofile(tmp_path / f"{name}.hgt")
    dem = terrain.read_tiles(spark, str(tmp_path))
    assert [(r.tile, r.block_row, r.block_col, len(r.heights)) for r in dem.collect()] == [("N01E002", 0, 0, terrain.BLOCK**2)]  # the other tile is void
    places = spark.createDataFrame([(1, 1.99, 2.01), (2, 1.0, 2.5), (3, -1.5, -0.5), (4, 40.0, 40.0), (5, -2.0, -1.0)], "k int, lat double, lon double")
    out = {r.k: r.terrain_m for r in terrain.terrain_height(places, dem, "lat", "lon", 3).collect()}
    assert out == {1: 0.0, 2: 7.0, 3: -1.0, 4: -1.0, 5: -1.0}
    names = places.select("k", G.tile_name(F.col("lat"), F.col("lon")).alias("t")).collect()
    assert {r.k: r.t for r in names} == {1: "N01E002", 2: "N01E002", 3: "S02W001", 4: "N40E040", 5: "S03W002"}


def test_terrain_of_a_full_tile(spark, tmp_path):
    import numpy as np

    side = 1201
    heights = (np.arange(side * side).reshape(side, side) % 4001).astype(np.int16)
    heights[700, 800] = terrain.VOID
    heights.astype(">i2").tofile(tmp_path / "N10W021.hgt")
    dem = terrain.read_tiles(spark, str(tmp_path))
    assert dem.count() == 100
    rng = random.Random(1)
    at = [(r, c) for r, c in ((rng.randrange(1, side - 1), rng.randrange(1, side - 1)) for _ in range(200))] + [(700, 800)]
    places = spark.createDataFrame([(r, c, 11 - r / 1200, -21 + c / 1200) for r, c in at], "r int, c int, lat double, lon double")
    got = {(x.r, x.c): x.terrain_m for x in terrain.terrain_height(places, dem, "lat", "lon", side).collect()}
    assert got == {(r, c): -1.0 if (r, c) == (700, 800) else float(heights[r, c]) for r, c in at}
    posts = spark.createDataFrame([("t", 5, 300, 7), ("t", 6, 0, None), ("t", 0, 1, -3)], "tile string, row int, col int, elevation_m int")
    own = {(r.block_row, r.block_col): r.heights for r in terrain.blocks(posts).collect()}
    assert own[0, 2][5 * 128 + 44] == 7 and own[0, 0][1] == -3 and own[0, 0][6 * 128] == terrain.VOID


@pytest.mark.parametrize("profile", sorted(profiles.PROFILES))
def test_profile_round_trip(spark, profile):
    rows = [("v", 0, 0, 1.0, 12.34, -3.2, None), ("v", 0, 1, 2.0, None, float("nan"), 1.5)]
    g = spark.createDataFrame(rows, "volume_id string, ray_idx int, gate_idx int, range_m double, DBZ double, VEL double, WIDTH double")
    back = profiles.read_profile(profiles.apply_profile(g, profile), profile).orderBy("gate_idx").collect()
    assert back[0].DBZ == pytest.approx(12.34, abs=0.006) and back[0].VEL == pytest.approx(-3.2, abs=0.006)
    assert back[1].DBZ is None and back[0].WIDTH is None and back[1].WIDTH == pytest.approx(1.5, abs=0.006)


def test_model(spark):
    schema = model.gates_schema(["DBZ", "ODD"])
    assert schema["DBZ"].metadata["units"] == "dBZ" and schema["ODD"].metadata["units"] == "unknown"
    rays = spark.createDataFrame([("v", i, i * 2) for i in range(6)], "volume_id string, ray_idx int, t int")
    sweeps = spark.createDataFrame([("v", 0, 0, 2), ("v", 1, 3, 4)], "volume_id string, sweep_idx int, start_ray int, end_ray int")
    out = model.split_sweeps(rays, sweeps).orderBy("ray_idx").collect()
    assert [(r.ray_idx, r.sweep_idx) for r in out] == [(0, 0), (1, 0), (2, 0), (3, 1), (4, 1)]


def test_every_sweep_is_gridded(spark):
    d = "/root/testdata/sf0.01"
    out = registry.queries()["grid_ppi_sweeps"](spark, d).groupBy("sweep_idx").count().collect()
    n = spark.read.parquet(f"{d}/events.parquet").select(F.floor(F.col("event_id") / 5000)).distinct().count()
    assert n > 1 and {r["count"] for r in out} == {26 * 21} and len(out) == n


def test_every_azimuth_is_gridded(spark):
    out = registry.queries()["grid_rhi_azimuths"](spark, "/root/testdata/sf0.01").groupBy("azimuth_idx").count().collect()
    assert {r["count"] for r in out} == {9 * 51} and sorted(r.azimuth_idx for r in out) == list(range(50))


def same_as_sql(spark, folder, name, events):
    """A query over events (event_id, event_type, value) against its SQL."""
    rows = [(i, datetime(2024, 1, 1) + timedelta(seconds=i % 86400), 1, t, float(v), "") for i, t, v in events]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{folder}/events.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    wanted = c.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, str(folder)).select(*(x[0] for x in wanted.description))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(wanted.fetchall(), key=repr)


def test_linear_values_at_the_edge_of_rounding(spark, tmp_path):
    edges = [75.47271339912272, 311.9258050166876, 477.79327335417514, 319.220089617953, 549.4411036199127]
    same_as_sql(spark, tmp_path, "db_linear", [(i, "click", v) for i, v in enumerate(edges)])


def test_power_of_ten(spark):
    values = [0.0, 1.0, 3.0, -1.0, 6.546271339912272, 22.0, -22.5, 300.1, -300.1, 308.2, 1e6, -1e6]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "y double").select(G.power_of_ten(F.col("y"))).collect()]
    for y, p in zip(values, got, strict=True):
        assert p == (float(Decimal(10) ** Decimal(y)) if y < 309 else math.inf)
    assert spark.range(1).select(G.power_of_ten(F.lit(None).cast("double")), F.isnan(G.power_of_ten(F.lit(float("nan"))))).first()[:] == (None, True)


@pytest.mark.parametrize("sweep", [298, 880])
def test_degree_grid_beyond_a_pole(spark, tmp_path, sweep):
    """The sweep's latitudes lie next to 90 and beyond 270 degrees."""
    same_as_sql(spark, tmp_path, "radar_latlon_volume", [(sweep * 5000 + i, "click", i * 7.3 % 120) for i in range(5000)])


@pytest.mark.parametrize("name", ["grid_volume", "grid_rhi_azimuths", "grid_composite", "grid_column", "grid_ppi_sweeps"])
def test_tasks_hold_bounded_numbers_of_gates(spark, monkeypatch, name):
    """Gates dealt to many tasks give the same grid."""
    wanted = registry.queries()[name](spark, SF)
    monkeypatch.setattr(grid, "TASK_GATES", 100)
    monkeypatch.setattr(grid, "TASK_RAYS", 1)
    dealt = grid._dealt(radar_queries.volume(spark, SF), None, ["volume_id", "ray_idx", "gate_idx"])
    sizes = [r[0] for r in dealt.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert dealt.rdd.getNumPartitions() == 10 and sum(sizes) == 1000 and max(sizes) <= 500
    assert sorted(map(tuple, registry.queries()[name](spark, SF).collect())) == sorted(map(tuple, wanted.collect()))


def test_degree_grid_files_beyond_a_pole(spark, tmp_path):
    same_as_sql(spark, tmp_path, "latlon_grid_files", [(880 * 5000 + i, "click", i * 7.3 % 120) for i in range(5000)])


def test_places_over_one_block_are_parted(spark, monkeypatch):
    """Places that meet one block of posts are taken by several tasks; those without a place go anywhere."""
    monkeypatch.setattr(terrain, "PART_PLACES", 50)
    dem = terrain.blocks(spark.createDataFrame([("N01E002", r, c, 10 * r + c) for r in range(3) for c in range(3)], "tile string, row int, col int, elevation_m int"))
    places = spark.range(1000).selectExpr("id", "CASE WHEN id % 5 < 4 THEN 1.001D + id % 9 / 10D END AS lat", "2.001D + id % 7 / 10D AS lon", "map('a', id) AS m")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(kept, ("-1", "false", "16"), strict=True):
            spark.conf.set(k, v)
        rows = terrain.terrain_height(places, dem, "lat", "lon", 3).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert len(rows) == 1000 and len({r.id for r in rows}) == 1000
    at = lambda v: math.floor(v + 0.5)
    assert all(r.terrain_m == (-1.0 if r.lat is None else 10.0 * at((math.ceil(r.lat) - r.lat) * 2) + at((r.lon - math.floor(r.lon)) * 2)) for r in rows)
    most = [sum(r.task == k and (r.lat is None) == none for r in rows) for k in range(16) for none in (True, False)]
    assert max(most) <= 400


def test_deal_without_sorting():
    """Tables of up to 400 times TASK_GATES are dealt without a sort; no task ever gets more than twice TASK_GATES on average."""
    assert [grid._tasks(n) for n in (0, 1, grid.TASK_GATES, grid.TASK_GATES + 1)] == [0, 1, 1, 2]
    assert grid._tasks(36_000_000) == grid.UNSORTED == grid._tasks(400 * grid.TASK_GATES)
    assert all(grid._tasks(n) * 2 * grid.TASK_GATES >= n for n in (36_000_000, 10**9, 10**12))
