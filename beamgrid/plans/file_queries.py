"""Queries on projections, the drivers of the grids, files and arriving volumes, each with SQL that gives the same rows.

They use the volume of radar_queries. Rays lie on a slant line of latitudes and longitudes where a moving platform is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beamgrid import model
from beamgrid.functions import geometry as G
from beamgrid.operators import grid
from beamgrid.plans import radar_queries as R
from beamgrid.plans.radar_queries import INFLATION, KINDS, POWER, X, Y, Z, volume
from beamgrid.sources import radarvol, volumes
from beamgrid.sources.scratch import scratch
from beamgrid.streaming import state
from beamgrid.streaming.arrivals import grid_arrivals

LAT0, LON0 = -2.5, -45.25
LEVELS = (0.0, 250.0, 9)
LAT, LON, STEP = (0.0, 16), (0.0, 18), 0.01


def _moving(g: DataFrame) -> DataFrame:
    """gates on a platform that moves ray by ray."""
    return g.withColumns({"latitude": LAT0 + 0.013 * (F.col("ray_idx") % 50), "longitude": LON0 + 0.017 * (F.col("ray_idx") % 37) - 0.003 * F.col("gate_idx")})


def place_radar(spark: SparkSession, d: str) -> DataFrame:
    """The place of each gate's platform in metres from the reference."""
    g = grid.place_radar(_moving(volume(spark, d)), LAT0, LON0)
    return g.select("ray_idx", "gate_idx", *(R._r(F.col(c), 3).alias(c) for c in ("x0", "y0")))


def tm_inverse(spark: SparkSession, d: str) -> DataFrame:
    """Projected and projected back: the places are those that went in."""
    g = grid.place_radar(_moving(volume(spark, d)), LAT0, LON0)
    lat, lon = G.tm_inverse(F.col("x0"), F.col("y0"), LAT0, LON0)
    return g.select("ray_idx", "gate_idx", R._r(lat, 8).alias("latitude"), R._r(lon, 8).alias("longitude"))


def _rays(g: DataFrame, *more: str) -> DataFrame:
    first = [F.min_by(c, "gate_idx").alias(c) for c in ("time", "azimuth", "elevation", *more)]
    return g.groupBy("volume_id", "sweep_idx", "ray_idx").agg(*first)


def join_rays(spark: SparkSession, d: str) -> DataFrame:
    """A gates table without angles gets those of its rays."""
    g = volume(spark, d)
    gates = g.select("volume_id", "ray_idx", "gate_idx", "range_m", "dbz")
    out = model.join_rays(gates, _rays(g), ["azimuth", "elevation", "time"])
    return out.select("ray_idx", "gate_idx", "azimuth", "elevation", "time", R._r(F.col("dbz")).alias("dbz"))


def _flying(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(gates, rays) of sweeps as volumes, each begun elsewhere, whose platform moves from ray to ray."""
    g = volume(spark, d).withColumn("volume_id", F.col("sweep_idx"))
    g = g.withColumns({"latitude": LAT0 + 0.31 * F.col("sweep_idx") + 0.0004 * (F.col("ray_idx") % 50), "longitude": LON0 - 0.23 * F.col("sweep_idx") + 0.0006 * (F.col("ray_idx") % 37)})
    rays = g.filter("gate_idx = 0").select("volume_id", "ray_idx", "azimuth", "elevation", "altitude", "latitude", "longitude")
    return g.drop("azimuth", "elevation", "altitude", "latitude", "longitude", "x0", "y0"), rays


def _driven(df: DataFrame, keys: list[str], moments=KINDS) -> DataFrame:
    return df.withColumnRenamed("volume_id", "sweep_idx").select("sweep_idx", *keys, *(R._r(F.col(c), 6).alias(c) for c in ("lat", "lon")), *(R._r(F.col(m)).alias(m) for m in moments))


def radar_volume(spark: SparkSession, d: str) -> DataFrame:
    return _driven(grid.radar_volume(*_flying(spark, d), KINDS, X, Y, Z, INFLATION, POWER), ["iz", "iy", "ix"])


def radar_composite(spark: SparkSession, d: str) -> DataFrame:
    return _driven(grid.radar_composite(*_flying(spark, d), list(KINDS), X, Y, INFLATION), ["iy", "ix"])


def radar_column(spark: SparkSession, d: str) -> DataFrame:
    return _driven(grid.radar_column(*_flying(spark, d), KINDS, Z, INFLATION, POWER), ["iz"])


def grid_ppi(spark: SparkSession, d: str) -> DataFrame:
    return _driven(grid.radar_ppi(*_flying(spark, d), KINDS, X, Y, INFLATION, POWER), ["iy", "ix"])


def grid_rhi(spark: SparkSession, d: str) -> DataFrame:
    return _driven(grid.radar_rhi(*_flying(spark, d), KINDS, R.R, Z, INFLATION, POWER), ["iz", "ir"])


def radar_latlon_volume(spark: SparkSession, d: str) -> DataFrame:
    return _driven(grid.radar_latlon_volume(*_flying(spark, d), KINDS, *LAT, *LON, STEP, LEVELS, INFLATION, POWER), ["iz", "ilat", "ilon"])


def radar_arrays(spark: SparkSession, d: str) -> DataFrame:
    """The platform's place, the beam and the place of every gate, each sweep from its own reference."""
    g = grid.locate(grid.placed(*_flying(spark, d)))
    shown = {"lat0": 8, "lon0": 8, "x0": 3, "y0": 3, "az": 8, "el": 8, "range_m": 3, "h": 3, "gx": 3, "gy": 3}
    return g.select(F.col("volume_id").alias("sweep_idx"), "ray_idx", "gate_idx", *(R._r(F.col(c), n).alias(c) for c, n in shown.items()))


def volume_reference(spark: SparkSession, d: str) -> DataFrame:
    """The reference of every sweep by its first ray, and the same cut to tenths of a degree."""
    _, rays = _flying(spark, d)
    cut = grid.reference(rays, 0.1).select("volume_id", F.col("lat0").alias("lat_cut"), F.col("lon0").alias("lon_cut"))
    out = grid.reference(rays).join(cut, "volume_id")
    return out.select(F.col("volume_id").alias("sweep_idx"), *(R._r(F.col(c), 8).alias(c) for c in ("lat0", "lon0", "az_first", "lat_cut", "lon_cut")))


def _by_sweep(g: DataFrame) -> DataFrame:
    return g.withColumn("volume_id", F.concat(F.lit("s"), F.col("sweep_idx").cast("string")))


def _sweep_files(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(gates with all columns, rays, sweeps): every sweep a volume with rays from 0, as files hold them."""
    g = _by_sweep(volume(spark, d))
    start = F.min("ray_idx").over(R.qc.Window.partitionBy("volume_id"))
    g = g.withColumn("ray", (F.col("ray_idx") - start).cast("int")).drop("ray_idx").withColumnRenamed("ray", "ray_idx")
    extra = {"scan_name": F.lit("SUR"), "latitude": F.lit(LAT0), "longitude": F.lit(LON0), "pitch": F.col("elevation") / 4, "roll": F.col("azimuth") / 8 - 2}
    rays = _rays(g.withColumns(extra), "altitude", "nyquist_velocity", "ew_platform", "ns_platform", "w_platform", "heading", *extra).withColumn("time", F.col("time").cast("timestamp"))
    sweeps = g.groupBy("volume_id", F.lit(0).alias("sweep_idx")).agg(F.min("elevation").alias("fixed_angle"), F.min("ray_idx").alias("start_ray"), F.max("ray_idx").alias("end_ray"))
    return g, rays, sweeps


def _written(spark: SparkSession, d: str, profile: str, columns: list[str]) -> str:
    """The folder of sweeps written by a profile; columns: SQL of its fields."""
    g, rays, sweeps = _sweep_files(spark, d)
    if profile == "airborne":
        rays = rays.selectExpr("*", "azimuth / 16 AS drift", "elevation / 2 AS tilt", "azimuth - 20 AS eastward_wind", "2.5D AS northward_wind", "elevation - 1 AS vertical_wind")
    folder = scratch(spark, profile)
    volumes.write_volumes(g.selectExpr("volume_id", "ray_idx", "gate_idx", "range_m", *columns), rays, sweeps, folder, profile)
    return folder


def volume_files(spark: SparkSession, d: str) -> DataFrame:
    """Every sweep written as a packed file with its rays, and read back."""
    folder = _written(spark, d, "packed", ["dbz AS DBZ", "width AS WIDTH", "dbz AS raw_DBZ", "snr AS raw_SNR"])
    back = volumes.read_gates(spark, folder, ["DBZ", "WIDTH", "DBZ_L1", "SNR"])
    own = volumes.read_rays(spark, folder).select("volume_id", "ray_idx", "azimuth", "elevation")
    out = back.join(own, ["volume_id", "ray_idx"])
    return out.select("volume_id", "ray_idx", "gate_idx", F.col("azimuth").cast("double").alias("azimuth"), F.col("elevation").cast("double").alias("elevation"), *(R._r(F.col(c), 3).alias(c.lower()) for c in ("DBZ", "WIDTH", "DBZ_L1", "SNR")))


def volume_source(spark: SparkSession, d: str) -> DataFrame:
    """The same files read by the data source in splits of 16 kB: gates with their sweep, rays with the platform's attitude."""
    folder = _written(spark, d, "packed", ["vel AS VEL", "sqi AS raw_SQI"])
    radarvol.register(spark)
    source = lambda **options: spark.read.format("radarvol").options(**options)
    gates = source(split_bytes=16384).schema("volume_id string, ray_idx int, sweep_idx int, gate_idx int, range_m float, VEL double, SQI double").load(folder)
    rays = source(table="rays").load(folder).select("volume_id", "ray_idx", "heading", "pitch", "roll", "time")
    sweeps = source(table="sweeps").load(folder).select("volume_id", "sweep_idx", "fixed_angle")
    out = gates.join(rays, ["volume_id", "ray_idx"]).join(sweeps, ["volume_id", "sweep_idx"])
    shown = [R._r(F.col(c).cast("double"), 3).alias(c) for c in ("range_m", "heading", "pitch", "roll", "fixed_angle")]
    return out.select("volume_id", "ray_idx", "gate_idx", *shown, F.col("time").cast("timestamp_ntz").alias("time"), R._r(F.col("VEL"), 3).alias("vel"), R._r(F.col("SQI"), 3).alias("sqi"))


_POLARIMETRIC = ["DBZ_TOT", "DBZ", "VEL", "RATE_ZH", "SQI_FOR_MASK", "HID_CSU", "RATE_CSU_BLENDED", "TEMP_FOR_PID", "ZDR_L2"]


def polarimetric_files(spark: SparkSession, d: str) -> DataFrame:
    """Every sweep written by the two polarimetric profiles and read back; fields that a profile only declares are missing."""
    columns = ["dbz AS raw_DBZ_TOT", "dbz AS DBZ", "vel AS VEL", "width AS RATE_ZH", "sqi AS SQI_FOR_MASK", "floor(width) AS HID_CSU", "snr AS RATE_CSU_BLENDED", "phidp AS raw_TEMP_FOR_PID", "rhohv AS raw_ZDR_L2"]
    parts = [volumes.read_gates(spark, _written(spark, d, p, columns), _POLARIMETRIC).withColumn("profile", F.lit(p)) for p in ("single_pol", "dual_pol")]
    return parts[0].union(parts[1]).select("profile", "volume_id", "ray_idx", "gate_idx", *(R._r(F.col(c), 3).alias(c.lower()) for c in _POLARIMETRIC))


def airborne_files(spark: SparkSession, d: str) -> DataFrame:
    """Every sweep written by the airborne profile; the variables of its rays read back."""
    folder = _written(spark, d, "airborne", ["dbz AS DBZ", "vel AS VEL", "width AS WIDTH", "dbz AS raw_DBZ_TOT"])
    own = ["rotation", "drift", "tilt", "track", "eastward_wind", "northward_wind", "vertical_wind"]
    said = volumes.read_extras(spark, folder).filter(F.col("name").isin(own)).select("volume_id", "name", F.posexplode("numbers").alias("ray_idx", "v"))
    wide = said.groupBy("volume_id", "ray_idx").pivot("name", own).agg(F.first("v"))
    gates = volumes.read_gates(spark, folder, ["DBZ_TOT", "VEL"]).join(wide, ["volume_id", "ray_idx"])
    return gates.select("volume_id", "ray_idx", "gate_idx", *(R._r(F.nanvl(F.col(c), F.lit(None).cast("double")), 4).alias(c) for c in own), R._r(F.col("DBZ_TOT"), 3).alias("dbz_tot"), R._r(F.col("VEL"), 3).alias("vel"))


def _grid_back(spark: SparkSession, grids: DataFrame, layout: str, keys: list[str]) -> DataFrame:
    folder = scratch(spark, layout)
    volumes.write_grid(grids.withColumns({m: R._r(F.col(m)) for m in KINDS}), folder, layout, list(KINDS))
    return volumes.read_grid(spark, folder, layout, list(KINDS)).select("volume_id", *keys, *(R._r(F.col(m), 3).alias(m) for m in KINDS))


def volume_grid_files(spark: SparkSession, d: str) -> DataFrame:
    """The volume grids of all sweeps through files."""
    out = grid.grid_volume(_by_sweep(volume(spark, d)), KINDS, X, Y, Z, R.H_ROI, R.V_ROI, INFLATION, POWER)
    return _grid_back(spark, out, "volume", ["iz", "iy", "ix", "z", "y", "x"])


def cartesian_grid_files(spark: SparkSession, d: str) -> DataFrame:
    """The same in the other tool's layout of files."""
    out = grid.grid_volume(_by_sweep(volume(spark, d)), KINDS, X, Y, Z, R.H_ROI, R.V_ROI, INFLATION, POWER)
    return _grid_back(spark, out, "cartesian", ["iz", "iy", "ix", "z", "y", "x"])


def latlon_grid_files(spark: SparkSession, d: str) -> DataFrame:
    """The grids on regular degrees through files that hold only their axes."""
    out = grid.radar_latlon_volume(*_flying(spark, d), KINDS, *LAT, *LON, STEP, LEVELS, INFLATION, POWER)
    out = out.withColumn("volume_id", F.concat(F.lit("s"), F.col("volume_id").cast("string")))
    back = _grid_back(spark, out, "latlon", ["iz", "ilat", "ilon", "lat", "lon"])
    return back.withColumns({c: R._r(F.col(c), 4) for c in ("lat", "lon")})


def rhi_grid_files(spark: SparkSession, d: str) -> DataFrame:
    """The vertical sections of all sweeps through files."""
    out = grid.grid_rhi(_by_sweep(volume(spark, d)), KINDS, R.R, Z, 375.0, R.V_ROI, INFLATION, POWER)
    return _grid_back(spark, out, "rhi", ["iz", "ir", "z", "r"])


def column_grid_files(spark: SparkSession, d: str) -> DataFrame:
    """The columns of all sweeps through files."""
    out = grid.grid_column(_by_sweep(volume(spark, d)), KINDS, Z, R.V_ROI, INFLATION, POWER)
    return _grid_back(spark, out, "column", ["iz", "z"])


def grid_files(spark: SparkSession, d: str) -> DataFrame:
    """The composites of all sweeps written as grid files with their places and times, and read back."""
    g = _by_sweep(volume(spark, d))
    out = grid.with_latlon(grid.grid_composite(g, ["dbz", "vel", "width"], X, Y, R.H_ROI, INFLATION), LAT0, LON0)
    about = model.volume_times(_rays(g)).select("volume_id", "start", "stop", F.lit(LAT0).alias("lat0"), F.lit(LON0).alias("lon0"), F.lit(30.0).alias("heading"))
    folder = scratch(spark, "grids")
    rounded = out.withColumns({m: R._r(F.col(m)) for m in KINDS})
    volumes.write_grid(rounded, folder, "ppi", list(KINDS), about)
    back = volumes.read_grid(spark, folder, "ppi", list(KINDS))
    return back.select("volume_id", "iy", "ix", "y", "x", R._r(F.col("lat"), 3).alias("lat"), R._r(F.col("lon"), 3).alias("lon"), F.col("start").cast("timestamp_ntz").alias("start"), F.col("stop").cast("timestamp_ntz").alias("stop"), *(R._r(F.col(m), 3).alias(m) for m in KINDS))


def arriving_volumes(spark: SparkSession, d: str) -> DataFrame:
    """Sweeps that arrive as files, gridded by a stream."""
    g = _by_sweep(volume(spark, d)).drop("time")
    source, sink, checkpoint = (scratch(spark, x) for x in ("arrivals", "gridded", "state"))
    g.repartition("volume_id").write.parquet(source)
    process = lambda b: grid.grid_composite(b, ["dbz", "vel", "width"], X, Y, R.H_ROI, INFLATION)
    grid_arrivals(spark, source, g.schema, sink, checkpoint, process, once=True).awaitTermination()
    return R._grid_shown(spark.read.parquet(sink), ["volume_id", "iy", "ix"], KINDS)


def _apart(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(gates, rays, sweeps) of files of ten rays, of which four after one another belong together; n_sweeps tells how many do."""
    g = volume(spark, d).withColumns({"file": F.floor(F.col("ray_idx") / 10), "merged": F.concat(F.lit("m"), F.floor(F.col("ray_idx") / 40))})
    g = g.withColumn("volume_id", F.concat(F.lit("f"), F.col("file")))
    rays = g.groupBy("volume_id", "merged", "file", "ray_idx").agg(*(F.min_by(c, "gate_idx").alias(c) for c in ("time", "azimuth", "elevation")))
    files = rays.groupBy("merged").agg(F.countDistinct("volume_id").alias("n_sweeps"))
    sweeps = rays.groupBy("volume_id", F.lit(0).alias("sweep_idx")).agg(F.min("elevation").alias("fixed_angle"), F.min("ray_idx").alias("start_ray"), F.max("ray_idx").alias("end_ray"))
    return g.select("volume_id", "ray_idx", "gate_idx", "dbz"), rays.join(files, "merged"), sweeps


def _merged(gates: DataFrame, held: DataFrame) -> DataFrame:
    counts = held.groupBy("volume_id").agg(F.count(F.lit(1)).alias("n_sweeps"), F.sum(F.col("end_ray").cast("long")).alias("ends"))
    return gates.join(counts, "volume_id").select("volume_id", "ray_idx", "gate_idx", R._r(F.col("dbz")).alias("dbz"), "n_sweeps", "ends")


def merge_volumes(spark: SparkSession, d: str) -> DataFrame:
    """Files of ten rays, merged into volumes of four with the rays in order of time."""
    gates, rays, sweeps = _apart(spark, d)
    _, gates, held = model.merge_volumes(rays.drop("n_sweeps"), gates, sweeps, F.col("merged"))
    return _merged(gates, held)


def assembled_volumes(spark: SparkSession, d: str) -> DataFrame:
    """The same files arrive apart, in three batches that each hold some of every volume; a stream puts them together."""
    gates, rays, sweeps = _apart(spark, d)
    source, sink, checkpoint = (scratch(spark, x) for x in ("sweeps", "assembled", "state"))
    wanted = rays.select("merged", "n_sweeps", "volume_id", "ray_idx", F.col("time").cast("timestamp").alias("time"), (F.pmod(F.xxhash64("volume_id"), F.lit(3))).alias("batch"))
    for k in range(3):
        wanted.filter(F.col("batch") == k).drop("batch").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(wanted.drop("batch").schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = state.assemble_sweeps(stream, "3650 days").writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    state.start(spark, out.format("parquet").option("path", sink)).awaitTermination()
    _, gates, held = model.merge_volumes(rays.drop("n_sweeps", "merged"), gates, sweeps, number=spark.read.parquet(sink).filter("state != 'late'"))
    return _merged(gates, held)


def _scan_files(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    names = F.when(F.col("event_type") == "click", "PICCOLO_LONG").when(F.col("event_type") == "view", "RHI_A").when(F.col("event_id") % 97 == 96, "VOL2").when(F.col("event_type") == "error", "TEST").otherwise("CIRC")
    return e.select(F.concat(F.lit("site"), F.col("event_id") % 3).alias("site"), F.col("ts").cast("timestamp").alias("time"), F.col("event_id").alias("file_order"), names.alias("scan_name"))


def site_scans(spark: SparkSession, d: str) -> DataFrame:
    """The scans of three sites, routed by site and day."""
    files = _scan_files(spark, d).withColumn("day", F.to_date("time"))
    return R.qc.route_scans(files, ["site", "day"]).select("site", "file_order", "product")


def arriving_scans(spark: SparkSession, d: str) -> DataFrame:
    """The same scans as they arrive, in five batches, routed by a stream that keeps each site's day in its state."""
    files = _scan_files(spark, d)
    source, sink, checkpoint = (scratch(spark, x) for x in ("scans", "routed", "state"))
    last = files.agg(F.max("file_order")).first()[0] or 0
    for k in range(5):
        part = files.filter(F.floor(F.col("file_order") * 5 / (last + 1)) == k)
        part.coalesce(1).write.mode("append").parquet(f"{source}/{k}")
    stream = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(source)
    out = state.route_arrivals(stream, "3650 days").writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    state.start(spark, out.format("parquet").option("path", sink)).awaitTermination()
    return spark.read.parquet(sink).select("site", "file_order", "product")


def _e(v: float) -> str:
    return f"{v!r}e0" if "e" not in repr(v) else repr(v)


def _tm(lat: str, lon: str) -> tuple[str, str]:
    """SQL of the projected x and y of a latitude and a longitude from LAT0, LON0."""
    radius, forward, _ = G._kruger()
    t = f"sinh(atanh(sin(radians({lat}))) - {_e(G._E)} * atanh({_e(G._E)} * sin(radians({lat}))))"
    dl = f"radians({lon} - ({_e(LON0)}))"
    xi, eta = f"atan2({t}, cos({dl}))", f"asinh(sin({dl}) / sqrt({t} * {t} + cos({dl}) * cos({dl})))"
    x = " + ".join([eta, *(f"{_e(a)} * cos({2 * j}e0 * {xi}) * sinh({2 * j}e0 * {eta})" for j, a in enumerate(forward, 1))])
    y = " + ".join([xi, *(f"{_e(a)} * sin({2 * j}e0 * {xi}) * cosh({2 * j}e0 * {eta})" for j, a in enumerate(forward, 1))])
    return f"{_e(radius)} * ({x})", f"{_e(radius)} * ({y}) - ({_e(G.meridian_arc(LAT0))})"


def _projected(source: str, lat: str, lon: str, lat0: str, lon0: str, x: str, y: str) -> str:
    """SQL of source's rows with x and y of a latitude and a longitude from a reference in columns."""
    radius, forward, _ = G._kruger()

    def conformal(v: str) -> str:
        return f"sinh(atanh(sin(radians({v}))) - {_e(G._E)} * atanh({_e(G._E)} * sin(radians({v}))))"

    def series(base: str, f: str, g: str) -> str:
        return " + ".join([base, *(f"{_e(a)} * {f}({2 * j}e0 * _xi) * {g}({2 * j}e0 * _eta)" for j, a in enumerate(forward, 1))])

    arc = " + ".join(["_xi0", *(f"{_e(a)} * sin({2 * j}e0 * _xi0)" for j, a in enumerate(forward, 1))])
    first = f"SELECT *, {conformal(lat)} AS _t, radians({lon} - {lon0}) AS _dl, atan({conformal(lat0)}) AS _xi0 FROM {source}"
    second = f"SELECT *, atan2(_t, cos(_dl)) AS _xi, asinh(sin(_dl) / sqrt(_t * _t + cos(_dl) * cos(_dl))) AS _eta FROM ({first})"
    return f"SELECT * EXCLUDE (_t, _dl, _xi0, _xi, _eta), {_e(radius)} * ({series('_eta', 'cos', 'sinh')}) AS {x}, {_e(radius)} * ({series('_xi', 'sin', 'cosh')} - ({arc})) AS {y} FROM ({second})"


def _unprojected(source: str, x: str, y: str, keep: str) -> str:
    """SQL of lat and lon of projected places by Newton steps on the forward series, which it inverts without the inverse one."""
    steps = f"SELECT {keep}, {x} AS _x, {y} AS _y, lat0, lon0, lat0 + {y} / 110574e0 AS _lat, lon0 + {x} / (111320e0 * cos(radians(lat0))) AS _lon FROM {source}"
    for k in range(4):
        forward = _projected(f"({steps})", "_lat", "_lon", "lat0", "lon0", "_fx", "_fy")
        steps = f"SELECT {keep}, _x, _y, lat0, lon0, _lat + (_y - _fy) / 110574e0 AS _lat, _lon + (_x - _fx) / (111320e0 * cos(radians(_lat))) AS _lon FROM ({forward})"
    return f"SELECT {keep}, round(_lat, 6) + 0e0 AS lat, round(_lon, 6) + 0e0 AS lon FROM ({steps})"


def _placed_sql(cut: str = "{v}") -> str:
    """Tables up to the located gates `q` of sweeps that are placed from their first rays (`ref`)."""
    rays = f"SELECT sweep_idx, ray_idx, azimuth, {_e(LAT0)} + 0.31e0 * sweep_idx + 0.0004e0 * (ray_idx % 50) AS latitude, {_e(LON0)} - 0.23e0 * sweep_idx + 0.0006e0 * (ray_idx % 37) AS longitude FROM g WHERE gate_idx = 0"
    first = f"SELECT sweep_idx AS section, {cut.format(v='arg_min(latitude, ray_idx)')} AS lat0, {cut.format(v='arg_min(longitude, ray_idx)')} AS lon0, radians(arg_min(azimuth, ray_idx)) AS az_first FROM rays GROUP BY sweep_idx"
    own = _projected("(SELECT section, r.ray_idx AS own_ray, latitude, longitude, lat0, lon0, az_first FROM rays r JOIN ref ON r.sweep_idx = section)", "latitude", "longitude", "lat0", "lon0", "px", "py")
    return f"rays AS ({rays}), ref AS MATERIALIZED ({first}), own AS MATERIALIZED ({own}), placed AS (SELECT g.* EXCLUDE (x0, y0), own.px AS x0, own.py AS y0, own.az_first, own.section FROM g JOIN own ON g.ray_idx = own.own_ray), {R._LOCATED.replace('FROM g)', 'FROM placed)')}"


def _driver_sql(kernel: str, keys: list[str], cell: list[str], place: str, cut: str = "{v}") -> str:
    """SQL of a driver's grid: each sweep is placed from its first ray.

    kernel: tables up to a last SELECT of the cells' values; place: SQL of lat and lon by section and the numbers in `cell`.
    """
    at = kernel.rindex("SELECT c.")
    shown = ", ".join([f"o.section AS sweep_idx, {', '.join('o.' + k for k in keys)}, p.lat, p.lon", *KINDS])
    return R._sql(f"SELECT {shown} FROM values_ o JOIN places p USING (section{''.join(', ' + c for c in cell)})", f"{_placed_sql(cut)}, {kernel[:at].rstrip()}, values_ AS ({kernel[at:]}), places AS ({place})")


_SECTIONS = "(SELECT DISTINCT sweep_idx AS section FROM g) n"
_FLAT = f"SELECT n.section, f.* FROM ({R._FLAT}) f, {_SECTIONS}"
_ARC = f"sin(sqrt((x - x0) ^ 2 + (y - y0) ^ 2) / {R._REFF}) * ({R._REFF} + z - altitude) / cos(elc)"
_OWN = f"c.section = q.section AND {R._PLANAR}"


def _flat_places() -> str:
    return _unprojected("(SELECT DISTINCT section, iy, ix, x, y, lat0, lon0 FROM cells JOIN ref USING (section))", "x", "y", "section, iy, ix")


def _composite_kernel() -> str:
    best = ", ".join(f"arg_max({{'v': {m}}}, {{'v': dbz, 'r': -ray_idx, 'g': -gate_idx}}) FILTER (dbz IS NOT NULL).v AS {m}" for m in KINDS)
    found = f"b AS (SELECT c.section, iy, ix, max(CASE WHEN sqi IS NOT NULL THEN 1 ELSE 0 END) AS seen, {best} FROM cells c JOIN q ON {_OWN} GROUP BY c.section, iy, ix)"
    shown = ", ".join(f"round(CASE WHEN seen = 1 THEN coalesce(b.{m}, -9999e0) ELSE -32768e0 END, 4) + 0e0 AS {m}" for m in KINDS)
    return f"cells AS MATERIALIZED ({_FLAT}), {found} SELECT c.section, c.iy, c.ix, {shown} FROM cells c LEFT JOIN b USING (section, iy, ix)"


def _degree_cells() -> str:
    lat, lon = (f"round({v}0 + {_e(float(first))}, 2) + {_e(STEP)} * {i}.range" for v, first, i in (("lat", LAT[0], "j"), ("lon", LON[0], "i")))
    roi = f"0.75e0 * {_e(STEP)} * 1e3 * sqrt((111.13209e0 - 0.56605e0 * cos(2e0 * radians(lat0))) ^ 2 + (111.41513e0 * cos(radians(lat0))) ^ 2)"
    flat = f"(SELECT section, lat0, lon0, CAST(j.range AS INT) AS ilat, CAST(i.range AS INT) AS ilon, {lat} AS lat, {lon} AS lon, {roi} AS roi FROM ref, range({LAT[1]}) j, range({LON[1]}) i)"
    wide = "greatest(0.01e0 * sqrt(x * x + y * y), {})"
    return f"SELECT p.* EXCLUDE (lat0, lon0, roi), {wide.format('roi')} AS eff_h, {wide.format('187.5e0')} AS eff_v, CAST(k.range AS INT) AS iz, 250e0 * k.range AS z FROM ({_projected(flat, 'lat', 'lon', 'lat0', 'lon0', 'x', 'y')}) p, range(9) k"


_CUT = "(CASE WHEN abs({{v}} / {d} - round({{v}} / {d})) > 1e-9 THEN trunc({{v}} / {d}) * {d} ELSE {{v}} END)"
_HAVERSINE = R._HAVERSINE.format(e="elc", a=R._AZ)
_ROUNDED_FAR = "abs(rc - range_m) > 187.5e0"
DRIVERS = {
    "radar_volume": _driver_sql(R._kernel(f"SELECT c.*, CAST(k.range AS INT) AS iz, 250e0 * k.range AS z FROM ({_FLAT}) c, range(9) k", _OWN, "abs(h - z)", "z", _HAVERSINE, _ARC, _ROUNDED_FAR, ["section", "iz", "iy", "ix"]), ["iz", "iy", "ix"], ["iy", "ix"], _flat_places()),
    "radar_composite": _driver_sql(_composite_kernel(), ["iy", "ix"], ["iy", "ix"], _flat_places()),
    "radar_column": _driver_sql(R._kernel(f"SELECT n.section, CAST(k.range AS INT) AS iz, 250e0 * k.range AS z, greatest(2.5e0 * k.range, 187.5e0) AS eff_v FROM range(9) k, {_SECTIONS}", "c.section = q.section", "abs(h - z)", "z", "abs(elc - el)", "CASE WHEN elc IS NOT NULL THEN z / cos(el) END", _ROUNDED_FAR, ["section", "iz"]), ["iz"], [], "SELECT section, round(lat0, 6) + 0e0 AS lat, round(lon0, 6) + 0e0 AS lon FROM ref"),
    "grid_ppi": _driver_sql(R._kernel(_FLAT, _OWN, "0e0", "0e0", R._HAVERSINE.format(e="el", a=R._AZ), "sqrt((x - x0) ^ 2 + (y - y0) ^ 2)", "abs(rc - range_m) > 750e0", ["section", "iy", "ix"], flag_any=True), ["iy", "ix"], ["iy", "ix"], _flat_places()),
    "grid_rhi": _driver_sql(R._rhi_kernel("SELECT DISTINCT sweep_idx AS section FROM g", "section", "az_first"), ["iz", "ir"], ["ir"], _unprojected("(SELECT DISTINCT section, ir, r * sin(az_first) AS x, r * cos(az_first) AS y, lat0, lon0 FROM cells JOIN ref USING (section))", "x", "y", "section, ir")),
    "radar_latlon_volume": _driver_sql(R._kernel(_degree_cells(), _OWN, "abs(h - z)", "z", _HAVERSINE, _ARC, _ROUNDED_FAR, ["section", "iz", "ilat", "ilon"]), ["iz", "ilat", "ilon"], ["ilat", "ilon"], "SELECT DISTINCT section, ilat, ilon, round(lat, 6) + 0e0 AS lat, round(lon, 6) + 0e0 AS lon FROM cells", _CUT.format(d=_e(STEP))),
}

_PLACED = f"m AS (SELECT *, {_e(LAT0)} + 0.013e0 * (ray_idx % 50) AS latitude, {_e(LON0)} + 0.017e0 * (ray_idx % 37) - 0.003e0 * gate_idx AS longitude FROM g)"


def _composite(source: str, select: str) -> str:
    """SQL of a composite of each sweep."""
    cells = f"cells AS (SELECT f.*, n.sweep_idx AS sweep FROM ({R._FLAT}) f, (SELECT DISTINCT sweep_idx FROM g) n)"
    best = ", ".join(f"arg_max({{'v': {m}}}, {{'v': dbz, 'r': -ray_idx, 'g': -gate_idx}}) FILTER (dbz IS NOT NULL).v AS {m}" for m in KINDS)
    found = f"b AS (SELECT sweep, iy, ix, max(CASE WHEN sqi IS NOT NULL THEN 1 ELSE 0 END) AS seen, {best} FROM cells c JOIN q ON c.sweep = q.sweep_idx AND {R._PLANAR} GROUP BY sweep, iy, ix)"
    shown = ", ".join(f"round(CASE WHEN seen = 1 THEN coalesce(b.{m}, -9999e0) ELSE -32768e0 END, 4) + 0e0 AS {m}" for m in KINDS)
    return R._sql(select, f"{R._LOCATED}, {cells}, {found}, r AS (SELECT c.sweep, 's' || c.sweep AS volume_id, c.iy, c.ix, c.y, c.x, {shown} FROM cells c LEFT JOIN b USING (sweep, iy, ix)){source}")


def _file(c: str, offset: str = "0e0") -> str:
    """SQL of a packed value, as read back in single precision."""
    n = f"round(({c} - {offset}) / 0.01e0)"
    return f"round(CAST(CAST(CASE WHEN {n} BETWEEN -32767 AND 32767 THEN {n} * 0.01e0 + {offset} END AS FLOAT) AS DOUBLE), 3) + 0e0"


_MERGED = R._sql(
    "SELECT n.m AS volume_id, n.new_ray AS ray_idx, g.gate_idx, round(g.dbz, 4) + 0e0 AS dbz, s.n_sweeps, s.ends FROM g JOIN n USING (ray_idx) JOIN s USING (m)",
    "r AS (SELECT ray_idx, arg_min(time, gate_idx) AS time, 'm' || (ray_idx // 40) AS m, 'f' || (ray_idx // 10) AS f FROM g GROUP BY ray_idx), n AS (SELECT ray_idx, m, f, CAST(row_number() OVER (PARTITION BY m ORDER BY time, f, ray_idx) - 1 AS INT) AS new_ray FROM r), s AS (SELECT m, count(*) AS n_sweeps, CAST(sum(e) AS BIGINT) AS ends FROM (SELECT m, max(new_ray) AS e FROM n GROUP BY m, f) GROUP BY m)",
)
_ROUTED = "WITH f AS (SELECT event_id, 'site' || (event_id % 3) AS site, CAST(ts AS DATE) AS day, CASE WHEN event_type = 'click' THEN 'PICCOLO_LONG' WHEN event_type = 'view' THEN 'RHI_A' WHEN event_id % 97 = 96 THEN 'VOL2' WHEN event_type = 'error' THEN 'TEST' ELSE 'CIRC' END AS n FROM events), s AS (SELECT *, count_if(n = 'VOL2') OVER (PARTITION BY site, day ORDER BY event_id) > 0 AS second FROM f) SELECT site, event_id AS file_order, CASE WHEN n = 'RHI_A' THEN 'rhi' WHEN n = 'TEST' THEN 'none' WHEN second THEN 'volume2' ELSE 'volume1' END AS product FROM s"

def _grid_file_sql(kernel: str, keys: list[str], axes: dict[str, str]) -> str:
    """SQL of a kernel's values, by section, as a file gives them back."""
    at = kernel.rindex("SELECT c.")
    place = ", ".join(f"{v} AS {k}" for k, v in axes.items())
    values = ", ".join(f"round(CAST(CAST(nullif({m}, -32768e0) AS FLOAT) AS DOUBLE), 3) + 0e0 AS {m}" for m in KINDS)
    return R._sql(f"SELECT 's' || section AS volume_id, {', '.join(keys)}, {place}, {values} FROM values_", f"{R._LOCATED}, {kernel[:at].rstrip()}, values_ AS ({kernel[at:]})")


_VOLUME_FILES = _grid_file_sql(R._kernel(f"SELECT c.*, CAST(k.range AS INT) AS iz, 250e0 * k.range AS z FROM ({_FLAT}) c, range(9) k", f"c.section = q.sweep_idx AND {R._PLANAR}", "abs(h - z)", "z", _HAVERSINE, _ARC, _ROUNDED_FAR, ["section", "iz", "iy", "ix"]), ["iz", "iy", "ix"], {"z": "250e0 * iz", "y": "1e3 * iy", "x": "1e3 * ix"})
_RAW = "'s' || sweep_idx AS volume_id, CAST(ray_idx - min(ray_idx) OVER (PARTITION BY sweep_idx) AS INT) AS ray_idx, gate_idx"
_FLOATS = {"dbz_tot": "dbz", "dbz": "dbz", "vel": "vel", "rate_zh": "width", "sqi_for_mask": "sqi", "hid_csu": "floor(width)", "rate_csu_blended": "snr", "temp_for_pid": "phidp", "zdr_l2": "rhohv"}
_DUAL_ONLY = {"hid_csu", "rate_csu_blended", "temp_for_pid", "zdr_l2"}


def _floats(profile: str) -> str:
    shown = ", ".join("CAST(NULL AS DOUBLE) AS " + k if profile == "single_pol" and k in _DUAL_ONLY else f"round(CAST(CAST({v} AS FLOAT) AS DOUBLE), 3) + 0e0 AS {k}" for k, v in _FLOATS.items())
    return f"SELECT '{profile}' AS profile, {_RAW}, {shown} FROM g"


FILES = {
    "volume_source": R._sql(f"SELECT {_RAW}, range_m, 30e0 AS heading, round(elevation / 4, 3) AS pitch, round(azimuth / 8 - 2, 3) + 0e0 AS roll, elevation AS fixed_angle, arg_min(time, gate_idx) OVER (PARTITION BY g.ray_idx) AS time, {_file('vel')} AS vel, round(CAST(CAST(round((sqi - 0.5000076e0) / 1.5259488e-5) * 1.5259488e-5 + 0.5000076e0 AS FLOAT) AS DOUBLE), 3) + 0e0 AS sqi FROM g"),
    "polarimetric_files": R._sql(_floats("single_pol") + " UNION ALL " + _floats("dual_pol")),
    "airborne_files": R._sql(f"SELECT {_RAW}, round(azimuth / 8 - 2, 4) + 0e0 AS rotation, round(azimuth / 16, 4) + 0e0 AS drift, round(elevation / 2, 4) + 0e0 AS tilt, CAST(NULL AS DOUBLE) AS track, round(azimuth - 20, 4) + 0e0 AS eastward_wind, 2.5e0 AS northward_wind, round(elevation - 1, 4) + 0e0 AS vertical_wind, {_file('dbz')} AS dbz_tot, {_file('vel')} AS vel FROM g"),
    "volume_grid_files": _VOLUME_FILES,
    "cartesian_grid_files": _VOLUME_FILES,
    "latlon_grid_files": "SELECT 's' || sweep_idx AS volume_id, iz, ilat, ilon, round(CAST(CAST(lat AS FLOAT) AS DOUBLE), 4) + 0e0 AS lat, round(CAST(CAST(lon AS FLOAT) AS DOUBLE), 4) + 0e0 AS lon, " + ", ".join(f"round(CAST(CAST(nullif({m}, -32768e0) AS FLOAT) AS DOUBLE), 3) + 0e0 AS {m}" for m in KINDS) + f" FROM ({DRIVERS['radar_latlon_volume']})",
    "rhi_grid_files": _grid_file_sql(R._rhi_kernel("SELECT DISTINCT sweep_idx AS section FROM g", "sweep_idx", "0e0"), ["iz", "ir"], {"z": "250e0 * iz", "r": "500e0 * ir"}),
    "column_grid_files": _grid_file_sql(R._kernel(f"SELECT n.section, CAST(k.range AS INT) AS iz, 250e0 * k.range AS z, greatest(2.5e0 * k.range, 187.5e0) AS eff_v FROM range(9) k, {_SECTIONS}", "c.section = q.sweep_idx", "abs(h - z)", "z", "abs(elc - el)", "CASE WHEN elc IS NOT NULL THEN z / cos(el) END", _ROUNDED_FAR, ["section", "iz"]), ["iz"], {"z": "250e0 * iz"}),
}

QUERIES = {f.__name__: f for f in (place_radar, tm_inverse, join_rays, radar_volume, radar_composite, radar_column, grid_ppi, grid_rhi, radar_latlon_volume, radar_arrays, volume_reference, volume_files, volume_source, polarimetric_files, airborne_files, volume_grid_files, cartesian_grid_files, latlon_grid_files, rhi_grid_files, column_grid_files, grid_files, arriving_volumes, merge_volumes, assembled_volumes, site_scans, arriving_scans)}

SQL = DRIVERS | FILES | {
    "place_radar": R._sql("SELECT ray_idx, gate_idx, round({}, 3) + 0e0 AS x0, round({}, 3) + 0e0 AS y0 FROM m".format(*_tm("latitude", "longitude")), _PLACED),
    "tm_inverse": R._sql("SELECT ray_idx, gate_idx, round(latitude, 8) + 0e0 AS latitude, round(longitude, 8) + 0e0 AS longitude FROM m", _PLACED),
    "join_rays": R._sql("SELECT g.ray_idx, g.gate_idx, r.azimuth, r.elevation, r.time, round(g.dbz, 4) + 0e0 AS dbz FROM g JOIN (SELECT ray_idx, arg_min(azimuth, gate_idx) AS azimuth, arg_min(elevation, gate_idx) AS elevation, arg_min(time, gate_idx) AS time FROM g GROUP BY ray_idx) r USING (ray_idx)"),
    "radar_arrays": R._sql("SELECT q.sweep_idx, ray_idx, gate_idx, " + ", ".join(f"round({c}, {n}) + 0e0 AS {c}" for c, n in (("lat0", 8), ("lon0", 8), ("x0", 3), ("y0", 3), ("az", 8), ("el", 8), ("range_m", 3), ("h", 3), ("gx", 3), ("gy", 3))) + " FROM q JOIN ref USING (section)", _placed_sql()),
    "volume_reference": R._sql(
        f"SELECT sweep_idx, round(lat, 8) + 0e0 AS lat0, round(lon, 8) + 0e0 AS lon0, round(az, 8) + 0e0 AS az_first, round({_CUT.format(d='0.1e0').format(v='lat')}, 8) + 0e0 AS lat_cut, round({_CUT.format(d='0.1e0').format(v='lon')}, 8) + 0e0 AS lon_cut FROM r",
        f"r AS (SELECT sweep_idx, {_e(LAT0)} + 0.31e0 * sweep_idx + 0.0004e0 * (min(ray_idx) % 50) AS lat, {_e(LON0)} - 0.23e0 * sweep_idx + 0.0006e0 * (min(ray_idx) % 37) AS lon, radians(arg_min(azimuth, ray_idx)) AS az FROM g GROUP BY sweep_idx)",
    ),
    "volume_files": R._sql(f"SELECT 's' || sweep_idx AS volume_id, CAST(ray_idx - min(ray_idx) OVER (PARTITION BY sweep_idx) AS INT) AS ray_idx, gate_idx, azimuth, elevation, {_file('dbz')} AS dbz, {_file('width', '327.68e0')} AS width, {_file('dbz')} AS dbz_l1, {_file('snr')} AS snr FROM g"),
    "grid_files": _composite(
        ", t AS (SELECT sweep_idx, arg_min(time, ray_idx) AS start, arg_max(time, ray_idx) AS stop FROM g WHERE gate_idx = 0 GROUP BY sweep_idx)",
        f"SELECT volume_id, iy, ix, y, x, round({_e(LAT0)} + y / (1e3 * (111.13209e0 - 0.56605e0 * cos(2e0 * radians({_e(LAT0)})) + 0.0012e0 * cos(4e0 * radians({_e(LAT0)})))), 3) AS lat, round({_e(LON0)} + x / (1e3 * (111.41513e0 * cos(radians({_e(LAT0)})) - 0.09455e0 * cos(3e0 * radians({_e(LAT0)})))), 3) AS lon, start, stop, " + ", ".join(f"round(CAST(CAST(nullif({m}, -32768e0) AS FLOAT) AS DOUBLE), 3) + 0e0 AS {m}" for m in KINDS) + " FROM r JOIN t ON r.sweep = t.sweep_idx",
    ),
    "arriving_volumes": _composite("", "SELECT volume_id, iy, ix, " + ", ".join(KINDS) + " FROM r"),
    "merge_volumes": _MERGED,
    "assembled_volumes": _MERGED,
    "site_scans": _ROUTED,
    "arriving_scans": _ROUTED,
}
