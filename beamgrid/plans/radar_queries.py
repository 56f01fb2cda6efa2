"""The radar operators as queries on a volume made from the events table, each with SQL that gives the same rows.

Every hundred events are a ray, every fifty rays a sweep; angles, moments and gaps follow from the event's columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beamgrid import model
from beamgrid.functions import geometry as G
from beamgrid.operators import grid, qc, terrain

VOLUME = """
SELECT 'v' AS volume_id, ray_idx, gate_idx, CAST(floor(ray_idx / 50) AS INT) AS sweep_idx, ts AS time,
       250e0 + 250e0 * gate_idx AS range_m, 1e0 * (ray_idx % 50) AS azimuth, 0.5e0 + 1e0 * floor(ray_idx / 50) AS elevation,
       10e0 AS altitude, 20e0 AS nyquist_velocity, 5e0 AS ew_platform, -3e0 AS ns_platform, 0.1e0 AS w_platform, 30e0 AS heading,
       0e0 AS x0, 0e0 AS y0,
       CASE WHEN t = 'error' THEN NULL ELSE v % 80e0 - 10e0 END AS dbz,
       CASE WHEN t = 'error' THEN NULL ELSE (v * 7e0) % 50e0 - 25e0 END AS vel,
       v % 10e0 AS width,
       CASE WHEN t = 'view' AND id % 2 = 0 THEN NULL ELSE (v % 100e0) / 100e0 END AS sqi,
       v % 30e0 AS snr,
       0.6e0 + (v % 40e0) / 100e0 AS rhohv,
       CASE WHEN t = 'signup' AND id % 30 = 0 THEN NULL ELSE 1e0 * gate_idx - 20e0 + v % 42e0 END AS phidp
FROM (SELECT event_id AS id, ts, event_type AS t, value AS v, CAST(floor(event_id / 100) AS INT) AS ray_idx, CAST(event_id % 100 AS INT) AS gate_idx FROM {events}) e
"""
MOMENTS = ["dbz", "vel", "width", "sqi", "snr", "rhohv", "phidp"]
KINDS = {"dbz": "linear", "vel": "weighted", "width": "nearest"}
X, Y, Z, R = (0.0, 1000.0, 21), (0.0, 1000.0, 26), (0.0, 250.0, 9), (0.0, 500.0, 51)
H_ROI, V_ROI, INFLATION, POWER = 750.0, 187.5, 0.01, 0.5
KEY = ["ray_idx", "gate_idx"]


def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(VOLUME.format(events="{e}"), e=spark.read.parquet(f"{sf_dir}/events.parquet"))


def _r(c, digits: int = 4):
    """Rounded as SQL does, which scales the double first and not its shortest decimal form; without a negative zero."""
    scaled = F.round(c * 10.0**digits)
    return F.when(F.abs(scaled) < float("inf"), scaled / 10.0**digits).otherwise(c) + 0.0


def _shown(df: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    return df.select(*KEY, *(_r(F.col(c), digits).alias(c) for c in columns))


def _height():
    return G.beam_height(F.col("range_m"), F.col("elevation"), F.col("altitude"))


def beam_height(spark, d):
    return volume(spark, d).select(*KEY, _r(_height()).alias("height"))


def beam_info(spark, d):
    g = grid.locate(volume(spark, d))
    return g.select(*KEY, _r(F.col("az"), 8).alias("az"), _r(F.col("el"), 8).alias("el"), "range_m", _r(F.col("h")).alias("h"))


def gate_position(spark, d):
    return _shown(grid.locate(volume(spark, d)), ["s", "gx", "gy"])


def azimuth_offset(spark, d):
    return qc.add_azimuthal_offset(volume(spark, d), -10.5).select(*KEY, "azimuth")


def rhohv_fix(spark, d):
    return volume(spark, d).select(*KEY, _r(G.rhohv_from_counts(F.col("snr")), 8).alias("rhohv"))


def platform_motion(spark, d):
    v = qc.unfold(*(F.col(c) for c in ("vel", "ew_platform", "ns_platform", "w_platform", "azimuth", "elevation", "nyquist_velocity")))
    return volume(spark, d).select(*KEY, _r(v).alias("vel"))


def db_linear(spark, d):
    g = volume(spark, d)
    return g.select(*KEY, _r(G.db_to_linear(F.col("dbz"))).alias("linear"), _r(G.linear_to_db(F.col("snr"))).alias("db"), _r(G.linear_to_db(G.db_to_linear(F.col("dbz")))).alias("back"))


def appx_inverse(spark, d):
    lat, lon = G.appx_inverse(F.lit(-2.5), F.lit(-45.25), F.col("gx"), F.col("gy"))
    return grid.locate(volume(spark, d)).select(*KEY, _r(lat, 8).alias("lat"), _r(lon, 8).alias("lon"))


def spherical_angle(spark, d):
    g = grid.locate(volume(spark, d))
    return g.select(*KEY, _r(G.spherical_angle(F.col("az"), F.col("el"), F.lit(0.5), F.lit(0.1)), 8).alias("angle"))


def qc_copies(spark, d):
    g = model.init_qc(volume(spark, d), ["dbz", "vel"])
    return g.select(*KEY, *(_r(F.col(c)).alias(c) for c in ("raw_dbz", "dbz", "raw_vel", "vel")))


def qc_below(spark, d):
    return _shown(qc.threshold_below(volume(spark, d), MOMENTS, F.col("sqi"), model.SQI, ("sqi",)), MOMENTS)


def qc_above(spark, d):
    return _shown(qc.threshold_above(volume(spark, d), MOMENTS, F.col("width"), model.WIDTH, ("sqi",)), MOMENTS)


def qc_four(spark, d):
    g = qc.threshold_four(volume(spark, d), MOMENTS, F.col("sqi"), F.col("snr"), F.col("rhohv"), F.col("width"), (model.SQI, model.SNR, model.RHOHV, model.WIDTH))
    return _shown(g, MOMENTS)


def _clutter():
    return qc.is_clutter(F.col("dbz"), F.col("vel"), F.col("width"), _height(), 20.0, 10.0, 6.0)


def clutter_mask(spark, d):
    return _shown(qc.mask(volume(spark, d), MOMENTS, _clutter()), MOMENTS)


def clutter_stats(spark, d):
    return qc.clutter_stats(volume(spark, d), _clutter(), F.col("dbz"), ["sweep_idx"])


def height_mask(spark, d):
    return _shown(qc.height_mask(volume(spark, d), MOMENTS, F.col("dbz"), _height(), 300.0, ("sqi",)), MOMENTS)


def sector_mask(spark, d):
    return _shown(qc.sector_mask(volume(spark, d), MOMENTS, F.col("azimuth"), F.col("heading"), 10.5, 345.5, "sqi"), MOMENTS)


def despeckle_range(spark, d):
    return _shown(qc.despeckle(volume(spark, d), ["dbz", "vel"], 2), ["dbz", "vel"])


def despeckle_azimuth(spark, d):
    return _shown(qc.despeckle_azimuthal(volume(spark, d), ["dbz", "sqi"], 2), ["dbz", "sqi"])


def phidp_std_mask(spark, d):
    return _shown(qc.phidp_std_mask(volume(spark, d), ["dbz", "phidp"]), ["dbz", "phidp"])


def _sweeps(g: DataFrame) -> DataFrame:
    return g.groupBy("volume_id", "sweep_idx").agg(F.min("ray_idx").alias("start_ray"), F.max("ray_idx").alias("end_ray"))


def split_sweeps(spark, d):
    g = volume(spark, d)
    rays = g.groupBy("volume_id", "ray_idx").agg(F.min_by("azimuth", "gate_idx").alias("azimuth"), F.count("dbz").alias("n_dbz"))
    return model.split_sweeps(rays, _sweeps(g)).select("sweep_idx", "ray_idx", "azimuth", "n_dbz")


def volume_time_span(spark, d):
    rays = volume(spark, d).groupBy("volume_id", "sweep_idx", "ray_idx").agg(F.min_by("time", "gate_idx").alias("time"))
    return model.volume_times(rays.withColumn("volume_id", F.col("sweep_idx"))).withColumnRenamed("volume_id", "sweep_idx")


def regular_grid(spark, d):
    """The points of a grid for every sweep that the volume has."""
    sweeps = volume(spark, d).select(F.col("sweep_idx").alias("volume_id")).distinct()
    return grid.volume_points(sweeps, z=Z, y=Y, x=X).withColumnRenamed("volume_id", "sweep_idx")


def tile_name(spark, d):
    g = volume(spark, d)
    return g.select(*KEY, G.tile_name(F.col("dbz") - 30.0, F.col("vel") * 7.0).alias("tile"))


def terrain_mask(spark, d):
    """Heights of posts are counts of events; the tile of the radar has one post a tenth of a degree."""
    g = volume(spark, d)
    posts = g.groupBy((F.col("ray_idx") % 11).alias("row"), (F.col("gate_idx") % 11).alias("col")).agg(F.count("dbz").alias("n"))
    dem = posts.select(F.lit("S03W046").alias("tile"), "row", "col", F.when(F.col("n") % 7 == 0, terrain.VOID).otherwise(F.col("n") % 97).cast("short").alias("elevation_m"))
    return _shown(terrain.terrain_mask(g, ["dbz", "vel"], terrain.blocks(dem), -2.52, -45.23, 50.0, 11, "sqi"), ["dbz", "vel"])


def pack_int16(spark, d):
    from beamgrid.sources.profiles import pack

    g = volume(spark, d)
    return g.select(*KEY, pack(F.col("dbz"), 0.01, 0.0).alias("dbz"), pack(F.col("width"), 0.01, 327.68).alias("width"), pack(F.col("phidp"), 0.0054933317, 180.0).alias("phidp"))


def route_scans(spark, d):
    names = F.when(F.col("event_type") == "click", "PICCOLO_LONG").when(F.col("event_type") == "view", "RHI_A").when(F.col("event_id") % 997 == 996, "VOL2").when(F.col("event_type") == "error", "TEST").otherwise("CIRC")
    files = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("file_order"), names.alias("scan_name"))
    return qc.route_scans(files).select("file_order", "product")


def _grid_shown(df: DataFrame, keys: list[str], moments) -> DataFrame:
    return df.select(*keys, *(_r(F.col(m)).alias(m) for m in moments))


def grid_composite(spark, d):
    g = qc.threshold_below(volume(spark, d), ["dbz", "vel", "width"], F.col("sqi"), model.SQI)
    return _grid_shown(grid.grid_composite(g, ["dbz", "vel", "width"], X, Y, H_ROI, INFLATION), ["iy", "ix", "y", "x"], KINDS)


def grid_volume(spark, d):
    return _grid_shown(grid.grid_volume(volume(spark, d), KINDS, X, Y, Z, H_ROI, V_ROI, INFLATION, POWER), ["iz", "iy", "ix"], KINDS)


def grid_ppi_sweeps(spark, d):
    """Every sweep as a volume of its own."""
    g = volume(spark, d).withColumn("volume_id", F.col("sweep_idx"))
    return _grid_shown(grid.grid_ppi(g, KINDS, X, Y, H_ROI, INFLATION, POWER).withColumnRenamed("volume_id", "sweep_idx"), ["sweep_idx", "iy", "ix"], KINDS)


def grid_rhi_azimuths(spark, d):
    """Every azimuth's rays as a volume of their own."""
    g = volume(spark, d).withColumn("volume_id", F.col("ray_idx") % 50)
    return _grid_shown(grid.grid_rhi(g, KINDS, R, Z, 375.0, V_ROI, INFLATION, POWER).withColumnRenamed("volume_id", "azimuth_idx"), ["azimuth_idx", "iz", "ir"], KINDS)


def grid_column(spark, d):
    return _grid_shown(grid.grid_column(volume(spark, d), KINDS, Z, V_ROI, INFLATION, POWER), ["iz"], KINDS)


def _sql(body: str, with_: str = "") -> str:
    return f"WITH g AS ({VOLUME.format(events='events')}){', ' + with_ if with_ else ''} {body}"


_H = "(sqrt(range_m * range_m + 72157212444444.44e0 + 2e0 * range_m * 8494666.666666666e0 * sin(radians(elevation))) - 8494666.666666666e0 + altitude)"
_H = _H.replace("72157212444444.44e0", "8494666.666666666e0 * 8494666.666666666e0")
_S = f"(8494666.666666666e0 * asin(range_m * cos(radians(elevation)) / (8494666.666666666e0 + {_H})))"
_LOCATED = f"p AS (SELECT *, {_H} AS h, {_S} AS s FROM g), q AS MATERIALIZED (SELECT *, x0 + s * sin(radians(azimuth)) AS gx, y0 + s * cos(radians(azimuth)) AS gy, radians(azimuth) AS az, radians(elevation) AS el FROM p)"


def _masked(bad: str, moments: list[str] = MOMENTS, skip: tuple[str, ...] = (), source: str = "g") -> str:
    cols = ", ".join(f"round({m}, 4) + 0e0 AS {m}" if m in skip else f"round(CASE WHEN {bad} THEN NULL ELSE {m} END, 4) + 0e0 AS {m}" for m in moments)
    return f"SELECT ray_idx, gate_idx, {cols} FROM {source}"


def _despeckled(moments: list[str], line: str, place: str, n: int) -> str:
    parts = []
    for m in moments:
        parts.append(
            f"{m}_a AS (SELECT {line}, {place}, {m}, {m} IS NOT NULL AND {place} < max({place}) OVER (PARTITION BY {line}) AS ok FROM g), "
            f"{m}_b AS (SELECT *, row_number() OVER (PARTITION BY {line} ORDER BY {place}) - sum(CAST(ok AS INT)) OVER (PARTITION BY {line} ORDER BY {place}) AS run FROM {m}_a), "
            f"{m}_c AS (SELECT {line}, {place}, CASE WHEN ok AND count(*) OVER (PARTITION BY {line}, ok, run) <= {n} THEN NULL ELSE {m} END AS {m} FROM {m}_b)"
        )
    a, b = moments
    return _sql(f"SELECT ray_idx, gate_idx, round({a}, 4) + 0e0 AS {a}, round({b}, 4) + 0e0 AS {b} FROM {a}_c JOIN {b}_c USING (ray_idx, gate_idx)", ", ".join(parts))


_UNFOLD = "vel + ew_platform * cos(radians(elevation)) * sin(radians(azimuth)) + ns_platform * cos(radians(elevation)) * cos(radians(azimuth)) + w_platform * sin(radians(elevation))"
_IS_CLUTTER = f"coalesce(dbz >= 20 AND abs(vel) <= 10 AND width <= 6 AND {_H} < 500, false)"
_REFF = "8494666.666666666e0"


def _kernel(cells: str, on: str, dist: str, z: str, angle: str, r_cell: str, off: str, keys: list[str], flag_any: bool = False, pairs: str = "cells c JOIN q") -> str:
    """SQL of a weighted grid: pairs by brute force (or from an equal join, given as `pairs`), then the rules for each moment."""
    el = f"CASE WHEN abs((({z} - altitude + {_REFF}) ^ 2 - range_m ^ 2 - {_REFF} ^ 2) / (2e0 * range_m * {_REFF})) < 1 THEN asin((({z} - altitude + {_REFF}) ^ 2 - range_m ^ 2 - {_REFF} ^ 2) / (2e0 * range_m * {_REFF})) END"
    k = ", ".join(keys)
    near = "max(CASE WHEN sqi IS NOT NULL THEN 1 ELSE 0 END)" if flag_any else "arg_min(CASE WHEN sqi IS NOT NULL THEN 1 ELSE 0 END, {'d': dist, 'r': ray_idx, 'g': gate_idx})"
    reach = "true" if flag_any else "min(dist) <= max(eff_v)"
    return f"""
cells AS MATERIALIZED ({cells}),
pairs AS (SELECT c.*, q.*, {dist} AS dist{'' if flag_any else f', {el} AS elc'} FROM {pairs} ON {on}),
angled AS (SELECT *, {angle} AS angle, {r_cell} AS rc FROM pairs),
weighed AS (SELECT *, CASE WHEN dbz IS NOT NULL AND rc IS NOT NULL AND NOT ({off}) AND exp(-79.43e0 * angle) >= 0.5e0 THEN rc / range_m * exp(-79.43e0 * angle) ELSE 0 END AS w FROM angled),
found AS (SELECT {k}, {reach} AS reach, {near} AS flag, max(w) > 0 AS any_w,
  sum(w * 10e0 ^ (dbz / 10e0)) FILTER (w > 0 AND dbz IS NOT NULL) / sum(w) FILTER (w > 0 AND dbz IS NOT NULL) AS dbz,
  sum(w * vel) FILTER (w > 0 AND vel IS NOT NULL) / sum(w) FILTER (w > 0 AND vel IS NOT NULL) AS vel,
  arg_max(width, {{'w': w, 'r': -ray_idx, 'g': -gate_idx}}) FILTER (w > 0 AND width IS NOT NULL) AS width
  FROM weighed GROUP BY {k}),
ruled AS (SELECT {k}, CASE WHEN NOT reach OR ({'flag = 0' if flag_any else 'false'}) THEN 0 WHEN any_w THEN 2 WHEN flag = 1 THEN 1 ELSE 0 END AS rule, 10e0 * log10(dbz) AS dbz, vel, width FROM found)
SELECT {', '.join(f'c.{x}' for x in keys)}, {', '.join(f"round(CASE WHEN rule = 2 AND r.{m} IS NOT NULL THEN r.{m} WHEN rule > 0 THEN -9999e0 ELSE -32768e0 END, 4) + 0e0 AS {m}" for m in KINDS)}
FROM cells c LEFT JOIN ruled r ON {' AND '.join(f'c.{x} = r.{x}' for x in keys)}"""


_FLAT = "SELECT CAST(j.range AS INT) AS iy, CAST(i.range AS INT) AS ix, 1e3 * j.range AS y, 1e3 * i.range AS x, greatest(0.01e0 * sqrt(1e6 * j.range * j.range + 1e6 * i.range * i.range), 750e0) AS eff_h, greatest(0.01e0 * sqrt(1e6 * j.range * j.range + 1e6 * i.range * i.range), 187.5e0) AS eff_v FROM range(26) j, range(21) i"
_LEVELS = "SELECT c.*, CAST(k.range AS INT) AS iz, 250e0 * k.range AS z FROM ({flat}) c, range(9) k"
_PLANAR = "(gx - x) * (gx - x) + (gy - y) * (gy - y) <= eff_h * eff_h"
_AZ = "CASE WHEN pi() / 2 - atan2(y - y0, x - x0) < 0 THEN pi() / 2 - atan2(y - y0, x - x0) + 2 * pi() ELSE pi() / 2 - atan2(y - y0, x - x0) END"
_HAVERSINE = "2e0 * asin(least(1e0, sqrt(sin(({e} - el) / 2) ^ 2 + cos(el) * cos({e}) * sin((({a}) - az) / 2) ^ 2)))"



def _rhi_kernel(sections: str, own: str, azimuth: str) -> str:
    """SQL of vertical sections, each a volume: a gate meets the two points on either side of its ground range."""
    cells = f"SELECT n.section, CAST(k.range AS INT) AS iz, CAST(i.range AS INT) AS ir, 250e0 * k.range AS z, 500e0 * i.range AS r, greatest(5e0 * i.range, 187.5e0) AS eff_v FROM range(9) k, range(51) i, ({sections}) n"
    between = f"(SELECT q.*, {own} AS own_section, CAST(floor(s / 500e0) AS INT) + unnest([-1, 0, 1, 2]) AS side FROM q) q JOIN cells c"
    planar = f"sqrt((r * sin({azimuth}) - x0) ^ 2 + (r * cos({azimuth}) - y0) ^ 2)"
    return _kernel(cells, "c.section = q.own_section AND c.ir = q.side AND abs(s - r) <= 375e0", "abs(h - z)", "z", "abs(elc - el)", f"sin({planar} / {_REFF}) * ({_REFF} + z - altitude) / cos(elc)", "abs(rc - range_m) > 187.5e0", ["section", "iz", "ir"], pairs=between)


QUERIES = {f.__name__: f for f in (beam_height, beam_info, gate_position, azimuth_offset, rhohv_fix, platform_motion, db_linear, appx_inverse, spherical_angle, qc_copies, qc_below, qc_above, qc_four, clutter_mask, clutter_stats, height_mask, sector_mask, despeckle_range, despeckle_azimuth, phidp_std_mask, split_sweeps, volume_time_span, regular_grid, tile_name, terrain_mask, pack_int16, route_scans, grid_composite, grid_volume, grid_ppi_sweeps, grid_rhi_azimuths, grid_column)}

SQL = {
    "beam_height": _sql(f"SELECT ray_idx, gate_idx, round({_H}, 4) + 0e0 AS height FROM g"),
    "beam_info": _sql("SELECT ray_idx, gate_idx, round(az, 8) + 0e0 AS az, round(el, 8) + 0e0 AS el, range_m, round(h, 4) + 0e0 AS h FROM q", _LOCATED),
    "gate_position": _sql("SELECT ray_idx, gate_idx, round(s, 4) + 0e0 AS s, round(gx, 4) + 0e0 AS gx, round(gy, 4) + 0e0 AS gy FROM q", _LOCATED),
    "azimuth_offset": _sql("SELECT ray_idx, gate_idx, ((azimuth - 10.5e0) % 360e0 + 360e0) % 360e0 AS azimuth FROM g"),
    "rhohv_fix": _sql("SELECT ray_idx, gate_idx, round((snr + 32639e0) / 65533e0, 8) + 0e0 AS rhohv FROM g"),
    "platform_motion": _sql("SELECT ray_idx, gate_idx, round(CASE WHEN u > 20e0 THEN u - 40e0 ELSE u END, 4) + 0e0 AS vel FROM u", f"a AS (SELECT ray_idx, gate_idx, {_UNFOLD} AS v FROM g), u AS (SELECT *, CASE WHEN v < -20e0 THEN v + 40e0 ELSE v END AS u FROM a)"),
    "db_linear": _sql("SELECT ray_idx, gate_idx, round(10e0 ^ (dbz / 10e0), 4) + 0e0 AS linear, round(CASE WHEN snr = 0 THEN '-inf'::DOUBLE ELSE 10e0 * log10(nullif(snr, 0)) END, 4) + 0e0 AS db, round(dbz, 4) + 0e0 AS back FROM g"),
    "appx_inverse": _sql("SELECT ray_idx, gate_idx, round(-2.5e0 + gy / (1e3 * (111.13209e0 - 0.56605e0 * cos(2e0 * radians(-2.5e0)))), 8) + 0e0 AS lat, round(-45.25e0 + gx / (1e3 * 111.41513e0 * cos(radians(-2.5e0))), 8) + 0e0 AS lon FROM q", _LOCATED),
    "spherical_angle": _sql(f"SELECT ray_idx, gate_idx, round({_HAVERSINE.format(e='0.1e0', a='0.5e0')}, 8) + 0e0 AS angle FROM q", _LOCATED),
    "qc_copies": _sql("SELECT ray_idx, gate_idx, round(dbz, 4) + 0e0 AS raw_dbz, round(dbz::FLOAT::DOUBLE, 4) + 0e0 AS dbz, round(vel, 4) + 0e0 AS raw_vel, round(vel::FLOAT::DOUBLE, 4) + 0e0 AS vel FROM g"),
    "qc_below": _sql(_masked("sqi < 0.35e0", skip=("sqi",))),
    "qc_above": _sql(_masked("width IS NULL OR width >= 8", skip=("sqi",))),
    "qc_four": _sql(_masked("sqi < 0.35e0 OR snr < 6 OR rhohv < 0.7e0 OR width >= 8 OR width IS NULL", skip=("sqi", "phidp"))),
    "clutter_mask": _sql(_masked(_IS_CLUTTER)),
    "clutter_stats": _sql(f"SELECT sweep_idx, count(*) AS n_gates, count_if({_IS_CLUTTER}) AS n_bad, count_if(NOT {_IS_CLUTTER} AND dbz IS NOT NULL) AS n_real, round(100e0 * count_if({_IS_CLUTTER}) / count(*), 2) AS pct_bad, round(100e0 * count_if(NOT {_IS_CLUTTER} AND dbz IS NOT NULL) / count(*), 2) AS pct_real FROM g GROUP BY sweep_idx"),
    "height_mask": _sql(_masked(f"dbz IS NOT NULL AND {_H} < 300", skip=("sqi",))),
    "sector_mask": _sql(_masked("sqi IS NOT NULL AND (CASE WHEN azimuth < heading THEN azimuth - heading + 360e0 WHEN azimuth - heading > 360 THEN azimuth - heading - 360e0 ELSE azimuth - heading END) BETWEEN 10.5e0 AND 345.5e0")),
    "despeckle_range": _despeckled(["dbz", "vel"], "ray_idx", "gate_idx", 2),
    "despeckle_azimuth": _despeckled(["dbz", "sqi"], "gate_idx", "ray_idx", 2),
    "phidp_std_mask": _sql(
        _masked("bad", ["dbz", "phidp"], source="b"),
        "a AS (SELECT *, CASE WHEN phidp < 0 THEN phidp + 360e0 ELSE phidp END AS up FROM g), b AS (SELECT *, count(*) OVER w <> count(phidp) OVER w OR NOT coalesce(stddev_samp(up) OVER w <= 12, false) AS bad FROM a WINDOW w AS (PARTITION BY ray_idx ORDER BY gate_idx ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING))",
    ),
    "split_sweeps": _sql("SELECT sweep_idx, ray_idx, any_value(azimuth) AS azimuth, count(dbz) AS n_dbz FROM g GROUP BY sweep_idx, ray_idx"),
    "volume_time_span": _sql("SELECT sweep_idx, arg_min(time, ray_idx) AS start, arg_max(time, ray_idx) AS stop FROM g WHERE gate_idx = 0 GROUP BY sweep_idx"),
    "regular_grid": _sql("SELECT n.sweep_idx, CAST(k.range AS INT) AS iz, CAST(j.range AS INT) AS iy, CAST(i.range AS INT) AS ix, 250e0 * k.range AS z, 1e3 * j.range AS y, 1e3 * i.range AS x FROM range(9) k, range(26) j, range(21) i, (SELECT DISTINCT sweep_idx FROM g) n"),
    "tile_name": _sql("SELECT ray_idx, gate_idx, (CASE WHEN a < 0 THEN 'S' ELSE 'N' END) || lpad(CAST(CAST(floor(abs(a)) AS INT) + (a < 0)::INT AS VARCHAR), 2, '0') || (CASE WHEN b < 0 THEN 'W' ELSE 'E' END) || lpad(CAST(CAST(floor(abs(b)) AS INT) + (b < 0)::INT AS VARCHAR), 3, '0') AS tile FROM (SELECT *, dbz - 30e0 AS a, vel * 7e0 AS b FROM g)"),
    "terrain_mask": _sql(
        "SELECT ray_idx, gate_idx, round(CASE WHEN sqi IS NOT NULL AND n % 7 <> 0 AND n % 97 > 50 THEN NULL ELSE dbz END, 4) + 0e0 AS dbz, round(CASE WHEN sqi IS NOT NULL AND n % 7 <> 0 AND n % 97 > 50 THEN NULL ELSE vel END, 4) + 0e0 AS vel FROM l LEFT JOIN dem ON dem.r = round((ceil(lat) - lat) * 10) AND dem.c = round((lon - floor(lon)) * 10) AND lat BETWEEN -3 AND -2 AND lon BETWEEN -46 AND -45",
        _LOCATED + ", dem AS (SELECT ray_idx % 11 AS r, gate_idx % 11 AS c, count(dbz) AS n FROM g GROUP BY 1, 2), l AS (SELECT *, -2.52e0 + gy / (1e3 * (111.13209e0 - 0.56605e0 * cos(2e0 * radians(-2.52e0)))) AS lat, -45.23e0 + gx / (1e3 * 111.41513e0 * cos(radians(-2.52e0))) AS lon FROM q)",
    ),
    "pack_int16": _sql("SELECT ray_idx, gate_idx, CAST(CASE WHEN a BETWEEN -32767 AND 32767 THEN a ELSE -32768 END AS SMALLINT) AS dbz, CAST(CASE WHEN b BETWEEN -32767 AND 32767 THEN b ELSE -32768 END AS SMALLINT) AS width, CAST(CASE WHEN c BETWEEN -32767 AND 32767 THEN c ELSE -32768 END AS SMALLINT) AS phidp FROM p", "p AS (SELECT *, round(dbz / 0.01e0) AS a, round((width - 327.68e0) / 0.01e0) AS b, round((phidp - 180e0) / 0.0054933317e0) AS c FROM g)"),
    "route_scans": "WITH f AS (SELECT event_id, CASE WHEN event_type = 'click' THEN 'PICCOLO_LONG' WHEN event_type = 'view' THEN 'RHI_A' WHEN event_id % 997 = 996 THEN 'VOL2' WHEN event_type = 'error' THEN 'TEST' ELSE 'CIRC' END AS n FROM events), s AS (SELECT *, count_if(n = 'VOL2') OVER (ORDER BY event_id) > 0 AS second FROM f) SELECT event_id AS file_order, CASE WHEN n = 'RHI_A' THEN 'rhi' WHEN n = 'TEST' THEN 'none' WHEN second THEN 'volume2' ELSE 'volume1' END AS product FROM s",
    "grid_composite": _sql(
        "SELECT c.iy, c.ix, c.y, c.x, " + ", ".join(f"round(CASE WHEN seen = 1 THEN coalesce(b.{m}, -9999e0) ELSE -32768e0 END, 4) + 0e0 AS {m}" for m in KINDS) + " FROM cells c LEFT JOIN b USING (iy, ix)",
        _LOCATED + f", m AS (SELECT ray_idx, gate_idx, gx, gy, sqi, " + ", ".join(f"CASE WHEN sqi < 0.35e0 THEN NULL ELSE {m} END AS {m}" for m in KINDS) + f" FROM q), cells AS ({_FLAT}), b AS (SELECT iy, ix, max(CASE WHEN sqi IS NOT NULL THEN 1 ELSE 0 END) AS seen, " + ", ".join(f"arg_max({{'v': {m}}}, {{'v': dbz, 'r': -ray_idx, 'g': -gate_idx}}) FILTER (dbz IS NOT NULL).v AS {m}" for m in KINDS) + f" FROM cells c JOIN m ON {_PLANAR} GROUP BY iy, ix)",
    ),
    "grid_volume": _sql("", _LOCATED + ", " + _kernel(_LEVELS.format(flat=_FLAT), _PLANAR, "abs(h - z)", "z", _HAVERSINE.format(e="elc", a=_AZ), f"sin(sqrt((x - x0) ^ 2 + (y - y0) ^ 2) / {_REFF}) * ({_REFF} + z - altitude) / cos(elc)", "abs(rc - range_m) > 187.5e0", ["iz", "iy", "ix"])),
    "grid_ppi_sweeps": "SELECT sweep AS sweep_idx, * EXCLUDE (sweep) FROM (" + _sql("", _LOCATED + ", " + _kernel(f"SELECT f.*, n.sweep FROM ({_FLAT}) f, (SELECT DISTINCT sweep_idx AS sweep FROM g) n", "c.sweep = q.sweep_idx AND " + _PLANAR, "0e0", "0e0", _HAVERSINE.format(e="el", a=_AZ), "sqrt((x - x0) ^ 2 + (y - y0) ^ 2)", "abs(rc - range_m) > 750e0", ["sweep", "iy", "ix"], flag_any=True)) + ")",
    "grid_rhi_azimuths": "SELECT section AS azimuth_idx, * EXCLUDE (section) FROM (" + _sql("", _LOCATED + ", " + _rhi_kernel("SELECT DISTINCT ray_idx % 50 AS section FROM g", "ray_idx % 50", "radians(1e0 * section)")) + ")",
    "grid_column": _sql("", _LOCATED + ", " + _kernel("SELECT CAST(k.range AS INT) AS iz, 250e0 * k.range AS z, greatest(2.5e0 * k.range, 187.5e0) AS eff_v FROM range(9) k", "true", "abs(h - z)", "z", "abs(elc - el)", "CASE WHEN elc IS NOT NULL THEN z / cos(el) END", "abs(rc - range_m) > 187.5e0", ["iz"])),
}
