"""Gridding: volumes, vertical and horizontal sections, composites and columns.

Gates meet cells without a join. On a regular axis the cells that a gate can reach are ranges of index numbers, which follow from
its own place: if a cell at distance d from the origin takes gates within max(roi, f d), then a gate at distance g reaches
no farther than max(roi, f g / (1 - f)). A gate is spread over these ranges, the exact distance test follows, and a pair is
spread only over the levels near the beam: those whose beam angle can pass the power threshold, and those within the vertical
radius. All results of a cell (nearest gate, sums, largest weight) come from one aggregation, which is partial before its
shuffle. It sorts its pairs, so large tables are first dealt to tasks of bounded numbers of gates.

Every gate also marks its volume, in the same aggregation, so that volumes are known without a second scan. Cells that no
gate reaches are filled in line by line: what is shuffled for them is a row for each line of the innermost axis.

Gates need volume_id, ray_idx, gate_idx, range_m, azimuth, elevation, altitude, x0, y0 (the radar's place) and the moments;
the drivers join them from the rays and take each volume's first ray as its reference. Ties go to the smallest (ray_idx,
gate_idx). Sentinels: UNSEEN where no gate is near, NO_VALID where gates are near without a valid value. A volume without gates
has no grid; gates whose place is missing or NaN reach no cell.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beamgrid.functions import geometry as G
from beamgrid.model import BEAM_SLOPE, NO_VALID, R_EFF, UNSEEN

#: Minimum (a column of the volume, too), increment, number.
Axis = tuple[float | Column, float, int]


def _at(axis: Axis, i: Column) -> Column:
    first = axis[0] if isinstance(axis[0], Column) else F.lit(float(axis[0]))
    return first + float(axis[1]) * i


def regular_grid(spark: SparkSession, **axes: Axis) -> DataFrame:
    """A row for each point of the axes, the first outermost: i<name> and the coordinate <name> for each."""
    n = math.prod(a[2] for a in axes.values())
    out, step = spark.range(n), n
    for name, a in axes.items():
        step //= a[2]
        out = out.withColumn(f"i{name}", (F.floor(F.col("id") / step) % a[2]).cast("int"))
    return out.select(*(f"i{name}" for name in axes), *(_at(a, F.col(f"i{name}")).alias(name) for name, a in axes.items()))


def volume_points(volumes: DataFrame, **axes: Axis) -> DataFrame:
    """The points of regular_grid for each volume_id, axis by axis, so that no row ever holds more than the points of one axis."""
    out = volumes.select("volume_id")
    for name, a in axes.items():
        out = out.select("*", F.explode(F.sequence(F.lit(0), F.lit(a[2] - 1))).alias(f"i{name}"))
    return out.select("volume_id", *(f"i{name}" for name in axes), *(_at(a, F.col(f"i{name}")).alias(name) for name, a in axes.items()))


def locate(gates: DataFrame) -> DataFrame:
    """gates with az, el (radians), h (beam height), s (ground range), gx, gy."""
    out = gates.withColumns({"az": F.radians("azimuth"), "el": F.radians("elevation"), "h": G.beam_height(F.col("range_m"), F.col("elevation"), F.col("altitude"))})
    out = out.withColumn("s", G.ground_range(F.col("range_m"), F.col("elevation"), F.col("h")))
    x, y = G.gate_xy(F.col("s"), F.col("azimuth"), F.col("x0"), F.col("y0"))
    return out.withColumns({"gx": x, "gy": y})


#: The number that stands for the volume as a whole instead of a cell.
_WHOLE = -1


def _numbers(axis: Axis, low: Column, high: Column) -> Column:
    """Numbers of the points of an axis from low to high; none where a bound is missing or NaN."""
    first = axis[0] if isinstance(axis[0], Column) else F.lit(float(axis[0]))
    a, b = ((v - first) / float(axis[1]) for v in ((low, high) if axis[1] > 0 else (high, low)))
    a, b = F.greatest(F.ceil(a).cast("double"), F.lit(0.0)), F.least(F.floor(b).cast("double"), F.lit(axis[2] - 1.0))
    held = F.when((a <= b) & low.isNotNull() & high.isNotNull() & ~F.isnan(low) & ~F.isnan(high), F.sequence(a.cast("int"), b.cast("int")))
    return F.coalesce(held, F.array().cast("array<int>"))


def _and_whole(numbers: Column) -> Column:
    return F.concat(numbers, F.array(F.lit(_WHOLE)))


def _or_whole(outer: str, numbers: Column) -> Column:
    return F.when(F.col(outer) == _WHOLE, F.array(F.lit(_WHOLE))).otherwise(numbers)


def _within(outer: str, test: Column) -> Column:
    return (F.col(outer) == _WHOLE) | test


def inflated(distance: Column, roi: Column | float, inflation: float) -> Column:
    roi = roi if isinstance(roi, Column) else F.lit(float(roi))
    return F.greatest(inflation * distance, roi) if inflation > 0 else roi


def reach(distance: Column, roi: Column | float, inflation: float) -> Column:
    """How far from a gate at a distance from the origin a cell can be whose radius it lies in, rounded up."""
    if inflation >= 1:
        return F.lit(1e12)
    return inflated(distance, roi, inflation / (1 - inflation)) * (1 + 1e-9) + 1e-3


def near_cells(gates: DataFrame, x: Axis, y: Axis, h_roi: Column | float, inflation: float) -> DataFrame:
    """Located gates with iy, ix, y, x, d0 of the cells that they are near to, and once with numbers of _WHOLE."""
    held = gates.withColumn("_e", reach(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")), h_roi, inflation))
    held = held.withColumn("iy", F.explode(_and_whole(_numbers(y, F.col("gy") - F.col("_e"), F.col("gy") + F.col("_e"))))).withColumn("y", _at(y, F.col("iy")))
    dy = F.col("gy") - F.col("y")
    half = F.sqrt(F.greatest(F.col("_e") * F.col("_e") - dy * dy, F.lit(0.0)))
    held = held.withColumn("ix", F.explode(_or_whole("iy", _numbers(x, F.col("gx") - half, F.col("gx") + half)))).withColumn("x", _at(x, F.col("ix")))
    return _exactly(held, h_roi, inflation)


def _exactly(pairs: DataFrame, h_roi: Column | float, inflation: float) -> DataFrame:
    pairs = pairs.withColumn("d0", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")))
    dx, dy, e = F.col("gx") - F.col("x"), F.col("gy") - F.col("y"), inflated(F.col("d0"), h_roi, inflation)
    return pairs.filter(_within("iy", dx * dx + dy * dy <= e * e)).drop("_e")


def near_degrees(gates: DataFrame, lat: Axis, lon: Axis, h_roi: Column | float, inflation: float) -> DataFrame:
    """As near_cells, for a grid of regular degrees around each volume's lat0, lon0: iy counts latitudes, ix longitudes.

    The projection never shortens a distance, so the degrees that a gate can reach are bounded as on a sphere of the least
    radius of curvature, by its own latitude and longitude.
    """
    lat0, lon0 = F.col("lat0"), F.col("lon0")
    glat, glon = G.tm_inverse(F.col("gx"), F.col("gy"), lat0, lon0)
    held = gates.withColumns({"_e": reach(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")), h_roi, inflation), "_lat": glat, "_lon": glon})
    angle = F.least(F.col("_e") * (1.01 / 6335000.0), F.lit(math.pi))
    top = F.abs(F.radians("_lat")) + angle
    wide = F.when(top < 1.57, F.asin(F.least(F.lit(1.0), F.sin(angle) / F.cos(F.radians("_lat"))))).otherwise(math.pi)
    held = held.withColumns({"_a": F.degrees(angle), "_w": F.degrees(wide)})
    # an axis that passes a pole goes on beyond 90 degrees, where the projection knows a latitude by its sine only
    middle = _at(lat, F.lit((lat[2] - 1) / 2))
    places = [v + 360.0 * F.round((middle - v) / 360.0) for v in (F.col("_lat"), 180.0 - F.col("_lat"))]
    rows = F.array_union(*(_numbers(lat, v - F.col("_a"), v + F.col("_a")) for v in places))
    held = held.withColumn("iy", F.explode(_and_whole(rows)))
    held = held.withColumn("ix", F.explode(_or_whole("iy", _numbers(lon, F.col("_lon") - F.col("_w"), F.col("_lon") + F.col("_w")))))
    held = G.with_tm(held.drop("_lat", "_lon", "_a", "_w"), _at(lat, F.col("iy")), _at(lon, F.col("ix")), lat0, lon0, "_x", "_y")
    # behind a generator the long expressions of x and y are not copied into the distance test
    kept = [c for c in held.columns if c not in ("_x", "_y")]
    held = held.select(*kept, F.explode(F.array(F.struct(F.col("_x").alias("x"), F.col("_y").alias("y")))).alias("_p")).select(*kept, "_p.x", "_p.y")
    return _exactly(held, h_roi, inflation)


def beam_heights(gates: DataFrame, power: float) -> DataFrame:
    """Located gates with the heights (_low, _high) between which a beam can still have weight; all where it has no limit."""
    if power <= 0:
        return gates.withColumns({"_low": F.lit(-1e12), "_high": F.lit(1e12)})
    delta = max(0.0, -math.log(min(power, 1.0)) / BEAM_SLOPE) + 1e-9

    def height(el: Column) -> Column:
        el = F.greatest(F.least(el, F.lit(math.pi / 2)), F.lit(-math.pi / 2))
        return F.sqrt(F.col("range_m") ** 2 + R_EFF**2 + 2.0 * F.col("range_m") * R_EFF * F.sin(el)) - R_EFF + F.col("altitude")

    return gates.withColumns({"_low": height(F.col("el") - delta) - 1.0, "_high": height(F.col("el") + delta) + 1.0})


def _at_levels(pairs: DataFrame, z: Axis, outer: str | None) -> DataFrame:
    """Pairs on each level that the gate can matter for: near in height (eff_v), or inside the beam."""
    low, high = F.least(F.col("_low"), F.col("h") - F.col("eff_v")), F.greatest(F.col("_high"), F.col("h") + F.col("eff_v"))
    numbers = _numbers(z, low, high)
    numbers = _and_whole(numbers) if outer is None else _or_whole(outer, numbers)
    return pairs.withColumn("iz", F.explode(numbers)).withColumn("z", _at(z, F.col("iz")))


def _angle_weight(angle: Column, power: float) -> Column:
    w = F.exp(-BEAM_SLOPE * angle)
    return F.when(w < power, 0.0).otherwise(w)


def _cell_elevation(dz: Column, r: Column) -> Column:
    """Elevation at which a beam of range r reaches dz above the radar; null where it can't."""
    sine = F.when(r > 0, ((dz + R_EFF) * (dz + R_EFF) - r * r - R_EFF**2) / (2.0 * r * R_EFF))
    return F.when(F.abs(sine) < 1.0, F.asin(sine))


def _grid_azimuth(dx: Column, dy: Column) -> Column:
    az = math.pi / 2 - F.atan2(dy, dx)
    return F.when(az < 0, az + 2 * math.pi).otherwise(az)


def _accumulate(pairs: DataFrame, cell: list[str], moments: dict[str, str], vertical: bool, flag: Column, carry: tuple[str, ...]) -> DataFrame:
    """One row per volume and cell: its nearest gate's distance and flag, and each moment's value.

    pairs: gates with a weight w (0 or null: none), dist (vertical distance) and the cell's columns. carry: columns that are
    the same in a whole volume.
    """
    w = F.col("w")
    heavy = w > 0
    aggregates = [F.max(heavy.cast("int")).alias("any_w"), F.max(flag.cast("int")).alias("any_flag")]
    if vertical:
        aggregates.append(F.min(F.struct("dist", "ray_idx", "gate_idx", flag.alias("flag"), "eff_v")).alias("near"))
    for m, kind in moments.items():
        has = heavy & F.col(m).isNotNull()
        aggregates.append(F.sum(F.when(has, w)).alias(f"w_{m}"))
        if kind == "nearest":
            aggregates.append(F.max(F.when(has, F.struct(w.alias("w"), (-F.col("ray_idx")).alias("a"), (-F.col("gate_idx")).alias("b"), F.col(m).alias("v")))).alias(f"v_{m}"))
        else:
            value = G.db_to_linear(F.col(m)) if kind == "linear" else F.col(m)
            aggregates.append(F.sum(F.when(has, w * value)).alias(f"v_{m}"))
    out = pairs.groupBy("volume_id", *carry, *cell).agg(*aggregates)
    values = {}
    for m, kind in moments.items():
        mean = F.col(f"v_{m}.v") if kind == "nearest" else F.col(f"v_{m}") / F.col(f"w_{m}")
        if kind == "linear":
            mean = F.when(mean > 0, 10.0 * F.log10(mean)).otherwise(NO_VALID)
        seen = F.col("near.flag") if vertical else (F.col("any_flag") == 1)
        seen = F.coalesce(seen, F.lit(False))
        weighted = F.coalesce(F.col("any_w") == 1, F.lit(False))
        if not vertical:  # cells that no gate flags are left as they are
            weighted = weighted & seen
        value = F.when(weighted & F.col(f"w_{m}").isNotNull(), mean).when(weighted | seen, NO_VALID).otherwise(UNSEEN)
        if vertical:
            value = F.when(F.col("near.dist") <= F.col("near.eff_v"), value).otherwise(UNSEEN)
        values[m] = value
    return out.select("volume_id", *carry, *cell, *(v.alias(m) for m, v in values.items()))


def fill_grid(found: DataFrame, axes: dict[str, Axis], moments: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """All cells of the grid of each volume, with found's values where it has some.

    found has a row of _WHOLE numbers for each volume, which marks all lines of the innermost axis; a line's cells are then
    laid out in the task that holds it. No row ever holds more than the points of one axis, or the lines of a volume.
    """
    *outer, inner = axes
    last = axes[inner][2] - 1
    lines = math.prod(axes[name][2] for name in outer)
    line, step = F.lit(0).cast("long"), 1
    for name in reversed(outer):
        line, step = line + F.col(f"i{name}").cast("long") * step, step * axes[name][2]
    i = f"i{inner}"
    marks = F.when(F.col(i) == _WHOLE, F.sequence(F.lit(0).cast("long"), F.lit(lines - 1).cast("long"))).otherwise(F.array(line))
    seen = found.select("volume_id", *carry, F.explode(marks).alias("_line"), F.when(F.col(i) != _WHOLE, F.struct(i, *moments)).alias("_cell"))
    rows = seen.groupBy("volume_id", *carry, "_line").agg(F.sort_array(F.collect_list("_cell")).alias("_seen"))

    def stretch(k: Column) -> Column:
        """Unseen cells between seen ones number k - 1 and k, then the latter."""
        a = F.coalesce(F.get("_seen", k - 1)[i], F.lit(-1)) + 1
        b = F.coalesce(F.get("_seen", k)[i] - 1, F.lit(last))
        gap = F.transform(F.sequence(a, F.greatest(a, b)), lambda n: F.struct(n.alias(i), *(F.lit(UNSEEN).alias(m) for m in moments)))
        none = F.filter(gap, lambda c: F.lit(False))
        return F.concat(F.when(a <= b, gap).otherwise(none), F.when(k < F.size("_seen"), F.slice("_seen", k + 1, 1)).otherwise(none))

    cells = rows.select("volume_id", *carry, "_line", F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.size("_seen")), stretch))).alias("_c"))
    numbers, step = {}, lines
    for name in outer:
        step //= axes[name][2]
        numbers[f"i{name}"] = (F.floor(F.col("_line") / step) % axes[name][2]).cast("int")
    out = cells.select("volume_id", *carry, *(v.alias(k) for k, v in numbers.items()), F.col(f"_c.{i}").alias(i), *(F.col(f"_c.{m}").alias(m) for m in moments))
    return out.select("volume_id", *carry, *(f"i{name}" for name in axes), *(_at(a, F.col(f"i{name}")).alias(name) for name, a in axes.items()), *moments)


#: Gates that a task spreads over cells, on average, and rays that stay together.
TASK_GATES, TASK_RAYS = 1 << 17, 16
#: Tasks up to which Spark deals rows straight to files; beyond, each task of the scan sorts its rows in memory first.
UNSORTED = 200


def _tasks(n_gates: int) -> int:
    """Numbers of gates a little above the average are better than a deal that sorts; twice the average is the most."""
    tasks = -(-n_gates // TASK_GATES)
    return tasks if tasks <= UNSORTED else max(UNSORTED, -(-n_gates // (2 * TASK_GATES)))


def _dealt(gates: DataFrame, n_gates: int | None, columns: list[str]) -> DataFrame:
    """The columns of gates, dealt to tasks in blocks of rays, so that the pairs a task sorts don't grow with the table.

    n_gates: at least the number of gates, counted where it isn't given. Few gates stay where they are.
    """
    tasks = _tasks(gates.count() if n_gates is None else n_gates)
    out = gates.select(*dict.fromkeys(columns))
    return out.repartition(tasks, "volume_id", F.floor(F.col("ray_idx") / TASK_RAYS)) if tasks > 1 else out


def _needed(gates: DataFrame, moments, missing_key: str, valid_key: str, carry: tuple[str, ...], n_gates: int | None) -> DataFrame:
    """Located gates with the columns that a grid takes, dealt to tasks."""
    known = ["volume_id", *carry, "ray_idx", "gate_idx", "range_m", "altitude", "x0", "y0"]
    values = [*moments, missing_key, valid_key]
    dealt = _dealt(gates, n_gates, [*known, "azimuth", "elevation", *values])
    return locate(dealt).select(*dict.fromkeys([*known, "az", "el", "h", "s", "gx", "gy", *values]))


def grid_volume(gates: DataFrame, moments: dict[str, str], x: Axis, y: Axis, z: Axis, h_roi: Column | float, v_roi: float, inflation: float, power: float, missing_key: str = "sqi", valid_key: str = "dbz", carry: tuple[str, ...] = (), n_gates: int | None = None) -> DataFrame:
    """Values on z, y, x. moments: name to linear, weighted or nearest."""
    held = beam_heights(_needed(gates, moments, missing_key, valid_key, carry, n_gates), power)
    found = _volume(near_cells(held, x, y, h_roi, inflation), moments, z, h_roi, v_roi, inflation, power, missing_key, valid_key, carry)
    return fill_grid(found, {"z": z, "y": y, "x": x}, list(moments), carry)


def _volume(pairs: DataFrame, moments: dict[str, str], z: Axis, h_roi: Column | float, v_roi: float, inflation: float, power: float, missing_key: str, valid_key: str, carry: tuple[str, ...]) -> DataFrame:
    pairs = _at_levels(pairs.withColumn("eff_v", inflated(F.col("d0"), v_roi, inflation)), z, "iy")
    dx, dy, dz = F.col("x") - F.col("x0"), F.col("y") - F.col("y0"), F.col("z") - F.col("altitude")
    pairs = pairs.withColumn("el_cell", _cell_elevation(dz, F.col("range_m")))
    angle = G.spherical_angle(F.col("az"), F.col("el"), _grid_azimuth(dx, dy), F.col("el_cell"))
    pairs = pairs.withColumn("r_cell", F.sin(F.sqrt(dx * dx + dy * dy) / R_EFF) * (R_EFF + dz) / F.cos("el_cell"))
    roi = F.least(h_roi, F.lit(float(v_roi))) if isinstance(h_roi, Column) else F.lit(float(min(h_roi, v_roi)))
    pairs = pairs.withColumns({"w": _weight(angle, power, valid_key, roi), "dist": F.abs(F.col("h") - F.col("z"))})
    return _accumulate(pairs, ["iz", "iy", "ix"], moments, True, F.col(missing_key).isNotNull(), carry)


def _weight(angle: Column, power: float, valid_key: str, roi: Column | float) -> Column:
    """(cell range / r) * beam weight; nothing where the cell is not visible, the field not valid or the range too far off."""
    off = F.abs(F.col("r_cell") - F.col("range_m")) > roi
    return F.when(F.col(valid_key).isNotNull() & F.col("r_cell").isNotNull() & ~off & (F.col("range_m") > 0), F.col("r_cell") / F.col("range_m") * _angle_weight(angle, power))


def grid_rhi(gates: DataFrame, moments: dict[str, str], r: Axis, z: Axis, h_roi: float, v_roi: float, inflation: float, power: float, missing_key: str = "sqi", valid_key: str = "dbz", carry: tuple[str, ...] = (), n_gates: int | None = None) -> DataFrame:
    """Values on z, r: a vertical section along the first ray's azimuth; neighbours by ground range only.

    The azimuth is the volume's column az_first (radians); where gates lack it, it is taken from them by a scan of its own.
    """
    n_gates = gates.count() if n_gates is None else n_gates
    if "az_first" not in gates.columns:
        first = gates.groupBy("volume_id").agg(F.min_by(F.radians("azimuth"), F.struct("ray_idx", "gate_idx")).alias("az_first"))
        gates = gates.join(first, "volume_id")
    held = beam_heights(_needed(gates, [*moments, "az_first"], missing_key, valid_key, carry, n_gates), power)
    ahead = _numbers(r, F.col("s") - (h_roi + 1e-3), F.col("s") + (h_roi + 1e-3))
    behind = _numbers(r, -F.col("s") - (h_roi + 1e-3), -F.col("s") + (h_roi + 1e-3))
    pairs = held.withColumn("ir", F.explode(_and_whole(F.array_union(ahead, behind)))).withColumn("r", _at(r, F.col("ir")))
    pairs = pairs.filter(_within("ir", F.abs(F.col("s") - F.abs("r")) <= h_roi)).withColumn("eff_v", inflated(F.abs("r"), v_roi, inflation))
    pairs = _at_levels(pairs, z, "ir")
    dx = F.col("r") * F.sin("az_first") - F.col("x0")
    dy = F.col("r") * F.cos("az_first") - F.col("y0")
    dz = F.col("z") - F.col("altitude")
    pairs = pairs.withColumn("el_cell", _cell_elevation(dz, F.col("range_m")))
    angle = F.abs(F.col("el_cell") - F.col("el"))
    pairs = pairs.withColumn("r_cell", F.sin(F.sqrt(dx * dx + dy * dy) / R_EFF) * (R_EFF + dz) / F.cos("el_cell"))
    pairs = pairs.withColumns({"w": _weight(angle, power, valid_key, min(h_roi, v_roi)), "dist": F.abs(F.col("h") - F.col("z"))})
    found = _accumulate(pairs, ["iz", "ir"], moments, True, F.col(missing_key).isNotNull(), carry)
    return fill_grid(found, {"z": z, "r": r}, list(moments), carry)


def grid_column(gates: DataFrame, moments: dict[str, str], z: Axis, v_roi: float, inflation: float, power: float, missing_key: str = "sqi", valid_key: str = "dbz", carry: tuple[str, ...] = (), n_gates: int | None = None) -> DataFrame:
    """Values on z from all gates of a volume; no horizontal place is used, and the cell's range is z / cos(elevation)."""
    # the radius of the farthest level bounds the levels a gate is near to; the exact test follows
    far = max(abs(z[0]), abs(z[0] + z[1] * (z[2] - 1)))
    held = beam_heights(_needed(gates, moments, missing_key, valid_key, carry, n_gates), power).withColumn("eff_v", F.lit(max(inflation * far, v_roi)))
    pairs = _at_levels(held, z, None).withColumn("eff_v", inflated(F.abs("z"), v_roi, inflation))
    pairs = pairs.withColumn("el_cell", _cell_elevation(F.col("z") - F.col("altitude"), F.col("range_m")))
    pairs = pairs.withColumn("r_cell", F.when(F.col("el_cell").isNotNull(), F.col("z") / F.cos("el")))
    pairs = pairs.withColumns({"w": _weight(F.abs(F.col("el_cell") - F.col("el")), power, valid_key, v_roi), "dist": F.abs(F.col("h") - F.col("z"))})
    found = _accumulate(pairs, ["iz"], moments, True, F.col(missing_key).isNotNull(), carry)
    return fill_grid(found, {"z": z}, list(moments), carry)


def grid_ppi(gates: DataFrame, moments: dict[str, str], x: Axis, y: Axis, h_roi: float, inflation: float, power: float, missing_key: str = "sqi", valid_key: str = "dbz", carry: tuple[str, ...] = (), n_gates: int | None = None) -> DataFrame:
    """Values on y, x of one scan; planar ranges, no vertical test."""
    pairs = near_cells(_needed(gates, moments, missing_key, valid_key, carry, n_gates), x, y, h_roi, inflation)
    dx, dy = F.col("x") - F.col("x0"), F.col("y") - F.col("y0")
    angle = G.spherical_angle(F.col("az"), F.col("el"), _grid_azimuth(dx, dy), F.col("el"))
    pairs = pairs.withColumn("r_cell", F.sqrt(dx * dx + dy * dy)).withColumn("w", _weight(angle, power, valid_key, h_roi))
    found = _accumulate(pairs, ["iy", "ix"], moments, False, F.col(missing_key).isNotNull(), carry)
    return fill_grid(found, {"y": y, "x": x}, list(moments), carry)


def grid_composite(gates: DataFrame, moments: list[str], x: Axis, y: Axis, h_roi: float, inflation: float, missing_key: str = "sqi", valid_key: str = "dbz", carry: tuple[str, ...] = (), n_gates: int | None = None) -> DataFrame:
    """All moments of the near gate with the largest valid field; NO_VALID where it misses one, or gates near have none."""
    known, values = ["volume_id", *carry, "ray_idx", "gate_idx"], [*moments, missing_key, valid_key]
    dealt = _dealt(gates, n_gates, [*known, "range_m", "azimuth", "elevation", "altitude", "x0", "y0", *values])
    held = locate(dealt).select(*dict.fromkeys([*known, "gx", "gy", *values]))
    pairs = near_cells(held, x, y, h_roi, inflation)
    best = F.max(F.when(F.col(valid_key).isNotNull(), F.struct(F.col(valid_key).alias("v"), (-F.col("ray_idx")).alias("a"), (-F.col("gate_idx")).alias("b"), F.struct(*moments).alias("m"))))
    found = pairs.groupBy("volume_id", *carry, "iy", "ix").agg(best.alias("best"), F.max(F.col(missing_key).isNotNull()).alias("seen"))
    found = found.select("volume_id", *carry, "iy", "ix", *(F.when(F.col("seen"), F.coalesce(f"best.m.{m}", F.lit(NO_VALID))).otherwise(UNSEEN).alias(m) for m in moments))
    return fill_grid(found, {"y": y, "x": x}, moments, carry)


def with_latlon(grid: DataFrame, lat0: Column | float, lon0: Column | float) -> DataFrame:
    """A grid on y, x with the latitude and longitude of its cells."""
    lat, lon = G.tm_inverse(F.col("x"), F.col("y"), lat0, lon0)
    return grid.withColumns({"lat": lat, "lon": lon})


def place_radar(rays: DataFrame, lat0: Column | float, lon0: Column | float) -> DataFrame:
    """rays with x0, y0: the radar's place from a reference, ray by ray for moving platforms."""
    x, y = G.tm_forward(F.col("latitude").cast("double"), F.col("longitude").cast("double"), lat0, lon0)
    return rays.withColumns({"x0": x, "y0": y})


def cut(degrees: Column, increment: float) -> Column:
    """A latitude or longitude cut towards zero to a multiple of the increment."""
    ratio = degrees / increment
    whole = F.when(ratio < 0, F.ceil(ratio)).otherwise(F.floor(ratio))
    return F.when(F.abs(ratio - F.round(ratio)) > 1e-9, whole * increment).otherwise(degrees)


def reference(rays: DataFrame, increment: float | None = None) -> DataFrame:
    """volume_id, lat0, lon0, az_first: each volume's reference, which is the place of its first ray, and that ray's azimuth.

    increment: the reference is cut to multiples of so many degrees.
    """
    first = rays.groupBy("volume_id").agg(F.min_by(F.struct("latitude", "longitude", "azimuth"), "ray_idx").alias("f"))
    lat0, lon0 = (F.col(f"f.{c}").cast("double") for c in ("latitude", "longitude"))
    if increment is not None:
        lat0, lon0 = cut(lat0, increment), cut(lon0, increment)
    return first.select("volume_id", lat0.alias("lat0"), lon0.alias("lon0"), F.radians(F.col("f.azimuth").cast("double")).alias("az_first"))


def placed(gates: DataFrame, rays: DataFrame, increment: float | None = None) -> DataFrame:
    """gates with their rays' angles, altitude and place (x0, y0) from the volume's own reference (lat0, lon0, az_first).

    All volumes of a table are placed at once, each by its own first ray. Work that belongs to rays is done on rays.
    """
    own = place_radar(rays.join(reference(rays, increment), "volume_id"), F.col("lat0"), F.col("lon0"))
    angles = ["azimuth", "elevation", "altitude"]
    own = own.select("volume_id", "ray_idx", *(F.col(c).cast("double").alias(c) for c in angles), "x0", "y0", "lat0", "lon0", "az_first")
    return gates.drop(*angles, "x0", "y0", "lat0", "lon0", "az_first").join(own, ["volume_id", "ray_idx"])


def radar_volume(gates: DataFrame, rays: DataFrame, moments: dict[str, str], x: Axis, y: Axis, z: Axis, inflation: float, power: float, **keys) -> DataFrame:
    """grid_volume around each volume's first ray, with radii of three quarters of the increments, and the places of the cells."""
    out = grid_volume(placed(gates, rays), moments, x, y, z, 0.75 * x[1], 0.75 * z[1], inflation, power, carry=("lat0", "lon0"), n_gates=gates.count(), **keys)
    return with_latlon(out, F.col("lat0"), F.col("lon0"))


def radar_rhi(gates: DataFrame, rays: DataFrame, moments: dict[str, str], r: Axis, z: Axis, inflation: float, power: float, **keys) -> DataFrame:
    out = grid_rhi(placed(gates, rays), moments, r, z, 0.75 * r[1], 0.75 * z[1], inflation, power, carry=("lat0", "lon0", "az_first"), n_gates=gates.count(), **keys)
    lat, lon = G.tm_inverse(F.col("r") * F.sin("az_first"), F.col("r") * F.cos("az_first"), F.col("lat0"), F.col("lon0"))
    return out.withColumns({"lat": lat, "lon": lon})


def radar_ppi(gates: DataFrame, rays: DataFrame, moments: dict[str, str], x: Axis, y: Axis, inflation: float, power: float, **keys) -> DataFrame:
    out = grid_ppi(placed(gates, rays), moments, x, y, 0.75 * x[1], inflation, power, carry=("lat0", "lon0"), n_gates=gates.count(), **keys)
    return with_latlon(out, F.col("lat0"), F.col("lon0"))


def radar_composite(gates: DataFrame, rays: DataFrame, moments: list[str], x: Axis, y: Axis, inflation: float, **keys) -> DataFrame:
    out = grid_composite(placed(gates, rays), moments, x, y, 0.75 * x[1], inflation, carry=("lat0", "lon0"), n_gates=gates.count(), **keys)
    return with_latlon(out, F.col("lat0"), F.col("lon0"))


def radar_column(gates: DataFrame, rays: DataFrame, moments: dict[str, str], z: Axis, inflation: float, power: float, **keys) -> DataFrame:
    out = grid_column(placed(gates, rays), moments, z, 0.75 * z[1], inflation, power, carry=("lat0", "lon0"), n_gates=gates.count(), **keys)
    return out.withColumns({"lat": F.col("lat0"), "lon": F.col("lon0")})


def latlon_axes(lat0: Column, lon0: Column, latmin: float, latdim: int, lonmin: float, londim: int, degincr: float) -> tuple[Axis, Axis, Column]:
    """The latitude and longitude axes of a regular degree grid around a cut reference, and its radius of influence.

    The minima are offsets to the reference, rounded to two digits.
    """
    lat_km, lon_km = G.degree_lengths(lat0)
    roi = 0.75 * degincr * 1000.0 * F.sqrt(lat_km * lat_km + lon_km * lon_km)
    return (F.round(lat0 + latmin, 2), degincr, latdim), (F.round(lon0 + lonmin, 2), degincr, londim), roi


def radar_latlon_volume(gates: DataFrame, rays: DataFrame, moments: dict[str, str], latmin: float, latdim: int, lonmin: float, londim: int, degincr: float, z: Axis, inflation: float, power: float, missing_key: str = "sqi", valid_key: str = "dbz") -> DataFrame:
    """A volume on regular degrees around each volume's first ray, cut to multiples of degincr."""
    carry = ("lat0", "lon0")
    lat, lon, roi = latlon_axes(F.col("lat0"), F.col("lon0"), latmin, latdim, lonmin, londim, degincr)
    held = beam_heights(_needed(placed(gates, rays, degincr), moments, missing_key, valid_key, carry, gates.count()), power)
    found = _volume(near_degrees(held, lat, lon, roi, inflation), moments, z, roi, 0.75 * z[1], inflation, power, missing_key, valid_key, carry)
    return fill_grid(found.withColumnsRenamed({"iy": "ilat", "ix": "ilon"}), {"z": z, "lat": lat, "lon": lon}, list(moments), carry)
