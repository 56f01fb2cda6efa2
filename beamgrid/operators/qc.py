"""Quality control: each step sets moments to null where its rule says so, and never drops a gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beamgrid.functions.geometry import azimuth_offset

NAN = float("nan")


def mask(gates: DataFrame, moments: list[str], bad: Column) -> DataFrame:
    """Null the moments where bad is true; null and false keep them."""
    return gates.withColumns({m: F.when(bad, F.lit(None)).otherwise(F.col(m)) for m in moments})


def threshold_below(gates: DataFrame, moments: list[str], field: Column, value: float, skip: tuple[str, ...] = ()) -> DataFrame:
    """Null where field < value; a gate whose field is missing or NaN is kept."""
    return mask(gates, [m for m in moments if m not in skip], F.coalesce(field < value, F.lit(False)))


def threshold_above(gates: DataFrame, moments: list[str], field: Column, value: float, skip: tuple[str, ...] = ()) -> DataFrame:
    """Keep only where field < value; a gate whose field is missing or NaN is removed."""
    return mask(gates, [m for m in moments if m not in skip], ~F.coalesce(field < value, F.lit(False)))


def threshold_four(gates: DataFrame, moments: list[str], sqi: Column, snr: Column, rhohv: Column, width: Column, limits: tuple[float, float, float, float], skip: tuple[str, ...] = ("sqi", "phidp")) -> DataFrame:
    """The usual four tests at once; limits: sqi, snr, rhohv (below), width (from there on)."""
    low = lambda c, v: F.coalesce(c < v, F.lit(False))
    bad = low(sqi, limits[0]) | low(snr, limits[1]) | low(rhohv, limits[2]) | ~low(width, limits[3])
    return mask(gates, [m for m in moments if m not in skip], bad)


def is_clutter(dbz: Column, vel: Column, width: Column, height: Column, dbz_least: float, vel_most: float, width_most: float, below: float = 500.0) -> Column:
    """Strong, slow, narrow and low; a missing or NaN field is not clutter."""
    test = (dbz >= dbz_least) & ~F.isnan(dbz) & (F.abs(vel) <= vel_most) & (width <= width_most) & (height < below)
    return F.coalesce(test, F.lit(False))


def clutter_stats(gates: DataFrame, clutter: Column, dbz: Column, by: list[str] | None = None) -> DataFrame:
    """Counts of gates, of clutter and of present values that stay, with percentages of all to two digits."""
    n = F.count(F.lit(1))
    bad, real = (F.coalesce(F.sum(c.cast("long")), F.lit(0)) for c in (clutter, (~clutter & dbz.isNotNull())))
    share = lambda c: F.round(100.0 * c / F.greatest(n, F.lit(1)), 2)
    return gates.groupBy(*(by or [])).agg(n.alias("n_gates"), bad.alias("n_bad"), real.alias("n_real"), share(bad).alias("pct_bad"), share(real).alias("pct_real"))


def height_mask(gates: DataFrame, moments: list[str], raw_dbz: Column, height: Column, least: float, skip: tuple[str, ...] = ("SQI_FOR_MASK", "PID_FOR_QC")) -> DataFrame:
    return mask(gates, [m for m in moments if m not in skip], F.coalesce(raw_dbz.isNotNull() & (height < least), F.lit(False)))


def sector_mask(gates: DataFrame, moments: list[str], azimuth: Column, heading: Column, az_min: float, az_max: float, mask_key: str) -> DataFrame:
    """Null a sector relative to the heading, without wrap, where the mask field is present."""
    rel = azimuth - heading
    rel = F.when(rel < 0, rel + 360.0).when(rel > 360, rel - 360.0).otherwise(rel)
    return mask(gates, moments, F.coalesce(rel.between(az_min, az_max) & F.col(mask_key).isNotNull(), F.lit(False)))


def unfold(velocity: Column, ew: Column, ns: Column, w: Column, azimuth_deg: Column, elevation_deg: Column, nyquist: Column) -> Column:
    """Velocity without the platform's motion: one fold up where it is below minus Nyquist, then one down where above."""
    az, el = F.radians(azimuth_deg), F.radians(elevation_deg)
    v = velocity + ew * F.cos(el) * F.sin(az) + ns * F.cos(el) * F.cos(az) + w * F.sin(el)
    up = F.when(v < -nyquist, v + 2.0 * nyquist).otherwise(v)
    return F.when(up > nyquist, up - 2.0 * nyquist).otherwise(up)


def _short_runs(gates: DataFrame, moments: list[str], n: int, line: list[str], place: str) -> DataFrame:
    """Null runs of at most n present values along a line; its last place is neither changed nor counted.

    A short run has a missing place before it and one within n places after each of its own; one sort serves all moments.
    """
    if n <= 0:
        raise ValueError("speckle must be above 0")
    along = Window.partitionBy(*line).orderBy(place)
    before, after = along.rowsBetween(Window.unboundedPreceding, 0), along.rowsBetween(0, n)
    out = gates.withColumns({"_row": F.row_number().over(along), "_next": F.lead(place).over(along)})
    gap = {m: F.when(F.col(m).isNull() | F.col("_next").isNull(), F.col("_row")) for m in moments}
    out = out.withColumns({f"_before_{m}": F.max(g).over(before) for m, g in gap.items()} | {f"_after_{m}": F.min(g).over(after) for m, g in gap.items()})
    short = lambda m: F.col(f"_after_{m}") - F.coalesce(f"_before_{m}", F.lit(0)) - 1 <= n
    inside = lambda m: F.col(m).isNotNull() & F.col("_next").isNotNull()
    changed = {m: F.when(inside(m) & F.coalesce(short(m), F.lit(False)), F.lit(None)).otherwise(F.col(m)) for m in moments}
    return out.withColumns(changed).drop("_row", "_next", *(f"_{x}_{m}" for m in moments for x in ("before", "after")))


def despeckle(gates: DataFrame, moments: list[str], n: int) -> DataFrame:
    """Along each ray."""
    return _short_runs(gates, moments, n, ["volume_id", "ray_idx"], "gate_idx")


def despeckle_azimuthal(gates: DataFrame, moments: list[str], n: int) -> DataFrame:
    """Across rays at each gate; not circular, over sweep bounds."""
    return _short_runs(gates, moments, n, ["volume_id", "gate_idx"], "ray_idx")


def phidp_std_mask(gates: DataFrame, moments: list[str], phidp: str = "phidp", window: int = 11, most: float = 12.0) -> DataFrame:
    """Null where the differential phase varies more than `most` in the window, or any gate of it misses the phase."""
    if window <= 0 or window % 2 == 0:
        raise ValueError("window must be odd and above 0")
    h = (window - 1) // 2
    near = Window.partitionBy("volume_id", "ray_idx").orderBy("gate_idx").rowsBetween(-h, h)
    p = F.col(phidp)
    lifted = F.when(p < 0, p + 360.0).otherwise(p)
    spread = F.stddev_samp(lifted).over(near)
    bad = (F.count(F.lit(1)).over(near) != F.count(p).over(near)) | F.coalesce(~(spread <= most) | F.isnan(spread), F.lit(True))
    # the test is taken before any moment changes
    return mask(gates.withColumn("_bad", bad), moments, F.col("_bad")).drop("_bad")


def add_azimuthal_offset(rays: DataFrame, offset: float) -> DataFrame:
    return rays.withColumn("azimuth", azimuth_offset(F.col("azimuth"), offset))


def route_scans(files: DataFrame, by: list[str] | None = None) -> DataFrame:
    """files: file_order, scan_name -> with product: rhi, volume1, volume2 or none.

    RHI scans go by their name. Long volumes and sector scans are of the first volume until a file of the second has
    been seen, which every later volume then follows. by: columns (site, day) in each of whose groups that is decided apart.
    """
    name = F.col("scan_name")
    by = by or []
    # one number for each group, however many files: where the second volume begins
    first = files.filter(name.contains("VOL2")).groupBy(*by).agg(F.min("file_order").alias("_second"))
    files = files.join(first, by, "left") if by else files.join(F.broadcast(first))
    volume = name.rlike("PICCOLO_LONG|CIRL|CIRC|PICO_LONGVOL|VOL2")
    second = F.coalesce(F.col("file_order") >= F.col("_second"), F.lit(False))
    return files.withColumn("product", F.when(name.contains("RHI"), "rhi").when(volume & second, "volume2").when(volume, "volume1").otherwise("none")).drop("_second")
