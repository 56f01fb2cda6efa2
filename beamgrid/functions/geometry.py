"""Beam geometry, map projection and unit conversions as Column functions."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beamgrid.model import R_EFF

#: WGS84. Fixed values.
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563


def beam_height(slant: Column, elevation_deg: Column, radar_height: Column) -> Column:
    """Height of a beam over the 4/3 earth."""
    el = F.radians(elevation_deg)
    return F.sqrt(slant * slant + R_EFF**2 + 2.0 * slant * R_EFF * F.sin(el)) - R_EFF + radar_height


def ground_range(slant: Column, elevation_deg: Column, height: Column) -> Column:
    """Distance along the ground to below a gate whose beam height is given."""
    return R_EFF * F.asin(slant * F.cos(F.radians(elevation_deg)) / (R_EFF + height))


def gate_xy(ground: Column, azimuth_deg: Column, x0: Column, y0: Column) -> tuple[Column, Column]:
    """(x, y) of a gate from the radar's place; azimuths are clockwise from north."""
    az = F.radians(azimuth_deg)
    return x0 + ground * F.sin(az), y0 + ground * F.cos(az)


def spherical_angle(az1: Column, el1: Column, az2: Column, el2: Column) -> Column:
    """Angle between two directions in radians, by the haversine."""
    a, b = F.sin((el2 - el1) / 2), F.sin((az2 - az1) / 2)
    return 2.0 * F.asin(F.least(F.lit(1.0), F.sqrt(a * a + F.cos(el1) * F.cos(el2) * b * b)))


def azimuth_offset(azimuth: Column, offset: float) -> Column:
    return F.pmod(azimuth + offset, F.lit(360.0))


#: 2 ** (i / 32) for i from 0 to 31 as the nearest double and what that leaves, and log10(2) / 32 as a head of 36 bits and a rest.
_ROOTS = [2 ** (Decimal(i) / 32) for i in range(32)]
_HEADS = [float(v) for v in _ROOTS]
_RESTS = [float(v - Decimal(h)) for v, h in zip(_ROOTS, _HEADS, strict=True)]
_STEP = Decimal(2).log10() / 32
_STEP_HEAD = float(int(_STEP * 2**42)) / 2**42
_STEP_REST = float(_STEP - Decimal(_STEP_HEAD))


def power_of_ten(y: Column) -> Column:
    """10 ** y, nearest double but for about one in a hundred; pow misses it for one in ten, which shows in rounded values."""
    k = F.least(F.greatest(F.rint(y / float(_STEP)), F.lit(-34000.0)), F.lit(33000.0))
    left = F.expm1(((y - k * _STEP_HEAD) - k * _STEP_REST) * math.log(10.0))
    root = F.pmod(k, F.lit(32.0)).cast("int")
    head, rest = (F.get(F.array(*map(F.lit, v)), root) for v in (_HEADS, _RESTS))
    return (head + (head * left + rest)) * F.pow(F.lit(2.0), F.floor(k / 32).cast("double"))


def db_to_linear(x: Column) -> Column:
    return power_of_ten(x / 10.0)


def linear_to_db(x: Column) -> Column:
    """Zero gives minus infinity; negative values give null."""
    return F.when(x == 0, F.lit(float("-inf"))).otherwise(10.0 * F.log10(x))


def rhohv_from_counts(counts: Column) -> Column:
    """Correlation coefficient from the raw 16-bit field that carries it."""
    return (counts + 32640.0 - 1.0) / 65533.0


def degree_lengths(lat_deg: Column, full_series: bool = False) -> tuple[Column, Column]:
    """(km per degree of latitude, of longitude); the short form has the leading terms only, which is the default."""
    p = F.radians(lat_deg)
    lat = 111.13209 - 0.56605 * F.cos(2.0 * p)
    lon = 111.41513 * F.cos(p)
    if full_series:
        lat = lat + 0.00120 * F.cos(4.0 * p)
        lon = lon - 0.09455 * F.cos(3.0 * p) + 0.00012 * F.cos(5.0 * p)
    return lat, lon


def appx_inverse(lat0: Column, lon0: Column, x: Column, y: Column, full_series: bool = False) -> tuple[Column, Column]:
    """(latitude, longitude) of a place x, y metres from a reference."""
    lat, lon = degree_lengths(lat0, full_series)
    return lat0 + y / (1000.0 * lat), lon0 + x / (1000.0 * lon)


def _kruger() -> tuple[float, list[float], list[float]]:
    """Rectifying radius and the forward and inverse series of the transverse Mercator projection, to the fourth order."""
    n = WGS84_F / (2 - WGS84_F)
    radius = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forward = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    inverse = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    return radius, forward, inverse


_E = math.sqrt(WGS84_F * (2 - WGS84_F))


def meridian_arc(lat0_deg: Column | float) -> Column | float:
    """Metres from the equator along the meridian."""
    radius, forward, _ = _kruger()
    if isinstance(lat0_deg, Column):
        s = F.sin(F.radians(lat0_deg))
        xi = F.atan(F.sinh(F.atanh(s) - _E * F.atanh(_E * s)))
        return radius * sum((a * F.sin(2.0 * j * xi) for j, a in enumerate(forward, 1)), xi)
    s = math.sin(math.radians(lat0_deg))
    tau = math.sinh(math.atanh(s) - _E * math.atanh(_E * s))
    xi = math.atan(tau)
    return radius * (xi + sum(a * math.sin(2 * (j + 1) * xi) for j, a in enumerate(forward)))


def tm_forward(lat_deg: Column, lon_deg: Column, lat0: Column | float, lon0: Column | float) -> tuple[Column, Column]:
    """Transverse Mercator (x, y) with scale 1 and the reference as origin, on WGS84. The reference may be a column."""
    radius, forward, _ = _kruger()
    s, dl = F.sin(F.radians(lat_deg)), F.radians(lon_deg - lon0)
    t = F.sinh(F.atanh(s) - _E * F.atanh(_E * s))
    xi = F.atan2(t, F.cos(dl))
    eta = F.asinh(F.sin(dl) / F.sqrt(t * t + F.cos(dl) * F.cos(dl)))
    x, y = eta, xi
    for j, a in enumerate(forward, 1):
        y = y + a * F.sin(2.0 * j * xi) * F.cosh(2.0 * j * eta)
        x = x + a * F.cos(2.0 * j * xi) * F.sinh(2.0 * j * eta)
    return radius * x, radius * y - meridian_arc(lat0)


def with_tm(df: DataFrame, lat_deg: Column, lon_deg: Column, lat0: Column | float, lon0: Column | float, x: str = "x", y: str = "y") -> DataFrame:
    """df with tm_forward's x and y, step by step, so that a row computes each part of the series once however it is used."""
    radius, forward, _ = _kruger()
    s = F.sin(F.radians(lat_deg))
    out = df.withColumns({"_t": F.sinh(F.atanh(s) - _E * F.atanh(_E * s)), "_dl": F.radians(lon_deg - lon0)})
    out = out.withColumns({"_xi": F.atan2(F.col("_t"), F.cos("_dl")), "_eta": F.asinh(F.sin("_dl") / F.sqrt(F.col("_t") * F.col("_t") + F.cos("_dl") * F.cos("_dl")))})
    xs, ys = F.col("_eta"), F.col("_xi")
    for j, a in enumerate(forward, 1):
        ys = ys + a * F.sin(2.0 * j * F.col("_xi")) * F.cosh(2.0 * j * F.col("_eta"))
        xs = xs + a * F.cos(2.0 * j * F.col("_xi")) * F.sinh(2.0 * j * F.col("_eta"))
    return out.withColumns({x: radius * xs, y: radius * ys - meridian_arc(lat0)}).drop("_t", "_dl", "_xi", "_eta")


def tm_inverse(x: Column, y: Column, lat0: Column | float, lon0: Column | float) -> tuple[Column, Column]:
    """(latitude, longitude) of transverse Mercator coordinates."""
    radius, _, inverse = _kruger()
    xi, eta = (y + meridian_arc(lat0)) / radius, x / radius
    u, v = xi, eta
    for j, b in enumerate(inverse, 1):
        u = u - b * F.sin(2.0 * j * xi) * F.cosh(2.0 * j * eta)
        v = v - b * F.cos(2.0 * j * xi) * F.sinh(2.0 * j * eta)
    s = F.sin(u) / F.cosh(v)
    psi = F.atanh(s)
    q = psi
    for _ in range(5):  # isometric to geographic latitude; converges by 0.7 % a step
        q = psi + _E * F.atanh(_E * F.tanh(q))
    return F.degrees(F.asin(F.tanh(q))), lon0 + F.degrees(F.atan2(F.sinh(v), F.cos(u)))


def tile_name(lat: Column, lon: Column) -> Column:
    """Name of the one-degree elevation tile; whole negative degrees belong to the next tile outwards."""

    def part(v: Column, plus: str, minus: str, width: int) -> Column:
        n = F.floor(F.abs(v)) + F.when(v < 0, 1).otherwise(0)
        return F.concat(F.when(v < 0, F.lit(minus)).otherwise(F.lit(plus)), F.lpad(n.cast("string"), width, "0"))

    return F.concat(part(lat, "N", "S", 2), part(lon, "E", "W", 3))
