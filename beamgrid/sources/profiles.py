"""Profiles of volume files: which field is written from which column, packed how."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILL16, FILL_FLOAT = -32768, -9999.0


def pack(value: Column, scale: float, offset: float) -> Column:
    """As a 16-bit integer; missing, NaN and out-of-range values become the fill value."""
    n = F.round((value - offset) / scale)
    return F.when(n.between(-32767, 32767), n).otherwise(FILL16).cast("short")


def unpack(packed: Column, scale: float, offset: float) -> Column:
    return F.when(packed != FILL16, packed * scale + offset)


class Field(NamedTuple):
    """A variable of a file: its name, the column it comes from (None: declared, all fill), scale and offset of 16-bit packing (None:
    not packed), fill, and its type."""

    name: str
    column: str | None
    scale: float | None = None
    offset: float = 0.0
    fill: float = -32768.0
    kind: str = "float"

    @property
    def dtype(self) -> str:
        return ">i2" if self.scale is not None else {"float": ">f4", "double": ">f8", "short": ">i2"}[self.kind]


#: Scale and offset of packed fields. Fixed values of the file format.
PACKING = {
    "DBZ": (0.01, 0.0), "VEL": (0.01, 0.0), "ZDR": (0.01, 0.0), "KDP": (0.01, 0.0), "SNR": (0.01, 0.0),
    "WIDTH": (0.01, 327.68), "RHOHV": (1.5259488e-5, 0.5000076), "SQI": (1.5259488e-5, 0.5000076), "PHIDP": (0.0054933317, 180.0),
    "UNKNOWN_ID_82": (1.0, 128.0),
}
_SEVEN = ["DBZ", "ZDR", "VEL", "KDP", "RHOHV", "PHIDP", "WIDTH"]
#: Fields of the polarimetric files, those of them whose fill is -9999, and their other types. Fixed values of the file format.
_POLARIMETRIC = [
    "DBZ", "DBZ_ATTEN_UNCORRECTED", "DBZ_L2", "DBZ_TOT", "DBZ_TOT_L2", "HID_CSU", "KDP", "PHIDP", "PHIDP_L2", "PID_FOR_QC", "RATE_ZH", "RATE_CSU_METHOD", "RATE_CSU_BLENDED", "RHOHV", "RHOHV_L2",
    "RHOHV_NNC", "RHOHV_NNC_L2", "SNR", "SNR_L2", "SQI", "SQI_FOR_MASK", "TEMP_FOR_PID", "VEL", "VEL_L2", "WIDTH", "WIDTH_L2", "ZDR", "ZDR_ATTEN_UNCORRECTED", "ZDR_L2",
]
_LOW_FILL = {"DBZ", "KDP", "ZDR", "HID_CSU", "PID_FOR_QC", "RATE_ZH", "RATE_CSU_METHOD", "RATE_CSU_BLENDED", "TEMP_FOR_PID"}


def _packed(name: str, column: str | None) -> Field:
    return Field(name, column, *PACKING[name.removesuffix("_L1").removesuffix("_TOT")])


def _polarimetric(raw: set[str], qc: set[str], kinds: dict[str, str]) -> list[Field]:
    """All fields of the list: raw copies, those after quality control, and the rest, which is declared only."""
    return [Field(m, m if m in qc else f"raw_{m}" if m in raw else None, None, 0.0, FILL_FLOAT if m in _LOW_FILL else -32768.0, kinds.get(m, "float")) for m in _POLARIMETRIC]


_COMMON = {*_SEVEN, "RATE_ZH", "SQI_FOR_MASK"}
#: raw_<name> are the columns as read, <name> those after quality control.
PROFILES = {
    "packed": [*(_packed(f"{m}_L1", f"raw_{m}") for m in _SEVEN), _packed("SQI", "raw_SQI"), _packed("SNR", "raw_SNR"), *(_packed(m, m) for m in _SEVEN), _packed("UNKNOWN_ID_82", None)],
    "single_pol": _polarimetric({"DBZ_TOT", "SNR", "SQI"}, _COMMON, {"HID_CSU": "double", "RATE_CSU_METHOD": "short", "RATE_CSU_BLENDED": "short"}),
    "dual_pol": _polarimetric({"DBZ_TOT", "SNR", "SQI", "DBZ_ATTEN_UNCORRECTED", "DBZ_L2", "RHOHV_L2", "RHOHV_NNC_L2", "TEMP_FOR_PID", "VEL_L2", "WIDTH_L2", "ZDR_L2"}, _COMMON | {"HID_CSU", "RATE_CSU_BLENDED", "PID_FOR_QC"}, {"HID_CSU": "double"}),
    "airborne": [Field("DBZ_TOT", "raw_DBZ_TOT", 0.01), _packed("SQI", "raw_SQI"), *(_packed(m, m) for m in ("DBZ", "VEL", "WIDTH"))],
}

#: Variables that the airborne profile has for each ray beside those of all profiles: name, (long name, units). Fixed names.
AIRBORNE = {
    "track": ("platform_track_over_the_ground", "degrees"), "drift": ("platform_drift_angle", "degrees"), "rotation": ("ray_rotation_angle_relative_to_platform", "degrees"),
    "tilt": ("ray_tilt_angle_relative_to_platform", "degrees"), "eastward_wind": ("eastward_wind_speed", "meters per second"), "northward_wind": ("northward_wind", "meters per second"), "vertical_wind": ("upward_air_velocity", "meters per second"),
}


def apply_profile(gates: DataFrame, profile: str) -> DataFrame:
    """Keys, range and the profile's fields under their file names, packed or as floats with fills; absent columns are all fill."""

    def value(f: Field) -> Column:
        c = F.col(f.column) if f.column in gates.columns else F.lit(None).cast("double")
        return pack(c, f.scale, f.offset) if f.scale is not None else F.coalesce(F.round(c) if f.kind == "short" else c, F.lit(f.fill)).cast(f.kind)

    return gates.select("volume_id", "ray_idx", "gate_idx", "range_m", *(value(f).alias(f.name) for f in PROFILES[profile]))


def read_profile(packed: DataFrame, profile: str) -> DataFrame:
    """The inverse of apply_profile: fields as doubles, fills as null."""

    def value(f: Field) -> Column:
        c = F.col(f.name)
        return unpack(c, f.scale, f.offset) if f.scale is not None else F.when(c != f.fill, c.cast("double"))

    return packed.select("volume_id", "ray_idx", "gate_idx", "range_m", *(value(f).alias(f.name) for f in PROFILES[profile]))


def georeference(rays: DataFrame, profile: str) -> DataFrame:
    """Platform columns as the airborne profile stores them: rotation is filled from roll, track is declared only; drift, tilt and
    winds are those of rays, where it has them."""
    if profile != "airborne":
        return rays
    own = {c: F.col(c).cast("double") if c in rays.columns else F.lit(None).cast("double") for c in AIRBORNE if c not in ("track", "rotation")}
    return rays.withColumns(own | {"rotation": F.col("roll").cast("double"), "track": F.lit(None).cast("double")})
