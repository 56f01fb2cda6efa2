"""Tables, defaults and field metadata of the radar engine.

A volume is a star of tables: `rays` and `gates` keyed by volume_id, ray_idx (and gate_idx), `sweeps` by volume_id and
sweep_idx. The operators take the gates with the ray columns they need already joined on (see join_rays).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Effective earth radius (4/3 of 6371 km), sentinels of grids, beam weight slope. Fixed values.
R_EFF = 4.0 * 6371000.0 / 3.0
UNSEEN, NO_VALID = -32768.0, -9999.0
BEAM_SLOPE = 79.43

#: Default quality thresholds and grids: (minimum, increment, number). Fixed values.
SQI, SNR, WIDTH, RHOHV = 0.35, 6.0, 8.0, 0.7
X = Y = (-125000.0, 500.0, 501)
Z = (0.0, 500.0, 37)
RHI_R, RHI_Z = (0.0, 250.0, 481), (0.0, 250.0, 41)
BEAM_INFLATION, POWER_THRESHOLD = 0.01, 0.5

RAYS = "volume_id string, scan_name string, ray_idx int, time timestamp, azimuth float, elevation float, latitude float, longitude float, altitude float, ew_platform float, ns_platform float, w_platform float, nyquist_velocity float, heading double, pitch double, roll double"
SWEEPS = "volume_id string, sweep_idx int, fixed_angle float, start_ray int, end_ray int"

#: Field name: (standard name, long name, units). Fixed values of the file formats.
FIELDS = {
    "DBZ": ("equivalent_reflectivity_factor", "Equivalent reflectivity factor", "dBZ"),
    "ZDR": ("log_differential_reflectivity_hv", "Differential reflectivity", "dB"),
    "RHOHV": ("cross_correlation_ratio_hv", "Copolar correlation coefficient", "unitless"),
    "KDP": ("specific_differential_phase_hv", "Specific differential phase", "degrees/km"),
    "WIDTH": ("doppler_spectrum_width", "Spectrum width", "m/s"),
    "VEL": ("radial_velocity_of_scatterers_away_from_instrument", "Doppler velocity", "m/s"),
    "PHIDP": ("differential_phase_hv", "Differential phase", "degrees"),
    "SNR": ("signal_to_noise_ratio", "Signal to noise ratio", "dB"),
    "SQI": ("normalized_coherent_power", "Signal quality index", "unitless"),
    "RATE_CSU_BLENDED": ("rain_rate", "Blended rain rate", "mm/hr"),
    "PID": ("PID", "particle_id", "none"),
    "PID_FOR_QC": ("PID_FOR_QC", "particle_id", "none"),
    "HID_CSU": ("HID_CSU", "particle_id", "none"),
    "UNKNOWN": ("unknown", "Unknown", "unknown"),
}


def field_metadata(name: str) -> dict[str, str]:
    """Attributes of a field; those of UNKNOWN for names not listed, and a first-level mark for raw copies."""
    base = name.removesuffix("_L1")
    standard, long, units = FIELDS.get(base, FIELDS["UNKNOWN"])
    return {"standard_name": standard, "long_name": long + (", level 1" if name != base and base in FIELDS else ""), "units": units}


def gates_schema(moments: list[str]) -> T.StructType:
    """Schema of the gates table for a list of moments, with their metadata."""
    out = T.StructType().add("volume_id", T.StringType()).add("ray_idx", T.IntegerType()).add("gate_idx", T.IntegerType()).add("range_m", T.FloatType())
    for m in moments:
        out = out.add(m, T.DoubleType(), True, field_metadata(m.upper()))
    return out


def init_qc(gates: DataFrame, moments: list[str], raw: str = "raw_", narrow: bool = True) -> DataFrame:
    """Keep each moment's raw values under raw_<name> and let the moment itself be the copy that quality control changes."""
    copy = lambda m: F.col(m).cast("float").cast("double") if narrow else F.col(m)
    return gates.withColumns({f"{raw}{m}": F.col(m) for m in moments} | {m: copy(m) for m in moments})


def join_rays(gates: DataFrame, rays: DataFrame, columns: list[str]) -> DataFrame:
    """Spread ray columns to gates; a fixed platform's single latitude, longitude and altitude are on every ray already."""
    return gates.join(rays.select("volume_id", "ray_idx", *columns), ["volume_id", "ray_idx"])


def split_sweeps(rays: DataFrame, sweeps: DataFrame) -> DataFrame:
    """rays with their sweep_idx; a sweep holds its rays from start_ray to end_ray, both included.

    Each sweep's range is spread over the ray numbers it holds, so the join is one on equal keys.
    """
    held = sweeps.select("volume_id", "sweep_idx", F.explode(F.sequence("start_ray", "end_ray")).alias("ray_idx"))
    return rays.join(held, ["volume_id", "ray_idx"])


def volume_times(rays: DataFrame) -> DataFrame:
    """volume_id, start, stop: the times of the first and the last ray, not the least and greatest."""
    return rays.groupBy("volume_id").agg(F.min_by("time", "ray_idx").alias("start"), F.max_by("time", "ray_idx").alias("stop"))


def number_rays(rays: DataFrame, into: Column) -> DataFrame:
    """merged, volume_id, ray_idx, new_ray, new_sweep of files that belong together, as volumes named by `into`.

    Rays are numbered anew by time; ties go by the file's name, then the ray's own number. Files are numbered by their first
    ray. A volume's rays are one group: of a volume's size, however many volumes there are.
    """
    order = Window.partitionBy("merged").orderBy("time", "volume_id", "ray_idx")
    placed = rays.select(into.alias("merged"), "volume_id", "ray_idx", "time").withColumn("new_ray", (F.row_number().over(order) - 1).cast("int"))
    first = placed.withColumn("_first", F.min("new_ray").over(Window.partitionBy("merged", "volume_id")))
    return first.select("merged", "volume_id", "ray_idx", "new_ray", (F.dense_rank().over(Window.partitionBy("merged").orderBy("_first")) - 1).cast("int").alias("new_sweep"))


def merge_volumes(rays: DataFrame, gates: DataFrame, sweeps: DataFrame, into: Column | None = None, number: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rays, gates and sweeps of files that belong together, as volumes named by `into` (a column of rays).

    number: what number_rays gives, or a stream of sweeps that arrive apart (streaming.state.assemble_sweeps), instead of into.
    Sweeps are numbered by the time of their first ray, and hold the rays from their first to their last one.
    """
    if number is None:
        number = number_rays(rays, into)
    number = number.select("volume_id", "ray_idx", "merged", "new_ray")
    placed = rays.drop("merged", "new_ray").join(number, ["volume_id", "ray_idx"])
    held = split_sweeps(number, sweeps).groupBy("merged", "volume_id", "sweep_idx").agg(F.min("new_ray").alias("start_ray"), F.max("new_ray").alias("end_ray"))
    by_start = Window.partitionBy("merged").orderBy("start_ray", "volume_id", "sweep_idx")
    held = held.join(sweeps.drop("start_ray", "end_ray"), ["volume_id", "sweep_idx"]).withColumn("new_sweep", (F.row_number().over(by_start) - 1).cast("int"))
    own = [c for c in sweeps.columns if c not in ("volume_id", "sweep_idx", "start_ray", "end_ray")]
    return (
        placed.select(F.col("merged").alias("volume_id"), F.col("new_ray").alias("ray_idx"), *(c for c in rays.columns if c not in ("volume_id", "ray_idx", "merged", "new_ray"))),
        gates.join(number, ["volume_id", "ray_idx"]).select(F.col("merged").alias("volume_id"), F.col("new_ray").alias("ray_idx"), *(c for c in gates.columns if c not in ("volume_id", "ray_idx"))),
        held.select(F.col("merged").alias("volume_id"), F.col("new_sweep").alias("sweep_idx"), *own, "start_ray", "end_ray"),
    )
