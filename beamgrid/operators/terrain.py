"""Elevation tiles, terrain heights of places, and the mask of gates over high ground.

A tile is kept as square blocks of posts, a row for each (DEM), so the table that places are joined with has a few hundred rows a
tile; a place takes its post out of the block by its number. Blocks without a single height are left out. The places over one block
are parted over tasks by their own number, each part with a copy of the block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beamgrid.functions import geometry as G
from beamgrid.operators.grid import locate
from beamgrid.operators.qc import mask

VOID = -32768
#: Posts along the edge of a block.
BLOCK = 128
DEM = "tile string, block_row int, block_col int, heights array<short>"


def _blocks(name: str, heights: np.ndarray) -> Iterator[dict]:
    """Blocks of a square of heights; those at its edges are filled with voids."""
    side = -(-len(heights) // BLOCK) * BLOCK
    full = np.full((side, side), VOID, np.int16)
    full[: len(heights), : len(heights)] = heights
    for row in range(side // BLOCK):
        for col in range(side // BLOCK):
            own = full[row * BLOCK : (row + 1) * BLOCK, col * BLOCK : (col + 1) * BLOCK].ravel()
            if (own != VOID).any():
                yield {"tile": name, "block_row": row, "block_col": col, "heights": own}


def read_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """All .hgt tiles of a folder as DEM: square tiles of big-endian 16-bit heights, the first row northernmost."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("tile", pa.string()), ("block_row", pa.int32()), ("block_col", pa.int32()), ("heights", pa.list_(pa.int16()))])
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                heights = np.frombuffer(content, ">i2").astype(np.int16)
                side = int(len(heights) ** 0.5)
                name = path.rpartition("/")[2].partition(".")[0]
                yield pa.RecordBatch.from_pylist(list(_blocks(name, heights[: side * side].reshape(side, side))), schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.hgt").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content").mapInArrow(decode, DEM)


def _place(row: Column, col: Column) -> tuple[Column, Column, Column]:
    """(block row, block column, number in the block) of a post."""
    return F.floor(row / BLOCK).cast("int"), F.floor(col / BLOCK).cast("int"), ((row % BLOCK) * BLOCK + col % BLOCK).cast("int")


def blocks(posts: DataFrame) -> DataFrame:
    """DEM from a table of single posts: tile, row, col, elevation_m; posts that are not there are void."""
    block_row, block_col, number = _place(F.col("row"), F.col("col"))

    def join(key: tuple, table: pa.Table) -> pa.Table:
        own = np.full(BLOCK * BLOCK, VOID, np.int16)
        own[table["number"].to_numpy()] = table["elevation_m"].fill_null(VOID).to_numpy()
        return pa.table({"tile": [key[0].as_py()], "block_row": pa.array([key[1].as_py()], pa.int32()), "block_col": pa.array([key[2].as_py()], pa.int32()), "heights": pa.array([own], pa.list_(pa.int16()))})

    held = posts.select("tile", block_row.alias("block_row"), block_col.alias("block_col"), number.alias("number"), F.col("elevation_m").cast("short").alias("elevation_m"))
    return held.groupBy("tile", "block_row", "block_col").applyInArrow(join, DEM)


def tile_cell(lat: Column, lon: Column, side: int) -> tuple[Column, Column, Column]:
    """(tile, row, col) of the nearest post of a tile with `side` posts along an edge."""
    row = F.round((F.ceil(lat) - lat) * (side - 1)).cast("int")
    col = F.round((lon - F.floor(lon)) * (side - 1)).cast("int")
    # on a whole degree the tile's name decides the edge
    row = F.when(lat == F.floor(lat), F.when(lat < 0, 0).otherwise(side - 1)).otherwise(row)
    col = F.when(lon == F.floor(lon), F.when(lon < 0, side - 1).otherwise(0)).otherwise(col)
    return G.tile_name(lat, lon), row, col


#: Places over a block that stay together, on average, and blocks whose places are parted at most, those with most places.
PART_PLACES, PARTED_BLOCKS = 1 << 17, 100_000
_BLOCK_KEY = ["_tile", "_row", "_col"]


def _parts(marked: DataFrame) -> DataFrame:
    """The keys of blocks with more than PART_PLACES places, and the number of their parts; never more rows than PARTED_BLOCKS."""
    counts = marked.groupBy(*_BLOCK_KEY).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > PART_PLACES)
    most = counts.orderBy(F.desc("_n"), *_BLOCK_KEY).limit(PARTED_BLOCKS)
    return most.select(*_BLOCK_KEY, F.ceil(F.col("_n") / PART_PLACES).cast("int").alias("_parts"))


def elevations(places: DataFrame, dem: DataFrame, lat: str, lon: str, side: int, name: str = "elevation_m") -> DataFrame:
    """places with the elevation there; null where the tile is absent or the post void."""
    tile, row, col = tile_cell(F.col(lat), F.col(lon), side)
    block_row, block_col, number = _place(row, col)
    marked = places.withColumns({"_tile": tile, "_row": block_row, "_col": block_col, "_number": number})
    held = dem.select(F.col("tile").alias("_tile"), F.col("block_row").alias("_row"), F.col("block_col").alias("_col"), "heights")
    parts, own = F.broadcast(_parts(marked)), F.coalesce("_parts", F.lit(1))
    draw = F.xxhash64(*(c for c, kind in places.dtypes if "map<" not in kind and kind != "variant"))
    # places without a block need no part of it and may be anywhere
    marked = marked.join(parts, _BLOCK_KEY, "left").withColumn("_part", F.when(F.col("_tile").isNull(), draw).otherwise(F.pmod(draw, own))).drop("_parts")
    held = held.join(parts, _BLOCK_KEY, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), own.cast("long") - 1))).drop("_parts")
    height = F.get("heights", F.col("_number"))
    return marked.join(held, [*_BLOCK_KEY, "_part"], "left").select(*places.columns, F.when(height != VOID, height).alias(name))


def terrain_height(places: DataFrame, dem: DataFrame, lat: str, lon: str, side: int, name: str = "terrain_m") -> DataFrame:
    """As elevations, in metres as a double, -1 where there is none."""
    return elevations(places, dem, lat, lon, side, "_elevation").withColumn(name, F.coalesce(F.col("_elevation").cast("double"), F.lit(-1.0))).drop("_elevation")


def terrain_mask(gates: DataFrame, moments: list[str], dem: DataFrame, lat0: float, lon0: float, most: float, side: int, mask_key: str = "SQI_FOR_MASK") -> DataFrame:
    """Null all moments of gates over ground higher than `most`, where the mask field is present."""
    lat, lon = G.appx_inverse(F.lit(float(lat0)), F.lit(float(lon0)), F.col("gx"), F.col("gy"))
    placed = locate(gates).withColumns({"_lat": lat, "_lon": lon})
    high = terrain_height(placed, dem, "_lat", "_lon", side, "_terrain")
    return mask(high, moments, F.col(mask_key).isNotNull() & (F.col("_terrain") > most)).select(*gates.columns)
