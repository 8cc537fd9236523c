"""Rasters as tiles: one row for each square of pixels, its bands as arrays; points are read tile by tile."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .mesh import triangle_centres
from .raster import _bands, axis_index, window_points

#: Side of a tile; 256 x 256 pixels of a band are 256 KB.
TILE = 256
#: Points that are read from one tile in one task, and the most tiles whose shares are broadcast.
GROUP_POINTS = 500_000
BROADCAST_TILES = 65_536


def to_tiles(raster: DataFrame, side: int | None = None) -> DataFrame:
    """A long raster (row, col, bands of whole numbers) as tiles: tile_row, tile_col, side, and for each band
    an array of side * side values, row by row, null where there is no pixel.

    Each tile is one bounded group. Of pixels that repeat the greatest value of each band stays."""
    n, bands = side or TILE, _bands(raster)
    schema = pa.schema([("tile_row", pa.int32()), ("tile_col", pa.int32()), ("side", pa.int32()), *[(b, pa.list_(pa.int32())) for b in bands]])
    whole = F.lit(n)
    placed = raster.select(F.floor(F.col("row") / whole).cast("int").alias("tile_row"), F.floor(F.col("col") / whole).cast("int").alias("tile_col"), (F.pmod("row", whole) * whole + F.pmod("col", whole)).cast("int").alias("at"), *[F.col(b).cast("int").alias(b) for b in bands])

    def fill(key: tuple, group: pa.Table) -> pa.Table:
        at = group.column("at").to_numpy()
        arrays = []
        for b in bands:
            values, known = np.full(n * n, np.iinfo(np.int32).min, np.int64), np.zeros(n * n, bool)
            column = group.column(b).combine_chunks()
            there = column.is_valid().to_numpy(zero_copy_only=False)
            np.maximum.at(values, at[there], column.fill_null(0).to_numpy()[there])
            known[at[there]] = True
            arrays.append(pa.ListArray.from_arrays(pa.array([0, n * n], pa.int32()), pa.array(values.astype(np.int32), mask=~known)))
        return pa.Table.from_arrays([pa.array([k.as_py()], pa.int32()) for k in key] + [pa.array([n], pa.int32()), *arrays], schema=schema)

    return placed.groupBy("tile_row", "tile_col").applyInArrow(fill, "tile_row int, tile_col int, side int, " + ", ".join(f"{b} array<int>" for b in bands))


def write_tiles(raster: DataFrame, path: str, side: int | None = None) -> None:
    to_tiles(raster, side).write.mode("overwrite").parquet(path)


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_pixels(points: DataFrame, tiles: DataFrame, height: int, width: int, side: int | None = None) -> DataFrame:
    """The points (row, col) with the bands of their pixel; points without one are left out.

    Points are shuffled once, to their tile, and read from its arrays in one step; a tile is never
    repeated for each point. A tile with more than GROUP_POINTS points is sent to several tasks, each with
    a share of them by a hash of the whole row, so that a task that runs again has the same share."""
    n = side or TILE
    bands = [c for c in tiles.columns if c not in ("tile_row", "tile_col", "side")]
    kept = [f for f in points.schema if f.name not in ("row", "col", *bands)]
    located = points.filter("row IS NOT NULL AND col IS NOT NULL").select(*[f.name for f in kept], "row", "col")
    located = located.withColumns({"__tr": F.floor(F.col("row") / F.lit(n)).cast("int"), "__tc": F.floor(F.col("col") / F.lit(n)).cast("int")})
    shares = located.groupBy("__tr", "__tc").agg(F.ceil(F.count("*") / GROUP_POINTS).cast("int").alias("__shares"))
    few = math.ceil(height / n) * math.ceil(width / n) <= BROADCAST_TILES
    dealt = located.join(F.broadcast(shares) if few else shares, ["__tr", "__tc"])
    dealt = dealt.withColumn("__share", F.when(F.col("__shares") > 1, F.pmod(F.xxhash64(*[f.name for f in kept], "row", "col"), F.col("__shares"))).otherwise(F.lit(0)).cast("int")).drop("__shares")
    sent = tiles.select(F.col("tile_row").alias("__tr"), F.col("tile_col").alias("__tc"), *bands).join(F.broadcast(shares) if few else shares, ["__tr", "__tc"])
    sent = sent.withColumn("__share", F.explode(F.sequence(F.lit(0), F.col("__shares") - 1))).drop("__shares")
    schema = T.StructType([*kept, T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType()), *[T.StructField(b, T.IntegerType()) for b in bands]])

    def look(some: pa.Table, tile: pa.Table) -> pa.Table:
        if not len(tile):
            some = some.slice(0, 0)
        row, col = (some.column(c).cast(pa.int32()) for c in ("row", "col"))
        at = pa.array((row.to_numpy() % n) * n + col.to_numpy() % n)
        values = [tile.column(b).combine_chunks().flatten().take(at) if len(tile) else pa.array([], pa.int32()) for b in bands]
        out = pa.table([*[some.column(f.name) for f in kept], row, col, *values], [f.name for f in schema])
        return out.filter(values[0].is_valid()) if bands else out

    return dealt.groupBy("__tr", "__tc", "__share").cogroup(sent.groupBy("__tr", "__tc", "__share")).applyInArrow(look, schema)


def sample_tiles(points: DataFrame, tiles: DataFrame, extent: tuple[float, float, float, float], height: int, width: int, lat: str = "lat", lon: str = "lon", north_up: bool = True, side: int | None = None) -> DataFrame:
    """raster.sample over tiles: the points with row, col and the bands of the pixel that holds them."""
    at = points.withColumns({"row": axis_index(F.col(lat), extent[0], extent[1], height, north_up), "col": axis_index(F.col(lon), extent[2], extent[3], width)})
    return read_pixels(at, tiles, height, width, side)


def resample_tiles(centres: DataFrame, tiles: DataFrame, degrees: float, n: int, extent: tuple[float, float, float, float], height: int, width: int, side: int | None = None) -> DataFrame:
    """raster.resample_window over tiles."""
    return sample_tiles(window_points(centres, degrees, n), tiles, extent, height, width, side=side)


def colour_mesh_tiles(mesh: DataFrame, tiles: DataFrame, extent: tuple[float, float, float, float], height: int, width: int, side: int | None = None) -> DataFrame:
    """mesh.colour_mesh over tiles: the truncated mean of the pixels at the centres of a half-hexagon's triangles."""
    bands = [c for c in tiles.columns if c not in ("tile_row", "tile_col", "side")]
    placed = sample_tiles(triangle_centres(mesh), tiles, extent, height, width, side=side)
    return placed.groupBy("name", "path").agg(*[(F.sum(b) / 3).cast("int").alias(b) for b in bands])
