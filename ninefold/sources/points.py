"""Sources of points, polyhedra and gridded fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """lat, lon, weight from quoted CSV files without a header; of rows with one place the last wins.

    Order is that of the files' names, then of their lines."""
    rows = spark.read.schema("lat DOUBLE, lon DOUBLE, weight DOUBLE").csv(path, quote='"')
    order = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("line"))
    return rows.select("lat", "lon", "weight", order.alias("seq")).groupBy("lat", "lon").agg(F.max_by("weight", "seq").alias("weight"))


def profile_points(points: DataFrame, columns: tuple[str, ...] = ("lat", "lon", "weight")) -> DataFrame:
    """One row: distinct values, least and greatest of each column."""
    return points.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("distinct", F.count_distinct), ("min", F.min), ("max", F.max))])


def grid_to_points(field: DataFrame, n_rows: int, n_cols: int, lat_first: float, lat_step: float, lon_step: float, scale: float = 1.0) -> DataFrame:
    """Long table lat, lon, value of a field (i, j, value) whose rows run north to south.

    Rows are reversed, values scaled, the first column is repeated at 360 degrees, and longitudes are
    shifted from 0..360 to -180..180 (360 becomes 0)."""
    from_south = F.lit(n_rows - 1) - F.col("i")
    rows = field.select(from_south.alias("i"), F.col("j"), (F.col("value") * scale).alias("value"))
    cyclic = rows.filter("j = 0").withColumn("j", F.lit(n_cols))
    both = rows.unionByName(cyclic)
    lon = F.col("j") * F.lit(float(lon_step))
    lat = F.lit(float(lat_first)) + (F.lit(n_rows - 1) - F.col("i")) * F.lit(float(lat_step))
    return both.select("i", "j", lat.alias("lat"), (F.pmod(lon + 180.0, F.lit(360.0)) - 180.0).alias("lon"), "value")
