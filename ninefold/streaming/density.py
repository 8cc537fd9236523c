"""Density of cells over event time, for streams and tables alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ninefold.operators.addressing import assign_cells


def stream_density(points: DataFrame, level: int, window: str, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Points (x, y, c2 and a time) by window and cell: start, path, n.

    Cell assignment keeps no state; the windowed count has a watermark, so a stream may run for ever."""
    cells = assign_cells(points.withWatermark(time, late), level)
    counted = cells.groupBy(F.window(time, window), "path").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "path", "n")
