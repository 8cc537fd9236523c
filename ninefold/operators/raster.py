"""Rasters as long tables: row, col and one column for each band (row 0 is north)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BANDS = ("r", "g", "b")


def _bands(raster: DataFrame) -> list[str]:
    return [c for c in raster.columns if c not in ("row", "col")]


def _clamp(v: Column, size: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(size - 1), v)).cast("int")


def checker(pixels: DataFrame, unit: int, colours: list[tuple[int, int, int]], side: int) -> DataFrame:
    """Checkerboard over pixels (row, col) of a square of that side, which must be a multiple of unit
    times the number of colours (see whole_side); the first and last squares are marked."""
    k = F.pmod(F.floor(F.col("row") / unit) + F.floor(F.col("col") / unit), F.lit(len(colours)))
    first = (F.col("row") < unit) & (F.col("col") < unit)
    last = (F.col("row") >= side - unit) & (F.col("col") >= side - unit)

    def band(i: int) -> Column:
        out = F.lit(colours[0][i])
        for n, c in enumerate(colours):
            out = F.when(k == n, F.lit(c[i])).otherwise(out)
        return F.when(last, F.lit((255, 255, 0)[i])).when(first, F.lit((0, 255, 255)[i])).otherwise(out)

    return pixels.select("row", "col", *[band(i).alias(b) for i, b in enumerate(BANDS)])


def whole_side(side: int, unit: int, colours: int) -> int:
    """The side rounded up to a multiple of the unit times the number of colours."""
    return -(-side // (unit * colours)) * unit * colours


def border(side: int, width: int) -> Column:
    """Black on the border of a square of that side, white inside."""
    return F.when((F.least("row", "col") < width) | (F.greatest("row", "col") >= side - width), 0).otherwise(255)


def borders(pixels: DataFrame, side: int, width: int) -> DataFrame:
    """White pixels of a square of that side with a black border."""
    return pixels.select("row", "col", *[border(side, width).alias(b) for b in BANDS])


def mosaic(tiles: DataFrame, sizes: DataFrame, swap: bool = False) -> DataFrame:
    """Tiles (tile_row, tile_col, row, col, bands) side by side, by the sizes (tile_row, tile_col,
    height, width); with swap, the first and third band change places. Only `sizes` is windowed."""
    from pyspark.sql import Window

    across = Window.partitionBy("tile_row").orderBy("tile_col").rowsBetween(Window.unboundedPreceding, -1)
    down = sizes.groupBy("tile_row").agg(F.max("height").alias("height"))
    above = Window.orderBy("tile_row").rowsBetween(Window.unboundedPreceding, -1)
    down = down.select("tile_row", F.coalesce(F.sum("height").over(above), F.lit(0)).alias("top"))
    at = sizes.select("tile_row", "tile_col", F.coalesce(F.sum("width").over(across), F.lit(0)).alias("left")).join(down, "tile_row")
    bands = [c for c in tiles.columns if c not in ("tile_row", "tile_col", "row", "col")]
    names = [bands[2], bands[1], bands[0]] if swap else bands
    out = tiles.join(at, ["tile_row", "tile_col"])
    return out.select((F.col("row") + F.col("top")).cast("int").alias("row"), (F.col("col") + F.col("left")).cast("int").alias("col"), *[F.col(n).cast("int").alias(b) for n, b in zip(names, bands, strict=True)])


def crop(raster: DataFrame, x0: int, x1: int, y0: int, y1: int) -> DataFrame:
    """The half-open window, counted from its corner."""
    inside = raster.filter((F.col("col") >= x0) & (F.col("col") < x1) & (F.col("row") >= y0) & (F.col("row") < y1))
    return inside.withColumns({"row": F.col("row") - y0, "col": F.col("col") - x0})


def flip(raster: DataFrame, code: int, height: int, width: int) -> DataFrame:
    """0 swaps top and bottom, above 0 left and right, below 0 both."""
    out = raster if code > 0 else raster.withColumn("row", F.lit(height - 1) - F.col("row"))
    return out if code == 0 else out.withColumn("col", F.lit(width - 1) - F.col("col"))


def resize(raster: DataFrame, scale: float, height: int, width: int) -> DataFrame:
    """Nearest neighbour, to int(scale * size); each source pixel is copied to where it is nearest."""
    new_h, new_w = int(scale * height), int(scale * width)

    def targets(v: Column, old: int, new: int) -> Column:
        # Candidates around v * new / old, kept if the copy's source is v; products are long.
        v = v.cast("long")
        low = F.greatest(F.lit(0), F.floor(v * new / old) - 1).cast("int")
        high = F.least(F.lit(new - 1), F.ceil((v + 1) * new / old)).cast("int")
        return F.filter(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>")), lambda t: F.least(F.lit(old - 1), F.floor(t * (old / new))) == v)

    out = raster.withColumn("row", F.explode(targets(F.col("row"), height, new_h)))
    return out.withColumn("col", F.explode(targets(F.col("col"), width, new_w)))


def brighten(raster: DataFrame, add: float, factor: float) -> DataFrame:
    """int(factor * (value + add)) in each band."""
    return raster.withColumns({b: (F.lit(float(factor)) * (F.col(b) + F.lit(float(add)))).cast("int") for b in _bands(raster)})


def bounded_lookup(points: DataFrame, raster: DataFrame, default: tuple[int, ...] = (0, 255, 0)) -> DataFrame:
    """The points (row, col) with the bands of their pixel, or the default outside."""
    bands = _bands(raster)
    out = points.join(raster, ["row", "col"], "left")
    return out.withColumns({b: F.coalesce(b, F.lit(d)) for b, d in zip(bands, default, strict=True)})


def axis_index(v: Column, low: float, high: float, size: int, reverse: bool = False) -> Column:
    """Place of v by sorted search on an even axis from low to high, modulo its size."""
    step = (high - low) / (size - 1)
    place = F.greatest(F.lit(0), F.least(F.lit(size), F.ceil((v - F.lit(float(low))) / F.lit(step)))).cast("int")
    at = F.pmod(place, F.lit(size))
    return (F.lit(size - 1) - at if reverse else at).cast("int")


def sample(points: DataFrame, raster: DataFrame, extent: tuple[float, float, float, float], height: int, width: int, lat: str = "lat", lon: str = "lon", north_up: bool = True) -> DataFrame:
    """The points with the bands of the pixel that holds them; extent is lat_min, lat_max, lon_min, lon_max."""
    at = points.withColumns({"row": axis_index(F.col(lat), extent[0], extent[1], height, north_up), "col": axis_index(F.col(lon), extent[2], extent[3], width)})
    return at.join(raster, ["row", "col"])


def window_points(centres: DataFrame, degrees: float, n: int, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """An n x n grid around each centre, north-west first, end points included: wrow, wcol, lat, lon."""
    step = 2 * degrees / (n - 1)
    grid = centres.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(n * n - 1))))
    row, col = (F.col("__k") / n).cast("int"), F.col("__k") % n
    return grid.withColumns({"wrow": row, "wcol": col}).withColumns({lat: F.col(lat) + degrees - F.col("wrow") * step, lon: F.col(lon) - degrees + F.col("wcol") * step}).drop("__k")


def resample_window(centres: DataFrame, raster: DataFrame, degrees: float, n: int, extent: tuple[float, float, float, float], height: int, width: int) -> DataFrame:
    return sample(window_points(centres, degrees, n), raster, extent, height, width)


def graticule(raster: DataFrame, extent: tuple[float, float, float, float], height: int, width: int, lat_step: float, lon_step: float, colour: tuple[int, ...] = (0, 0, 0), stroke: int = 1) -> DataFrame:
    """The raster with lines burnt in at low + (low mod step) + k * step, `stroke` pixels wide."""
    half = stroke // 2

    def on_line(pixel: str, low: float, high: float, step: float, size: int, reverse: bool) -> Column:
        """Whether one of the pixels whose stroke reaches this one holds a line. Pixel p of the axis holds
        the values above that of pixel p - 1, up to its own; the first line beyond the former is found
        by a quotient, so neither axis nor lines are listed."""
        first, width = low + low % step, (high - low) / (size - 1)
        value = lambda p: F.lit(float(low)) + p * F.lit(width)
        hit = F.lit(False)
        for shift in range(-half, stroke - half):
            p = F.col(pixel) - shift
            p = F.lit(size - 1) - p if reverse else p
            n = F.greatest(F.lit(0.0), F.floor((value(p - 1) - F.lit(first)) / F.lit(float(step))))
            for more in (0, 1):  # rounding may leave the quotient one short
                line = F.lit(first) + (n + more) * F.lit(float(step))
                hit |= (p >= 0) & (p < size) & (line < high) & (line <= value(p)) & ((p == 0) | (line > value(p - 1)))
        return hit

    on = F.lit(False)
    if lat_step > 0:
        on |= on_line("row", extent[0], extent[1], lat_step, height, True)
    if lon_step > 0:
        on |= on_line("col", extent[2], extent[3], lon_step, width, False)
    return raster.withColumns({b: F.when(on, F.lit(c)).otherwise(F.col(b)) for b, c in zip(_bands(raster), colour, strict=True)})


# -- area weights ------------------------------------------------------------------------------------

#: Fixed values, for squares of width 1 and shapes of height 1: the pitch of columns, the width of a
#: shape's profile, its rise, and how far the first square is set in.
SHAPES = {
    "hex": {"pitch": 1.5 / 3**0.5, "span": 2 / 3**0.5, "rise": 0.5 / 3**0.5, "inset": 0.5 / 3**0.5},
    "tri": {"pitch": 1 / 3**0.5, "span": 2 / 3**0.5, "rise": 1 / 3**0.5, "inset": 1 / 3**0.5},
}


def profile_area(t: Column, shape: str) -> Column:
    """Area left of t under a shape's height profile: rise, top of height 1, fall."""
    s = SHAPES[shape]
    rise, span, total = s["rise"], s["span"], s["span"] - s["rise"]
    return F.when(t <= 0, F.lit(0.0)).when(t <= rise, t * t / (2 * rise)).when(t <= span - rise, rise / 2 + (t - rise)).when(t < span, total - (span - t) * (span - t) / (2 * rise)).otherwise(F.lit(total))


def overlap_weights(columns: DataFrame, shape: str, least: int = 0) -> DataFrame:
    """For square columns (sq): the shape columns, from `least` on, that they overlap and the area, sq, other, area.

    Neighbouring profiles add up to 1, so the areas of a square add up to 1 and those of a shape to
    its pitch. A range join of intervals, done as an explode of the few possible columns."""
    s = SHAPES[shape]
    left = F.col("sq") + F.lit(s["inset"])
    first = F.floor(left / s["pitch"]).cast("int")
    near = columns.select("sq", F.explode(F.sequence(first - 2, first + 2)).alias("other"))
    area = lambda edge: profile_area(edge - F.col("other") * F.lit(s["pitch"]), shape)
    return near.withColumn("area", area(left + 1.0) - area(left)).filter((F.col("other") >= least) & (F.col("area") > 1e-12))


def write_weights(spark: SparkSession, path: str, shape: str, n: int) -> None:
    """Weights of n square columns as Parquet, in a folder of their shape, with the periods of both lattices."""
    s = SHAPES[shape]
    weights = overlap_weights(spark.range(n).withColumnRenamed("id", "sq"), shape)
    periods = {"square_pitch": F.lit(1.0), "pitch": F.lit(float(s["pitch"]))}
    weights.withColumns(periods).write.mode("overwrite").parquet(f"{path}/shape={shape}")


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """Stored weights: sq, other, area, square_pitch, pitch, shape; a filter on shape reads its folder only."""
    return spark.read.parquet(path)


def check_weights(weights: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Square columns whose areas do not add up to 1: sq, total."""
    return weights.groupBy("sq").agg(F.sum("area").alias("total")).filter(F.abs(F.col("total") - 1) > tolerance)


def _weighted(raster: DataFrame, weights: DataFrame, targets: Column) -> DataFrame:
    """Sums of bands times weight (src, dst, w) into the rows that `targets` names for each pixel."""
    bands = _bands(raster)
    out = raster.join(weights, raster["col"] == weights["src"]).withColumn("t", F.explode(targets))
    return out.groupBy(F.col("t.row").alias("row"), F.col("dst").cast("int").alias("col")).agg(*[F.sum(F.col(b) * F.col("w") * F.col("t.f")).alias(b) for b in bands])


def _both_rows(on: Column, step: int, height: int) -> Column:
    """Rows that a pixel gives to: its own, or where `on` half to its own and half to the one `step`
    away; the row at the edge stands in for the one beyond it."""
    row = F.col("row").cast("int")
    entry = lambda r, f: F.struct(r.cast("int").alias("row"), F.lit(f).alias("f"))
    edge = row == (0 if step > 0 else height - 1)
    other = row + step
    pair = F.filter(F.array(entry(row, 0.5), entry(F.when((other >= 0) & (other < height), other), 0.5), entry(F.when(edge, row), 0.5)), lambda e: e["row"].isNotNull())
    return F.when(on, pair).otherwise(F.array(entry(row, 1.0)))


def _clamped(weights: DataFrame, size: int) -> DataFrame:
    return weights.groupBy(_clamp(F.col("src"), size).alias("src"), "dst").agg(F.sum("w").alias("w"))


#: Columns of one period of squares, hexagons and triangles, nearly equal in width.
PERIOD = {"square": 1351, "hex": 1560, "tri": 2340}


def period_drift(shape: str) -> float:
    """By how much a shape's columns of one period are wider than its squares, in squares."""
    return PERIOD[shape] * SHAPES[shape]["pitch"] - PERIOD["square"]


def period_bound(shape: str, width: int, back: bool = False) -> float:
    """The most by which periodic weights of a raster `width` columns wide may change a value, as a share of
    the greatest: every border between columns moves by no more than the drift of all periods before it,
    and a pixel has at most four of them."""
    periods = width // PERIOD[shape if back else "square"] + 1
    return 4 * periods * abs(period_drift(shape)) / (1.0 if back else SHAPES[shape]["pitch"])


def periodic_weights(spark: SparkSession, shape: str) -> DataFrame:
    """The weights of the squares of one period (sq, other, area), however wide a raster is; other may lie
    in the period before or after."""
    return overlap_weights(spark.range(PERIOD["square"]).select(F.col("id").cast("int").alias("sq")), shape, -2)


def _by_period(raster: DataFrame, weights: DataFrame, source: int, target: int, targets: Column, count: int) -> DataFrame:
    """As _weighted, with weights (src, dst, w) of one period: columns meet them by remainder."""
    bands, period = _bands(raster), F.floor(F.col("col") / source).cast("int")
    rows = raster.withColumn("__p", period).withColumn("src", (F.col("col") - F.col("__p") * source).cast("int"))
    met = rows.join(F.broadcast(weights), "src").withColumn("dst", F.col("dst") + F.col("__p") * target).filter((F.col("dst") >= 0) & (F.col("dst") < count))
    met = met.withColumn("t", F.explode(targets))
    return met.groupBy(F.col("t.row").alias("row"), F.col("dst").cast("int").alias("col")).agg(*[F.sum(F.col(b) * F.col("w") * F.col("t.f")).alias(b) for b in bands])


def _with_edges(raster: DataFrame, before: int, after: int, width: int) -> DataFrame:
    """The raster with copies of its edge columns beside it."""
    copies = lambda at, places: raster.filter(F.col("col") == at).withColumn("col", F.explode(F.array(*[F.lit(p) for p in places])))
    out = raster
    if before:
        out = out.unionByName(copies(0, range(-before, 0)))
    return out.unionByName(copies(width - 1, range(width, width + after)))


def square_to_shape_periodic(raster: DataFrame, shape: str, height: int, width: int) -> DataFrame:
    """square_to_shape by weights of one period, a table of constant size that is broadcast; values differ
    from the closed form by no more than period_bound."""
    pitch = SHAPES[shape]["pitch"]
    weights = periodic_weights(raster.sparkSession, shape).select(F.col("sq").alias("src"), F.col("other").alias("dst"), (F.col("area") / F.lit(pitch)).alias("w"))
    odd = (F.pmod("dst", F.lit(2)) == 1) if shape == "hex" else F.lit(False)
    return _by_period(_with_edges(raster, 2, 3, width), weights, PERIOD["square"], PERIOD[shape], _both_rows(odd, 1, height), int(np.ceil(width / pitch - 1e-9)))


def shape_to_square_periodic(raster: DataFrame, shape: str, height: int, width: int) -> DataFrame:
    """shape_to_square by weights of one period."""
    s, squares, others = SHAPES[shape], PERIOD["square"], PERIOD[shape]
    turn = F.floor(F.col("other") / others)  # a shape of the period before or after stands for one of this
    weights = periodic_weights(raster.sparkSession, shape).select((F.col("other") - turn * others).cast("int").alias("src"), (F.col("sq") - turn * squares).cast("int").alias("dst"), F.col("area").alias("w"))
    odd = (F.pmod("col", F.lit(2)) == 1) if shape == "hex" else F.lit(False)
    return _by_period(_with_edges(raster, 0, 3, width), weights, others, squares, _both_rows(odd, -1, height), max(int(np.floor(width * s["pitch"] - s["inset"] + 1e-9)), 0))


def square_to_shape(raster: DataFrame, shape: str, height: int, width: int) -> DataFrame:
    """Square pixels to hexagon or triangle pixels. Odd hexagon columns average their row and the one before."""
    spark, pitch = raster.sparkSession, SHAPES[shape]["pitch"]
    count = int(np.ceil(width / pitch - 1e-9))
    weights = overlap_weights(spark.range(-2, width + 3).select(F.col("id").alias("sq")), shape)
    full = weights.filter(F.col("other") < count).select(F.col("sq").alias("src"), F.col("other").alias("dst"), (F.col("area") / F.lit(pitch)).alias("w"))
    odd = (F.col("dst") % 2 == 1) if shape == "hex" else F.lit(False)
    return _weighted(raster, _clamped(full, width), _both_rows(odd, 1, height))


def shape_to_square(raster: DataFrame, shape: str, height: int, width: int) -> DataFrame:
    """Hexagon or triangle pixels, `width` columns of them, to square pixels. Odd hexagon columns give
    their row and the one after."""
    spark, s = raster.sparkSession, SHAPES[shape]
    count = int(np.floor(width * s["pitch"] - s["inset"] + 1e-9))
    weights = overlap_weights(spark.range(0, max(count, 0)).select(F.col("id").alias("sq")), shape)
    turned = weights.select(F.col("other").alias("src"), F.col("sq").alias("dst"), F.col("area").alias("w"))
    odd = (F.col("src") % 2 == 1) if shape == "hex" else F.lit(False)
    return _weighted(raster, _clamped(turned, width), _both_rows(odd, -1, height))


def roundtrip_error(raster: DataFrame, height: int, width: int, shape: str = "hex") -> DataFrame:
    """Square pixels to shapes and back: number of pixels, average and largest difference of each band."""
    columns = int(np.ceil(width / SHAPES[shape]["pitch"] - 1e-9))
    back = shape_to_square(square_to_shape(raster, shape, height, width), shape, height, columns)
    bands = _bands(raster)
    both = raster.join(back.select("row", "col", *[F.col(b).alias(f"{b}_back") for b in bands]), ["row", "col"])
    diff = {b: F.abs(F.col(b) - F.col(f"{b}_back")) for b in bands}
    return both.agg(F.count("*").alias("n"), *[F.avg(d).alias(f"avg_{b}") for b, d in diff.items()], *[F.max(d).alias(f"max_{b}") for b, d in diff.items()])


# -- districts ---------------------------------------------------------------------------------------

#: The three triangle pixels (x, y) of each district of a large tile (9 x 6 pixels with
#: column parity), in order of the districts.
NINE = [
    [(2, 3), (3, 3), (4, 3)], [(2, 2), (3, 2), (4, 2)], [(5, 2), (5, 1), (6, 1)], [(6, 2), (7, 1), (7, 2)],
    [(7, 4), (7, 3), (6, 3)], [(5, 3), (5, 4), (6, 4)], [(8, 3), (9, 3), (10, 3)], [(8, 2), (9, 2), (10, 2)],
    [(2, 4), (2, 5), (3, 4)], [(3, 5), (4, 5), (4, 4)], [(3, 0), (4, 0), (4, 1)], [(2, 0), (2, 1), (3, 1)],
    [(5, 0), (6, 0), (7, 0)], [(5, 5), (6, 5), (7, 5)], [(8, 5), (8, 4), (9, 4)], [(0, 2), (1, 1), (1, 2)],
    [(0, 3), (1, 3), (1, 4)], [(8, 0), (8, 1), (9, 1)],
]
#: The same for the twelve districts of a small tile (6 x 6 pixels).
SIX = [
    [(0, 0), (0, 1), (1, 1)], [(1, 0), (2, 0), (2, 1)], [(3, 0), (4, 0), (5, 0)], [(0, 2), (1, 2), (2, 2)],
    [(3, 2), (3, 1), (4, 1)], [(4, 2), (5, 2), (5, 1)], [(0, 3), (1, 3), (2, 3)], [(3, 3), (3, 4), (4, 4)],
    [(4, 3), (5, 3), (5, 4)], [(0, 4), (0, 5), (1, 4)], [(1, 5), (2, 4), (2, 5)], [(3, 5), (4, 5), (5, 5)],
]


def district_pixels(hexes: DataFrame, layout: str, height: int, width: int, inverted: bool = False, scatter: bool = False) -> DataFrame:
    """For hexes (hx, hy): district, k and the row and col of its triangle pixels, clamped. Rows that name
    a district themselves get that one only, and keep their other columns."""
    table = NINE if layout == "9" else SIX
    offsets = hexes.sparkSession.createDataFrame([(d, k, x, y) for d, ps in enumerate(table) for k, (x, y) in enumerate(ps)], "district int, k int, dx int, dy int")
    if layout == "9":
        parity = F.pmod("hx", F.lit(2)) if not inverted else 1 - F.pmod("hx", F.lit(2))
        tx, ty = F.col("hx") * 9, F.col("hy") * 6 - parity * 3 if scatter else F.col("hy") * 6 + parity * 3 - 2
    else:
        tx, ty = F.col("hx") * 6, F.col("hy") * 6
    low = (lambda v, n: _clamp(v, n)) if layout == "9" else (lambda v, n: F.least(F.lit(n - 1), v).cast("int"))
    named = "district" in hexes.columns
    placed = hexes.join(F.broadcast(offsets), "district") if named else hexes.crossJoin(F.broadcast(offsets))
    kept = [c for c in hexes.columns if c not in ("hx", "hy", "district")] if named else []
    return placed.select("hx", "hy", "district", "k", *kept, low(ty + F.col("dy"), height).alias("row"), low(tx + F.col("dx"), width).alias("col"))


def tri_to_district(raster: DataFrame, hexes: DataFrame, layout: str, height: int, width: int, inverted: bool = False) -> DataFrame:
    """Mean of the three triangle pixels of each district of each hex: hx, hy, district, bands."""
    at = district_pixels(hexes, layout, height, width, inverted)
    return at.join(raster, ["row", "col"]).groupBy("hx", "hy", "district").agg(*[(F.sum(b) / 3).alias(b) for b in _bands(raster)])


def district_to_tri(colours: DataFrame, height: int, width: int) -> DataFrame:
    """Districts (hx, hy, district, bands) to triangle pixels; where several write, the last one in
    order of hy, hx, district and pixel wins.

    Each district gives its own three pixels, without a shuffle; the only one is of pixels."""
    bands = [c for c in colours.columns if c not in ("hx", "hy", "district")]
    rows = district_pixels(colours.filter("hx IS NOT NULL AND hy IS NOT NULL"), "9", height, width, scatter=True)
    last = rows.groupBy("row", "col").agg(F.max_by(F.struct(*bands), F.struct("hy", "hx", "district", "k")).alias("v"))
    return last.select("row", "col", *[F.col(f"v.{b}").alias(b) for b in bands])


# -- despeckle ----------------------------------------------------------------------------------------

TILE = 256
_HALO = 8


def _gaussian(k: int) -> np.ndarray:
    sigma = 0.3 * ((k - 1) * 0.5 - 1) + 0.8
    g = np.exp(-((np.arange(k) - k // 2) ** 2) / (2 * sigma * sigma))
    return g / g.sum()


def _adaptive(v: np.ndarray, k: int, c: float) -> np.ndarray:
    """255 where a value is above the Gaussian mean of its k x k surroundings less c, else 0."""
    g, p = _gaussian(k), np.pad(v.astype(float), k // 2, mode="edge")
    rows = sum(g[i] * p[i : i + v.shape[0], :] for i in range(k))
    mean = sum(g[i] * rows[:, i : i + v.shape[1]] for i in range(k))
    return np.where(v > np.rint(mean) - c, 255, 0)


#: Most different values that the sliding histogram counts; wider ranges are ranked window by window.
HISTOGRAM_BINS = 1024


def _medians(padded: np.ndarray, k: int) -> np.ndarray:
    """Medians of all k x k windows. A histogram of each column goes down the image, one value in and one
    out, and windows are sums of k of them, so the work for a pixel does not grow with the window."""
    height, width = padded.shape[0] - k + 1, padded.shape[1] - k + 1
    low = int(padded.min())
    bins = int(padded.max()) - low + 1
    if bins > HISTOGRAM_BINS:
        return np.sort(np.lib.stride_tricks.sliding_window_view(padded, (k, k)).reshape(height, width, k * k), axis=2)[:, :, k * k // 2]
    values, x = padded - low, np.arange(padded.shape[1])
    columns = np.zeros((len(x), bins), np.int32)
    for y in range(k - 1):
        columns[x, values[y]] += 1
    out = np.empty((height, width), np.int64)
    running = np.zeros((len(x) + 1, bins), np.int32)
    for y in range(height):
        columns[x, values[y + k - 1]] += 1
        np.cumsum(columns, axis=0, out=running[1:])
        inside = np.cumsum(running[k:] - running[:-k], axis=1)
        out[y] = (inside > k * k // 2).argmax(axis=1) + low
        columns[x, values[y]] -= 1
    return out


def despeckle(raster: DataFrame) -> DataFrame:
    """9 x 9 medians, except where an edge mask of the brightness (two adaptive thresholds) is set.

    The raster is cut into tiles of bounded size that carry a halo of their neighbours; each tile is
    one group, so no task depends on the raster's size. Missing pixels repeat the nearest edge."""
    bands = _bands(raster)

    def smooth(key: tuple, source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(source))
        row, col = table.column("row").to_numpy(), table.column("col").to_numpy()
        r0, c0 = row.min(), col.min()
        image = np.full((row.max() - r0 + 1, col.max() - c0 + 1, len(bands)), -1, np.int64)
        for i, b in enumerate(bands):
            image[row - r0, col - c0, i] = table.column(b).to_numpy()
        value = image.max(axis=2)
        mask = _adaptive(255 - value, 9, 17)
        inverse = 255 - mask
        edge = np.clip(_adaptive(inverse, 5, 9) - inverse, 0, 255)
        padded = np.pad(image, ((4, 4), (4, 4), (0, 0)), mode="edge")
        tr, tc = key[0].as_py() * TILE, key[1].as_py() * TILE
        own = (row >= tr) & (row < tr + TILE) & (col >= tc) & (col < tc + TILE)
        y, x = row[own] - r0, col[own] - c0
        median = np.stack([_medians(padded[:, :, i], 9)[y, x] for i in range(len(bands))], axis=1) if len(y) else np.zeros((0, len(bands)), np.int64)
        out = np.where(edge[y, x][:, None] == 0, median, image[y, x])
        yield pa.RecordBatch.from_arrays([pa.array(row[own].astype(np.int32)), pa.array(col[own].astype(np.int32)), *[pa.array(out[:, i].astype(np.int32)) for i in range(len(bands))]], ["row", "col", *bands])

    near = lambda c: F.array_distinct(F.transform(F.array(F.lit(-_HALO), F.lit(0), F.lit(_HALO)), lambda d: F.floor((F.col(c) + d) / TILE).cast("int")))
    tiles = raster.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), *[F.col(b).cast("int").alias(b) for b in bands])
    tiles = tiles.withColumn("tr", F.explode(near("row"))).withColumn("tc", F.explode(near("col")))
    wanted = raster.select((F.floor(F.col("row") / TILE)).cast("int").alias("tr"), (F.floor(F.col("col") / TILE)).cast("int").alias("tc")).distinct()
    return tiles.join(wanted, ["tr", "tc"]).groupBy("tr", "tc").applyInArrow(smooth, "row int, col int, " + ", ".join(f"{b} int" for b in bands))


# -- areas between cuts -----------------------------------------------------------------------------------

def split_area(cuts: DataFrame, by: list[str], side: float = 1.0) -> DataFrame:
    """Parts of a shape between vertical cuts (x, shape: square, triangle or half_hex, of that side).

    n cuts of a shape give n + 1 rows: place (from 1), share of the whole, and area."""
    x, r3 = F.col("x") / F.lit(side), 3**0.5
    square = F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(x)
    triangle = F.when(x <= 0, 0.0).when(x <= 0.5, x * x * 2).when(x < 1, 1 - (1 - x) * (1 - x) * 2).otherwise(1.0)
    h = r3 / 2
    whole = 1.5 * h
    half_hex = F.when(x <= 0, 0.0).when(x <= 0.5, x * x * r3 / 2 / whole).when(x <= 1.5, (h / 4 + (x - 0.5) * h) / whole).when(x < 2, 1 - (2 - x) * (2 - x) * r3 / 2 / whole).otherwise(1.0)
    is_a = lambda *v: F.when(F.col("shape") == "square", v[0]).when(F.col("shape") == "triangle", v[1]).otherwise(v[2])
    w = Window.partitionBy(*by).orderBy("x")
    rows = cuts.withColumn("left", is_a(square, triangle, half_hex)).withColumn("size", is_a(1.0, r3 / 4, whole) * F.lit(side * side))
    rows = rows.withColumn("place", F.row_number().over(w)).withColumn("share", F.col("left") - F.coalesce(F.lag("left").over(w), F.lit(0.0)))
    rest = rows.groupBy(*by).agg((F.count("*") + 1).cast("int").alias("place"), (F.lit(1.0) - F.max("left")).alias("share"), F.max("size").alias("size"))
    return rows.select(*by, "place", "share", "size").unionByName(rest).select(*by, "place", "share", (F.col("share") * F.col("size")).alias("area"))
