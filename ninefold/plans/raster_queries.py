"""Queries over rasters and their SQL. The raster has one pixel for each order, 96 wide."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ninefold.operators import mesh as M
from ninefold.operators import raster as X
from ninefold.operators import tiles as T

from .sql import RASTER_SQL, RASTER_WIDTH, num, places, places_sql, raster, raster_sql, shared_folder, table

W = RASTER_WIDTH
EXTENT = (-90.0, 90.0, -180.0, 180.0)
#: Pixels of a task, about, where few rows make many pixels.
TASK_PIXELS = 500_000


def _full(spark: SparkSession, sf_dir: str, width: int = W) -> tuple[DataFrame, int]:
    """The raster, its last row filled up with the colour of places outside a raster, and its height."""
    image = raster(spark, sf_dir, width)
    n = image.count()
    height = max(1, -(-n // width))
    rest = spark.range(n, height * width).selectExpr(f"CAST(id div {width} AS INT) AS row", f"CAST(id % {width} AS INT) AS col", "0 AS r", "255 AS g", "0 AS b")
    return image.unionByName(rest), height


def _base(width: int) -> tuple[str, str]:
    """SQL that begins with the height, and with the height and the filled raster."""
    size = f"WITH size AS (SELECT greatest(1, (count(*) + {width - 1}) // {width}) AS h FROM orders), img AS "
    return size, size + f'({raster_sql(width)} UNION ALL SELECT (k // {width})::int, (k % {width})::int, 0, 255, 0 FROM range((SELECT count(*) FROM orders), (SELECT h * {width} FROM size)) p(k)) '


_HEIGHT, BASE = _base(W)
ROUND = ", ".join(f"round({b}, 6) AS {b}" for b in "rgb")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("row", "col", *[F.round(b, 6).alias(b) for b in X.BANDS])


def s7_checker(spark, sf_dir):
    """A checkerboard large enough for a pixel of each order, and its border."""
    orders = table(spark, sf_dir, "orders")
    side = X.whole_side(math.ceil(orders.count() ** 0.5), 4, 2)
    pixels = orders.select(F.expr(f"CAST(o_orderkey div {side} AS INT)").alias("row"), F.expr(f"CAST(o_orderkey % {side} AS INT)").alias("col"))
    return X.checker(pixels, 4, [(255, 255, 255), (0, 0, 0)], side).withColumn("border", X.border(side, 3))


S7 = """WITH s AS (SELECT (CAST(ceil(sqrt(count(*))) AS INT) + 7) // 8 * 8 AS side FROM orders), p AS (SELECT (o_orderkey // side)::int AS "row", (o_orderkey % side)::int AS col, side FROM orders, s)
SELECT "row", col, CASE WHEN "row" >= side-4 AND col >= side-4 THEN 255 WHEN "row" < 4 AND col < 4 THEN 0 WHEN ("row"//4 + col//4) % 2 = 0 THEN 255 ELSE 0 END AS r,
  CASE WHEN ("row" >= side-4 AND col >= side-4) OR ("row" < 4 AND col < 4) THEN 255 WHEN ("row"//4 + col//4) % 2 = 0 THEN 255 ELSE 0 END AS g,
  CASE WHEN "row" >= side-4 AND col >= side-4 THEN 0 WHEN "row" < 4 AND col < 4 THEN 255 WHEN ("row"//4 + col//4) % 2 = 0 THEN 255 ELSE 0 END AS b,
  CASE WHEN least("row", col) < 3 OR greatest("row", col) >= side-3 THEN 0 ELSE 255 END AS border FROM p"""


def s3_mosaic(spark, sf_dir):
    """Four tiles of the raster put together in another order, colours swapped."""
    image, height = _full(spark, sf_dir)
    half, wide = height // 2, 40
    tile_row, tile_col = (F.col("row") < half).cast("int"), (F.col("col") < wide).cast("int")
    tiles = image.select(tile_row.alias("tile_row"), tile_col.alias("tile_col"), F.when(F.col("row") < half, F.col("row")).otherwise(F.col("row") - half).alias("row"), F.when(F.col("col") < wide, F.col("col")).otherwise(F.col("col") - wide).alias("col"), "r", "g", "b")
    sizes = tiles.groupBy("tile_row", "tile_col").agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"))
    return X.mosaic(tiles, sizes, swap=True)


S3 = BASE + f"""SELECT (CASE WHEN "row" < h//2 THEN "row" + h - h//2 ELSE "row" - h//2 END)::int AS "row", (CASE WHEN col < 40 THEN col + {W - 40} ELSE col - 40 END)::int AS col, b AS r, g, r AS b FROM img, size"""


def p3_crop_flip_resize(spark, sf_dir):
    image, height = _full(spark, sf_dir)
    part = X.flip(X.crop(image, 8, 88, 2, height - 2), -1, height - 4, 80)
    return X.resize(part, 1.5, height - 4, 80).select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "r", "g", "b")


P3 = BASE + """, part AS (SELECT h-4-1-("row"-2) AS "row", 80-1-(col-8) AS col, r, g, b FROM img, size WHERE col >= 8 AND col < 88 AND "row" >= 2 AND "row" < h-2)
SELECT y.k::int AS "row", x.k::int AS col, r, g, b FROM size, range(0, (SELECT floor(1.5*(h-4))::bigint FROM size)) y(k), range(0, 120) x(k), part
WHERE part."row" = least(h-5, floor(y.k * ((h-4)::double / floor(1.5*(h-4))))) AND part.col = least(79, floor(x.k * (80::double/120)))"""


def p5_brightness(spark, sf_dir):
    return X.brighten(raster(spark, sf_dir), 16.0, 0.75)


P5 = f'SELECT "row", col, trunc(0.75::double*(r + 16.0::double))::int AS r, trunc(0.75::double*(g + 16.0::double))::int AS g, trunc(0.75::double*(b + 16.0::double))::int AS b FROM ({RASTER_SQL})'


def p6_bounded_lookup(spark, sf_dir):
    points = table(spark, sf_dir, "events").selectExpr("event_id", "CAST(event_id % 211 AS INT) AS row", "CAST(user_id % 131 AS INT) - 10 AS col")
    return X.bounded_lookup(points, raster(spark, sf_dir))


P6 = f'SELECT e.event_id, e."row", e.col, coalesce(i.r, 0) AS r, coalesce(i.g, 255) AS g, coalesce(i.b, 0) AS b FROM (SELECT event_id, (event_id % 211)::int AS "row", (user_id % 131)::int - 10 AS col FROM events) e LEFT JOIN ({RASTER_SQL}) i USING ("row", col)'


def p7_graticule(spark, sf_dir):
    image, height = _full(spark, sf_dir)
    burnt = X.graticule(image, EXTENT, height, W, 30.0, 30.0, (1, 2, 3), 1)
    return burnt.filter("r = 1 AND g = 2 AND b = 3").groupBy("row").agg(F.count("*").alias("n"))


_LINES = ", ".join(f"h - 1 - (SELECT count(*) FROM range(0, h) a(k) WHERE -90.0::double + k*(180.0::double/(h-1)) < {num(-90 + 30 * k)}) % h" for k in range(6))
_COLS = ", ".join(str(-(-(k * 30 * (W - 1)) // 360)) for k in range(12))
P7 = BASE + f'SELECT "row", count(*) AS n FROM img, size WHERE "row" IN ({_LINES}) OR col IN ({_COLS}) OR (r = 1 AND g = 2 AND b = 3) GROUP BY ALL'


def j2_sample_raster(spark, sf_dir):
    image, height = _full(spark, sf_dir)
    return X.sample(places(spark, sf_dir, extra=("c_custkey",)), image, EXTENT, height, W).select("c_custkey", "r", "g", "b")


_H = "greatest(0, least(h, ceil((lat + 90.0::double)/(180.0::double/(h-1)))))"
_C = f"greatest(0, least({W}, ceil((lon + 180.0::double)/(360.0::double/{W - 1}))))"
J2 = BASE + f"""SELECT c_custkey, r, g, b FROM (SELECT c_custkey, (h - 1 - ({_H})::int % h)::int AS "row", (({_C})::int % {W})::int AS col FROM ({places_sql(extra=("c_custkey",))}), size) p JOIN img USING ("row", col)"""


def j3_resample_window(spark, sf_dir):
    image, height = _full(spark, sf_dir)
    centres = places(spark, sf_dir, "supplier", "s_suppkey", ("s_suppkey",))
    return X.resample_window(centres, image, 7.3, 4, EXTENT, height, W).select("s_suppkey", "wrow", "wcol", "r", "g", "b")


J3 = BASE + f"""SELECT s_suppkey, wrow, wcol, r, g, b FROM (SELECT s_suppkey, wrow, wcol, (h - 1 - ({_H})::int % h)::int AS "row", (({_C})::int % {W})::int AS col FROM
  (SELECT s_suppkey, (k//4)::int AS wrow, (k%4)::int AS wcol, lat + 7.3::double - (k//4)*(2*7.3::double/3) AS lat, lon - 7.3::double + (k%4)*(2*7.3::double/3) AS lon FROM ({places_sql("supplier", "s_suppkey", ("s_suppkey",))}), range(0, 16) g(k)), size) p JOIN img USING ("row", col)"""


# -- the same from tiles -------------------------------------------------------------------------------

TILE_SIDE = 32


def tiled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """The raster written as tiles and read again, and its height."""
    image, height = _full(spark, sf_dir)
    path = f"{shared_folder(spark)}/tiles-{uuid.uuid4().hex}"
    T.write_tiles(image, path, TILE_SIDE)
    return T.read_tiles(spark, path), height


def j2_sample_tiles(spark, sf_dir):
    tiles, height = tiled(spark, sf_dir)
    points = places(spark, sf_dir, extra=("c_custkey",))
    return T.sample_tiles(points, tiles, EXTENT, height, W, side=TILE_SIDE).select("c_custkey", "r", "g", "b")


def j3_resample_tiles(spark, sf_dir):
    tiles, height = tiled(spark, sf_dir)
    centres = places(spark, sf_dir, "supplier", "s_suppkey", ("s_suppkey",))
    return T.resample_tiles(centres, tiles, 7.3, 4, EXTENT, height, W, side=TILE_SIDE).select("s_suppkey", "wrow", "wcol", "r", "g", "b")


def _profile(t: str, shape: str) -> str:
    s = X.SHAPES[shape]
    rise, span = num(s["rise"]), num(s["span"])
    total = num(s["span"] - s["rise"])
    return f"(CASE WHEN {t} <= 0 THEN 0.0::double WHEN {t} <= {rise} THEN {t}*{t}/(2*{rise}) WHEN {t} <= {span}-{rise} THEN {rise}/2 + ({t}-{rise}) WHEN {t} < {span} THEN {total} - ({span}-{t})*({span}-{t})/(2*{rise}) ELSE {total} END)"


def _weights(columns: str, shape: str) -> str:
    s = X.SHAPES[shape]
    left = f"(sq + {num(s['inset'])} - other*{num(s['pitch'])})"
    return f"SELECT sq, other, {_profile(f'({left} + 1.0::double)', shape)} - {_profile(left, shape)} AS area FROM (SELECT sq, (floor((sq + {num(s['inset'])})/{num(s['pitch'])}) + d)::int AS other FROM ({columns}), range(-2, 3) r(d)) WHERE other >= 0"


def _weights_query(shape):
    def query(spark, sf_dir):
        out = X.overlap_weights(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sq")), shape)
        return out.select("sq", "other", F.round("area", 6).alias("area")).filter("area > 0")

    return query


def x0_check_weights(spark, sf_dir):
    """Squares whose weights do not add up (none), beside the number of squares."""
    squares = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sq"))
    out = None
    for shape in ("hex", "tri"):
        weights = X.overlap_weights(squares, shape)
        one = weights.agg(F.lit(shape).alias("shape"), F.count_distinct("sq").alias("squares")).crossJoin(X.check_weights(weights).agg(F.count("*").alias("deviating")))
        out = one if out is None else out.unionByName(one)
    return out


def _x0_check() -> str:
    one = lambda shape: f"SELECT '{shape}' AS shape, count(*) AS squares, count(*) FILTER (WHERE abs(total - 1) > 1e-6) AS deviating FROM (SELECT sq, sum(area) AS total FROM ({_weights('SELECT p_partkey AS sq FROM part', shape)}) WHERE area > 1e-12 GROUP BY sq)"
    return f"{one('hex')} UNION ALL {one('tri')}"


def x0_stored_weights(spark, sf_dir):
    """Weights stored for as many columns as there are parts, and read again with their periods."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    for shape in X.SHAPES:
        X.write_weights(spark, path, shape, table(spark, sf_dir, "part").count())
    return X.read_weights(spark, path).select("shape", "sq", "other", F.round("area", 6).alias("area"), F.round("pitch", 9).alias("pitch"))


X0S = " UNION ALL ".join(f"SELECT '{s}' AS shape, sq, other, round(area, 6) AS area, round({num(X.SHAPES[s]['pitch'])}, 9) AS pitch FROM ({_weights('SELECT k AS sq FROM range(0, (SELECT count(*) FROM part)) q(k)', s)}) WHERE area > 1e-12" for s in X.SHAPES)


def _to_shape(shape):
    def query(spark, sf_dir):
        image, height = _full(spark, sf_dir)
        return _rounded(X.square_to_shape(image, shape, height, W))

    return query


def _sums(digits: int) -> str:
    return ", ".join(f"round(sum({b}*w*f), {digits}) AS {b}" for b in "rgb")


def _to_shape_sql(shape: str, digits: int = 6, base: str = BASE, width: int = W) -> str:
    pitch = num(X.SHAPES[shape]["pitch"])
    odd = "dst % 2 = 1" if shape == "hex" else "false"
    return base + f""", w AS (SELECT other AS dst, greatest(0, least({width - 1}, sq)) AS src, area/{pitch} AS w FROM ({_weights(f'SELECT k::int AS sq FROM range(-2, {width + 3}) q(k)', shape)}) WHERE area > 1e-12 AND other < ceil({width}/{pitch})),
t AS (SELECT y.k AS ty, dst, src, w, o.d, CASE WHEN {odd} THEN 0.5::double ELSE 1.0::double END AS f FROM w, range(0, (SELECT h FROM size)) y(k), (VALUES (0), (1)) o(d) WHERE o.d = 0 OR ({odd}))
SELECT ty::int AS "row", dst::int AS col, {_sums(digits)} FROM t JOIN img ON img.col = src AND img."row" = greatest(0, ty - d) GROUP BY ALL"""


def _to_square(shape):
    def query(spark, sf_dir):
        image, height = _full(spark, sf_dir)
        return _rounded(X.shape_to_square(image, shape, height, W))

    return query


def _to_square_sql(shape: str, digits: int = 6, base: str = BASE, width: int = W) -> str:
    s = X.SHAPES[shape]
    count = int(width * s["pitch"] - s["inset"] + 1e-9)
    odd = "src % 2 = 1" if shape == "hex" else "false"
    return base + f""", w AS (SELECT sq AS dst, greatest(0, least({width - 1}, other)) AS src, area AS w FROM ({_weights(f'SELECT k::int AS sq FROM range(0, {count}) q(k)', shape)}) WHERE area > 1e-12),
t AS (SELECT y.k AS ty, dst, src, w, o.d, CASE WHEN {odd} THEN 0.5::double ELSE 1.0::double END AS f FROM w, range(0, (SELECT h FROM size)) y(k), (VALUES (0), (1)) o(d) WHERE o.d = 0 OR ({odd}))
SELECT ty::int AS "row", dst::int AS col, {_sums(digits)} FROM t, size, img WHERE img.col = src AND img."row" = least(h - 1, ty + d) GROUP BY ALL"""


# -- weights of one period -----------------------------------------------------------------------------

#: Wide enough for several periods.
WIDE = 4500


def _periodic(shape: str, back: bool):
    """Exact colours of a wide raster, and whether those by weights of one period keep to their bound."""

    def query(spark, sf_dir):
        image, height = _full(spark, sf_dir, WIDE)
        exact, periodic = (X.shape_to_square, X.shape_to_square_periodic) if back else (X.square_to_shape, X.square_to_shape_periodic)
        near = periodic(image, shape, height, WIDE).withColumnsRenamed({b: f"p_{b}" for b in X.BANDS})
        bound = 255 * X.period_bound(shape, WIDE, back)
        close = F.greatest(*[F.abs(F.col(b) - F.col(f"p_{b}")) for b in X.BANDS]) <= bound
        return _rounded_with(exact(image, shape, height, WIDE).join(near, ["row", "col"], "full"), F.coalesce(close, F.lit(False)).alias("within_bounds"))

    return query


def _rounded_with(df: DataFrame, *more) -> DataFrame:
    return df.select("row", "col", *[F.round(b, 6).alias(b) for b in X.BANDS], *more)


def _periodic_sql(shape: str, back: bool) -> str:
    exact = (_to_square_sql if back else _to_shape_sql)(shape, 6, _base(WIDE)[1], WIDE)
    return f"SELECT *, true AS within_bounds FROM ({exact})"


PERIODIC = {f"x{n}_periodic_{name}": (shape, back) for n, name, shape, back in ((1, "square_to_hex", "hex", False), (2, "hex_to_square", "hex", True), (3, "square_to_tri", "tri", False), (4, "tri_to_square", "tri", True))}


def x0_periodic_weights(spark, sf_dir):
    """The weights of one period by the number of parts that fall on each square column of it."""
    on = table(spark, sf_dir, "part").groupBy(F.pmod("p_partkey", F.lit(X.PERIOD["square"])).cast("int").alias("sq")).agg(F.count("*").alias("parts"))
    both = [X.periodic_weights(spark, s).join(on, "sq").select(F.lit(s).alias("shape"), "sq", "other", "parts", F.round("area", 6).alias("area")) for s in X.SHAPES]
    return both[0].unionByName(both[1])


_PARTS = "SELECT p_partkey % 1351 AS sq, count(*) AS parts FROM part GROUP BY ALL"
X0P = " UNION ALL ".join(f"SELECT '{s}' AS shape, sq::int AS sq, other, parts, round(area, 6) AS area FROM ({_weights(f'SELECT sq FROM ({_PARTS})', s).replace(' WHERE other >= 0', '')}) JOIN ({_PARTS}) USING (sq) WHERE area > 1e-12" for s in X.SHAPES)


TRI_WIDE = math.ceil(W / X.SHAPES["tri"]["pitch"])
TRI_HEXES = math.ceil(TRI_WIDE / 9)


def _district_colours(spark, sf_dir, inverted=False):
    """Square pixels to triangles to districts, and the rows of hexes."""
    image, height = _full(spark, sf_dir)
    rows = math.ceil(height / 6)
    hexes = spark.range(TRI_HEXES * rows).selectExpr(f"CAST(id % {TRI_HEXES} AS INT) AS hx", f"CAST(id div {TRI_HEXES} AS INT) AS hy")
    return X.tri_to_district(X.square_to_shape(image, "tri", height, W), hexes, "9", height, TRI_WIDE, inverted), rows


def x5_raster_to_districts(spark, sf_dir):
    out, _ = _district_colours(spark, sf_dir)
    return out.select("hx", "hy", "district", *[F.round(b, 5).alias(b) for b in X.BANDS])


def x5_district_polygons(spark, sf_dir):
    """The districts' colours on their polygons, as whole pixels."""
    colours, rows = _district_colours(spark, sf_dir, inverted=True)
    out = M.colour_polygons(colours, TRI_HEXES, rows, 9.0)
    corners = [(F.round(F.col("polygon")[k][i], 4) + F.lit(0.0)).alias(f"{c}{k}") for k in range(4) for i, c in enumerate("xy")]
    return out.select("hx", "hy", "district", *[F.round(b, 5).alias(b) for b in X.BANDS], *corners)


def g8_roundtrip_error(spark, sf_dir):
    image, height = _full(spark, sf_dir)
    out = X.roundtrip_error(image, height, W)
    return out.select("n", *[F.round(c, 5).alias(c) for c in out.columns if c != "n"])


def _district_query(layout):
    def query(spark, sf_dir):
        image, height = _full(spark, sf_dir)
        step = 9 if layout == "9" else 6
        hexes = image.select(F.expr(f"CAST(col div {step} AS INT)").alias("hx"), F.expr("CAST(row div 6 AS INT)").alias("hy")).distinct()
        out = X.tri_to_district(image, hexes, layout, height, W)
        return out.select("hx", "hy", "district", *[F.round(b, 6).alias(b) for b in X.BANDS])

    return query


def _offsets(layout: str) -> str:
    return ", ".join(f"({d}, {k}, {x}, {y})" for d, ps in enumerate(X.NINE if layout == "9" else X.SIX) for k, (x, y) in enumerate(ps))


def _district_sql(layout: str, digits: int = 6, base: str = BASE, width: int = W, odd: str = "hx % 2") -> str:
    step = 9 if layout == "9" else 6
    ty = f"hy*6 + ({odd})*3 - 2" if layout == "9" else "hy*6"
    return base + f""", hexes AS (SELECT DISTINCT (c.k//{step})::int AS hx, ("row"//6)::int AS hy FROM img, range(0, {width}) c(k)), o(district, k, dx, dy) AS (VALUES {_offsets(layout)})
SELECT hx, hy, district::int AS district, round(sum(r)/3, {digits}) AS r, round(sum(g)/3, {digits}) AS g, round(sum(b)/3, {digits}) AS b FROM hexes, o, size, img
WHERE img.col = greatest(0, least({width - 1}, hx*{step} + dx)) AND img."row" = greatest(0, least(h - 1, {ty} + dy)) GROUP BY ALL"""


def g6_district_to_tri(spark, sf_dir):
    image, height = _full(spark, sf_dir)
    hexes = image.select(F.expr("CAST(col div 9 AS INT)").alias("hx"), F.expr("CAST(row div 6 AS INT)").alias("hy")).distinct()
    # A hex makes 54 rows, so the few bytes of hexes are dealt by the pixels they become.
    hexes = hexes.repartition(max(spark.sparkContext.defaultParallelism, -(-height * W // TASK_PIXELS)), "hx", "hy")
    colours = hexes.withColumn("district", F.explode(F.sequence(F.lit(0), F.lit(17)))).selectExpr("hx", "hy", "district", "(hx*7 + hy*13 + district) % 256 AS r", "(hx + hy*3 + district*11) % 256 AS g", "(hx*district + hy) % 256 AS b")
    return X.district_to_tri(colours, height, W)


G6 = BASE + f""", hexes AS (SELECT DISTINCT (col//9)::int AS hx, ("row"//6)::int AS hy FROM img), o(district, k, dx, dy) AS (VALUES {_offsets("9")}),
w AS (SELECT greatest(0, least(h - 1, hy*6 - (hx % 2)*3 + dy))::int AS "row", greatest(0, least({W - 1}, hx*9 + dx))::int AS col, hx, hy, district, k FROM hexes, o, size)
SELECT "row", col, ((hx*7 + hy*13 + district) % 256)::int AS r, ((hx + hy*3 + district*11) % 256)::int AS g, ((hx*district + hy) % 256)::int AS b FROM (SELECT *, row_number() OVER (PARTITION BY "row", col ORDER BY hy DESC, hx DESC, district DESC, k DESC) AS n FROM w) WHERE n = 1"""


def x6_despeckle(spark, sf_dir):
    image, _ = _full(spark, sf_dir)
    return X.despeckle(image)


def w2_split_area(spark, sf_dir):
    """Cuts of shapes of side 2 by supplier."""
    cuts = table(spark, sf_dir, "supplier").selectExpr("CAST(s_suppkey div 9 AS INT) AS grp", "element_at(array('square', 'triangle', 'half_hex'), CAST(s_suppkey % 3 AS INT) + 1) AS shape", "((s_suppkey*7919) % 1000)/1000.0D*4.2D AS x")
    return X.split_area(cuts, ["grp", "shape"], side=2.0).select("grp", "shape", "place", F.round("share", 6).alias("share"), F.round("area", 6).alias("area"))


_R3 = num(3**0.5)
W2 = f"""WITH c AS (SELECT (s_suppkey // 9)::int AS grp, ['square', 'triangle', 'half_hex'][(s_suppkey % 3) + 1] AS shape, ((s_suppkey*7919) % 1000)/1000.0::double*4.2::double/2.0::double AS x FROM supplier),
l AS (SELECT *, CASE shape WHEN 'square' THEN least(1, greatest(0, x)) WHEN 'triangle' THEN CASE WHEN x <= 0 THEN 0 WHEN x <= 0.5 THEN 2*x*x WHEN x < 1 THEN 1 - 2*(1-x)*(1-x) ELSE 1 END
  ELSE CASE WHEN x <= 0 THEN 0 WHEN x <= 0.5 THEN x*x*{_R3}/2/(0.75*{_R3}) WHEN x <= 1.5 THEN ({_R3}/8 + (x-0.5)*{_R3}/2)/(0.75*{_R3}) WHEN x < 2 THEN 1 - (2-x)*(2-x)*{_R3}/2/(0.75*{_R3}) ELSE 1 END END::double AS a FROM c)
SELECT grp, shape, place, round(share, 6) AS share, round(share * 4.0::double * CASE shape WHEN 'square' THEN 1.0::double WHEN 'triangle' THEN {_R3}/4 ELSE 0.75::double*{_R3} END, 6) AS area FROM
(SELECT grp, shape, row_number() OVER w::int AS place, a - coalesce(lag(a) OVER w, 0) AS share FROM l WINDOW w AS (PARTITION BY grp, shape ORDER BY x) UNION ALL SELECT grp, shape, (count(*) + 1)::int, 1 - max(a) FROM l GROUP BY grp, shape)"""

_TRI = _HEIGHT + f"({_to_shape_sql('tri', 12)})"
X5 = _district_sql("9", 5, _TRI, TRI_WIDE)


def _x5_polygons() -> str:
    """Corners of a half-hexagon of unit 9, turned, moved and placed, from the figures of NINE_OFFSETS."""
    a, h = num(9.0), num(9.0 * math.sqrt(3.0) / 2)
    rows = ", ".join(f"({d}, {x}::double, {y}::double, {t})" for d, (x, y, t) in enumerate(M.NINE_OFFSETS))
    c, s = "cos(radians(60.0::double*t))", "sin(radians(60.0::double*t))"
    ox = f"ceil({TRI_HEXES}*4.5::double*{a})/2 + (hx - {TRI_HEXES // 4 * 2})*4.5::double*{a}"
    oy = f"ceil(n*6*{h})/2 + ((hy - n//2)*6 - (hx % 2)*3)*{h}"
    at = lambda x, y: (f"({x}*{a}*{c} - {y}*{h}*{s} + dx*{a} + {ox})", f"({x}*{a}*{s} + {y}*{h}*{c} + dy*{h} + {oy})")
    corners = ", ".join(f"round({v}, 4) + 0.0::double AS {n}{k}" for k, (x, y) in enumerate(((1, 0), (0.5, 1), (-0.5, 1), (-1, 0))) for n, v in zip("xy", at(f"{x}::double", f"{y}::double"), strict=True))
    colours = _district_sql("9", 5, _TRI, TRI_WIDE, "1 - hx % 2")
    return f"SELECT hx, hy, district, r, g, b, {corners} FROM ({colours}), (SELECT (greatest(1, (count(*) + {W - 1}) // {W}) + 5) // 6 AS n FROM orders), (VALUES {rows}) o(d, dx, dy, t) WHERE d = district"


_BACK = _to_square_sql("hex", 12, _HEIGHT + f"({_to_shape_sql('hex', 12)})", int(-(-W // X.SHAPES["hex"]["pitch"])))
G8 = BASE + f', back AS ({_BACK}) SELECT count(*) AS n, ' + ", ".join(f"round(avg(abs(i.{b} - k.{b})), 5) AS avg_{b}, round(max(abs(i.{b} - k.{b})), 5) AS max_{b}" for b in "rgb") + ' FROM img i JOIN back k USING ("row", col)'

QUERIES = {f.__name__: f for f in (s7_checker, s3_mosaic, p3_crop_flip_resize, p5_brightness, p6_bounded_lookup, p7_graticule, j2_sample_raster, j3_resample_window, j2_sample_tiles, j3_resample_tiles, x0_check_weights, x0_stored_weights, x5_raster_to_districts, x5_district_polygons, g8_roundtrip_error, g6_district_to_tri, x6_despeckle, w2_split_area)} | {
    "x0_weights_hex": _weights_query("hex"), "x0_weights_tri": _weights_query("tri"), **{n: _periodic(*k) for n, k in PERIODIC.items()}, "x0_periodic_weights": x0_periodic_weights, "x1_square_to_hex": _to_shape("hex"), "x2_hex_to_square": _to_square("hex"), "x3_square_to_tri": _to_shape("tri"), "x4_tri_to_square": _to_square("tri"),
    "g5_tri_to_district": _district_query("9"), "g5_tri_to_district_small": _district_query("6"),
}
ORACLE_SQL = {
    "s7_checker": S7, "s3_mosaic": S3, "p3_crop_flip_resize": P3, "p5_brightness": P5, "p6_bounded_lookup": P6, "j2_sample_raster": J2, "j3_resample_window": J3, "j2_sample_tiles": J2, "j3_resample_tiles": J3, "g6_district_to_tri": G6, "w2_split_area": W2, "x0_check_weights": _x0_check(), "x0_stored_weights": X0S, "p7_graticule": P7, "x5_raster_to_districts": X5, "x5_district_polygons": _x5_polygons(), "g8_roundtrip_error": G8,
    **{f"x0_weights_{s}": f"SELECT * FROM (SELECT sq, other, round(area, 6) AS area FROM ({_weights('SELECT p_partkey AS sq FROM part', s)}) WHERE area > 1e-12) WHERE area > 0" for s in ("hex", "tri")},
    **{n: _periodic_sql(*k) for n, k in PERIODIC.items()}, "x0_periodic_weights": X0P, "x1_square_to_hex": _to_shape_sql("hex"), "x2_hex_to_square": _to_square_sql("hex"), "x3_square_to_tri": _to_shape_sql("tri"), "x4_tri_to_square": _to_square_sql("tri"),
    "g5_tri_to_district": _district_sql("9"), "g5_tri_to_district_small": _district_sql("6"),
}
