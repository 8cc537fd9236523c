"""Queries over cells and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ninefold.functions import rules as R
from ninefold.operators import addressing as A
from ninefold.operators import cells as C
from ninefold.operators import globe as G
from ninefold.operators import sketches as K

from .sql import DIRECTIONS_SQL, centre_sql, directions, shared_folder, global_sql, num, places, places_sql, planar, planar_sql, walk_sql

LEVEL = 4
EARTH_EIGHTH = 510_065_621.724 / 8  # km², an octant
THIRD = num(R.H / 3)
SCOPE = f"(y > -{THIRD} AND y <= 2.0::double*{THIRD} - abs({num(R.R3)}*x))"


def _cells(spark: SparkSession, sf_dir: str, level: int = LEVEL, name: str = "lineitem", extra: tuple[str, ...] = ()) -> DataFrame:
    return A.assign_cells(planar(spark, sf_dir, name, extra), level)


def _walk(level: int = LEVEL, name: str = "lineitem", extra: tuple[str, ...] = ()) -> str:
    return walk_sql(planar_sql(name, extra), level, extra)


def g1_cell_density(spark, sf_dir):
    accepted = C.split_scope(planar(spark, sf_dir, "lineitem")).filter("in_scope")
    return C.cell_density(A.assign_cells(accepted, LEVEL))


G1 = _walk() + f"SELECT digits, half, count(*) AS n FROM cells WHERE lvl = {LEVEL} GROUP BY ALL"


def g1_weighted_density(spark, sf_dir):
    return C.cell_density(_cells(spark, sf_dir, 6, "orders", ("o_totalprice",)), weight="o_totalprice")


G1W = _walk(6, "orders", ("o_totalprice",)) + "SELECT digits, half, count(*) AS n, sum(o_totalprice::decimal(18,2))::double AS weight FROM cells WHERE lvl = 6 GROUP BY ALL"


def p1_split_scope(spark, sf_dir):
    return C.split_scope(planar(spark, sf_dir, "lineitem", wide=3.0)).groupBy("in_scope").agg(F.count("*").alias("n"))


P1 = f"SELECT {SCOPE} AS in_scope, count(*) AS n FROM ({planar_sql('lineitem', wide=3.0)}) GROUP BY ALL"


def p1_split_scope_down(spark, sf_dir):
    """The same points against the triangle that points down."""
    return C.split_scope(planar(spark, sf_dir, "lineitem", wide=3.0), "V").groupBy("in_scope").agg(F.count("*").alias("n"))


P1V = f"SELECT y <= {THIRD} AND y > -2.0::double*{THIRD} + abs({num(R.R3)}*x) AS in_scope, count(*) AS n FROM ({planar_sql('lineitem', wide=3.0)}) GROUP BY ALL"


def a1_assign_cells(spark, sf_dir):
    cells = A.assign_cells(planar(spark, sf_dir, "orders", ("o_orderkey",)), 12)
    return cells.select("o_orderkey", "digits", "half", "path")


A1 = _walk(12, "orders", ("o_orderkey",)) + "SELECT o_orderkey, digits, half, path FROM cells WHERE lvl = 12"


def a1_assign_cells_columns(spark, sf_dir):
    cells = A.assign_cells_columns(planar(spark, sf_dir, "orders", ("o_orderkey",)), 5)
    return cells.select("o_orderkey", "digits", "half", "path")


A1C = _walk(5, "orders", ("o_orderkey",)) + "SELECT o_orderkey, digits, half, path FROM cells WHERE lvl = 5"


def a2_assign_global(spark, sf_dir):
    return G.assign_global(directions(spark, sf_dir), 8).select("vec_id", "root", "digits", "half", "path")


A2 = global_sql(level=8) + "SELECT vec_id, root, digits, half, path FROM globe WHERE lvl = 8"


def a3_cell_centroids(spark, sf_dir):
    cells = A.cell_centroids(_cells(spark, sf_dir, 6, "orders").select("digits", "half").distinct())
    return cells.select("digits", "half", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


_CX, _CY = centre_sql()
A3 = _walk(6, "orders") + f"SELECT digits, half, round(any_value({_CX}), 6) AS cx, round(any_value({_CY}), 6) AS cy FROM cells WHERE lvl = 6 GROUP BY ALL"


def a4_unravel(spark, sf_dir):
    cells = _cells(spark, sf_dir, 7, "orders").select("digits", "half").distinct()
    return A.unravel(cells).groupBy("level", "digit", "level_half").agg(F.count("*").alias("n"))


A4 = _walk(7, "orders") + """, once AS (SELECT DISTINCT path FROM cells WHERE lvl = 7)
SELECT k::int AS level, substring(path, (2*k-1)::int, 1) AS digit, substring(path, (2*k)::int, 1) AS level_half, count(*) AS n FROM once, range(1, 8) r(k) GROUP BY ALL"""


def a4_ravel(spark, sf_dir):
    cells = _cells(spark, sf_dir, 7, "orders").select("path", "digits", "half").distinct()
    return A.ravel(A.unravel(cells), ["path"]).select("path", "raveled", "raveled_half")


A4R = _walk(7, "orders") + "SELECT DISTINCT path, digits AS raveled, half AS raveled_half FROM cells WHERE lvl = 7"


def a7_children(spark, sf_dir):
    """Children of the occupied half-hexagons, and how many points each has."""
    points = _cells(spark, sf_dir, 5, "lineitem").select(C.prefix(4).alias("path"), F.col("path").alias("child_path"))
    kids = A.children(points.select("path").distinct()).select("path", "child_path")
    held = points.groupBy("child_path").agg(F.count("*").alias("n"))
    return kids.join(held, "child_path", "left").groupBy("path").agg(F.count("*").alias("children"), F.count("n").alias("occupied"), F.sum(F.coalesce("n", F.lit(0))).alias("n"))


A7 = _walk(5) + "SELECT left(path, 8) AS path, 9::bigint AS children, count(DISTINCT path) AS occupied, count(*) AS n FROM cells WHERE lvl = 5 GROUP BY ALL"


def a7_hexagon_children(spark, sf_dir):
    """Of each occupied hexagon: half-hexagons below it, the hexagons that these belong to, those that it
    owns, and the points in it."""
    points = _cells(spark, sf_dir, 4, "lineitem").select("digits", "half", C.prefix(3).alias("above"))
    held = points.groupBy("digits", "half").agg(F.count("*").alias("n"))
    parents = points.select(F.expr("substring(digits, 1, 3)").alias("digits"), F.expr("right(above, 1)").alias("half"))
    kids = A.hexagon_children(parents).join(held, ["digits", "half"], "left")
    return kids.groupBy("hexagon").agg(F.count("*").alias("halves"), F.count_distinct("canonical").alias("hexagons"), F.count_distinct(F.when(F.col("owned"), F.col("canonical"))).alias("owned"), F.sum(F.coalesce("n", F.lit(0))).alias("n"))


def _hexagons_sql(points: str, level: int, tag: str) -> str:
    """Cells that points hit: path, own (digits and half) and hexagon, by mirroring their centre."""
    mx, my = centre_sql(mate=True)
    once = walk_sql(points, level, tag=tag) + f"SELECT digits AS d0, half AS h0, path AS p0, any_value({mx}) AS mx0, any_value({my}) AS my0 FROM cells{tag} WHERE lvl = {level} GROUP BY ALL"
    mirrored = walk_sql(f"SELECT *, mx0 AS x, my0 AS y, '021' AS c2 FROM ({once})", level, ("d0", "h0", "p0", "mx0", "my0"), tag=f"{tag}m")
    return f"({mirrored}SELECT p0 AS path, d0 || h0 AS own, CASE WHEN h0 = 'V' OR NOT {SCOPE.replace('y ', 'my0 ').replace('*x', '*mx0')} THEN d0 || h0 ELSE digits || half END AS hexagon FROM cells{tag}m WHERE lvl = {level})"


# All cells of the triangle, from a lattice of points so fine that each cell holds some.
_LATTICE = f"SELECT x, y, '021' AS c2 FROM (SELECT (i + 0.37::double)/300.0::double*{num(R.W)} - {num(R.W / 2)} AS x, (j + 0.41::double)/300.0::double*{num(R.H)} - {num(R.H / 3)} AS y FROM range(300) a(i), range(300) b(j)) WHERE {SCOPE}"
A7H = f"""WITH pts AS ({planar_sql('lineitem')}), own3 AS {_hexagons_sql(_LATTICE, 3, 'a')}, own4 AS {_hexagons_sql(_LATTICE, 4, 'b')},
held AS ({_walk(4)}SELECT path, count(*) AS n FROM cells WHERE lvl = 4 GROUP BY ALL), occupied AS (SELECT DISTINCT hexagon FROM held JOIN own3 ON own3.path = left(held.path, 6)),
kids AS (SELECT p.hexagon, k.own, k.hexagon AS canonical, coalesce(n, 0) AS n FROM occupied JOIN own3 p USING (hexagon) JOIN own4 k ON left(k.path, 6) = p.path LEFT JOIN held ON held.path = k.path)
SELECT hexagon, count(*) AS halves, count(DISTINCT canonical) AS hexagons, count(DISTINCT CASE WHEN own = canonical THEN canonical END) AS owned, sum(n)::bigint AS n FROM kids GROUP BY ALL"""


def a8_density_per_area(spark, sf_dir):
    found = G.assign_global(directions(spark, sf_dir), 3)
    rolled = C.cell_rollup(found, [1, 2, 3], root=True)
    out = C.density_per_area(rolled.filter("level > 0"), EARTH_EIGHTH)
    return out.select("level", "cell", "n", F.round("area", 4).alias("area"), F.round("per_area", 9).alias("per_area"))


A8 = global_sql(level=3) + f"SELECT level, cell, n, round(area, 4) AS area, round(n/area, 9) AS per_area FROM (SELECT lvl AS level, path AS cell, count(*) AS n, any_value({num(EARTH_EIGHTH / 3)}/pow(9.0::double, lvl-1)) AS area FROM globe GROUP BY lvl, path)"


def g2_cell_rollup(spark, sf_dir):
    return C.cell_rollup(_cells(spark, sf_dir, LEVEL), [1, 2, 3, 4])


G2 = _walk() + "SELECT lvl AS level, path AS cell, count(*) AS n FROM cells GROUP BY ALL UNION ALL SELECT 0, '', count(*) FROM lineitem HAVING count(*) > 0"


def g3_cell_cube(spark, sf_dir):
    return C.cell_cube(_cells(spark, sf_dir, 3, "lineitem", ("l_returnflag",)), 3, "l_returnflag")


G3 = _walk(3, "lineitem", ("l_returnflag",)) + "SELECT path AS cell, l_returnflag AS category, count(*) AS n FROM cells WHERE lvl = 3 GROUP BY CUBE (path, l_returnflag)"


def g9_quantisation_error(spark, sf_dir):
    out = C.quantisation_error(planar(spark, sf_dir, "orders"), [2, 4, 6])
    return out.select("level", "n", F.round("max_error", 6).alias("max_error"), F.round("avg_error", 6).alias("avg_error"))


_POINT = planar_sql("orders", ("o_orderkey",))
G9 = walk_sql(f"SELECT *, x AS px, y AS py FROM ({_POINT})", 6, ("px", "py")) + f"SELECT lvl AS level, count(*) AS n, round(max(d), 6) AS max_error, round(avg(d), 6) AS avg_error FROM (SELECT lvl, sqrt(pow(px - {_CX}, 2) + pow(py - {_CY}, 2)) AS d FROM cells WHERE lvl IN (2, 4, 6)) GROUP BY ALL"


def g10_distinct_cells(spark, sf_dir):
    return C.distinct_cells(_cells(spark, sf_dir, 6), [1, 2, 3, 4, 5, 6])


G10 = _walk(6) + "SELECT lvl AS level, count(DISTINCT path) AS cells FROM cells GROUP BY ALL"


def g10_distinct_cells_approx(spark, sf_dir):
    """Exact numbers of cells, and whether the approximate ones are within three standard errors (15 %)."""
    cells = _cells(spark, sf_dir, 6)
    rough = C.distinct_cells(cells, [2, 4, 6], approximate=True).withColumnRenamed("cells", "rough")
    both = C.distinct_cells(cells, [2, 4, 6]).join(rough, "level")
    return both.select("level", "cells", (F.abs(F.col("rough") - F.col("cells")) <= 0.15 * F.col("cells")).alias("within_bounds"))


G10A = _walk(6) + "SELECT lvl AS level, count(DISTINCT path) AS cells, true AS within_bounds FROM cells WHERE lvl IN (2, 4, 6) GROUP BY ALL"


def w1_adaptive_level(spark, sf_dir):
    return C.adaptive_level(_cells(spark, sf_dir, 9, "orders", ("o_orderkey",)), "o_orderkey", 9)


W1 = _walk(9, "orders", ("o_orderkey",)) + """, counted AS (SELECT lvl, path, count(*) AS n, min(o_orderkey) AS o_orderkey FROM cells GROUP BY ALL)
SELECT o.o_orderkey, level FROM orders o LEFT JOIN (SELECT o_orderkey, min(lvl) AS level FROM counted WHERE n = 1 GROUP BY ALL) USING (o_orderkey)"""


SKETCHED = [1, 2, 3, 4]


def g10_sketched_cells(spark, sf_dir):
    """Customers and prices of the orders by cell of four levels, from one pass: exact numbers, and whether
    the merged sketches keep to their bounds (five and three standard errors)."""
    cells = _cells(spark, sf_dir, 4, "orders", ("o_custkey", "o_totalprice")).select("path", "o_custkey", "o_totalprice")
    path = f"{shared_folder(spark)}/sketches-{uuid.uuid4().hex}"
    K.sketch_cells(cells, 4, "o_custkey", "o_totalprice").write.parquet(path)
    found = K.estimates(K.merge_up(spark.read.parquet(path), 4, SKETCHED), [0.25, 0.5, 0.9])
    firsts = K.first_levels(cells, "o_custkey", 4)
    each = firsts.select(F.explode(F.array(*map(F.lit, SKETCHED))).alias("level"), "path", "first_level", "o_totalprice").withColumn("cell", F.expr("substring(path, 1, 2 * level)"))
    exact = each.join(found, ["level", "cell"])
    below = [F.avg((F.col("o_totalprice") <= F.col("quantiles")[k]).cast("double")) for k in range(3)]
    rows = exact.groupBy("level", "cell").agg(F.count("*").alias("n"), F.count_if(F.col("first_level") <= F.col("level")).alias("customers"), F.first("n").alias("n_"), F.first("distinct").alias("distinct"), F.greatest(*[F.abs(b - q) for b, q in zip(below, (0.25, 0.5, 0.9), strict=True)]).alias("off"))
    close = (F.col("n") == F.col("n_")) & (F.abs(F.col("distinct") - F.col("customers")) <= 0.08 * F.col("customers")) & (F.col("off") <= 0.04 + 1 / F.col("n"))
    return rows.select("level", "cell", "n", "customers", close.alias("within_bounds"))


G10K = _walk(4, "orders", ("o_custkey",)) + "SELECT lvl AS level, path AS cell, count(*) AS n, count(DISTINCT o_custkey) AS customers, true AS within_bounds FROM cells GROUP BY ALL"


# Each order's point and a neighbour of it, at a distance of which four sizes occur, down to 1e-12; some
# neighbours stand in the same place.
_NEAR = "CASE o_orderkey % 5 WHEN 0 THEN 0.001{d} WHEN 1 THEN 1e-6{d} WHEN 2 THEN 1e-9{d} WHEN 3 THEN 1e-12{d} ELSE 0.0{d} END"


def w1_refined_level(spark, sf_dir):
    """The level at which each point and planted neighbour is alone, down to level 30."""
    own = planar(spark, sf_dir, "orders", ("o_orderkey",))
    near = own.selectExpr("2*o_orderkey + 1 AS id", f"x + {_NEAR.format(d='D')} AS x", "y", "c2")
    points = own.selectExpr("2*o_orderkey AS id", "x", "y", "c2").unionByName(near)
    return C.refined_level(points, "id", A.assign_cells)


_PLANTED = planar_sql("orders", ("o_orderkey",))
W1R = walk_sql(f"SELECT 2*o_orderkey AS id, x, y, c2 FROM ({_PLANTED}) UNION ALL SELECT 2*o_orderkey + 1, x + {_NEAR.format(d='::double')}, y, c2 FROM ({_PLANTED})", 30, ("id",)) + """, counted AS (SELECT lvl, path, count(*) AS n, min(id) AS id FROM cells GROUP BY ALL)
SELECT p.id, level FROM (SELECT 2*o_orderkey AS id FROM orders UNION ALL SELECT 2*o_orderkey + 1 FROM orders) p LEFT JOIN (SELECT id, min(lvl) AS level FROM counted WHERE n = 1 GROUP BY ALL) USING (id)"""


def w1_global_refined(spark, sf_dir):
    """Levels at which directions are alone on the sphere, in steps of five."""
    return C.refined_level(directions(spark, sf_dir).select("vec_id", "x", "y", "z"), "vec_id", G.assign_global, 5, 12, root=True)


W1GR = global_sql(level=12) + f""", counted AS (SELECT lvl, path, count(*) AS n, min(vec_id) AS vec_id FROM globe GROUP BY ALL)
SELECT d.vec_id, level FROM ({DIRECTIONS_SQL}) d LEFT JOIN (SELECT vec_id, min(lvl) AS level FROM counted WHERE n = 1 GROUP BY ALL) USING (vec_id)"""


def w5_top_cells(spark, sf_dir):
    density = C.cell_density(G.assign_global(directions(spark, sf_dir), 3), ["root", "path"])
    return C.top_cells(density, 3, "root", "path")


W5 = global_sql(level=3) + "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY n DESC, path)::int AS place FROM (SELECT root, path, count(*) AS n FROM globe WHERE lvl = 3 GROUP BY ALL)) WHERE place <= 3"


def j4_colocate(spark, sf_dir):
    cells = lambda name, key: A.assign_cells(planar(spark, sf_dir, name, (key,)), 6, only=(key, "path"))
    return C.colocate(cells("orders", "o_orderkey"), cells("events", "event_id"), 6)


J4 = _walk(6, "orders", ("o_orderkey",)) + ", b AS (" + walk_sql(planar_sql("events", ("event_id",)), 6, ("event_id",), tag="2") + "SELECT * FROM cells2 WHERE lvl = 6) SELECT c.o_orderkey, b.event_id, c.path AS cell FROM cells c JOIN b USING (path) WHERE c.lvl = 6"


def j6_canonical_cells(spark, sf_dir):
    cells = _cells(spark, sf_dir, 4, "lineitem").select("digits", "half", "path")
    return A.canonical_cells(cells).groupBy("canonical").agg(F.count("*").alias("n"))


_MX, _MY = centre_sql(mate=True)
_ONCE = _walk(4) + f"SELECT digits AS d0, half AS h0, count(*) AS n0, any_value({_MX}) AS x, any_value({_MY}) AS y, '021' AS c2 FROM cells WHERE lvl = 4 GROUP BY ALL"
J6 = walk_sql(_ONCE, 4, ("d0", "h0", "n0", "mx0", "my0"), tag="2").replace(f"pts2 AS ({_ONCE})", f"pts2 AS (SELECT *, x AS mx0, y AS my0 FROM ({_ONCE}))") + f"""SELECT CASE WHEN h0 = 'V' OR NOT {SCOPE.replace('y ', 'my0 ').replace('*x', '*mx0')} THEN d0 || h0 ELSE digits || half END AS canonical, sum(n0)::bigint AS n FROM cells2 WHERE lvl = 4 GROUP BY ALL"""


def p8_cells_in(spark, sf_dir):
    cells = _cells(spark, sf_dir, 6, "lineitem", ("l_extendedprice",))
    return C.cells_in(cells, "5Λ2Λ").groupBy("path").agg(F.count("*").alias("n"))


P8 = _walk(6) + "SELECT path, count(*) AS n FROM cells WHERE lvl = 6 AND starts_with(path, '5Λ2Λ') GROUP BY ALL"


def s9_cell_store(spark, sf_dir):
    """Cells written by ancestor and read back for one of them."""
    path = f"{shared_folder(spark)}/cells-{uuid.uuid4().hex}"
    C.write_cells(_cells(spark, sf_dir, 6, "lineitem").select("path"), path, 1)
    return C.read_cells(spark, path, "5Λ2Λ", 1).groupBy("path").agg(F.count("*").alias("n"))


S9 = P8


def s9_cell_upsert(spark, sf_dir):
    """Counts of line items by cell, of which those of the orders take the place where both are."""
    path = f"{shared_folder(spark)}/cells-{uuid.uuid4().hex}"
    counts = lambda name: _cells(spark, sf_dir, 5, name).groupBy("path").agg(F.count("*").alias("n"))
    C.write_cells(counts("lineitem"), path, 2)
    C.upsert_cells(counts("orders").filter(F.col("path").startswith("5Λ")), path, 2)
    return spark.read.parquet(path).select("path", "n")


S9U = _walk(5) + ", b AS (" + walk_sql(planar_sql("orders"), 5, tag="2") + """SELECT path, count(*) AS n FROM cells2 WHERE lvl = 5 AND starts_with(path, '5Λ') GROUP BY ALL), a AS (SELECT path, count(*) AS n FROM cells WHERE lvl = 5 GROUP BY ALL)
SELECT coalesce(a.path, b.path) AS path, coalesce(b.n, a.n) AS n FROM a FULL JOIN b ON a.path = b.path"""



def u1_overlay_levels(spark, sf_dir):
    return C.overlay_levels(_cells(spark, sf_dir, 4), [1, 2, 3, 4])


U1 = _walk() + "SELECT DISTINCT lvl AS level, path AS cell FROM cells"


def u2_changed_cells(spark, sf_dir):
    return C.changed_cells(_cells(spark, sf_dir, 5, "orders"), _cells(spark, sf_dir, 5, "events"), 5)


U2 = _walk(5, "orders") + ", b AS (" + walk_sql(planar_sql("events"), 5, tag="2") + """SELECT DISTINCT path FROM cells2 WHERE lvl = 5), a AS (SELECT DISTINCT path FROM cells WHERE lvl = 5)
SELECT coalesce(a.path, b.path) AS cell, CASE WHEN b.path IS NULL THEN 'left' WHEN a.path IS NULL THEN 'right' ELSE 'both' END AS side FROM a FULL JOIN b ON a.path = b.path"""


def a2_assign_places(spark, sf_dir):
    """Customers by root hexagon of their place."""
    return G.assign_places(places(spark, sf_dir), 2).groupBy("root").agg(F.count("*").alias("n"))


_XYZ = "cos(radians(lat))*cos(radians(lon)) AS x, cos(radians(lat))*sin(radians(lon)) AS y, sin(radians(lat)) AS z"
A2P = global_sql(f"SELECT c_custkey, {_XYZ} FROM ({places_sql(extra=('c_custkey',))})", 2, ("c_custkey",)) + "SELECT root, count(*) AS n FROM globe WHERE lvl = 2 GROUP BY ALL"

# -- cells on the sphere -------------------------------------------------------------------------------

def _globe(spark, sf_dir, level):
    return G.assign_global(directions(spark, sf_dir), level)


def a3_global_centroids(spark, sf_dir):
    """Direction of the centre of each occupied cell."""
    cells = G.global_centroids(_globe(spark, sf_dir, 5).select("digits", "half").distinct())
    return cells.select("digits", "half", *[F.round(c, 6).alias(c) for c in ("cx", "cy", "cz")])


def _axis(plus: str, minus: str) -> str:
    sign = f"CASE WHEN contains(root, '{plus}') THEN 1 WHEN contains(root, '{minus}') THEN -1 WHEN up = (length(translate(root, 'PEN', '')) % 2 = 0) THEN -1 ELSE 1 END"
    return f"({sign}) * (CASE WHEN left(root, 1) IN ('{plus}', '{minus}') THEN (1 - abs(c) + ab)/2 WHEN right(root, 1) IN ('{plus}', '{minus}') THEN (1 - abs(c) - ab)/2 ELSE c END)"


_FRAME = f"SELECT root || substring(digits, 2) AS digits, half, root, substring(path, 2, 1) = 'Λ' AS up, 2*{_CX}/{num(R.W)} AS ab, (CASE WHEN substring(path, 2, 1) = 'Λ' THEN 1 ELSE -1 END)*{_CY}/{num(R.H)} + 1.0::double/3 AS c FROM cells WHERE lvl = 5"
_SHARES = f"SELECT digits, half, {_axis('P', 'A')} AS x, {_axis('E', 'W')} AS y, {_axis('N', 'S')} AS z FROM ({_FRAME})"
A3G = global_sql(level=5) + "SELECT digits, half, " + ", ".join(f"round(any_value({v}/sqrt(x*x + y*y + z*z)), 6) AS c{v}" for v in "xyz") + f" FROM ({_SHARES}) GROUP BY digits, half"


def a4_global_unravel(spark, sf_dir):
    """Digits and halves by level, where the root stands for the first digit."""
    cells = _globe(spark, sf_dir, 6).select("digits", "half").distinct()
    return A.unravel(cells, root=True).groupBy("level", "digit", "level_half").agg(F.count("*").alias("n"))


A4G = global_sql(level=6) + """, once AS (SELECT DISTINCT path FROM globe WHERE lvl = 6)
SELECT k::int AS level, CASE WHEN k = 1 THEN left(path, 2) ELSE substring(path, (2*k)::int, 1) END AS digit, substring(path, (2*k+1)::int, 1) AS level_half, count(*) AS n FROM once, range(1, 7) r(k) GROUP BY ALL"""


def w1_global(spark, sf_dir):
    return C.adaptive_level(_globe(spark, sf_dir, 8), "vec_id", 8, root=True)


W1G = global_sql(level=8) + f""", counted AS (SELECT lvl, path, count(*) AS n, min(vec_id) AS vec_id FROM globe GROUP BY ALL)
SELECT d.vec_id, level FROM ({DIRECTIONS_SQL}) d LEFT JOIN (SELECT vec_id, min(lvl) AS level FROM counted WHERE n = 1 GROUP BY ALL) USING (vec_id)"""


def g3_global(spark, sf_dir):
    return C.cell_cube(_globe(spark, sf_dir, 2), 2, "label", root=True)


G3G = global_sql(level=2) + "SELECT path AS cell, label AS category, count(*) AS n FROM globe WHERE lvl = 2 GROUP BY CUBE (path, label)"


def g10_global(spark, sf_dir):
    return C.distinct_cells(_globe(spark, sf_dir, 6), [1, 2, 3, 4, 5, 6], root=True)


G10G = global_sql(level=6) + "SELECT lvl AS level, count(DISTINCT path) AS cells FROM globe GROUP BY ALL"


def j6_global(spark, sf_dir):
    """Points by hexagon; its halves may lie in two octants."""
    named = G.global_canonical(_globe(spark, sf_dir, 4).select("digits", "half"), 4)
    return named.groupBy("canonical").agg(F.count("*").alias("n"))


def _global_hexagons_sql(points: str, level: int, keep: tuple[str, ...] = ("vec_id", "label")) -> str:
    """Cells on the sphere that points hit: path, own and hexagon, by mirroring their centre in the frame
    of their root; a mirror image beyond the octant's edge lies in the octant on the other side."""
    mx, my = centre_sql(mate=True)
    frame = global_sql(points, level, keep) + f"SELECT any_value(root) AS root, root || substring(digits, 2) AS d0, half AS h0, root || substring(path, 2) AS p0, any_value(substring(path, 2, 1) = 'Λ') AS up, any_value(2*{mx}/{num(R.W)}) AS ab, any_value((CASE WHEN substring(path, 2, 1) = 'Λ' THEN 1 ELSE -1 END)*{my}/{num(R.H)} + 1.0::double/3) AS c FROM cells WHERE lvl = {level} GROUP BY root, digits, half, path"
    images = f"SELECT d0, h0, p0, {_axis('P', 'A')} AS x, {_axis('E', 'W')} AS y, {_axis('N', 'S')} AS z FROM ({frame})"
    named = "CASE WHEN h0 = half THEN least(d0 || h0, digits || half) WHEN h0 = 'V' THEN d0 || h0 ELSE digits || half END"
    return f"({global_sql(images, level, ('d0', 'h0', 'p0'))}SELECT p0 AS path, d0 || h0 AS own, {named} AS hexagon FROM globe WHERE lvl = {level})"


J6G = f"WITH held AS ({global_sql(level=4)}SELECT digits || half AS own, count(*) AS n FROM globe WHERE lvl = 4 GROUP BY ALL) SELECT hexagon AS canonical, sum(n)::bigint AS n FROM held JOIN {_global_hexagons_sql(DIRECTIONS_SQL, 4)} USING (own) GROUP BY ALL"


def a7_global_hexagon_children(spark, sf_dir):
    """a7_hexagon_children on the sphere, where no hexagon lies on an edge."""
    held = _globe(spark, sf_dir, 4).groupBy("digits", "half").agg(F.count("*").alias("n"))
    kids = G.global_hexagon_children(_globe(spark, sf_dir, 3), 3).join(held, ["digits", "half"], "left")
    return kids.groupBy("hexagon").agg(F.count("*").alias("halves"), F.count_distinct("canonical").alias("hexagons"), F.count_distinct(F.when(F.col("owned"), F.col("canonical"))).alias("owned"), F.sum(F.coalesce("n", F.lit(0))).alias("n"))


_SPHERE = "SELECT a*sx AS x, b*sy AS y, (1 - a - b)*sz AS z FROM (SELECT (i + 0.37::double)/260.0::double AS a, (j + 0.41::double)/260.0::double AS b FROM range(260) p(i), range(260) q(j)), (VALUES (1), (-1)) u(sx), (VALUES (1), (-1)) v(sy), (VALUES (1), (-1)) w(sz) WHERE a + b < 1"
A7G = f"""WITH own3 AS {_global_hexagons_sql(_SPHERE, 3, ())}, own4 AS {_global_hexagons_sql(_SPHERE, 4, ())},
held AS ({global_sql(level=4)}SELECT path, count(*) AS n FROM globe WHERE lvl = 4 GROUP BY ALL), occupied AS (SELECT DISTINCT hexagon FROM held JOIN own3 ON own3.path = left(held.path, 7)),
kids AS (SELECT p.hexagon, k.own, k.hexagon AS canonical, coalesce(n, 0) AS n FROM occupied JOIN own3 p USING (hexagon) JOIN own4 k ON left(k.path, 7) = p.path LEFT JOIN held ON held.path = k.path)
SELECT hexagon, count(*) AS halves, count(DISTINCT canonical) AS hexagons, count(DISTINCT CASE WHEN own = canonical THEN canonical END) AS owned, sum(n)::bigint AS n FROM kids GROUP BY ALL"""


QUERIES = {f.__name__: f for f in (a3_global_centroids, a4_global_unravel, w1_global, g3_global, g10_global, j6_global, g1_cell_density, g1_weighted_density, p1_split_scope, p1_split_scope_down, a1_assign_cells, a1_assign_cells_columns, a2_assign_global, a2_assign_places, a3_cell_centroids, a4_unravel, a4_ravel, a7_children, a7_hexagon_children, a7_global_hexagon_children, a8_density_per_area, g2_cell_rollup, g3_cell_cube, g9_quantisation_error, g10_distinct_cells, g10_distinct_cells_approx, g10_sketched_cells, w1_adaptive_level, w1_refined_level, w1_global_refined, w5_top_cells, j4_colocate, j6_canonical_cells, p8_cells_in, s9_cell_store, s9_cell_upsert, u1_overlay_levels, u2_changed_cells)}
ORACLE_SQL = {
    "a3_global_centroids": A3G, "a4_global_unravel": A4G, "w1_global": W1G, "g3_global": G3G, "g10_global": G10G, "j6_global": J6G, "a7_global_hexagon_children": A7G,
    "g1_cell_density": G1, "g1_weighted_density": G1W, "p1_split_scope": P1, "p1_split_scope_down": P1V, "a1_assign_cells": A1, "a1_assign_cells_columns": A1C, "a2_assign_global": A2, "a2_assign_places": A2P,
    "a3_cell_centroids": A3, "a4_unravel": A4, "a4_ravel": A4R, "a7_children": A7, "a7_hexagon_children": A7H, "a8_density_per_area": A8, "g2_cell_rollup": G2, "g3_cell_cube": G3, "g9_quantisation_error": G9,
    "g10_distinct_cells": G10, "g10_sketched_cells": G10K, "g10_distinct_cells_approx": G10A, "w1_adaptive_level": W1, "w1_refined_level": W1R, "w1_global_refined": W1GR, "w5_top_cells": W5, "j4_colocate": J4, "j6_canonical_cells": J6, "p8_cells_in": P8, "s9_cell_store": S9, "s9_cell_upsert": S9U, "u1_overlay_levels": U1, "u2_changed_cells": U2,
}
