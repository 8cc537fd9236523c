"""Queries over points on the sphere, meshes and covers, and their SQL."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ninefold.functions.columns import latitude, longitude, unit_vector
from ninefold.operators import indexed_mesh as I
from ninefold.operators import mesh as M
from ninefold.operators import points as P
from ninefold.operators.spatial import nearest
from ninefold.operators.tiles import colour_mesh_tiles
from ninefold.sources import points as S
from ninefold.sources.maps import Maps, read_maps

from .raster_queries import _C, _H, BASE, EXTENT, TILE_SIDE, W, _full, tiled
from .sql import num, places, places_sql, shared_folder, table


def _shared(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


# -- points ------------------------------------------------------------------------------------------

def s1_read_points(spark, sf_dir):
    """Customers' points written as quoted CSV and read again; of a place that repeats the last row wins."""
    path = _shared(spark)
    rows = table(spark, sf_dir, "customer").orderBy("c_custkey").selectExpr("CAST((c_custkey*7919) % 61 - 30 AS DOUBLE) AS lat", "CAST((c_custkey*104729) % 71 - 35 AS DOUBLE) AS lon", "c_acctbal")
    rows.write.csv(path, quoteAll=True)
    return S.read_points(spark, path)


_S1 = "SELECT (c_custkey*7919 % 61 - 30)::double AS lat, (c_custkey*104729 % 71 - 35)::double AS lon, arg_max(c_acctbal, c_custkey) AS weight FROM customer GROUP BY ALL"


def s2_profile_points(spark, sf_dir):
    return S.profile_points(places(spark, sf_dir, extra=("c_acctbal AS weight",)))


S2 = "SELECT " + ", ".join(f"{f}({d}{c}) AS {n}_{c}" for c in ("lat", "lon", "weight") for n, f, d in (("distinct", "count", "DISTINCT "), ("min", "min", ""), ("max", "max", ""))) + f" FROM ({places_sql(extra=('c_acctbal AS weight',))})"


def s6_grid_to_points(spark, sf_dir):
    """A field of one value for each part, 36 columns of 10 degrees."""
    parts = table(spark, sf_dir, "part")
    n = -(-parts.count() // 36)
    field = parts.selectExpr("CAST(p_partkey div 36 AS INT) AS i", "CAST(p_partkey % 36 AS INT) AS j", "((p_partkey div 36)*37 + (p_partkey % 36)*101) % 1000 AS value")
    return S.grid_to_points(field, n, 36, 90.0, -1.0, 10.0, 0.5).select("i", "j", "lat", "lon", "value")


S6 = """WITH n AS (SELECT (count(*) + 35)//36 AS n FROM part), f AS (SELECT (n - 1 - p_partkey//36)::int AS i, (p_partkey%36)::int AS j, (((p_partkey//36)*37 + (p_partkey%36)*101) % 1000)*0.5::double AS value, n FROM part, n)
SELECT i, j, 90.0::double - (n-1-i) AS lat, ((j*10.0::double + 180) % 360) - 180 AS lon, value FROM (SELECT * FROM f UNION ALL SELECT i, 36, value, n FROM f WHERE j = 0)"""


def p2_rotate_points(spark, sf_dir):
    """Mean displacement of customers by nation."""
    moved = P.rotate_points(places(spark, sf_dir, extra=("c_nationkey",)), 20.0, -35.0, 60.0)
    return moved.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.round(F.avg("moved"), 6).alias("moved"))


# Turned about z, then y, then x, each by sine and cosine; the other query's matrix is not used.
_XYZ = "cos(radians(lat))*cos(radians(lon)) AS x, cos(radians(lat))*sin(radians(lon)) AS y, sin(radians(lat)) AS z"
_Z = f"SELECT *, x*cos(radians(60.0::double)) - y*sin(radians(60.0::double)) AS x1, x*sin(radians(60.0::double)) + y*cos(radians(60.0::double)) AS y1, z AS z1 FROM (SELECT c_nationkey, {_XYZ} FROM ({places_sql(extra=('c_nationkey',))}))"
_Y = f"SELECT *, x1*cos(radians(-35.0::double)) + z1*sin(radians(-35.0::double)) AS x2, y1 AS y2, z1*cos(radians(-35.0::double)) - x1*sin(radians(-35.0::double)) AS z2 FROM ({_Z})"
_X = f"SELECT *, x2 AS x3, y2*cos(radians(20.0::double)) - z2*sin(radians(20.0::double)) AS y3, y2*sin(radians(20.0::double)) + z2*cos(radians(20.0::double)) AS z3 FROM ({_Y})"
P2 = f"SELECT c_nationkey, count(*) AS n, round(avg(degrees(acos(greatest(-1.0::double, least(1.0::double, x*x3 + y*y3 + z*z3))))), 6) AS moved FROM ({_X}) GROUP BY ALL"


def _on_sphere(df: DataFrame) -> DataFrame:
    return df.select("*", *[c.alias(n) for n, c in zip("xyz", unit_vector(F.col("lat"), F.col("lon")), strict=True)])


def j1_nearest(spark, sf_dir):
    """The nearest three customers to each supplier."""
    queries = _on_sphere(places(spark, sf_dir, "supplier", "s_suppkey", ("s_suppkey AS query_id",)))
    points = _on_sphere(places(spark, sf_dir, extra=("c_custkey AS point_id",)))
    return nearest(queries, points, 3).select("query_id", "rank", F.round("dist", 6).alias("dist"))


def _nearest_sql(queries: str, points: str, k: int, digits: int, columns: str = "") -> str:
    return f"""WITH q AS (SELECT query_id, {_XYZ} FROM ({queries})), p AS (SELECT point_id, {_XYZ} FROM ({points}))
SELECT query_id, rank, {columns}round(d, {digits}) AS dist FROM (SELECT query_id, point_id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, point_id)::int AS rank FROM (SELECT query_id, point_id, sqrt(pow(q.x-p.x, 2) + pow(q.y-p.y, 2) + pow(q.z-p.z, 2)) AS d FROM q, p)) WHERE rank <= {k}"""


J1 = _nearest_sql(places_sql("supplier", "s_suppkey", ("s_suppkey AS query_id",)), places_sql(extra=("c_custkey AS point_id",)), 3, 6)

# Nine tenths of the customers, and of the suppliers, live in one city of some kilometres.
_CITY = {k: tuple(f"CASE WHEN {k} % 10 = 0 THEN ((({k}*{m}) % {n})/100.0{{d}}-{h}) ELSE {c}{{d}} + (({k}*{m}) % {r})/50000.0{{d}} END AS {name}" for name, m, n, h, c, r in (("lat", 7919, 18001, 90, "48.85", 1009), ("lon", 104729, 36000, 180, "2.35", 1013))) for k in ("c_custkey", "s_suppkey")}


def j1_nearest_city(spark, sf_dir):
    """The nearest five customers to each supplier where most of both live in one city; some share a place."""
    of = lambda name, key, alias: _on_sphere(table(spark, sf_dir, name).selectExpr(f"{key} AS {alias}", *[e.format(d="D") for e in _CITY[key]]))
    found = nearest(of("supplier", "s_suppkey", "query_id"), of("customer", "c_custkey", "point_id"), 5)
    return found.select("query_id", "rank", F.round("dist", 8).alias("dist"))


_of_sql = lambda name, key, alias: f"SELECT {key} AS {alias}, {', '.join(e.format(d='::double') for e in _CITY[key])} FROM {name}"
J1C = _nearest_sql(_of_sql("supplier", "s_suppkey", "query_id"), _of_sql("customer", "c_custkey", "point_id"), 5, 8)


def _pairs(spark, sf_dir):
    e = lambda k: f"CAST(embedding[{k}] AS DOUBLE)"
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id", *[f"{e(k)} AS u{c}" for k, c in enumerate("xyz")], f"{e(1)} + 0.01D*{e(3)} AS vx", f"{e(2)} + 0.01D*{e(4)} AS vy", f"{e(0)} + 0.01D*{e(5)} AS vz")


def g7_fit_rotation(spark, sf_dir):
    """A matrix fitted to directions and their noisy images."""
    out = P.fit_rotation(_pairs(spark, sf_dir))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


def g7_rotation_residuals(spark, sf_dir):
    """How far each image is from where the fitted matrix puts it."""
    pairs = _pairs(spark, sf_dir)
    out = P.rotation_residuals(pairs, P.fit_rotation(pairs))
    return out.select("vec_id", *[(F.round(c, 6) + 0.0).alias(c) for c in ("rx", "ry", "rz", "residual")])


def _g7(each: bool = False) -> str:
    e = lambda k: f"embedding[{k + 1}]::double"
    rows = f"SELECT vec_id, {', '.join(f'{e(k)} AS u{c}' for k, c in enumerate('xyz'))}, {e(1)} + 0.01::double*{e(3)} AS vx, {e(2)} + 0.01::double*{e(4)} AS vy, {e(0)} + 0.01::double*{e(5)} AS vz FROM embeddings"
    sums = ", ".join([f"sum(u{a}*u{b}) AS a{i}{j}" for i, a in enumerate("xyz") for j, b in enumerate("xyz")] + [f"sum(v{a}*u{b}) AS b{i}{j}" for i, a in enumerate("xyz") for j, b in enumerate("xyz")])
    cof = lambda m, i, j: f"({m}{(i + 1) % 3}{(j + 1) % 3}*{m}{(i + 2) % 3}{(j + 2) % 3} - {m}{(i + 1) % 3}{(j + 2) % 3}*{m}{(i + 2) % 3}{(j + 1) % 3})"
    det = lambda m: f"({m}00*{cof(m, 0, 0)} + {m}01*{cof(m, 0, 1)} + {m}02*{cof(m, 0, 2)})"
    inv = ", ".join(f"{cof('a', j, i)}/{det('a')} AS i{i}{j}" for i in range(3) for j in range(3))
    fit = ", ".join("+".join(f"b{i}{k}*i{k}{j}" for k in range(3)) + f" AS m{i}{j}" for i in range(3) for j in range(3))
    residual = " + ".join(f"pow(v{c} - (m{i}0*ux + m{i}1*uy + m{i}2*uz), 2)" for i, c in enumerate("xyz"))
    fitted = f"WITH r AS ({rows}), s AS (SELECT {sums} FROM r), i AS (SELECT *, {inv} FROM s), f AS (SELECT {fit} FROM i)"
    off = {c: f"(v{c} - (m{i}0*ux + m{i}1*uy + m{i}2*uz))" for i, c in enumerate("xyz")}
    if each:
        return f"{fitted} SELECT vec_id, {', '.join(f'round({o}, 6) + 0 AS r{c}' for c, o in off.items())}, round(sqrt({' + '.join(f'{o}*{o}' for o in off.values())}), 6) AS residual FROM r, f"
    return f"{fitted} SELECT {', '.join(f'round(any_value(m{i}{j}), 6) AS m{i}{j}' for i in range(3) for j in range(3))}, round(any_value({det('m')}), 6) AS determinant, round(sqrt(avg({residual})), 6) AS rms FROM r, f"


# -- meshes --------------------------------------------------------------------------------------------

def _triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spherical triangle for each vector: directions of its first nine components."""
    rows = table(spark, sf_dir, "embeddings").filter("size(embedding) >= 9")
    corner = lambda k: [F.col("embedding")[3 * k + i].cast("double") for i in range(3)]
    unit = lambda v: F.array(*[c / F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2]) for c in v])
    return rows.select("vec_id", *[unit(corner(k)).alias(f"p{k}") for k in range(3)])


def _corner_sql(k: int) -> str:
    v = [f"embedding[{3 * k + i + 1}]::double" for i in range(3)]
    n = f"sqrt({v[0]}*{v[0]} + {v[1]}*{v[1]} + {v[2]}*{v[2]})"
    return f"[{', '.join(f'{c}/{n}' for c in v)}]"


_TRI = f"SELECT vec_id, {', '.join(f'{_corner_sql(k)} AS p{k}' for k in range(3))} FROM embeddings WHERE len(embedding) >= 9"


def _angle_sql(a: str, b: str) -> str:
    return f"acos(greatest(-1.0::double, least(1.0::double, {a}[1]*{b}[1] + {a}[2]*{b}[2] + {a}[3]*{b}[3])))"


def j5_check_equilateral(spark, sf_dir):
    out = M.check_equilateral(_triangles(spark, sf_dir))
    return out.select("vec_id", *[F.round(c, 6).alias(c) for c in ("a", "b", "c", "spread")], "equilateral")


J5 = f"SELECT vec_id, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c, round(greatest(abs(a-b), abs(b-c), abs(c-a)), 6) AS spread, greatest(abs(a-b), abs(b-c), abs(c-a)) <= 1e-6 AS equilateral FROM (SELECT vec_id, {_angle_sql('p0', 'p1')} AS a, {_angle_sql('p1', 'p2')} AS b, {_angle_sql('p2', 'p0')} AS c FROM ({_TRI}))"


def j5_mesh_spread(spark, sf_dir):
    """How far subdivided triangles are from equilateral, by level."""
    out = None
    for depth in (1, 2):
        one = M.check_equilateral(M.subdivide_triangles(_triangles(spark, sf_dir), depth, ["vec_id"])).groupBy(F.lit(depth).alias("level"), "equilateral").agg(F.count("*").alias("n"), F.round(F.max("spread"), 6).alias("spread"))
        out = one if out is None else out.unionByName(one)
    return out


def _faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _triangles(spark, sf_dir).selectExpr("CAST(vec_id AS STRING) AS name", "vec_id % 2 = 0 AS up", "CAST(vec_id % 11 AS INT) AS gx", "CAST(vec_id % 4 AS INT) AS gy", "p0", "p1", "p2")


def m1_subdivide(spark, sf_dir):
    """Half-hexagons of two levels: how many of each rotation, and their planar centre."""
    out = M.subdivide(_faces(spark, sf_dir), 3.0, 2)
    return out.groupBy("name", "rot").agg(F.count("*").alias("n"), F.round(F.avg((F.col("xy")[0][0] + F.col("xy")[3][0]) / 2), 6).alias("mx"), F.round(F.avg((F.col("xy")[0][1] + F.col("xy")[3][1]) / 2), 6).alias("my"))


def m2_subdivide_triangles(spark, sf_dir):
    out = M.subdivide_triangles(_triangles(spark, sf_dir), 2, ["vec_id"])
    return out.select("vec_id", "path", *[F.round((F.col("p0")[k] + F.col("p1")[k] + F.col("p2")[k]) / 3, 6).alias(c) for k, c in enumerate("xyz")])


def _level_sql(source: str) -> str:
    """The nine children of each triangle of a source (vec_id, path, p0, p1, p2)."""
    angles = ", ".join(f"acos(p{a}[1]*p{b}[1] + p{a}[2]*p{b}[2] + p{a}[3]*p{b}[3]) AS t{a}" for a, b in ((0, 1), (1, 2), (2, 0)))
    arc = lambda a, b, t: [f"((sin((1-{t})*t{a})*p{a}[{k}] + sin({t}*t{a})*p{b}[{k}])/sin(t{a}))" for k in (1, 2, 3)]
    plain = lambda a: [f"p{a}[{k}]" for k in (1, 2, 3)]
    third, two = "(1.0::double/3)", "(2.0::double/3)"
    ten = [[f"(p0[{k}] + p1[{k}] + p2[{k}])/3" for k in (1, 2, 3)], plain(0), arc(0, 1, third), arc(0, 1, two), plain(1), arc(1, 2, third), arc(1, 2, two), plain(2), arc(2, 0, third), arc(2, 0, two)]
    raw = ", ".join(f"[{', '.join(v)}] AS r{k}" for k, v in enumerate(ten))
    unit = ", ".join(f"list_transform(r{k}, lambda c: c/sqrt(r{k}[1]*r{k}[1] + r{k}[2]*r{k}[2] + r{k}[3]*r{k}[3]))" if k not in (1, 4, 7) else f"r{k}" for k in range(10))
    kids = ", ".join(f"('{n}', {a + 1}, {b + 1}, {c + 1})" for n, (a, b, c) in enumerate(M.CHILD_TRIANGLES))
    return f"SELECT vec_id, path || n AS path, t[a] AS p0, t[b] AS p1, t[c] AS p2 FROM (SELECT vec_id, path, [{unit}] AS t FROM (SELECT vec_id, path, {raw} FROM (SELECT *, {angles} FROM ({source})))), (VALUES {kids}) k(n, a, b, c)"


_LEVEL1 = _level_sql(f"SELECT *, '' AS path FROM ({_TRI})")
_LEVEL2 = _level_sql(_LEVEL1)
M2 = f"SELECT vec_id, path, {', '.join(f'round((p0[{k}] + p1[{k}] + p2[{k}])/3, 6) AS {c}' for k, c in ((1, 'x'), (2, 'y'), (3, 'z')))} FROM ({_LEVEL2})"
_SPREAD = f"SELECT level, greatest(abs(a-b), abs(b-c), abs(c-a)) AS spread FROM (SELECT level, {_angle_sql('p0', 'p1')} AS a, {_angle_sql('p1', 'p2')} AS b, {_angle_sql('p2', 'p0')} AS c FROM (SELECT 1 AS level, * FROM ({_LEVEL1}) UNION ALL SELECT 2, * FROM ({_LEVEL2})))"
J5M = f"SELECT level, spread <= 1e-6 AS equilateral, count(*) AS n, round(max(spread), 6) AS spread FROM ({_SPREAD}) s GROUP BY level, s.spread <= 1e-6"


# -- meshes with shared vertices: an octahedron of three directions and their opposites for each vector ---

#: Faces by vertex: 0..2 are the directions, 3..5 their opposites.
_OCTAHEDRON = [(x, y, z) for x in (0, 3) for y in (1, 4) for z in (2, 5)]


def _octahedra(spark, sf_dir, depth: int) -> I.Mesh:
    corner = _triangles(spark, sf_dir)
    place = lambda v: [F.col(f"p{v % 3}")[k] * (1.0 if v < 3 else -1.0) for k in range(3)]
    vertices = corner.select(F.col("vec_id").alias("map"), F.explode(F.array(*[F.struct(F.lit(v).alias("idx"), *[x.alias(c) for x, c in zip(place(v), "xyz", strict=True)]) for v in range(6)])).alias("v")).select("map", "v.*")
    faces = corner.select(F.col("vec_id").alias("map"), F.explode(F.array(*[F.struct(F.lit(str(n)).alias("name"), *[F.lit(v).alias(f"v{k}") for k, v in enumerate(f)]) for n, f in enumerate(_OCTAHEDRON)])).alias("f")).select("map", "f.*")
    return I.subdivide_indexed(I.indexed(vertices, faces), depth)


def m1_euler(spark, sf_dir):
    """Vertices, edges and faces of octahedra after two levels, and what their numbers come to."""
    return I.counts(_octahedra(spark, sf_dir, 2))


def _octahedra_sql(depth: int) -> str:
    """The same triangles without shared vertices: vec_id (a map and a face), path, p0, p1, p2."""
    place = lambda v: f"p{v % 3}" if v < 3 else f"[-p{v % 3}[1], -p{v % 3}[2], -p{v % 3}[3]]"
    faces = " UNION ALL ".join(f"SELECT vec_id * 8 + {n} AS vec_id, '' AS path, {', '.join(f'{place(v)} AS p{k}' for k, v in enumerate(f))} FROM tri" for n, f in enumerate(_OCTAHEDRON))
    for _ in range(depth):
        faces = _level_sql(faces)
    return f"WITH tri AS ({_TRI}), t AS ({faces}), corners AS (SELECT vec_id // 8 AS map, [list_transform(p, lambda x: round(x, 6) + 0) for p in [p0, p1, p2]] AS c, [p0, p1, p2] AS p FROM t), sides AS (SELECT map, least(c[a], c[b]) AS low, greatest(c[a], c[b]) AS high, {_angle_sql('p[a]', 'p[b]')} AS angle FROM corners, (VALUES (1, 2), (2, 3), (3, 1)) e(a, b)), edge AS (SELECT map, low, high, any_value(angle) AS angle FROM sides GROUP BY ALL)"


M1E = _octahedra_sql(2) + """ SELECT map, v AS vertices, e AS edges, f AS faces, v - e + f AS euler FROM (SELECT map, count(*) AS f FROM corners GROUP BY ALL) JOIN (SELECT map, count(*) AS e FROM edge GROUP BY ALL) USING (map)
JOIN (SELECT map, count(DISTINCT p) AS v FROM (SELECT map, unnest(c) AS p FROM corners) GROUP BY ALL) USING (map)"""


def w3_mesh_edges(spark, sf_dir):
    """Edges of octahedra after a level, each once, and their lengths."""
    return I.edge_lengths(_octahedra(spark, sf_dir, 1)).groupBy("map").agg(F.count("*").alias("edges"), F.round(F.sum("length"), 5).alias("length"), F.round(F.min("length"), 5).alias("shortest"))


W3E = _octahedra_sql(1) + " SELECT map, count(*) AS edges, round(sum(degrees(angle)), 5) AS length, round(min(degrees(angle)), 5) AS shortest FROM edge GROUP BY ALL"


def j5_indexed_spread(spark, sf_dir):
    """How far the faces of such meshes are from equilateral, corners joined by number."""
    out = M.check_equilateral(I.with_corners(_octahedra(spark, sf_dir, 1)))
    return out.groupBy("map").agg(F.count("*").alias("n"), F.round(F.min("spread"), 6).alias("least"), F.round(F.max("spread"), 6).alias("most"))


J5I = _octahedra_sql(1) + f" SELECT map, count(*) AS n, round(min(s), 6) AS least, round(max(s), 6) AS most FROM (SELECT map, greatest(abs(a-b), abs(b-c), abs(c-a)) AS s FROM (SELECT vec_id // 8 AS map, {_angle_sql('p0', 'p1')} AS a, {_angle_sql('p1', 'p2')} AS b, {_angle_sql('p2', 'p0')} AS c FROM t)) GROUP BY ALL"


def _maps(spark: SparkSession, sf_dir: str) -> Maps:
    """Maps of 16 triangles each (a vertex list and faces by index), written as JSON and read again.

    By the map's number its vertices are x, y, z; degrees as numbers; degrees as pairs with a letter;
    or the first with wrong degrees beside it. Every third map has a grid, every fifth a mapping."""
    path = _shared(spark)
    corner = _triangles(spark, sf_dir).select(F.expr("vec_id div 16").alias("n"), F.posexplode(F.array("p0", "p1", "p2")).alias("k", "xyz"), "vec_id")
    v = [F.col("xyz")[k] for k in range(3)]
    corner = corner.withColumns({"lat": latitude(*v), "lon": longitude(v[0], v[1])})
    body = corner.groupBy("n").agg(F.array_sort(F.collect_list(F.struct("vec_id", "k", "xyz", "lat", "lon"))).alias("v"))
    number = lambda x: F.format_string("%.15f", x)
    pair = lambda x, plus, minus: F.concat(F.lit("["), number(F.abs(x)), F.when(x < 0, F.lit(f', "{minus}"]')).otherwise(F.lit(f', "{plus}"]')))
    xyz = lambda x: F.concat(F.lit('"xyz": ['), F.array_join(F.transform(x["xyz"], number), ", "), F.lit("]"))
    plain = lambda x: F.concat(F.lit('"ll": ['), number(x["lat"]), F.lit(", "), number(x["lon"]), F.lit("]"))
    lettered = lambda x: F.concat(F.lit('"ll": ['), pair(x["lat"], "N", "S"), F.lit(", "), pair(x["lon"], "E", "W"), F.lit("]"))
    form = F.col("n") % 4
    vertex = lambda x: F.concat(F.lit('{"name": "v'), x["vec_id"].cast("string"), F.lit('", '), F.when(form == 0, xyz(x)).when(form == 1, plain(x)).when(form == 2, lettered(x)).otherwise(F.concat(xyz(x), F.lit(', "ll": [[1, "N"], [2, "E"]]'))), F.lit("}"))
    face = lambda x, i: F.concat(F.lit('{"name": "'), x["vec_id"].cast("string"), F.lit('", "vx": ['), F.array_join(F.array(i * 3, i * 3 + 1, i * 3 + 2), ", "), F.lit('], "grid": [1, 2], "up": '), (x["vec_id"] % 2 == 0).cast("string"), F.lit("}"))
    listed = lambda x: F.concat(F.lit("["), F.array_join(x, ", "), F.lit("]"))
    text = F.concat(
        F.lit('{"id": "'), F.col("n").cast("string"), F.lit('", "vertices": '), listed(F.transform("v", vertex)),
        F.lit(', "sides": '), listed(F.transform(F.filter("v", lambda x: x["k"] == 0), face)),
        F.when(F.col("n") % 3 == 0, F.concat(F.lit(', "grid": [0, 0, '), F.col("n").cast("string"), F.lit(", 5]"))).otherwise(F.lit("")),
        F.when(F.col("n") % 5 == 0, F.concat(F.lit(', "mapping": {"next": '), listed(F.transform(F.sequence(F.lit(0), F.size("v") - 1), lambda k: ((k + 1) % F.size("v")).cast("string"))), F.lit("}"))).otherwise(F.lit("")), F.lit("}"),
    )
    body.select(text.alias("value")).write.text(path)
    return read_maps(spark, path, lines=True)


def s4_read_polyhedron(spark, sf_dir):
    """Faces of the maps with their corners, whatever the form of the vertices."""
    faces = _maps(spark, sf_dir).faces
    return faces.select("map", "name", "up", "v0", *[F.round(F.col("p1")[k], 6).alias(c) for k, c in enumerate("xyz")])


S4 = f"SELECT (vec_id // 16)::varchar AS map, vec_id::varchar AS name, vec_id % 2 = 0 AS up, ((row_number() OVER (PARTITION BY vec_id // 16 ORDER BY vec_id) - 1)*3)::int AS v0, round(p1[1], 6) AS x, round(p1[2], 6) AS y, round(p1[3], 6) AS z FROM ({_TRI})"


def s4_map_grids(spark, sf_dir):
    """Grids (given or default) and mappings of the maps."""
    maps = _maps(spark, sf_dir)
    mapped = maps.mappings.groupBy("map", "other").agg(F.count("*").alias("mapped"), F.sum(F.col("idx") * F.col("other_idx")).alias("checksum"))
    return maps.grids.join(mapped, "map", "left").select("map", F.array_join(F.col("grid").cast("array<string>"), " ").alias("grid"), "other", "mapped", "checksum")


S4G = f"""SELECT map::varchar AS map, CASE WHEN map % 3 = 0 THEN '0 0 ' || map || ' 5' ELSE '0 0 11 4' END AS grid, CASE WHEN map % 5 = 0 THEN 'next' END AS other,
CASE WHEN map % 5 = 0 THEN n END AS mapped, CASE WHEN map % 5 = 0 THEN list_sum(list_transform(range(0, n), lambda k: k * ((k + 1) % n)))::bigint END AS checksum FROM (SELECT vec_id // 16 AS map, 3 * count(*) AS n FROM ({_TRI}) GROUP BY ALL)"""


def g4_colour_mesh(spark, sf_dir):
    image, height = _full(spark, sf_dir)
    return M.colour_mesh(M.subdivide(_faces(spark, sf_dir), 3.0, 1), image, EXTENT, height, W)


def g4_colour_tiles(spark, sf_dir):
    """The same colours, read from the raster's tiles."""
    tiles, height = tiled(spark, sf_dir)
    return colour_mesh_tiles(M.subdivide(_faces(spark, sf_dir), 3.0, 1), tiles, EXTENT, height, W, side=TILE_SIDE)


# A face's nine triangles by the half-hexagon that they belong to: of each half-hexagon's long edge and
# short ones, the middle of the long edge is a corner of all three.
def _half_of(n: int, up: bool) -> int:
    corners = set(M.CHILD_TRIANGLES[n])
    return next(k for k, (at, _) in enumerate(M.HALF_HEXES[up]) if corners <= set(at))


_KIND = "CASE path " + " ".join(f"WHEN '{n}' THEN CASE WHEN vec_id % 2 = 0 THEN '{_half_of(n, True)}' ELSE '{_half_of(n, False)}' END" for n in range(9)) + " END"
_MIDDLE = ", ".join(f"(p0[{k}] + p1[{k}] + p2[{k}])/3 AS {c}" for k, c in ((1, "x"), (2, "y"), (3, "z")))
_AT = f"SELECT name, path, (h - 1 - ({_H})::int % h)::int AS \"row\", (({_C})::int % {W})::int AS col FROM (SELECT vec_id::varchar AS name, {_KIND} AS path, degrees(atan2(z, sqrt(x*x + y*y))) AS lat, degrees(atan2(y, x)) AS lon FROM (SELECT vec_id, path, {_MIDDLE} FROM ({_LEVEL1}))), size"
G4 = BASE + f'SELECT name, path, ' + ", ".join(f"trunc(sum({b})/3.0::double)::int AS {b}" for b in "rgb") + f' FROM ({_AT}) JOIN img USING ("row", col) GROUP BY ALL'


def w3_polygon_edges(spark, sf_dir):
    rows = _triangles(spark, sf_dir).select(F.col("vec_id").alias("polygon"), F.posexplode(F.array("p0", "p1", "p2")).alias("place", "p"))
    out = M.polygon_edges(rows.select("polygon", "place", *[F.col("p")[k].alias(c) for k, c in enumerate("xyz")]))
    return out.select("polygon", "place", F.round("length", 6).alias("length"))


W3 = " UNION ALL ".join(f"SELECT vec_id AS polygon, {k} AS place, round(degrees({_angle_sql(f'p{k}', f'p{(k + 1) % 3}')}), 6) AS length FROM ({_TRI})" for k in range(3))


def m4_warp_octahedron(spark, sf_dir):
    """Octahedral points of the vectors, warped: how far each moves, by face."""
    e = [F.col(f"p0")[k] for k in range(3)]
    rows = _triangles(spark, sf_dir).select("vec_id", *[(F.abs(c) / (F.abs(e[0]) + F.abs(e[1]) + F.abs(e[2]))).alias(n) for c, n in zip(e, "uvw", strict=True)])
    out = M.warp_octahedron(rows)
    return out.select("vec_id", *[F.round(c, 6).alias(c) for c in "xyz"])


def _m4() -> str:
    a, e, o = (num(v) for v in M.WARP)
    share = ", ".join(f"abs(p0[{k + 1}])/(abs(p0[1])+abs(p0[2])+abs(p0[3])) AS {n}" for k, n in enumerate("uvw"))
    tan = ", ".join(f"tan(({n} + {o})*{num(math.pi / 2)}) AS t{k}" for k, n in enumerate("uvw"))
    raw = ", ".join(f"t{k}*pow(t{(k + 1) % 3}*t{(k + 1) % 3} + t{(k + 2) % 3}*t{(k + 2) % 3} + {a}*t{(k + 1) % 3}*t{(k + 1) % 3}*t{(k + 2) % 3}*t{(k + 2) % 3}, {e}) AS r{k}" for k in range(3))
    return f"SELECT vec_id, {', '.join(f'round(r{k}/sqrt(r0*r0+r1*r1+r2*r2), 6) AS {c}' for k, c in enumerate('xyz'))} FROM (SELECT *, {raw} FROM (SELECT *, {tan} FROM (SELECT vec_id, {share} FROM ({_TRI}))))"


def m4_warp_distortion(spark, sf_dir):
    """Stretch of the octahedral map by octant and level, over the vectors' triangles and their children."""
    out = None
    for level in (0, 1):
        rows = _triangles(spark, sf_dir) if level == 0 else M.subdivide_triangles(_triangles(spark, sf_dir), level, ["vec_id"])
        flat = lambda p: F.transform(p, lambda c: F.abs(c) / F.aggregate(p, F.lit(0.0), lambda x, y: x + F.abs(y)))
        face = sum(((F.col("p0")[k] > 0).cast("int") * 2**k for k in range(3)), F.lit(0))
        one = rows.select(face.alias("face"), F.lit(level).alias("level"), *[flat(F.col(f"p{k}")).alias(f"p{k}") for k in range(3)])
        out = one if out is None else out.unionByName(one)
    found = M.warp_distortion(out, ["face", "level"])
    return found.select("face", "level", "n", *[F.round(c, 4).alias(c) for c in found.columns[3:]])


def _m4_distortion() -> str:
    a, e, o = (num(v) for v in M.WARP)
    rows = f"SELECT 0 AS level, '' AS path, vec_id, p0, p1, p2 FROM ({_TRI}) UNION ALL SELECT 1, path, vec_id, p0, p1, p2 FROM ({_LEVEL1})"
    flat = lambda p: f"list_transform({p}, lambda c: abs(c)/(abs({p}[1]) + abs({p}[2]) + abs({p}[3])))"
    face = " + ".join(f"(p0[{k + 1}] > 0)::int*{2**k}" for k in range(3))
    start = f"SELECT level, vec_id, path, {face} AS face, {', '.join(f'{flat(f"p{k}")} AS p{k}' for k in range(3))} FROM ({rows})"
    tan = ", ".join(f"list_transform(p{k}, lambda c: tan((c + {o})*{num(math.pi / 2)})) AS t{k}" for k in range(3))
    raw = lambda t: "[" + ", ".join(f"{t}[{i}]*pow({t}[{j}]*{t}[{j}] + {t}[{k}]*{t}[{k}] + {a}*{t}[{j}]*{t}[{j}]*{t}[{k}]*{t}[{k}], {e})" for i, j, k in ((1, 2, 3), (2, 3, 1), (3, 1, 2))) + "]"
    unit = ", ".join(f"list_transform(r{k}, lambda c: c/sqrt(list_dot_product(r{k}, r{k}))) AS q{k}" for k in range(3))
    warped = f"SELECT *, {unit} FROM (SELECT *, {', '.join(f'{raw(f"t{k}")} AS r{k}' for k in range(3))} FROM (SELECT *, {tan} FROM ({start})))"
    edges = ", ".join(f"acos(greatest(-1.0::double, least(1.0::double, list_dot_product(q{i}, q{j}))))/nullif(list_distance(p{i}, p{j}), 0)" for i, j in ((0, 1), (1, 2), (2, 0)))
    cross = lambda u, v: f"list_cross_product(({u})::double[3], ({v})::double[3])::double[]"
    excess = f"2*atan2(abs(list_dot_product(q0, {cross('q1', 'q2')})), 1 + list_dot_product(q0, q1) + list_dot_product(q1, q2) + list_dot_product(q2, q0))"
    minus = lambda u, v: "[" + ", ".join(f"{u}[{k}] - {v}[{k}]" for k in (1, 2, 3)) + "]"
    normal = cross(minus("p1", "p0"), minus("p2", "p0"))
    each = f"SELECT face, level, vec_id, path, [{edges}] AS edges, {excess}/nullif(sqrt(list_dot_product({normal}, {normal}))/2, 0) AS area FROM ({warped})".replace("list_cross_product", "array_cross_product")
    long = f"SELECT face, level, unnest(edges) AS edge FROM ({each})"
    by_edge = f"SELECT face, level, round(min(edge), 4) AS min_edge, round(max(edge), 4) AS max_edge, round(stddev_pop(edge), 4) AS dev_edge FROM ({long}) GROUP BY face, level"
    by_area = f"SELECT face, level, count(*) AS n, round(min(area), 4) AS min_area, round(max(area), 4) AS max_area, round(stddev_pop(area), 4) AS dev_area FROM ({each}) GROUP BY face, level"
    return f"SELECT * FROM ({by_area}) JOIN ({by_edge}) USING (face, level)"


def m5_slerp_vs_chord(spark, sf_dir):
    edges = _triangles(spark, sf_dir).select(F.col("p0").alias("p"), F.col("p1").alias("q"))
    return M.slerp_vs_chord(edges).groupBy(F.round("t", 6).alias("t")).agg(F.count("*").alias("n"), F.round(F.max("gap"), 6).alias("max_gap"), F.round(F.avg("gap"), 6).alias("avg_gap"))


_GAP = " + ".join(f"pow((sin((1-t)*th)*p0[{k}] + sin(t*th)*p1[{k}])/sin(th) - ((1-t)*p0[{k}] + t*p1[{k}]), 2)" for k in (1, 2, 3))
M5 = f"SELECT round(t, 6) AS t, count(*) AS n, round(max(gap), 6) AS max_gap, round(avg(gap), 6) AS avg_gap FROM (SELECT t, sqrt({_GAP}) AS gap FROM (SELECT *, acos(p0[1]*p1[1]+p0[2]*p1[2]+p0[3]*p1[3]) AS th FROM ({_TRI})), (VALUES (1.0::double/3), (0.5::double), (2.0::double/3)) v(t)) GROUP BY ALL"


def w4_best_fit(spark, sf_dir):
    steps = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"))
    return M.best_fit(steps, 100.0, 100.0 / math.sqrt(3.0) * 1.5).select("i", "s", "h", F.round("misfit", 9).alias("misfit"))


_SQ, _HX = num(100.0), num(100.0 / math.sqrt(3.0) * 1.5)
W4 = f"""SELECT i, s, h, round(misfit, 9) AS misfit FROM (SELECT arg_max(i, i) AS i, arg_max(s, i) AS s, arg_max(h, i) AS h, misfit FROM (SELECT i, s, h, sqrt((i*{_SQ} - h*{_HX})*(i*{_SQ} - h*{_HX}) + (i*{_HX} - s*{_SQ})*(i*{_HX} - s*{_SQ}))/100.0::double AS misfit FROM
(SELECT o_orderkey AS i, floor(o_orderkey*{_HX}/{_SQ})::bigint AS s, floor(o_orderkey*{_SQ}/{_HX})::bigint AS h FROM orders) WHERE h % 2 = 0) GROUP BY misfit) ORDER BY misfit, i LIMIT 30"""


_A, _HT = 9.0, 9.0 * math.sqrt(3.0) / 2


def _hexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("CAST(o_orderkey % 40 - 20 AS INT) AS hx", "CAST(o_orderkey div 40 - 200 AS INT) AS hy", "o_custkey AS value")


_HEX = "SELECT (o_orderkey % 40 - 20)::int AS hx, (o_orderkey // 40 - 200)::int AS hy, o_custkey AS value FROM orders"


def _district_rows(out: DataFrame) -> DataFrame:
    return out.select("hx", "hy", "district", *[(F.round(F.col("polygon")[k][i], 4) + F.lit(0.0)).alias(f"{c}{k}") for k in range(4) for i, c in enumerate("xy")])


def m6_cover(spark, sf_dir):
    hexes = _hexes(spark, sf_dir).select("hx", "hy", F.expr("CAST(value % 2 AS INT)").alias("level"))
    return _district_rows(M.cover(hexes, 1200.0, 900.0, 9.0))


def m6_canvas_cover(spark, sf_dir):
    """The districts on a canvas with room for a hex for each order."""
    side = math.ceil(table(spark, sf_dir, "orders").count() ** 0.5)
    width, height = M.size_for(side, side, _A)
    return M.canvas_cover(spark, width, height, _A, 4)


def m7_cover6(spark, sf_dir):
    tiles = _hexes(spark, sf_dir).select((F.col("hx") + 20).alias("hx"), (F.col("hy") + 200).alias("hy"))
    return _district_rows(M.cover6(tiles, 700.0, 3000.0, 9.0))


def _cover_sql(hexes: str, polygons: list, ox: str, oy: str, sc: str, width: float | str, height: float | str, slack: float, keep: str = "") -> str:
    values = ", ".join("(" + ", ".join([str(d), *[num(v) for p in poly for v in p]]) + ")" for d, poly in enumerate(polygons))
    names = [f"{c}{k}" for k in range(4) for c in "xy"]
    moved = ", ".join(f"{sc}*o.{n} + {ox if n[0] == 'x' else oy} AS {n}" for n in names)
    xs, ys = ", ".join(n for n in names if n[0] == "x"), ", ".join(n for n in names if n[0] == "y")
    return f"SELECT hx, hy, district::int AS district, {', '.join(f'round({n}, 4) + 0.0::double AS {n}' for n in names)} FROM (SELECT hx, hy, district, {keep}{moved} FROM ({hexes}) h, (VALUES {values}) o(district, {', '.join(names)})) WHERE least({xs}) >= {-slack} AND greatest({xs}) <= {width} + {slack} AND least({ys}) >= {-slack} AND greatest({ys}) <= {height} + {slack}"


_NINE = M._polygons([(1.0, 0.0), (0.5, 1.0), (-0.5, 1.0), (-1.0, 0.0)], M.NINE_OFFSETS, _A)
_SIX = M._polygons([(-1.0, 0.0), (1.0, 0.0), (0.5, 1.0), (-0.5, 1.0)], M.SIX_OFFSETS, _A)
_SC = "pow(3.0::double, level)"
M6 = _cover_sql(f"SELECT hx, hy, (value % 2)::int AS level FROM ({_HEX})", _NINE, f"(600.0::double + {_SC}*hx*{num(4.5 * _A)} + ({_SC}*3 - 3)*{num(_A / 2)})", f"(450.0::double + {_SC}*(hy*{num(6 * _HT)} - (((hx % 2) + 2) % 2)*{num(3 * _HT)}))", _SC, 1200.0, 900.0, 0.0)
_CANVAS = f"SELECT s, ceil(s*4.5::double*{num(_A)}) AS wide, ceil(s*6*{num(_HT)}) AS high FROM (SELECT ceil(sqrt(count(*)))::int AS s FROM orders)"
_LIMITS = f"SELECT wide, high, floor(wide/{num(4.5 * _A)})/2 AS cx, floor(high/{num(6 * _HT)})/2 AS cy FROM ({_CANVAS})"
M6C = _cover_sql(f"SELECT x.k::int AS hx, y.k::int AS hy, wide, high FROM ({_LIMITS}), range(-9999, 9999) x(k), range(-9999, 9999) y(k) WHERE x.k >= floor(-cx) - 2 AND x.k < floor(cx) + 2 AND y.k >= floor(-cy) - 2 AND y.k < floor(cy) + 2",
    _NINE, f"(wide/2 + hx*{num(4.5 * _A)})", f"(high/2 + hy*{num(6 * _HT)} - (((hx % 2) + 2) % 2)*{num(3 * _HT)})", "1.0::double", "wide", "high", 0.0, "wide, high, ")
M7 = _cover_sql(f"SELECT hx + 20 AS hx, hy + 200 AS hy FROM ({_HEX})", _SIX, f"(hx*{num(3 * _A)} + {num(_A)})", f"(hy*{num(6 * _HT)})", "1.0::double", 700.0, 3000.0, 3.0)


def m8_hex_neighbours(spark, sf_dir):
    out = M.hex_neighbours(_hexes(spark, sf_dir))
    return out.select("hx", "hy", "neighbours", F.round("mean", 6).alias("mean"))


M8 = f"""WITH c AS (SELECT hx, hy, value, hx AS q, -hy - ((hx - ((hx % 2) + 2) % 2)//2) AS r FROM ({_HEX})), d(dq, dr) AS (VALUES (1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1))
SELECT c.hx, c.hy, count(n.value) AS neighbours, round(avg(n.value), 6) AS mean FROM c CROSS JOIN d LEFT JOIN c n ON n.q = c.q + dq AND n.r = c.r + dr GROUP BY c.hx, c.hy"""


def m8_nested_axial(spark, sf_dir):
    """How many districts of three levels share an axial position."""
    rows = _hexes(spark, sf_dir).selectExpr("hx", "hy", "CAST(value % 3 AS INT) AS level", "CAST(value % 18 AS INT) AS district")
    return M.nested_axial(rows).groupBy("level", "q", "r", "half").agg(F.count("*").alias("n"))


M8N = f"""SELECT level, ((hx*3 + fq)*pow(3, level))::bigint AS q, (((-hy - (hx - ((hx % 2) + 2) % 2)//2)*3 + fr)*pow(3, level))::bigint AS r, half, count(*) AS n FROM (SELECT *, (value % 3)::int AS level FROM ({_HEX})),
(VALUES {', '.join(f"({d}, {q}, {r}, '{'ab'[k - 1]}')" for d, (q, r, k) in enumerate(M.DISTRICT_AXIAL))}) f(district, fq, fr, half) WHERE value % 18 = district GROUP BY ALL"""


def a6_grid_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("CAST(o_orderkey % 19 - 9 AS INT) AS hx", "CAST((o_orderkey div 19) % 17 - 8 AS INT) AS hy", "CAST(o_custkey % 18 AS INT) AS district").distinct()
    return M.grid_labels(rows, 3)


def a6_labels_at_level(spark, sf_dir):
    """The same districts taken as those of a coarser level."""
    rows = table(spark, sf_dir, "orders").selectExpr("CAST(o_orderkey % 19 - 9 AS INT) AS hx", "CAST((o_orderkey div 19) % 17 - 8 AS INT) AS hy", "CAST(o_custkey % 18 AS INT) AS district").distinct()
    return M.grid_labels(rows, 3, level=1)


def _a6(digits: int = 3) -> str:
    from ninefold.functions.rules import PARENT_HALF

    first = ", ".join(f"({d}, {q}, {r}, {ab})" for d, (q, r, ab) in enumerate(M.DISTRICT_AXIAL))
    place = ", ".join(f"({q}, {r}, {d})" for (q, r), d in M.AXIAL_DISTRICT.items())
    half = ", ".join(f"({ab}, {n}, {od}, {1 if PARENT_HALF[n, od, h] == 'V' else 2})" for ab, h in ((1, "V"), (2, "Λ")) for n in range(3) for od in range(9))
    trunc = lambda e: f"trunc(({e})/3.0)::int"
    sql = f"WITH f(district, fq, fr, ab) AS (VALUES {first}), a(qi, ri, n) AS (VALUES {place}), t(ab, n3, od, up) AS (VALUES {half}), l0 AS (SELECT hx, hy, d.district, hx*3 + fq AS q, (-hy - ((hx - ((hx % 2) + 2) % 2)//2))*3 + fr AS r, ab, '' AS label, NULL::int AS od FROM (SELECT DISTINCT (o_orderkey % 19 - 9)::int AS hx, ((o_orderkey//19) % 17 - 8)::int AS hy, (o_custkey % 18)::int AS district FROM orders) d JOIN f USING (district))"
    for k in range(digits):
        ab = "l.ab" if k == 0 else "t.up"
        join = "" if k == 0 else "JOIN t ON t.ab = l.ab AND t.n3 = a.n % 3 AND t.od = l.od"
        letter = f"|| CASE WHEN {ab} = 1 THEN 'a' ELSE 'b' END" if k == 0 else ""
        sql += f", l{k + 1} AS (SELECT hx, hy, l.district, {trunc('l.q - f.fq')} AS q, {trunc('l.r - f.fr')} AS r, {ab} AS ab, a.n::varchar || label {letter} AS label, a.n AS od FROM l{k} l JOIN a ON a.qi = l.q % 3 AND a.ri = l.r % 3 {join} JOIN f ON f.district//2 = a.n AND f.ab = {ab})"
    return sql + " SELECT hx, hy, district, label FROM l" + str(digits)


QUERIES = {f.__name__: f for f in (s1_read_points, s2_profile_points, s6_grid_to_points, p2_rotate_points, j1_nearest, j1_nearest_city, g7_fit_rotation, g7_rotation_residuals, j5_check_equilateral, j5_mesh_spread, m1_subdivide, m1_euler, w3_mesh_edges, j5_indexed_spread, m2_subdivide_triangles, s4_read_polyhedron, s4_map_grids, g4_colour_mesh, g4_colour_tiles, w3_polygon_edges, m4_warp_octahedron, m4_warp_distortion, m5_slerp_vs_chord, w4_best_fit, m6_cover, m6_canvas_cover, m7_cover6, m8_hex_neighbours, m8_nested_axial, a6_grid_labels, a6_labels_at_level)}
ORACLE_SQL = {"s1_read_points": _S1, "s2_profile_points": S2, "s6_grid_to_points": S6, "p2_rotate_points": P2, "j1_nearest": J1, "j1_nearest_city": J1C, "g7_fit_rotation": _g7(), "g7_rotation_residuals": _g7(True), "j5_check_equilateral": J5, "j5_mesh_spread": J5M, "m2_subdivide_triangles": M2, "s4_read_polyhedron": S4, "s4_map_grids": S4G, "g4_colour_mesh": G4, "g4_colour_tiles": G4, "m1_euler": M1E, "w3_mesh_edges": W3E, "j5_indexed_spread": J5I, "w3_polygon_edges": W3, "m4_warp_octahedron": _m4(), "m4_warp_distortion": _m4_distortion(), "m5_slerp_vs_chord": M5, "w4_best_fit": W4, "m6_cover": M6, "m6_canvas_cover": M6C, "m7_cover6": M7, "m8_hex_neighbours": M8, "m8_nested_axial": M8N, "a6_grid_labels": _a6(), "a6_labels_at_level": _a6(2)}
