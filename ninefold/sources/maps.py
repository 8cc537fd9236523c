"""Maps of polyhedra in JSON: vertices in several forms, faces, grids and mappings between maps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ninefold.functions.columns import unit_vector

#: The grid of a map that names none.
DEFAULT_GRID = (0, 0, 11, 4)


@dataclass
class Maps:
    """vertices: map, idx, name, x, y, z. faces: map, name, part, up, gx, gy, v0..v2 (indexes) and p0..p2
    (arrays x, y, z). grids: map, grid (four whole numbers). mappings: map, other, idx, other_idx."""

    vertices: DataFrame
    faces: DataFrame
    grids: DataFrame
    mappings: DataFrame


def _degrees(vertex: Column, place: int) -> Column:
    """A latitude or longitude: a signed number, or a pair of a number and N, S, E or W."""
    number = F.try_variant_get(vertex, f"$.ll[{place}]", "double")
    size, side = F.try_variant_get(vertex, f"$.ll[{place}][0]", "double"), F.upper(F.try_variant_get(vertex, f"$.ll[{place}][1]", "string"))
    return F.coalesce(number, F.when(side.isin("S", "W"), -size).when(side.isin("N", "E"), size))


def read_maps(spark: SparkSession, path: str, lines: bool = False) -> Maps:
    """The maps of JSON files: a file is one map, or with `lines` one map a line.

    A vertex has `xyz`, or else `ll` in degrees as numbers or as [number, "N"]; `xyz` wins where both are
    there, and a vertex with neither keeps its place with null coordinates. Faces (`sides`) name three
    vertices by place; a face that names a place beyond the list is left out. Maps may differ in form and have other members. `map` is a map's `id`, null if
    it has none. A text that is not JSON is an error."""
    body = spark.read.text(path, wholetext=not lines).filter("length(trim(value)) > 0").select(F.parse_json("value").alias("body"))
    member = lambda column, name, kind: F.try_variant_get(F.col(column), f"$.{name}", kind)
    maps = body.select(member("body", "id", "string").alias("map"), "body")
    each = maps.select("map", F.posexplode(member("body", "vertices", "array<variant>")).alias("idx", "v"))
    sphere = unit_vector(_degrees(F.col("v"), 0), _degrees(F.col("v"), 1))
    given = [F.try_variant_get("v", f"$.xyz[{k}]", "double") for k in range(3)]
    known = F.try_variant_get("v", "$.xyz[0]", "double").isNotNull()
    vertices = each.select("map", "idx", member("v", "name", "string").alias("name"), *[F.when(known, g).otherwise(p).alias(c) for c, g, p in zip("xyz", given, sphere, strict=True)])
    sides = maps.select("map", F.explode(member("body", "sides", "array<variant>")).alias("s"))
    faces = sides.select("map", member("s", "name", "string").alias("name"), member("s", "p", "string").alias("part"), member("s", "up", "boolean").alias("up"), member("s", "grid[0]", "int").alias("gx"), member("s", "grid[1]", "int").alias("gy"), *[member("s", f"vx[{k}]", "int").alias(f"v{k}") for k in range(3)])
    for k in range(3):
        corner = vertices.select(F.col("map").alias(f"m{k}"), F.col("idx").alias(f"i{k}"), F.array("x", "y", "z").alias(f"p{k}"))
        faces = faces.join(corner, F.col("map").eqNullSafe(F.col(f"m{k}")) & (F.col(f"v{k}") == F.col(f"i{k}"))).drop(f"m{k}", f"i{k}")
    grid = F.coalesce(F.filter(member("body", "grid", "array<int>"), lambda x: x.isNotNull()), F.array())
    grids = maps.select("map", F.when(F.size(grid) == 4, grid).otherwise(F.array(*map(F.lit, DEFAULT_GRID))).alias("grid"))
    other = maps.select("map", F.explode(member("body", "mapping", "map<string, array<int>>")).alias("other", "places"))
    mappings = other.select("map", "other", F.posexplode("places").alias("idx", "other_idx"))
    return Maps(vertices, faces, grids, mappings)
