"""Spherical meshes with shared vertices: a table of vertices, and faces that name them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ninefold.functions.columns import normalised, slerp
from ninefold.functions.storage import checkpointed

from .mesh import CHILD_TRIANGLES, MAX_DEPTH, _angle

_XYZ = ("x", "y", "z")
#: Faces of a partition after a level, about.
TASK_FACES = 500_000


@dataclass
class Mesh:
    """vertices: map, idx, x, y, z. faces: map, name, path, v0, v1, v2."""

    vertices: DataFrame
    faces: DataFrame


def indexed(vertices: DataFrame, faces: DataFrame) -> Mesh:
    """A mesh from vertices (map, idx, x, y, z) and faces (map, name, v0, v1, v2), as map files have them."""
    points = vertices.select("map", F.col("idx").cast("long").alias("idx"), *_XYZ)
    return Mesh(points, faces.select("map", "name", F.lit("").alias("path"), *[F.col(f"v{k}").cast("long").alias(f"v{k}") for k in range(3)]))


def edges(faces: DataFrame) -> DataFrame:
    """The edges of the faces, each once: map, low, high (the vertices, smaller number first)."""
    pairs = F.array(*[F.struct(F.least(f"v{a}", f"v{b}").alias("low"), F.greatest(f"v{a}", f"v{b}").alias("high")) for a, b in ((0, 1), (1, 2), (2, 0))])
    return faces.select("map", F.explode(pairs).alias("e")).select("map", "e.*").distinct()


def _at(rows: DataFrame, vertices: DataFrame, column: str, name: str) -> DataFrame:
    """The rows with the place of a vertex as an array."""
    named = vertices.select(F.col("map").alias("__m"), F.col("idx").alias("__i"), F.array(*_XYZ).alias(name))
    return rows.join(named, F.col("map").eqNullSafe(F.col("__m")) & (F.col(column) == F.col("__i"))).drop("__m", "__i")


def with_corners(mesh: Mesh) -> DataFrame:
    """The faces with p0, p1, p2, one equi-join for each corner."""
    rows = mesh.faces
    for k in range(3):
        rows = _at(rows, mesh.vertices, f"v{k}", f"p{k}")
    return rows


def edge_lengths(mesh: Mesh) -> DataFrame:
    """map, low, high and length (an angle in degrees) of every edge, once however many faces share it."""
    rows = _at(_at(edges(mesh.faces), mesh.vertices, "low", "a"), mesh.vertices, "high", "b")
    return rows.select("map", "low", "high", F.degrees(_angle(F.col("a"), F.col("b"))).alias("length"))


def counts(mesh: Mesh) -> DataFrame:
    """map, vertices, edges, faces and euler (vertices - edges + faces: 2 for a closed surface)."""
    one = lambda df, name: df.groupBy("map").agg(F.count("*").alias(name))
    kinds = [("vertices", mesh.vertices), ("edges", edges(mesh.faces)), ("faces", mesh.faces)]
    stacked = None
    for name, df in kinds:
        rows = one(df, "n").withColumn("kind", F.lit(name))
        stacked = rows if stacked is None else stacked.unionByName(rows)
    out = stacked.groupBy("map").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == name, F.col("n"))), F.lit(0)).alias(name) for name, _ in kinds])
    return out.withColumn("euler", F.col("vertices") - F.col("edges") + F.col("faces"))


def subdivide_indexed(mesh: Mesh, depth: int) -> Mesh:
    """Each face in nine, `depth` times. The two points that part an edge into thirds are made once for the
    edge, from its smaller vertex on, so faces on both sides have the same vertices and not only equal ones.

    A level is one pass over distinct edges and one over faces, and is checkpointed: its numbers are
    given out by place, level and kind, so they must not change if an executor is lost. A face becomes
    nine, so faces are dealt by what they become, and partitions do not grow with the mesh."""
    if not 0 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be from 0 to {MAX_DEPTH}")
    vertices, faces = mesh.vertices, mesh.faces
    for level in range(1, depth + 1):
        number = lambda kind, level=level: F.lit((level << 59) + (kind << 57)) + F.monotonically_increasing_id()
        parted = checkpointed(edges(faces).withColumn("first", number(0)))
        parted = parted.withColumn("second", F.col("first") + F.lit(1 << 57))
        whole = checkpointed(with_corners(Mesh(vertices, faces)).withColumn("centre", number(2)))
        ends = _at(_at(parted, vertices, "low", "a"), vertices, "high", "b")
        a, b = ([F.col(n)[k] for k in range(3)] for n in ("a", "b"))
        third = lambda t: F.array(*normalised(slerp(a, b, F.lit(t))))  # noqa: B023, E731
        cut = ends.select("map", F.explode(F.array(F.struct(F.col("first").alias("idx"), third(1 / 3).alias("p")), F.struct(F.col("second").alias("idx"), third(2 / 3).alias("p")))).alias("v"))
        middle = normalised([(F.col("p0")[k] + F.col("p1")[k] + F.col("p2")[k]) / 3 for k in range(3)])
        placed = cut.select("map", "v.idx", *[F.col("v.p")[k].alias(c) for k, c in enumerate(_XYZ)])
        centres = whole.select("map", F.col("centre").alias("idx"), *[m.alias(c) for m, c in zip(middle, _XYZ, strict=True)])
        rows = whole.select("map", "name", "path", "v0", "v1", "v2", "centre")
        for k, (u, v) in enumerate((("v0", "v1"), ("v1", "v2"), ("v2", "v0"))):
            named = parted.select(F.col("map").alias("__m"), F.col("low").alias("__l"), F.col("high").alias("__h"), F.col("first").alias("__1"), F.col("second").alias("__2"))
            on = F.col("map").eqNullSafe(F.col("__m")) & (F.least(u, v) == F.col("__l")) & (F.greatest(u, v) == F.col("__h"))
            rows = rows.join(named, on).withColumns({f"near{k}": F.when(F.col(u) < F.col(v), F.col("__1")).otherwise(F.col("__2")), f"far{k}": F.when(F.col(u) < F.col(v), F.col("__2")).otherwise(F.col("__1"))}).drop("__m", "__l", "__h", "__1", "__2")
        ten = [F.col(c) for c in ("centre", "v0", "near0", "far0", "v1", "near1", "far1", "v2", "near2", "far2")]
        kids = F.array(*[F.struct(F.lit(str(n)).alias("n"), *[ten[c].alias(f"v{m}") for m, c in enumerate(corners)]) for n, corners in enumerate(CHILD_TRIANGLES)])
        parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-whole.count() * len(CHILD_TRIANGLES) // TASK_FACES))
        rows = rows.repartition(parts, "map", "name", "path")
        faces = checkpointed(rows.select("map", "name", "path", F.explode(kids).alias("c")).select("map", "name", F.concat("path", "c.n").alias("path"), "c.v0", "c.v1", "c.v2"))
        vertices = checkpointed(vertices.unionByName(placed).unionByName(centres))
    return Mesh(vertices, faces)
