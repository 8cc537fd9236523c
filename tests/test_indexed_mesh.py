"""Meshes with shared vertices against those without, and their counts."""

import math

import pytest
from pyspark.sql import functions as F

from ninefold.operators import indexed_mesh as I
from ninefold.operators import mesh as M

GOLD = (1 + math.sqrt(5)) / 2


@pytest.fixture(scope="module")
def solids(spark):
    """An icosahedron, and an octahedron in a map without a name."""
    size = math.sqrt(1 + GOLD * GOLD)
    corners = [tuple(c / size for c in p) for s in (-1, 1) for t in (-GOLD, GOLD) for p in ((0, s, t), (s, t, 0), (t, 0, s))]
    near = lambda a, b: abs(math.dist(a, b) - 2 / size) < 1e-9
    sides = [(a, b, c) for a in range(12) for b in range(a) for c in range(b) if near(corners[a], corners[b]) and near(corners[b], corners[c]) and near(corners[a], corners[c])]
    poles = [(1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0), (-1.0, 0.0, 0.0), (0.0, -1.0, 0.0), (0.0, 0.0, -1.0)]
    octants = [(x, y, z) for x in (0, 3) for y in (1, 4) for z in (2, 5)]
    vertices = [("ico", k, *p) for k, p in enumerate(corners)] + [(None, k, *p) for k, p in enumerate(poles)]
    faces = [("ico", f"f{k}", *f) for k, f in enumerate(sides)] + [(None, f"f{k}", *f) for k, f in enumerate(octants)]
    assert len(sides) == 20
    return I.indexed(spark.createDataFrame(vertices, "map string, idx int, x double, y double, z double"), spark.createDataFrame(faces, "map string, name string, v0 int, v1 int, v2 int"))


@pytest.mark.parametrize("depth", [0, 1, 2])
def test_closed_surfaces(solids, depth):
    by = {r["map"]: r for r in I.counts(I.subdivide_indexed(solids, depth)).collect()}
    for name, faces in (("ico", 20), (None, 8)):
        r = by[name]
        assert r["faces"] == faces * 9**depth and 2 * r["edges"] == 3 * r["faces"] and r["euler"] == 2


def test_same_triangles_as_without_shared_vertices(solids):
    rounded = lambda df: sorted((r["map"] or "", r["name"], r["path"], *[round(x, 9) + 0.0 for k in range(3) for x in r[f"p{k}"]]) for r in df.collect())
    fine = I.subdivide_indexed(solids, 2)
    assert rounded(I.with_corners(fine)) == rounded(M.subdivide_triangles(I.with_corners(solids), 2, ["map", "name"]))
    assert fine.vertices.select("map", "idx").distinct().count() == fine.vertices.count()
    lengths = sorted(r["length"] for r in I.edge_lengths(I.subdivide_indexed(solids, 1)).filter("map = 'ico'").collect())
    assert len(lengths) == 270 and 15 < lengths[0] <= lengths[-1] < 30


def test_odd_meshes(spark, solids):
    assert I.counts(I.subdivide_indexed(I.Mesh(solids.vertices, solids.faces.limit(0)), 1)).filter("faces > 0").count() == 0
    with pytest.raises(ValueError, match="depth"):
        I.subdivide_indexed(solids, 99)


def test_partitions_do_not_grow_with_the_mesh(solids, monkeypatch):
    monkeypatch.setattr(I, "TASK_FACES", 100)
    faces = I.subdivide_indexed(solids, 2).faces
    sizes = [r["n"] for r in faces.selectExpr("spark_partition_id() AS p").groupBy("p").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 28 * 81 and len(sizes) >= 15 and max(sizes) <= 400
