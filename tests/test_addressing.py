"""Golden values and invariants of the addresses."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ninefold.functions import rules as R
from ninefold.operators import addressing as A
from ninefold.operators import globe as G
from ninefold.operators import mesh as M

POINT = (0.2924332269536584, 0.28114591390120613)
ADDRESS = "520352116102665517712277467235"
PATH = "5Λ2Λ0Λ3Λ5V2V1Λ1Λ6Λ1V0V2V6V6Λ5V5V1Λ7V7Λ1Λ2V2V7V7Λ4Λ6Λ7Λ2V3Λ5V"


def address(x, y, level, code=0):
    digits, codes = A.walk(np.array([x]), np.array([y]), np.array([code]), level)
    return tuple(t.to_pylist()[0] for t in A._text(digits, codes))


def test_published_address():
    assert address(*POINT, 30) == (ADDRESS, "V", PATH)
    assert A.unravel_path(ADDRESS, "V") == PATH
    x, y = A.centroid(ADDRESS, "V")
    assert math.hypot(x - POINT[0], y - POINT[1]) < 1e-12


def test_legacy_label():
    half = {"a": "V", "b": "Λ"}
    path = A.unravel_path("318705251", half["a"]).replace("V", "a").replace("Λ", "b")
    assert path == "3b1a8a7a0b5a2a5a1a"


@pytest.mark.parametrize("level", [1, 2, 3, 4])
def test_number_of_cells_and_round_trip(level):
    rng = np.random.default_rng(1)
    x, y = rng.uniform(-R.W / 2, R.W / 2, 60_000), rng.uniform(-R.H / 3, 2 * R.H / 3, 60_000)
    inside = (y > -R.H / 3) & (y <= 2 * R.H / 3 - abs(R.R3 * x))
    digits, codes = A.walk(x[inside], y[inside], np.zeros(inside.sum(), int), level)
    d, h, p = (t.to_pylist() for t in A._text(digits, codes))
    cells = set(zip(d, h, strict=True))
    assert len(cells) == 3 * 9 ** (level - 1)
    assert all(A.unravel_path(a, b) == c for a, b, c in zip(d, h, p, strict=True))
    for a, b in sorted(cells)[:300]:
        assert address(*A.centroid(a, b), level)[:2] == (a, b)


@settings(max_examples=60, deadline=None)
@given(st.floats(-0.25, 0.25), st.floats(-0.25, 0.25), st.integers(2, 12))
def test_prefix_is_ancestor(x, y, level):
    assert address(x, y, level)[2].startswith(address(x, y, level - 1)[2])


def test_barycentre_has_a_cell():
    assert address(0.0, 0.0, 3, 0)[0] and address(0.0, 0.0, 3, 3)[0]


def test_every_half_hexagon_has_nine_children(spark):
    cells = spark.createDataFrame([("5Λ",), ("0V",), ("8V",), ("6Λ",)], "path string")
    rows = A.children(cells).collect()
    assert sorted({r["path"]: sum(x["path"] == r["path"] for x in rows) for r in rows}.values()) == [9, 9, 9, 9]


def test_columns_and_kernel_agree_with_nulls(spark):
    points = [(0.1, 0.2, "021"), (-0.2, 0.05, "012"), (None, 0.1, "021"), (0.0, 0.0, "201"), (0.1, 0.2, "021"), (0.3, -0.1, None)]
    df = spark.createDataFrame(points, "x double, y double, c2 string").withColumnRenamed("x", "x")
    kernel = A.assign_cells(df.selectExpr("*", "'old' AS digits"), 4).filter("x is not null and c2 is not null").select("x", "y", "digits", "half", "path").collect()
    columns = A.assign_cells_columns(df.filter("x is not null and c2 is not null"), 4).select("x", "y", "digits", "half", "path").collect()
    assert sorted(kernel) == sorted(columns)
    assert A.assign_cells(df, 4).filter("digits is null").count() == 2
    assert A.assign_cells(df.limit(0), 4).count() == 0


def test_mate_has_the_same_last_digit_and_other_half(spark):
    rng = np.random.default_rng(2)
    x, y = rng.uniform(-0.2, 0.2, 400), rng.uniform(-0.2, 0.2, 400)
    for a, b in zip(x, y, strict=True):
        d, h, _ = address(a, b, 5)
        mx, my = A.centroid(d, h, mate=True)
        if -R.H / 3 < my <= 2 * R.H / 3 - abs(R.R3 * mx):
            md, mh, _ = address(mx, my, 5)
            assert mh != h and md[-1] == d[-1]
            back = A.centroid(md, mh, mate=True)
            assert address(*back, 5)[:2] == (d, h)


def test_subdivision_keeps_the_sphere_covered(spark):
    octant = spark.createDataFrame([("NPE", False, 1, 2, [0.0, 0.0, 1.0], [1.0, 0.0, 0.0], [0.0, 1.0, 0.0])], "name string, up boolean, gx int, gy int, p0 array<double>, p1 array<double>, p2 array<double>")

    def area(p):
        a, b, c = (np.array(v) for v in p)
        return 2 * math.atan2(abs(np.dot(a, np.cross(b, c))), 1 + a @ b + b @ c + c @ a)

    kids = M.subdivide_triangles(octant, 2, ["name"]).collect()
    assert len(kids) == 81
    assert abs(sum(area((r["p0"], r["p1"], r["p2"])) for r in kids) - math.pi / 2) < 1e-9
    halves = M.subdivide(octant, 3.0, 2).collect()
    assert len(halves) == 27
    assert all(abs(np.linalg.norm(p) - 1) < 1e-12 for r in halves for p in r["pts"])


def test_three_equal_edges(spark):
    rows = [([1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]), ([1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.6, 0.0, 0.8])]
    df = spark.createDataFrame(rows, "p0 array<double>, p1 array<double>, p2 array<double>")
    assert [r["equilateral"] for r in M.check_equilateral(df).collect()] == [True, False]


def test_cells_on_the_sphere_come_back(spark):
    """The centre of a cell lies in it, and the other half of its hexagon has this one as its other half."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(3000, 3))
    points = spark.createDataFrame([tuple(map(float, p)) for p in v / np.linalg.norm(v, axis=1, keepdims=True)], "x double, y double, z double")
    for level in (1, 2, 5):
        cells = G.assign_global(points, level).select("digits", "half").distinct()
        centres = G.global_centroids(cells).withColumnsRenamed({"digits": "d0", "half": "h0"})
        assert G.assign_global(centres, level, "cx", "cy", "cz").filter("d0 <> digits or h0 <> half").count() == 0
        mates = G.global_centroids(cells, mate=True).withColumnsRenamed({"digits": "d0", "half": "h0"})
        there = G.assign_global(mates, level, "mx", "my", "mz").select("d0", "h0", "digits", "half")
        assert there.filter("d0 = digits and h0 = half").count() == 0
        back = G.global_centroids(there.select("digits", "half").distinct(), mate=True).withColumnsRenamed({"digits": "d1", "half": "h1"})
        again = G.assign_global(back, level, "mx", "my", "mz").select("d1", "h1", "digits", "half")
        joined = there.join(again, (there["digits"] == again["d1"]) & (there["half"] == again["h1"])).filter((there["d0"] != again["digits"]) | (there["h0"] != again["half"]))
        assert joined.count() == 0
        sizes = G.global_canonical(cells, level).groupBy("canonical").count().collect()
        assert max(r["count"] for r in sizes) <= 2
