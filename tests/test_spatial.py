"""Nearest neighbours over the tree against brute force, and its bounds on dense places."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ninefold.operators import spatial


def on_sphere(rng, n, lat, lon, width):
    out = []
    for _ in range(n):
        p, q = math.radians(lat + width * (rng.random() - 0.5)), math.radians(lon + width * (rng.random() - 0.5))
        out.append((math.cos(p) * math.cos(q), math.cos(p) * math.sin(q), math.sin(p)))
    return out


def table(spark, rows, name):
    return spark.createDataFrame([(k, *p) for k, p in rows], f"{name} long, x double, y double, z double")


def expected(queries, points, k):
    out = []
    for q, a in queries:
        near = sorted((math.sqrt(sum((u - v) ** 2 for u, v in zip(a, b, strict=True))), i) for i, b in points)[:k]
        out += [(q, r + 1, i, round(d, 9)) for r, (d, i) in enumerate(near)]
    return sorted(out)


def found(spark, queries, points, k):
    rows = spatial.nearest(table(spark, queries, "query_id"), table(spark, points, "point_id"), k).collect()
    return sorted((r["query_id"], r["rank"], r["point_id"], round(r["dist"], 9)) for r in rows)


@pytest.fixture()
def small(monkeypatch):
    monkeypatch.setattr(spatial, "LEAF_POINTS", 8)
    monkeypatch.setattr(spatial, "FANOUT", 4)


@pytest.fixture(scope="module")
def city():
    """Nine tenths of points and queries within a hundredth of a degree, some in one place."""
    rng = random.Random(2)
    points = on_sphere(rng, 900, 48.85, 2.35, 0.01) + on_sphere(rng, 100, 0, 0, 170)
    points[100:140] = [points[0]] * 40
    queries = on_sphere(rng, 60, 48.85, 2.35, 0.01) + on_sphere(rng, 20, 0, 0, 170) + [points[0], points[5], (1.0, 0.0, 0.0), (0.0, 0.0, -1.0)]
    rng.shuffle(points)
    return list(enumerate(queries)), list(enumerate(points))


@pytest.mark.parametrize("k", [1, 6, 50])
def test_equals_brute_force(spark, small, city, k):
    assert found(spark, *city, k) == expected(*city, k)


def test_lower_levels_without_broadcast(spark, small, city, monkeypatch):
    monkeypatch.setattr(spatial, "BROADCAST_NODES", 0)
    assert found(spark, *city, 3) == expected(*city, 3)


def test_leaves_stay_small_where_points_are_dense(spark, small, city):
    queries, points = city
    tree = spatial.build_tree(table(spark, points, "point_id"), 3)
    held = [r["n"] for r in tree.leaves.select(F.size("points").alias("n")).collect()]
    assert max(held) == 8 and sum(held) == 1000 - 41 + 3  # 41 points share a place, three stay
    opened = spatial.candidate_leaves(table(spark, queries, "query_id"), tree, 3).groupBy("query_id").count()
    counts = sorted(r["count"] for r in opened.collect())
    assert len(counts) == len(queries) and counts[len(counts) // 2] <= 20 and counts[-1] <= 40 < len(held)
    per_leaf = [r["count"] for r in spatial.candidate_leaves(table(spark, queries, "query_id"), tree, 3).filter("turn = 1").groupBy("leaf").count().collect()]
    assert max(per_leaf) <= len(queries) // 4  # no leaf answers for the whole city


def test_few_points_and_odd_rows(spark):
    queries, points = [(1, (1.0, 0.0, 0.0)), (2, (0.0, 0.0, 0.0))], [(7, (0.0, 1.0, 0.0)), (5, (0.0, 1.0, 0.0)), (9, (0.0, 0.0, 0.0))]
    assert found(spark, queries, points, 5) == expected(queries, points, 5)
    odd = table(spark, [(3, (None, 0.0, 1.0))], "query_id")
    assert spatial.nearest(odd, table(spark, points, "point_id")).count() == 0
    assert spatial.nearest(table(spark, queries, "query_id"), table(spark, points, "point_id").filter("false")).count() == 0
    assert spatial.nearest(table(spark, queries, "query_id").filter("false"), table(spark, points, "point_id")).count() == 0


def test_leaves_lie_close_together(spark, small):
    """On even points, few boxes hold a place, as leaves are stretches of a curve without jumps."""
    points = list(enumerate(on_sphere(random.Random(3), 4000, 48.85, 2.35, 0.01)))
    tree = spatial.build_tree(table(spark, points, "point_id"), 5)
    known = spatial._known(table(spark, points[:400], "query_id"), "query_id")
    assert all(r["n"] >= 1 for r in spatial._own_leaf(known, tree, "query_id").groupBy("query_id").agg(F.count("*").alias("n")).collect())
    first = spatial._own_leaf(known, tree, "query_id").join(tree.leaves, "leaf").filter(F.exists("points", lambda p: p["id"] == F.col("query_id")))
    assert first.count() == 400  # each opens the leaf that holds it
    counts = sorted(r["count"] for r in spatial.candidate_leaves(table(spark, points[:400], "query_id"), tree, 5).filter("near = 0").groupBy("query_id").count().collect())
    assert len(counts) == 400 and sum(counts) <= 5 * 400 and counts[-1] <= 20


def test_the_curve_has_no_jumps():
    """Places that follow each other on the curve touch, on both halves of the sphere."""
    side = 64
    for south in (1, -1):
        u, v = (a.ravel() for a in np.meshgrid(*[(np.arange(-side, side) + 0.5) / side] * 2))
        inside = np.abs(u) + np.abs(v) < 1
        u, v = u[inside], v[inside]
        w = south * (1 - np.abs(u) - np.abs(v))
        order = np.argsort(spatial.curve_places(u, v, w))
        step = np.abs(np.diff(u[order])) + np.abs(np.diff(v[order]))
        assert np.mean(step < 1.5 / side) > 0.9
    assert list(spatial.curve_places(*np.array([[0.0, np.nan, np.inf, 1.0]] * 3))[:3]) == [-1, -1, -1]
