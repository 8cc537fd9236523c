"""Rasters as tiles against the long form."""

import pytest

from ninefold.operators import raster as X
from ninefold.operators import tiles as T

H, W = 37, 53


@pytest.fixture(scope="module")
def image(spark):
    """A raster with holes."""
    return spark.range(H * W).filter("id % 11 <> 3").selectExpr(f"CAST(id div {W} AS INT) AS row", f"CAST(id % {W} AS INT) AS col", "CAST(id * 7 % 256 AS INT) AS r", "CAST(id * id % 256 AS INT) AS g", "CASE WHEN id % 13 <> 0 THEN CAST(id % 5 AS INT) END AS b")


@pytest.fixture(scope="module")
def points(spark):
    return spark.range(4000).selectExpr("id", "CAST(id * 31 % 40 AS INT) AS row", "CAST(id * 17 % 60 AS INT) AS col", "string(id) AS r")


def rows(df):
    return sorted(map(repr, df.select("id", "row", "col", "r", "g").collect()))


@pytest.mark.parametrize("side", [8, 64])
@pytest.mark.parametrize("few", [True, False])
def test_pixels_are_those_of_the_long_form(spark, image, points, monkeypatch, side, few):
    monkeypatch.setattr(T, "BROADCAST_TILES", 1 << 16 if few else 0)
    monkeypatch.setattr(T, "GROUP_POINTS", 1 << 20 if few else 20)  # many shares of each tile
    tiles = T.to_tiles(image, side)
    assert tiles.count() == -(-H // side) * -(-W // side) and all(len(r["r"]) == side * side for r in tiles.collect())
    expected = points.drop("r").join(image, ["row", "col"])
    assert rows(T.read_pixels(points, tiles, H, W, side)) == rows(expected)


def test_a_crowded_tile_is_shared_out(spark, image, monkeypatch):
    monkeypatch.setattr(T, "GROUP_POINTS", 100)
    crowd = spark.range(3000).selectExpr("id", "0 AS row", "CAST(id % 3 AS INT) AS col").unionAll(spark.range(5).selectExpr("id", "30 AS row", "CAST(id AS INT) AS col"))
    found = T.read_pixels(crowd, T.to_tiles(image, 8), H, W, 8)
    assert found.count() == crowd.join(image, ["row", "col"]).count() > 2900


def test_windows_and_odd_rows(spark, image):
    tiles = T.to_tiles(image, 16)
    centres = spark.createDataFrame([(1, 10.0, 20.0), (2, 89.0, -179.0), (3, None, 5.0), (4, float("nan"), 5.0)], "id long, lat double, lon double")
    extent = (-90.0, 90.0, -180.0, 180.0)
    mine = T.resample_tiles(centres, tiles, 7.0, 5, extent, H, W, side=16)
    whole = X.resample_window(centres, image, 7.0, 5, extent, H, W)
    columns = ["id", "wrow", "wcol", "row", "col", "r", "g", "b"]
    assert sorted(map(repr, mine.select(columns).collect())) == sorted(map(repr, whole.select(columns).collect())) and mine.count() > 40
    assert T.read_pixels(spark.createDataFrame([], "id long, row int, col int"), tiles, H, W, 16).count() == 0
    assert T.to_tiles(image.limit(0), 16).count() == 0


def test_repeated_pixels_keep_the_greatest(spark):
    twice = spark.createDataFrame([(0, 0, 5), (0, 0, 9), (0, 0, None), (1, 1, -3)], "row int, col int, v int")
    assert T.to_tiles(twice, 2).first()["v"] == [9, None, None, -3]


def test_points_are_shuffled_once(spark, image, points):
    plan = T.read_pixels(points, T.to_tiles(image, 8), H, W, 8)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "FlatMapCoGroupsInArrow" in plan
