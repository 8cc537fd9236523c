"""Registered functions on odd values, and against the DataFrame operators."""

import pytest
from pyspark.sql import functions as F

from ninefold import extension
from ninefold.operators import addressing as A
from ninefold.operators import mesh as M


@pytest.fixture(scope="module")
def sql(spark):
    extension.register(spark)
    return spark.sql


def test_cells_of_odd_values(sql):
    rows = sql("""SELECT cell_of(x, y, c, l) AS cell FROM VALUES (0.1D, 0.2D, '021', 3), (null, 0.2D, '021', 3), (0.1D, double('nan'), '021', 3), (0.1D, 0.2D, 'x', 3), (0.1D, 0.2D, '021', 0), (0.1D, 0.2D, '021', 31), (0.1D, 0.2D, '021', 1), (0.1D, 0.2D, null, 2) AS t(x, y, c, l)""").collect()
    found = [r["cell"] for r in rows]
    assert [c is None for c in found] == [False, True, True, True, True, True, False, True]
    assert len(found[0]["digits"]) == 3 and found[0]["path"].startswith(found[6]["path"])


def test_the_worked_example(sql):
    cell = sql("SELECT cell_of(0.2924332269536584D, 0.28114591390120613D, '021', 30) AS c").first()["c"]
    assert cell["digits"] + cell["half"] == "520352116102665517712277467235V"
    centre = sql(f"SELECT cell_centre('{cell['digits']}', 'V') AS c").first()["c"]
    assert abs(centre["cx"] - 0.2924332269536584) < 1e-12 and abs(centre["cy"] - 0.28114591390120613) < 1e-12
    assert sql("SELECT cell_centre(null, 'V') AS a, cell_centre('5x', 'V') AS b, cell_centre('52', null) AS c").first() == (None, None, None)


def test_children_are_those_of_the_operator(spark, sql):
    paths = spark.createDataFrame([("5Λ2Λ",), ("8V",), ("0Λ",)], "path string")
    mine = sorted((r["path"], r["child_path"]) for r in A.children(paths).collect())
    paths.createOrReplaceTempView("some_paths")
    assert sorted(tuple(r) for r in sql("SELECT path, child_path FROM some_paths, LATERAL cell_children(path)").collect()) == mine and len(mine) == 27
    assert sql("SELECT * FROM VALUES (string(null)), ('') AS t(path), LATERAL cell_children(path)").count() == 0
    assert [tuple(r) for r in sql("SELECT * FROM cell_ancestors('NPΛ3V')").collect()] == [(1, "NPΛ"), (2, "NPΛ3V")]


def test_triangles_are_those_of_the_operator(spark, sql, monkeypatch):
    rows = [(1, [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]), (2, [0.0, 0.0, 1.0], [-1.0, 0.0, 0.0], [0.0, -1.0, 0.0])]
    df = spark.createDataFrame(rows, "key long, p0 array<double>, p1 array<double>, p2 array<double>")
    df.createOrReplaceTempView("some_triangles")
    flat = lambda d: {(r["key"], r["path"]): [round(x, 9) + 0.0 for c in range(3) for x in r[f"p{c}"]] for r in d.collect()}
    for depth in (0, 1, 3):
        assert flat(sql(f"SELECT * FROM triangle_children(TABLE(some_triangles), {depth})")) == flat(M.subdivide_triangles(df, depth, ["key"]))
    assert sql("SELECT * FROM triangle_children(TABLE(SELECT * FROM some_triangles WHERE key > 5), 2)").count() == 0
    with pytest.raises(Exception, match="depth must be"):
        sql("SELECT * FROM triangle_children(TABLE(some_triangles), 99)").collect()


def test_global_centres(spark, sql, sf_dir):
    from ninefold.operators import globe as G
    from ninefold.plans.sql import directions

    cells = G.assign_global(directions(spark, sf_dir), 4).select("digits", "half").distinct()
    mine = {(r["digits"], r["half"]): tuple(round(r[c], 9) for c in ("cx", "cy", "cz")) for r in G.global_centroids(cells).collect()}
    found = cells.select("digits", "half", F.call_function("global_cell_centre", "digits", "half").alias("c")).collect()
    assert {(r["digits"], r["half"]): tuple(round(x, 9) for x in r["c"]) for r in found} == mine
