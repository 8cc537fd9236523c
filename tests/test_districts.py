"""Districts written back to triangle pixels: shuffled once, and in tasks of bounded size."""

from pyspark.sql import functions as F

from ninefold.operators import mesh as M
from ninefold.operators import raster as X
from ninefold.plans import raster_queries as Q


def test_districts_find_their_pixels_without_a_join_of_rows(spark):
    hexes = spark.range(40).selectExpr("CAST(id % 8 AS INT) AS hx", "CAST(id div 8 AS INT) AS hy")
    colours = hexes.withColumn("district", F.explode(F.sequence(F.lit(0), F.lit(17)))).selectExpr("*", "hx*1000 + hy*100 + district AS r")
    colours = colours.unionByName(spark.createDataFrame([(None, 1, 3, -1), (1, None, 3, -1), (1, 1, None, -1)], "hx int, hy int, district int, r int"))
    height, width = 30, 70
    out = X.district_to_tri(colours, height, width)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1
    last = {}
    clamp = lambda v, n: max(0, min(n - 1, v))
    for hy, hx, d, k in sorted((y, x, d, k) for x in range(8) for y in range(5) for d in range(18) for k in range(3)):
        dx, dy = X.NINE[d][k]
        last[clamp(hy * 6 - (hx % 2) * 3 + dy, height), clamp(hx * 9 + dx, width)] = hx * 1000 + hy * 100 + d
    found = out.collect()
    assert len(found) == len(last) and {(r["row"], r["col"]): r["r"] for r in found} == last


def test_tasks_do_not_grow_with_the_raster(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(Q, "TASK_PIXELS", 100)
    plan = Q.g6_district_to_tri(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
    height = -(-spark.read.parquet(f"{sf_dir}/orders.parquet").count() // Q.W)
    assert f", {-(-height * Q.W // 100)})" in plan


def test_canvas_is_covered_by_columns_and_rows(spark):
    for columns, rows, a in ((1, 1, 9.0), (5, 8, 9.0), (12, 7, 2.5)):
        width, height = M.size_for(columns, rows, a)
        polygons = M.cover(M.canvas_hexes(spark, width, height, a), width, height, a)
        whole = {tuple(r) for r in polygons.select("hx", "hy", "district", *[F.round(F.col("polygon")[k][i], 4) + F.lit(0.0) for k in range(4) for i in range(2)]).collect()}
        out = M.canvas_cover(spark, width, height, a, 4)
        found = out.collect()
        assert whole and len(found) == len(whole) and {tuple(r) for r in found} == whole
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "round" not in plan[: plan.index("Join")]  # no corner is rounded for each district of the canvas
