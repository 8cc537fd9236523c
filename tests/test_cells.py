"""The cell store's layout, upserts and skipping; hexagons and their children."""

import glob
from collections import Counter

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from ninefold.operators import addressing as A
from ninefold.operators import cells as C
from ninefold.operators import globe as G
from ninefold.plans import cell_queries
from ninefold.plans.sql import planar


def files(path):
    return glob.glob(f"{path}/ancestor=*/*.parquet")


def scanned(df):
    """Rows that the file scan gave to the plan."""
    df.collect()
    todo, rows = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        plan = todo.pop()
        if plan.nodeName().startswith("AdaptiveSparkPlan"):
            plan = plan.executedPlan()
        if "Scan parquet" in plan.nodeName():
            rows += plan.metrics().apply("numOutputRows").value()
        children = plan.children()
        todo += [children.apply(k) for k in range(children.size())]
    return rows


def test_files_are_few_and_sorted(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "FILE_ROWS", 1000)
    cells = A.assign_cells(planar(spark, sf_dir, "lineitem").repartition(16), 6).select("path", "x")
    path = str(tmp_path / "store")
    C.write_cells(cells, path, 1)
    n, ancestors = cells.count(), cells.select(C.prefix(1)).distinct().count()
    assert len(files(path)) <= ancestors + -(-n // 1000) and sum(pq.read_metadata(f).num_rows for f in files(path)) == n
    spans = []
    for f in files(path):
        paths = pq.read_table(f, columns=["path"]).column(0).to_pylist()
        assert paths == sorted(paths)
        spans.append((paths[0], paths[-1]))
    spans.sort()
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))  # files do not overlap


def test_prefix_reads_skip_row_groups(spark, sf_dir, tmp_path):
    cells = A.assign_cells(planar(spark, sf_dir, "lineitem"), 6).select("path", "x")
    path = str(tmp_path / "store")
    spark.conf.set("parquet.block.size", 8192)
    try:
        C.write_cells(cells, path, 1)
    finally:
        spark.conf.unset("parquet.block.size")
    folder = next(f for f in files(path) if "5" in f.split("ancestor=")[1][:2])
    assert pq.read_metadata(folder).num_row_groups > 2
    one = C.read_cells(spark, path, "5Λ2Λ4", 1)
    wanted = cells.filter(F.col("path").startswith("5Λ2Λ4")).count()
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(path,5Λ2Λ4)" in plan and "PartitionFilters: [isnotnull(ancestor" in plan
    read = scanned(one)
    assert one.count() == wanted > 0 and wanted <= read < cells.filter(F.col("path").startswith("5Λ")).count() / 2


def test_upsert_touches_its_ancestors_only(spark, tmp_path):
    path = str(tmp_path / "store")
    old = [("0Λ1Λ", 1), ("0Λ2Λ", 2), ("5Λ1Λ", 3), ("7V0V", 4)]
    C.write_cells(spark.createDataFrame(old, "path string, n long"), path, 1)
    before = {f: pq.read_table(f).num_rows for f in files(path)}
    C.upsert_cells(spark.createDataFrame([("0Λ2Λ", 20), ("0Λ3Λ", 30), ("8V1V", 40)], "path string, n long"), path, 1)
    kept = [f for f in before if "ancestor=0" not in f]
    assert set(kept) <= set(files(path)) and len(kept) == 2
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("path", "n").collect()) == [("0Λ1Λ", 1), ("0Λ2Λ", 20), ("0Λ3Λ", 30), ("5Λ1Λ", 3), ("7V0V", 4), ("8V1V", 40)]
    C.upsert_cells(spark.createDataFrame([], "path string, n long"), path, 1)
    assert spark.read.parquet(path).count() == 6


def test_each_hexagon_is_owned_once(spark, sf_dir):
    """Over all hexagons of a level on the sphere: eighteen halves each, every child hexagon whole and
    owned by exactly one of the two that share it."""
    many = spark.range(20_000).selectExpr("id", "1 - (2 * id + 1) / 20000D AS z").selectExpr("sqrt(1 - z*z) * cos(id * 2.39996323D) AS x", "sqrt(1 - z*z) * sin(id * 2.39996323D) AS y", "z")
    kids = G.global_hexagon_children(G.assign_global(many, 2), 2).collect()
    assert set(Counter(r["hexagon"] for r in kids).values()) == {18} and len(kids) == 8 * 3 * 9 * 9
    halves: dict = {}
    for r in kids:
        halves.setdefault(r["canonical"], []).append((r["hexagon"], r["owned"]))
    assert all(len(x) == 2 for x in halves.values())
    assert all(len({h for h, owned in x if owned}) == 1 for x in halves.values())
    owned = Counter(h for x in halves.values() for h in {h for h, o in x if o})
    assert sum(owned.values()) == len(halves) and Counter(owned.values()).most_common(1)[0][0] == 9


def test_hexagons_of_one_triangle(spark):
    """At the triangle's edge a hexagon has one half only, and nine children below it."""
    cells = A.assign_cells(spark.range(20_000).selectExpr("(id % 141) / 100D - 0.7D AS x", "(id div 141) / 115D - 0.4D AS y", "'021' AS c2"), 2)
    whole = A.mates(cells.select("digits", "half").distinct()).collect()
    assert {r["mate"] is None for r in whole} == {True, False} and all(r["mate_half"] != r["half"] for r in whole if r["mate"])
    kids = Counter(r["hexagon"] for r in A.hexagon_children(cells).collect())
    assert set(kids.values()) == {9, 18}


def test_colocated_cells_bring_back_keys_and_paths_only(spark, sf_dir, monkeypatch):
    """All that is shuffled for a pair is a key and a path, and no other column comes back from Python."""
    points = planar(spark, sf_dir, "orders", ("o_orderkey",))
    whole, part = A.assign_cells(points, 6), A.assign_cells(points, 6, only=("o_orderkey", "path"))
    assert part.columns == ["o_orderkey", "path"] and sorted(part.collect()) == sorted(whole.select("o_orderkey", "path").collect())
    made = []
    kernel = A._kernel
    monkeypatch.setattr(A, "_kernel", lambda *a: made.append(kernel(*a)) or made[-1])
    cell_queries.j4_colocate(spark, sf_dir)
    assert [m.columns for m in made] == [["o_orderkey", "path"], ["event_id", "path"]]
