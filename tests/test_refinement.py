"""Refinement that addresses what is left, and sketches merged up the tree."""

import pytest
from pyspark.sql import functions as F

from ninefold.operators import addressing as A
from ninefold.operators import cells as C
from ninefold.operators import sketches as K
from ninefold.plans.sql import planar


def test_only_points_that_share_a_cell_go_on(spark):
    pairs = [(2 * k + d, 0.1 + 0.0017 * k + d * 10.0**-e, 0.05, "021") for k, e in enumerate((3, 6, 9, 12) * 3) for d in (0, 1)]
    points = spark.createDataFrame([*pairs, (90, 0.2, 0.2, "021"), (91, 0.2, 0.2, "021"), (92, 0.2, 0.2, "021"), (93, None, 0.1, "021"), (94, -0.2, 0.0, "021")], "id long, x double, y double, c2 string")
    seen = []

    def address(some, level):
        seen.append((level, some.count()))
        return A.assign_cells(some, level)

    found = {r["id"]: r["level"] for r in C.refined_level(points, "id", address).collect()}
    assert [level for level, _ in seen] == [6, 12, 18, 24, 30]
    counts = [n for _, n in seen]
    assert counts[0] == 24 + 1 + 2 and counts == sorted(counts, reverse=True) and counts[2] <= 20 and counts[-1] <= 10
    assert found[90] is found[91] is found[92] is found[93] is None and found[94] <= 3
    whole = {r["id"]: r["level"] for r in C.adaptive_level(A.assign_cells(points, 30).filter("path is not null"), "id", 30).collect()}
    assert {k: v for k, v in found.items() if k != 93} == whole and max(v for v in found.values() if v) > 20


def test_refinement_stops_when_all_are_alone(spark):
    points = spark.createDataFrame([(1, 0.1, 0.0, "021"), (2, -0.1, 0.1, "021")], "id long, x double, y double, c2 string")
    levels = []
    found = C.refined_level(points, "id", lambda some, level: levels.append(level) or A.assign_cells(some, level), 4, 30)
    assert levels == [4] and found.filter("level is null").count() == 0
    assert C.refined_level(points.limit(0), "id", A.assign_cells).count() == 0


@pytest.fixture(scope="module")
def cells(spark, sf_dir):
    return A.assign_cells(planar(spark, sf_dir, "lineitem", ("l_orderkey", "l_extendedprice")), 5)


def test_sketches_merge_to_what_one_pass_gives(cells):
    stored = K.sketch_cells(cells, 5, "l_orderkey", "l_extendedprice")
    merged = K.estimates(K.merge_up(stored, 5, [5, 3, 1]), [0.0, 0.5, 1.0]).collect()
    assert {r["level"] for r in merged} == {5, 3, 1} and len({(r["level"], r["cell"]) for r in merged}) == len(merged)
    for level in (3, 1):
        exact = cells.groupBy(C.prefix(level).alias("cell")).agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("d"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high")).collect()
        mine = {r["cell"]: r for r in merged if r["level"] == level}
        assert len(mine) == len(exact)
        for e in exact:
            m = mine[e["cell"]]
            assert m["n"] == e["n"] and abs(m["distinct"] - e["d"]) <= 0.08 * e["d"] and (m["quantiles"][0], m["quantiles"][2]) == (e["low"], e["high"])


def test_sketches_of_nothing(cells):
    assert K.merge_up(K.sketch_cells(cells.limit(0), 5, "l_orderkey", "l_extendedprice"), 5, [1, 2]).count() == 0


def test_items_are_counted_by_first_levels(cells):
    odd = cells.withColumn("l_orderkey", F.when(F.col("l_orderkey") % 10 > 0, F.col("l_orderkey") % 200))
    rows = K.first_levels(odd, "l_orderkey", 5)
    plan = rows.groupBy(C.prefix(5).alias("cell")).agg(F.count_if(F.col("first_level") <= 5))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    assert rows.count() == odd.count()
    for level in (1, 3, 5):
        exact = {tuple(r) for r in odd.groupBy(C.prefix(level).alias("cell")).agg(F.count_distinct("l_orderkey")).collect()}
        assert exact == {tuple(r) for r in rows.groupBy(C.prefix(level).alias("cell")).agg(F.count_if(F.col("first_level") <= level)).collect()}


def test_neighbours_of_other_partitions_count(spark):
    """Rows in one row each of many parts, in crowded cells cut by ranges, and many places shared by several."""
    rows = [(k, 0.1 + (k % 40) * 10.0 ** -(3 + k % 5), 0.05, "021") for k in range(120)] + [(200 + k, 0.2 + k * 1e-8, 0.1, "021") for k in range(60)]
    points = spark.createDataFrame(rows, "id long, x double, y double, c2 string").repartition(7)
    whole = C.adaptive_level(A.assign_cells(points, 30), "id", 30).collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "150"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert sorted(C.refined_level(points, "id", A.assign_cells).collect()) == sorted(whole)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_round_addresses_its_points_once(spark):
    """Places that hold several points leave with the round in which no other place shares their cell."""
    points = spark.createDataFrame([(k, 0.1 + 0.02 * (k // 2), 0.05, "021") for k in range(20)] + [(50, 0.2, 0.2, "021"), (51, 0.2 + 1e-9, 0.2, "021")], "id long, x double, y double, c2 string")
    rows = spark.sparkContext.accumulator(0)

    def address(some, level):
        def counted(batches):
            for batch in batches:
                rows.add(batch.num_rows)
                yield batch

        return A.assign_cells(some.mapInArrow(counted, some.schema), level)

    found = {r["id"]: r["level"] for r in C.refined_level(points, "id", address).collect()}
    assert all(found[k] is None for k in range(20)) and found[50] == found[51] > 12
    assert rows.value == 12 + 2 * (-(-found[50] // 6) - 1)
