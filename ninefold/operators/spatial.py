"""Nearest neighbours over a tree of boxes whose leaves hold a bounded number of points."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ninefold.functions.storage import checkpointed

#: Points of a leaf, nodes under a node, and the most nodes of a level that are broadcast (64 bytes each).
LEAF_POINTS = 128
FANOUT = 32
BROADCAST_NODES = 4096
#: Bits of each axis of the curve that points are sorted by; its squares are some centimetres wide.
CURVE_BITS = 30

_AXES = ("x", "y", "z")
_BOX = [f"{side}{c}" for c in _AXES for side in ("low_", "high_")]


@dataclass
class Tree:
    """leaves: leaf and its points (id, x, y, z) as an array. levels: the boxes of the nodes of each
    level, from the top (FANOUT nodes at most) to the leaves: node, parent, low and high of each axis,
    start (where it begins on the curve), n. sizes: number of nodes of each level."""

    leaves: DataFrame
    levels: list[DataFrame]
    sizes: list[int]


def curve_places(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Places of directions on a Hilbert curve over the unfolded octahedron; -1 where there is none.

    Neighbours on the curve are neighbours on the sphere, so any stretch of it lies close together. A
    stretch of addresses does not: children of a cell that follow each other need not touch."""
    total = np.abs(x) + np.abs(y) + np.abs(z)
    known = np.isfinite(total) & (total > 0)
    u, v = (np.where(known, c, 0.0) / np.where(known, total, 1.0) for c in (x, y))
    south = z < 0
    u, v = np.where(south, np.copysign(1 - np.abs(v), u), u), np.where(south, np.copysign(1 - np.abs(u), v), v)
    most = (1 << CURVE_BITS) - 1
    i, j = (np.clip(((c + 1) / 2 * (most + 1)).astype(np.int64), 0, most) for c in (u, v))
    out = np.zeros(len(x), np.int64)
    for bit in range(CURVE_BITS - 1, -1, -1):
        right, up = i >> bit & 1, j >> bit & 1
        out = out << 2 | (3 * right ^ up)
        i, j = np.where((up == 0) & (right == 1), most - i, i), np.where((up == 0) & (right == 1), most - j, j)
        i, j = np.where(up == 0, j, i), np.where(up == 0, i, j)
    return np.where(known, out, -1)


def _on_curve(points: DataFrame) -> DataFrame:
    """The points with curve, their place on it."""
    schema = T.StructType([*points.schema, T.StructField("curve", T.LongType())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            places = curve_places(*(batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in _AXES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places)], schema.names)

    return points.mapInArrow(run, schema)


def build_tree(points: DataFrame, k: int = 1, point_id: str = "point_id") -> Tree:
    """A tree over points (x, y, z), of which each place keeps its k smallest ids.

    Points are sorted along a curve, so neighbours in the order lie side by side, and cut into leaves
    of LEAF_POINTS; leaves and nodes are grouped in order. A dense city has more leaves and not larger
    ones, however dense it is."""
    rows = points.select(F.col(point_id).alias("id"), *[F.col(c).cast("double").alias(c) for c in _AXES]).filter("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
    first = Window.partitionBy(*_AXES).orderBy("id")
    rows = rows.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k).drop("place")
    order = ["curve", "id"]
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _on_curve(rows).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = checkpointed(dealt.select("id", *_AXES, "curve", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place")))
    sizes = placed.groupBy("part").agg(F.count("*").alias("size"))  # a row for each partition
    before = sizes.select("part", F.coalesce(F.expr("sum(size) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"), F.lit(0)).alias("before"))
    numbered = placed.join(F.broadcast(before), "part").select("id", *_AXES, "curve", F.expr(f"(before + place) div {LEAF_POINTS}").alias("leaf"))
    leaves = checkpointed(numbered.groupBy("leaf").agg(F.collect_list(F.struct("id", *_AXES)).alias("points"), F.min("curve").alias("start")))
    side = lambda c, least: (F.array_min if least else F.array_max)(F.col(f"points.{c}"))
    level = leaves.select(F.col("leaf").alias("node"), *[side(c, low).alias(f"{'low' if low else 'high'}_{c}") for c in _AXES for low in (True, False)], "start", F.size("points").cast("long").alias("n"))
    levels, counts = [], [leaves.count()]
    while True:
        level = checkpointed(level.withColumn("parent", F.expr(f"node div {FANOUT}")))
        levels.insert(0, level)
        if counts[0] <= FANOUT:
            return Tree(leaves, levels, counts)
        boxes = [F.min(c).alias(c) if c.startswith("low") else F.max(c).alias(c) for c in _BOX]
        level = level.groupBy(F.col("parent").alias("node")).agg(*boxes, F.min("start").alias("start"), F.sum("n").alias("n"))
        counts.insert(0, -(-counts[0] // FANOUT))


def _near_and_far() -> tuple[Column, Column]:
    """Distance of x, y, z from the nearest and the farthest place of a box."""
    near = far = F.lit(0.0)
    for c in _AXES:
        low, high, at = F.col(f"low_{c}"), F.col(f"high_{c}"), F.col(c)
        outside = F.greatest(low - at, at - high, F.lit(0.0))
        across = F.greatest(F.abs(at - low), F.abs(at - high))
        near, far = near + outside * outside, far + across * across
    return F.sqrt(near), F.sqrt(far)


def _within(distance: Column, bound: Column) -> Column:
    """Rounding aside, no farther than the bound, if there is one."""
    return bound.isNull() | (distance <= bound * (1 + 1e-12) + 1e-15)


def _own_leaf(queries: DataFrame, tree: Tree, query_id: str) -> DataFrame:
    """The leaf of the stretch of the curve that each query lies in: query_id, x, y, z, leaf."""
    rows = _on_curve(queries).withColumn("at", F.lit(0).cast("long"))
    columns = [query_id, *_AXES, "curve"]
    for level, size in zip(tree.levels, tree.sizes, strict=True):
        met = rows.join(_boxes(level, size), "at")
        here = F.max_by("node", F.when(F.col("start") <= F.col("curve"), F.col("node")))
        rows = met.groupBy(*columns).agg(F.coalesce(here, F.min("node")).alias("at"))
    return rows.select(query_id, *_AXES, F.col("at").alias("leaf"))


def _boxes(level: DataFrame, size: int) -> DataFrame:
    """The nodes of a level by their parent (at)."""
    boxes = level.select(F.col("parent").alias("at"), "node", *_BOX, "start", "n")
    return F.broadcast(boxes) if size <= BROADCAST_NODES else boxes


def _known(queries: DataFrame, query_id: str) -> DataFrame:
    rows = queries.select(query_id, *[F.col(c).cast("double").alias(c) for c in _AXES])
    return rows.filter("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")


def candidate_leaves(queries: DataFrame, tree: Tree, k: int, query_id: str = "query_id") -> DataFrame:
    """Leaves that may hold one of the k nearest points of each query, nearest leaf first: query_id,
    x, y, z, leaf, near (distance of its box) and turn (from 1)."""
    rows = _leaves_within(_known(queries, query_id).withColumn("bound", F.lit(None).cast("double")), tree, k, query_id)
    turn = F.row_number().over(Window.partitionBy(query_id).orderBy("near", "leaf"))
    return rows.select(query_id, *_AXES, "leaf", "near", turn.alias("turn"))


def _leaves_within(queries: DataFrame, tree: Tree, k: int, query_id: str) -> DataFrame:
    """The queries (query_id, x, y, z, bound and others) with each leaf that may hold one of their k
    nearest points, and near, the distance of its box.

    A query goes down all levels with the nodes it may need. A node with k points bounds the k-th
    distance by its farthest corner, if no nearer bound is given; nodes beyond the bound are left out."""
    columns = [c for c in queries.columns if c != "bound"]
    rows = queries.select(*columns, F.lit(0).cast("long").alias("at"), "bound")
    near, far = _near_and_far()
    of_query = Window.partitionBy(query_id)
    for level, size in zip(tree.levels, tree.sizes, strict=True):
        met = rows.join(_boxes(level, size), "at")
        met = met.select(*columns, "node", "bound", near.alias("near"), F.when(F.col("n") >= k, far).alias("far")).filter(_within(F.col("near"), F.col("bound")))
        met = met.withColumn("bound", F.least(F.col("bound"), F.min("far").over(of_query)))
        rows = met.filter(_within(F.col("near"), F.col("bound"))).select(*columns, F.col("node").alias("at"), "bound", "near")
    return rows.withColumnRenamed("at", "leaf")


def nearest(queries: DataFrame, points: DataFrame, k: int = 1, query_id: str = "query_id", point_id: str = "point_id") -> DataFrame:
    """The k points (x, y, z) nearest to each query (x, y, z) in chord distance: ids, rank, dist.

    Each query opens the leaf that it lies in, and goes down the tree with the k-th distance found
    there as its bound, to leaves that may hold nearer points; only points within the bound leave them,
    and at most k for each query leave a task. Ties go to the smaller id; of points in one place the k
    smallest ids count. With fewer than k points all are returned. Rows with a null coordinate take no
    part."""
    tree = build_tree(points, k, point_id)

    def away(p: Column) -> Column:
        return F.sqrt(sum(((F.col(c) - p[c]) * (F.col(c) - p[c]) for c in _AXES[1:]), (F.col("x") - p["x"]) * (F.col("x") - p["x"])))

    found = F.transform("points", lambda p: F.struct(away(p).alias("dist"), p["id"].alias(point_id)))
    own = _own_leaf(_known(queries, query_id), tree, query_id)
    first = checkpointed(own.join(tree.leaves, "leaf").select(query_id, *_AXES, "leaf", F.slice(F.array_sort(found), 1, k).alias("found")))
    bounded = first.select(query_id, *_AXES, F.col("leaf").alias("opened"), F.when(F.size("found") >= k, F.element_at("found", -1)["dist"]).alias("bound"))
    others = _leaves_within(bounded, tree, k, query_id).filter("leaf <> opened")
    met = others.join(tree.leaves, "leaf").select(query_id, *_AXES, "bound", F.explode("points").alias("p"))
    rest = met.select(query_id, away(F.col("p")).alias("dist"), F.col("p")["id"].alias(point_id), "bound").filter(_within(F.col("dist"), F.col("bound"))).drop("bound")
    each = first.select(query_id, F.explode("found").alias("f")).select(query_id, "f.*").unionByName(rest)
    place = Window.partitionBy(query_id).orderBy("dist", point_id)
    return each.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
