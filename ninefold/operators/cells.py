"""Analytics over cells. Every function takes points that have a `path` (and a `root`, if given)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ninefold.functions import rules as R
from ninefold.functions.storage import checkpointed

from .addressing import assign_cells, cell_centroids


def prefix(level: int, path: str = "path", root: bool = False) -> Column:
    """The ancestor of a path at a level: two characters a level; a root's name has one more."""
    return F.substring(path, 1, 2 * level + int(root))


def split_scope(points: DataFrame, kind: str = "Λ", x: str = "x", y: str = "y") -> DataFrame:
    """The points with in_scope: whether they lie in the triangle."""
    third, dx = F.lit(R.H / 3), F.abs(F.lit(R.R3) * F.col(x))
    py = F.col(y)
    inside = (py > -third) & (py <= 2 * third - dx) if kind == "Λ" else (py <= third) & (py > -2 * third + dx)
    return points.withColumn("in_scope", F.coalesce(inside, F.lit(False)))


def cell_density(cells: DataFrame, keys: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Points, and their weight, of each cell."""
    aggs = [F.count("*").alias("n")] + ([F.sum(F.col(weight).cast("decimal(18,2)")).cast("double").alias("weight")] if weight else [])
    return cells.groupBy(*(keys or ["digits", "half"])).agg(*aggs)


def cell_rollup(cells: DataFrame, levels: list[int], root: bool = False) -> DataFrame:
    """Points of each ancestor at the levels, and in total: level (0 for the total), cell, n.

    Points are counted at the finest level first, so the rollup expands cells and not points."""
    names = [f"p{k}" for k in levels]
    finest = cells.groupBy(prefix(max(levels), root=root).alias("__path")).agg(F.count("*").alias("__n"))
    ancestors = finest.select("__n", *[prefix(k, "__path", root).alias(n) for k, n in zip(levels, names, strict=True)])
    rolled = ancestors.rollup(*names).agg(F.sum("__n").alias("n"), F.grouping_id().alias("__g"))
    level = F.lit(0)
    for k in range(len(levels)):
        level = F.when(F.col("__g") == (1 << (len(levels) - 1 - k)) - 1, F.lit(levels[k])).otherwise(level)
    return rolled.filter("n IS NOT NULL").select(level.alias("level"), F.coalesce(*[F.col(n) for n in reversed(names)], F.lit("")).alias("cell"), "n")


def cell_cube(cells: DataFrame, level: int, category: str, root: bool = False) -> DataFrame:
    """Points by cell and category, with sub-totals (null cell or category); cells are counted first."""
    counted = cells.groupBy(prefix(level, root=root).alias("cell"), F.col(category).alias("category")).agg(F.count("*").alias("__n"))
    return counted.cube("cell", "category").agg(F.sum("__n").alias("n"))


def distinct_cells(cells: DataFrame, levels: list[int], approximate: bool = False, root: bool = False) -> DataFrame:
    """Number of occupied cells at each level; one pass, at most the finest level's cells shuffled."""
    if approximate:
        row = cells.agg(*[F.approx_count_distinct(prefix(k, root=root)).alias(f"c{k}") for k in levels])
        return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.col(f"c{k}").alias("cells")) for k in levels])).alias("r")).select("r.*")
    finest = cells.select(prefix(max(levels), root=root).alias("p")).distinct()
    each = finest.select(F.explode(F.array(*[F.struct(F.lit(k).alias("level"), prefix(k, "p", root).alias("cell")) for k in levels])).alias("r")).select("r.*")
    return each.distinct().groupBy("level").agg(F.count("*").alias("cells"))


def adaptive_level(cells: DataFrame, key: str, max_level: int, root: bool = False, min_level: int = 1) -> DataFrame:
    """The first level, from min_level on, at which each point is alone in its cell (null if never).

    Cells are counted level by level from the finest counts, so one shuffle of points is followed by
    shuffles of cells only."""
    finest = cells.groupBy(prefix(max_level, root=root).alias("path")).agg(F.count("*").alias("n"), F.min(key).alias(key))
    counted = finest.select(F.explode(F.sequence(F.lit(min_level), F.lit(max_level))).alias("level"), "path", "n", key)
    per_cell = counted.groupBy("level", F.expr(f"substring(path, 1, 2 * level + {int(root)})").alias("cell")).agg(F.sum("n").alias("n"), F.min(key).alias(key))
    alone = per_cell.filter("n = 1").groupBy(key).agg(F.min("level").alias("level"))
    return cells.select(key).join(alone, key, "left")


def _shared_levels(rows: DataFrame, key: str, level: int, root: bool) -> DataFrame:
    """The rows (with the path of a cell of the level) without path, with __shared: the deepest level,
    0 if none, at which a row's cell holds another row.

    In the order of paths that other row stands next to it, so rows are dealt by ranges, sorted and
    compared with their neighbours. Ranges cut crowded cells too, so no part holds a cell whole. The
    first and the last row of each part are compared again, across parts."""
    kept = [f for f in rows.schema if f.name != "path"]
    names, width = [f.name for f in kept], 2 * level + int(root)
    schema = T.StructType([*kept, T.StructField("__shared", T.IntegerType()), T.StructField("__edge", T.StringType()), T.StructField("__part", T.IntegerType()), T.StructField("__last", T.BooleanType())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def compared(batch: pa.RecordBatch, before: bytes | None, after: bytes | None) -> pa.RecordBatch:
            own = batch.column("__path").to_numpy(zero_copy_only=False).astype(f"S{width}")
            around = np.concatenate([[before or b""], own, [after or b""]]).astype(f"S{width}").view(np.uint8).reshape(-1, width)
            same = around[1:] == around[:-1]
            alike = np.where(same.all(axis=1), width, same.argmin(axis=1))
            shared = np.maximum(np.maximum(alike[1:], alike[:-1]) - int(root), 0) // 2
            edge = np.full(len(own), None, object)
            if before is None:
                edge[0] = own[0].decode()
            if after is None:
                edge[-1] = own[-1].decode()
            last = (np.arange(len(own)) == len(own) - 1) & (after is None)
            return pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(shared, pa.int32()), pa.array(edge, pa.string()), pa.array(np.full(len(own), part), pa.int32()), pa.array(last)], schema.names)

        held = before = None
        for batch in filter(len, source):
            if held is not None:
                yield compared(held, before, batch.column("__path")[0].as_py().encode())
                before = held.column("__path")[-1].as_py().encode()
            held = batch
        if held is not None:
            yield compared(held, before, None)

    # All letters of one byte, so that a level has two bytes in every path.
    placed = checkpointed(rows.withColumn("__path", F.translate("path", "Λ", "A")).drop("path"))
    done = checkpointed(placed.repartitionByRange("__path", key).sortWithinPartitions("__path", key).mapInArrow(run, schema))
    in_order = Window.orderBy("__part", "__last")  # two rows a part
    alike = lambda other: F.coalesce(F.array_max(F.filter(F.sequence(F.lit(0), F.lit(level)), lambda k: F.substring("__edge", F.lit(1), 2 * k + int(root)) == F.substring(other, F.lit(1), 2 * k + int(root)))), F.lit(0))
    edges = done.filter("__edge IS NOT NULL").withColumns({"__before": F.lag("__edge").over(in_order), "__after": F.lead("__edge").over(in_order)})
    edges = edges.withColumn("__shared", F.greatest("__shared", alike("__before"), alike("__after")))
    return done.filter("__edge IS NULL").select(*names, "__shared").unionByName(edges.select(*names, "__shared"))


def refined_level(points: DataFrame, key: str, address, step: int = 6, max_level: int = R.MAX_LEVEL, root: bool = False) -> DataFrame:
    """adaptive_level without a level to guess: key and level, null where points never part.

    address(points, level) gives points their path. All points are addressed to the first `step` levels;
    those that still share a cell then, and no others, are addressed `step` levels deeper, and so on to
    max_level. A point that is alone shares no deeper cell either, so those that are left suffice.
    Points in one place with others can never part: one of each place goes on while another place shares
    its cell, and its own answer counts only if it stands there alone. A round addresses its points once
    and sorts them once. Rounds are checkpointed. Keys must be unique; points without an address have a
    null level."""
    kept = checkpointed(points)
    columns = [c for c in kept.columns if c != key]
    places = kept.groupBy(*columns).agg(F.count("*").alias("__n"), F.min(key).alias(key))
    left = places.withColumn("__alone", F.col("__n") == 1).drop("__n")
    out = None
    for last in range(step, max_level + step, step):
        level = min(last, max_level)
        found = _shared_levels(address(left, level).filter("path IS NOT NULL").select(*columns, key, "__alone", "path"), key, level, root)
        parted = found.filter((F.col("__shared") < level) & F.col("__alone")).select(key, (F.col("__shared") + 1).alias("level"))
        out = parted if out is None else out.unionByName(parted)
        left = found.filter(F.col("__shared") >= level).drop("__shared")
        if left.filter("__alone").isEmpty():
            break
    return kept.select(key).join(out, key, "left")


def top_cells(density: DataFrame, k: int, by: str, cell: str) -> DataFrame:
    """The k densest cells of each group, ties in order of the cell."""
    w = Window.partitionBy(by).orderBy(F.desc("n"), cell)
    return density.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def density_per_area(rolled: DataFrame, triangle_area: float) -> DataFrame:
    """cell_rollup with area and points per area: a half-hexagon of level n has a third of its
    triangle over 9 to the power n - 1."""
    area = F.when(F.col("level") > 0, F.lit(triangle_area / 3) / F.pow(F.lit(9.0), F.col("level") - 1)).otherwise(F.lit(triangle_area))
    return rolled.withColumn("area", area).withColumn("per_area", F.col("n") / F.col("area"))


def colocate(a: DataFrame, b: DataFrame, level: int, root: bool = False) -> DataFrame:
    """Pairs of rows of two tables that lie in the same cell; AQE splits crowded cells."""
    left = a.withColumn("cell", prefix(level, root=root)).drop("path", "digits", "half")
    right = b.withColumn("cell", prefix(level, root=root)).drop("path", "digits", "half")
    return left.join(right, "cell")


def cells_in(cells: DataFrame, ancestor: str) -> DataFrame:
    """Descendants of a cell; the prefix test is pushed down to Parquet."""
    return cells.filter(F.col("path").startswith(ancestor))


def changed_cells(a: DataFrame, b: DataFrame, level: int, root: bool = False) -> DataFrame:
    """Cells that only one of two tables occupies, and those that both do: cell, side.

    One aggregate over both tables; each side is reduced to its cells before the shuffle."""
    side = lambda df, left: df.select(prefix(level, root=root).alias("cell"), F.lit(left).alias("left"), F.lit(not left).alias("right"))
    both = side(a, True).unionByName(side(b, False)).groupBy("cell").agg(F.bool_or("left").alias("left"), F.bool_or("right").alias("right"))
    return both.select("cell", F.when(F.col("left") & F.col("right"), "both").when(F.col("left"), "left").otherwise("right").alias("side"))


def overlay_levels(cells: DataFrame, levels: list[int], root: bool = False) -> DataFrame:
    """Occupied cells of several levels as layers: level, cell. Points are shuffled once, as cells."""
    finest = cells.select(prefix(max(levels), root=root).alias("path")).distinct()
    layers = F.array(*[F.struct(F.lit(k).alias("level"), prefix(k, root=root).alias("cell")) for k in levels])
    return finest.select(F.explode(layers).alias("r")).select("r.*").distinct()


def quantisation_error(points: DataFrame, levels: list[int], x: str = "x", y: str = "y", c2: str = "c2", percentile: float = 0.95) -> DataFrame:
    """Distance from points to the centre of their cell: level, n, max_error, avg_error and
    percentile_error (approximate). Points are addressed once, at the finest level, and centres are
    found for occupied cells only."""
    finest = assign_cells(points.select(x, y, c2), max(levels), x, y, c2)
    each = finest.filter("path is not null").withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    cells = each.select(x, y, "level", F.expr("substring(digits, 1, level)").alias("digits"), F.expr("substring(path, 2 * level, 1)").alias("half"))
    found = cell_centroids(cells)
    d = F.sqrt(F.pow(F.col(x) - F.col("cx"), 2) + F.pow(F.col(y) - F.col("cy"), 2))
    return found.groupBy("level").agg(F.count("*").alias("n"), F.max(d).alias("max_error"), F.avg(d).alias("avg_error"), F.percentile_approx(d, percentile, 10_000).alias("percentile_error"))


#: Rows of a file of the cell store, about.
FILE_ROWS = 4_000_000


def _clustered(cells: DataFrame, level: int, root: bool, rows: int | None) -> DataFrame:
    """The cells with their ancestor, dealt by ranges of paths into parts of about FILE_ROWS and sorted.

    A range holds whole ancestors but for the first and the last, so there are at most as many files as
    ancestors and parts together, and each file covers a narrow range of paths."""
    rows = cells.count() if rows is None else rows
    order = ["ancestor", "path"]
    return cells.withColumn("ancestor", prefix(level, root=root)).repartitionByRange(max(1, -(-rows // FILE_ROWS)), *order).sortWithinPartitions(*order)


def write_cells(cells: DataFrame, path: str, level: int, root: bool = False, rows: int | None = None) -> None:
    """Parquet in one folder for each ancestor at the level, sorted by path; replaces what is there.

    `rows` is their number where it is known; else they are counted first."""
    _clustered(cells, level, root, rows).write.mode("overwrite").partitionBy("ancestor").parquet(path)


def upsert_cells(cells: DataFrame, path: str, level: int, keys: tuple[str, ...] = ("path",), root: bool = False) -> None:
    """Rows that take the place of stored rows with the same keys (which include the path), or are added.

    Only ancestors of the new rows are read and written again; other folders are not touched. The merged
    rows are checkpointed before their folders are overwritten. New rows must be unique by their keys."""
    spark = cells.sparkSession
    touched = cells.select(prefix(level, root=root).alias("ancestor")).distinct()
    stored = spark.read.parquet(path)
    old = stored.withColumn("ancestor", F.col("ancestor").cast("string")).join(touched, "ancestor", "left_semi").drop("ancestor")
    merged = checkpointed(old.join(cells.select(*keys), list(keys), "left_anti").unionByName(cells))
    out = _clustered(merged, level, root, None)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ancestor").parquet(path)


def read_cells(spark, path: str, ancestor: str, level: int, root: bool = False) -> DataFrame:
    """Descendants of a cell: reads its folders only, and pushes the prefix test down."""
    rows = spark.read.option("basePath", path).parquet(path)
    width = 2 * level + int(root)
    short = ancestor[:width]
    folder = F.col("ancestor").cast("string")
    return cells_in(rows.filter(folder == short if len(ancestor) >= width else folder.startswith(short)), ancestor)
