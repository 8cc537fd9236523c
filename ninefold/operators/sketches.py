"""Distinct counts and quantiles by cell from sketches that are kept at one level and merged up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cells import prefix

#: Size of the distinct sketches (2^12 registers: about 1.6 % error) and of the quantile sketches (about
#: 1.3 % of the rank). Smaller cells are exact.
DISTINCT_SIZE = 12
QUANTILE_SIZE = 200


def sketch_cells(cells: DataFrame, level: int, item: str, value: str, root: bool = False) -> DataFrame:
    """One row for each cell of the level: level, cell, n, items (a sketch of distinct values of `item`) and
    amounts (a sketch of the distribution of `value`). The one pass over points; Spark merges partial
    sketches of bounded size, so no cell is too large. Rows without a value count for n and items."""
    amounts = F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(QUANTILE_SIZE))
    return cells.groupBy(prefix(level, root=root).alias("cell")).agg(F.count("*").alias("n"), F.hll_sketch_agg(item, F.lit(DISTINCT_SIZE)).alias("items"), amounts.alias("amounts")).select(F.lit(level).alias("level"), "cell", "n", "items", "amounts")


def merge_up(sketches: DataFrame, level: int, levels: list[int], root: bool = False) -> DataFrame:
    """The sketches of a level and of the levels above it, each merged from the one before: no point is
    read again, and every step has fewer rows."""
    wanted = sorted({k for k in levels if k <= level}, reverse=True)
    below, out = sketches, sketches if level in wanted else None
    for k in wanted:
        if k < level:
            merged = below.groupBy(prefix(k, "cell", root).alias("cell")).agg(F.sum("n").alias("n"), F.hll_union_agg("items").alias("items"), F.kll_merge_agg_double("amounts").alias("amounts"))
            below = merged.select(F.lit(k).alias("level"), "cell", "n", "items", "amounts")
            out = below if out is None else out.unionByName(below)
    return out


def estimates(sketches: DataFrame, ranks: list[float]) -> DataFrame:
    """level, cell, n, distinct and quantiles (an array, by rank) of each row of sketches."""
    quantiles = F.array(*[F.kll_sketch_get_quantile_double("amounts", F.lit(float(r))) for r in ranks])
    return sketches.select("level", "cell", "n", F.hll_sketch_estimate("items").alias("distinct"), quantiles.alias("quantiles"))


def first_levels(cells: DataFrame, item: str, level: int, root: bool = False) -> DataFrame:
    """The rows with first_level: the first level whose cell no row before them, of the same item and in
    order of paths, lies in (level + 1 if there is none). Paths of one cell follow each other in that
    order, so a cell of any level has as many different items as rows whose first_level is not beyond it:
    one sort stands for a distinct of cells and items at each level. Rows without an item have none."""
    before = F.lag(prefix(level, root=root)).over(Window.partitionBy(item).orderBy(prefix(level, root=root)))
    rows = cells.withColumn("__before", before)
    shared = lambda k: (prefix(k, root=root) == prefix(k, "__before", root)).cast("int")
    depth: Column = sum((F.coalesce(shared(k), F.lit(0)) for k in range(2, level + 1)), F.coalesce(shared(1), F.lit(0)))
    return rows.withColumn("first_level", F.when(F.col(item).isNotNull(), depth + 1)).drop("__before")
