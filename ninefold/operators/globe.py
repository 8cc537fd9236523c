"""Cells on the sphere: an octahedron of twelve root hexagons."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ninefold.functions import rules as R
from ninefold.functions.columns import unit_vector

from .addressing import _half_children, _kernel, _owned, _per_cell, centres


def octahedral(x: Column, y: Column, z: Column) -> list[Column]:
    """Shares of a direction's three octant corners: |x|, |y|, |z| over their sum; null for a zero direction."""
    total = F.abs(x) + F.abs(y) + F.abs(z)
    return [F.abs(c) / F.when(total > 0, total) for c in (x, y, z)]


def assign_global(points: DataFrame, level: int, x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """The points with root, digits, half and path of their cell on the sphere, from directions.

    The octant gives a face (its pole, then P or A, then E or W). Three root hexagons touch it, named
    by the corner that they touch and the next one; each has a frame of its own in which its sector
    comes first, so digits agree on both sides of the edge that halves the hexagon. The root's name
    stands for the first digit. Directions that are null or zero get null cells. No shuffle.
    """
    pole = F.when(F.col(z) >= 0, "N").otherwise("S")
    meridian = F.when(F.col(x) >= 0, "P").otherwise("A")
    side = F.when(F.col(y) >= 0, "E").otherwise("W")
    up = F.pmod(F.when(F.col(x) >= 0, 0).otherwise(1) + F.when(F.col(y) >= 0, 0).otherwise(1) + F.when(F.col(z) >= 0, 0).otherwise(1), F.lit(2)) == 1
    bx, by, bz = octahedral(F.col(x), F.col(y), F.col(z))
    out = points.withColumns({"__bx": bx, "__by": by, "__bz": bz, "__up": up})
    third = F.lit(1.0) / F.lit(3.0)
    # Corners in the face's order: pole, meridian, side; each root is (touched, next, third).
    choice = F.when((F.col("__bz") >= third) & (F.col("__by") < third), 0).when((F.col("__bx") >= third) & (F.col("__bz") < third), 1).otherwise(2)
    out = out.withColumn("__root", F.when(F.col("__bx").isNotNull() & ~F.isnan("__bx"), choice))
    pick = lambda a, b, c: F.when(F.col("__root") == 0, a).when(F.col("__root") == 1, b).otherwise(c)
    a, b, c = pick(F.col("__bz"), F.col("__bx"), F.col("__by")), pick(F.col("__bx"), F.col("__by"), F.col("__bz")), pick(F.col("__by"), F.col("__bz"), F.col("__bx"))
    root = F.when(F.col("__root").isNotNull(), pick(F.concat(pole, meridian), F.concat(meridian, side), F.concat(side, pole)))
    sign = F.when(F.col("__up"), F.lit(1.0)).otherwise(F.lit(-1.0))
    out = out.withColumns({"root": root, "__lx": (a - b) * F.lit(R.W / 2), "__ly": sign * (c - third) * F.lit(R.H), "__code": F.when(F.col("__up"), F.lit(0)).otherwise(F.lit(3))})
    out = out.drop("__bx", "__by", "__bz", "__up", "__root", "digits", "half", "path")
    return _kernel(out, level, "__lx", "__ly", "root").drop("__lx", "__ly")


def assign_places(points: DataFrame, level: int, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """assign_global for latitudes and longitudes in degrees."""
    x, y, z = unit_vector(F.col(lat), F.col(lon))
    return assign_global(points.withColumns({"__x": x, "__y": y, "__z": z}), level, "__x", "__y", "__z").drop("__x", "__y", "__z")


#: Axis and sign of the letters of a root's name.
_LETTERS = {"P": (0, 1), "A": (0, -1), "E": (1, 1), "W": (1, -1), "N": (2, 1), "S": (2, -1)}


def _directions(at: np.ndarray, up: np.ndarray, roots: list[str]) -> list[np.ndarray]:
    """Unit vectors of places in the frames of their roots. The octant's third letter, which a root
    does not name, follows from which way its face points; a place beyond the edge that halves the
    root's hexagon lies in the octant on the other side."""
    first, second = (np.array([_LETTERS[r[k]] for r in roots]) for k in range(2))
    sign = np.where(up, 1.0, -1.0)
    c = sign * at[:, 1] / R.H + 1 / 3
    share_c = np.abs(c)
    ab = 2 * at[:, 0] / R.W
    odd = (first[:, 1] < 0) ^ (second[:, 1] < 0)
    third = np.where(up ^ odd, -1, 1) * np.where(c < 0, -1, 1)  # a face points up if an odd number of its letters is negative
    out, rows = np.zeros((len(at), 3)), np.arange(len(at))
    out[rows, first[:, 0]] = first[:, 1] * (1 - share_c + ab) / 2
    out[rows, second[:, 0]] = second[:, 1] * (1 - share_c - ab) / 2
    out[rows, 3 - first[:, 0] - second[:, 0]] = third * share_c
    return list((out / np.linalg.norm(out, axis=1, keepdims=True)).T)


def global_centroids(cells: DataFrame, mate: bool = False) -> DataFrame:
    """The cells on the sphere (digits that start with a root, half) with cx, cy, cz, the direction of
    the centre of their half-hexagon; with mate, of the other half of its hexagon, in another root or
    octant too."""
    schema = "mx double, my double, mz double" if mate else "cx double, cy double, cz double"
    return _per_cell(cells, schema, lambda digits, half, roots: _directions(centres(digits, half, mate), half[:, 0] == 0, roots), root=True)


def global_canonical(cells: DataFrame, level: int) -> DataFrame:
    """Cells of a level with canonical, the address that both halves of their hexagon share: that of the
    V half, or, where both are of one kind, as across an edge of two faces, the smaller one."""
    once = cells.select(F.col("digits").alias("d0"), F.col("half").alias("h0")).distinct()
    found = assign_global(global_centroids(once.select(F.col("d0").alias("digits"), F.col("h0").alias("half")), mate=True).withColumnsRenamed({"digits": "d0", "half": "h0"}), level, "mx", "my", "mz")
    own, other = F.concat("d0", "h0"), F.concat("digits", "half")
    named = F.when(F.col("h0") == F.col("half"), F.least(own, other)).when(F.col("h0") == "V", own).otherwise(other)
    pairs = found.select(F.col("d0").alias("digits"), F.col("h0").alias("half"), named.alias("canonical"))
    return cells.join(pairs, ["digits", "half"])


def global_hexagon_children(cells: DataFrame, level: int) -> DataFrame:
    """hexagon_children for cells of one level on the sphere, where halves may lie in two octants or under
    two roots; every hexagon has both."""
    named = global_canonical(cells.select("digits", "half").distinct(), level).select(F.col("canonical").alias("hexagon")).distinct()
    first = named.select("hexagon", F.expr("left(hexagon, length(hexagon) - 1)").alias("digits"), F.expr("right(hexagon, 1)").alias("half"))
    other = assign_global(global_centroids(first, mate=True).drop("digits", "half"), level, "mx", "my", "mz").select("hexagon", "digits", "half")
    return _owned(_half_children(first.unionByName(other)), lambda kids: global_canonical(kids, level + 1))
