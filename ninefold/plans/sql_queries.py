"""Queries written in SQL over the registered functions; their checks walk the rules on their own."""

from __future__ import annotations

from ninefold.extension import register

from .cell_queries import _CX, _CY, _walk
from .mesh_queries import M2, _triangles
from .sql import directions, global_sql, planar


def _view(df, name: str) -> None:
    df.createOrReplaceTempView(name)


def ext_cells(spark, sf_dir):
    """Points by cell, with the cell's centre, by one statement."""
    register(spark)
    _view(planar(spark, sf_dir, "lineitem"), "ninefold_points")
    return spark.sql("""
        WITH found AS (SELECT cell_of(x, y, c2, 5) AS cell FROM ninefold_points),
        counted AS (SELECT cell.digits, cell.half, count(*) AS n FROM found GROUP BY ALL),
        placed AS (SELECT *, cell_centre(digits, half) AS centre FROM counted)
        SELECT digits, half, n, round(centre.cx, 6) AS cx, round(centre.cy, 6) AS cy FROM placed""")


EXT_CELLS = _walk(5) + f"SELECT digits, half, count(*) AS n, round(any_value({_CX}), 6) AS cx, round(any_value({_CY}), 6) AS cy FROM cells WHERE lvl = 5 GROUP BY ALL"


def ext_children(spark, sf_dir):
    """Children of the occupied cells by a lateral table function, and their points."""
    register(spark)
    _view(planar(spark, sf_dir, "lineitem"), "ninefold_points")
    return spark.sql("""
        WITH held AS (SELECT cell_of(x, y, c2, 5).path AS path, count(*) AS n FROM ninefold_points GROUP BY ALL),
        parents AS (SELECT DISTINCT left(path, 8) AS path FROM held),
        kids AS (SELECT p.path, c.child_path FROM parents p, LATERAL cell_children(p.path) c)
        SELECT k.path, k.child_path, coalesce(n, 0) AS n FROM kids k LEFT JOIN held h ON h.path = k.child_path""")


# Occupied children come from the walk; the others complete each parent to nine of the shapes that occur
# below its kind anywhere in a walk of the events.
_KINDS = _walk(6, "events").replace("cells AS", "cells_ AS").rstrip() + ", kinds AS (SELECT DISTINCT substring(path, 7, 2) AS kind, right(path, 2) AS child FROM cells_ WHERE lvl = 5 UNION SELECT DISTINCT substring(path, 9, 2), right(path, 2) FROM cells_ WHERE lvl = 6)"
EXT_CHILDREN = f"""WITH held AS ({_walk(5)}SELECT path, count(*) AS n FROM cells WHERE lvl = 5 GROUP BY ALL), kinds AS ({_KINDS} SELECT * FROM kinds),
parents AS (SELECT DISTINCT left(path, 8) AS path FROM held), kids AS (SELECT path, path || child AS child_path FROM parents JOIN kinds ON right(path, 2) = kind)
SELECT k.path, child_path, coalesce(n, 0) AS n FROM kids k LEFT JOIN held h ON h.path = child_path"""


def ext_ancestors(spark, sf_dir):
    """Directions by cell of every level, by a lateral table function over the occupied cells."""
    from ninefold.operators.globe import assign_global

    register(spark)
    _view(assign_global(directions(spark, sf_dir), 5), "ninefold_globe")
    return spark.sql("""
        WITH finest AS (SELECT path, count(*) AS n FROM ninefold_globe GROUP BY path)
        SELECT a.level, a.cell, sum(f.n) AS n FROM finest f, LATERAL cell_ancestors(f.path) a GROUP BY a.level, a.cell""")


EXT_ANCESTORS = global_sql(level=5) + "SELECT lvl AS level, path AS cell, count(*) AS n FROM globe GROUP BY ALL"


def ext_triangles(spark, sf_dir):
    """Triangles of two levels below each row of a table argument."""
    register(spark)
    _view(_triangles(spark, sf_dir).withColumnRenamed("vec_id", "key"), "ninefold_triangles")
    mid = ", ".join(f"round((p0[{k}] + p1[{k}] + p2[{k}]) / 3, 6) AS {c}" for k, c in enumerate("xyz"))
    return spark.sql(f"SELECT key AS vec_id, path, {mid} FROM triangle_children(TABLE(ninefold_triangles), 2)")


QUERIES = {f.__name__: f for f in (ext_cells, ext_children, ext_ancestors, ext_triangles)}
ORACLE_SQL = {"ext_cells": EXT_CELLS, "ext_children": EXT_CHILDREN, "ext_ancestors": EXT_ANCESTORS, "ext_triangles": M2}
