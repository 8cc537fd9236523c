"""SQL for DuckDB that walks the same rules, and points derived from the given tables in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ninefold.functions import rules as R
from ninefold.functions.storage import shared_folder  # noqa: F401  for the queries


def num(v: float) -> str:
    return f"{float(v)!r}::double"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A small file comes as one partition; only then are its rows dealt out before work in Python.

    A table with a partition for each core, as any large one, is left as it is and not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# -- planar points, all inside the triangle Λ -----------------------------------------------------

PLANAR = {
    "lineitem": ("((l_orderkey*7919 + l_partkey*31) % 2000)/2000.0{d}*0.5{d}-0.25{d}", "((l_partkey*104729 + l_linenumber*17) % 2003)/2003.0{d}*0.5{d}-0.25{d}"),
    "orders": ("((o_orderkey*7919 + o_custkey*31) % 2000)/2000.0{d}*0.5{d}-0.25{d}", "((o_orderkey*104729 + o_custkey*17) % 2003)/2003.0{d}*0.5{d}-0.25{d}"),
    "events": ("((event_id*7919 + user_id*31) % 2000)/2000.0{d}*0.5{d}-0.25{d}", "((user_id*104729 + event_id*17) % 2003)/2003.0{d}*0.5{d}-0.25{d}"),
}


def planar(spark: SparkSession, sf_dir: str, name: str, extra: tuple[str, ...] = (), wide: float = 1.0) -> DataFrame:
    x, y = (e.format(d="D") for e in PLANAR[name])
    return spread(table(spark, sf_dir, name).selectExpr(*extra, f"({x})*{wide}D AS x", f"({y})*{wide}D AS y", "'021' AS c2"))


def planar_sql(name: str, extra: tuple[str, ...] = (), wide: float = 1.0) -> str:
    x, y = (e.format(d="::double") for e in PLANAR[name])
    more = "".join(f"{e}, " for e in extra)
    return f"SELECT {more}({x})*{num(wide)} AS x, ({y})*{num(wide)} AS y, '021' AS c2 FROM {name}"


# -- geographic points and directions --------------------------------------------------------------

def places(spark: SparkSession, sf_dir: str, name: str = "customer", key: str = "c_custkey", extra: tuple[str, ...] = ()) -> DataFrame:
    return table(spark, sf_dir, name).selectExpr(*extra, f"(({key}*7919) % 18001)/100.0D-90 AS lat", f"(({key}*104729) % 36000)/100.0D-180 AS lon")


def places_sql(name: str = "customer", key: str = "c_custkey", extra: tuple[str, ...] = ()) -> str:
    more = "".join(f"{e}, " for e in extra)
    return f"SELECT {more}(({key}*7919) % 18001)/100.0::double-90 AS lat, (({key}*104729) % 36000)/100.0::double-180 AS lon FROM {name}"


def directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions on the sphere, without trigonometry."""
    v = [f"CAST(embedding[{k}] AS DOUBLE)" for k in range(3)]
    raw = table(spark, sf_dir, "embeddings").selectExpr("vec_id", "label", *[f"{e} AS v{k}" for k, e in enumerate(v)])
    return spread(raw.filter("v0 IS NOT NULL AND v1 IS NOT NULL AND v2 IS NOT NULL AND abs(v0) + abs(v1) + abs(v2) > 0").selectExpr("vec_id", "label", "v0 AS x", "v1 AS y", "v2 AS z"))


DIRECTIONS_SQL = "SELECT * FROM (SELECT vec_id, label, embedding[1]::double AS x, embedding[2]::double AS y, embedding[3]::double AS z FROM embeddings) WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND abs(x) + abs(y) + abs(z) > 0"


# -- rasters: one pixel for each order, 96 wide ------------------------------------------------------

RASTER_WIDTH = 96


def _raster(width: int, div: str) -> dict[str, str]:
    return {"row": f"CAST(o_orderkey {div} {width} AS INT)", "col": f"CAST(o_orderkey % {width} AS INT)", "r": "CAST((o_orderkey*7 + o_custkey*13) % 256 AS INT)", "g": "CAST((o_orderkey*11) % 256 AS INT)", "b": "CAST((o_orderkey*o_custkey) % 256 AS INT)"}


def raster(spark: SparkSession, sf_dir: str, width: int = RASTER_WIDTH) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*[f"{e} AS {n}" for n, e in _raster(width, "div").items()])


def raster_sql(width: int = RASTER_WIDTH) -> str:
    return "SELECT " + ", ".join(f'{e} AS "{n}"' for n, e in _raster(width, "//").items()) + " FROM orders"


RASTER_SQL = raster_sql()


# -- the walk ----------------------------------------------------------------------------------------

def _case(rows: list[tuple[str, str | None]]) -> str:
    return "CASE " + " ".join(f"WHEN {t} THEN {v}" if t else f"ELSE {v}" for v, t in rows) + " END"


def _test(rule: str | None) -> str | None:
    names = {"dx": f"({num(R.R3)}*x)", "wx": num(R.WX), "h3": num(R.H / 3)}
    return rule and " ".join(("-" if w[0] == "-" and w != "-" else "") + names.get(w.lstrip("-") if w != "-" else w, w.lstrip("-") if w != "-" else w) for w in rule.split())


def walk_sql(points: str, level: int, keep: tuple[str, ...] = (), first_sector: bool = False, tag: str = "") -> str:
    """CTEs that end in `cells`: the kept columns of the points with lvl, digits, half, path and the
    shifts before the last step (ax, ay) for each level up to `level`. `tag` tells nested walks apart."""
    columns = "".join(f"{c}, " for c in keep)
    sector = _case([(_case([(str(s), _test(r)) for s, r in R.SECTORS[h]]), f"half = '{h}'") for h in R.HALF])
    if first_sector:
        sector = f"CASE WHEN lvl = 0 THEN 0 ELSE {sector} END"
    child = _case([(_case([(repr(c), _test(r)) for c, r, _ in rows]), f"half = '{h}' AND s = {s}") for (h, s), rows in R.CHILDREN.items()])
    move = [_case([(num(sh[k] * (R.U, R.V)[k]), f"half = '{h}' AND s = {s} AND child = '{c}'") for (h, s), rows in R.CHILDREN.items() for c, _, sh in rows]) for k in range(2)]
    half = "CASE WHEN c2 IN ('021','102','210') THEN 'Λ' ELSE 'V' END"
    return f"""WITH RECURSIVE pts{tag} AS ({points}), walk{tag} AS (
  SELECT {columns}x, y, c2, 0 AS lvl, '' AS digits, '' AS path, 0.0::double AS bx, 0.0::double AS by_, 0.0::double AS ax, 0.0::double AS ay FROM pts{tag}
  UNION ALL
  SELECT {columns}(x + mx) * 3, (y + my) * 3, child, lvl + 1, digits || d, path || d || half, bx + mx / pow(3.0::double, lvl), by_ + my / pow(3.0::double, lvl), bx, by_
  FROM (SELECT *, {move[0]} AS mx, {move[1]} AS my
        FROM (SELECT *, {child} AS child, (CAST(substring(c2, s + 1, 1) AS INT) * 3 + s)::varchar AS d
              FROM (SELECT *, {sector} AS s FROM (SELECT *, {half} AS half FROM walk{tag} WHERE lvl < {level}))))
), cells{tag} AS (SELECT {columns}lvl, digits, right(path, 1) AS half, path, ax, ay FROM walk{tag} WHERE lvl > 0)
"""


def centre_sql(mate: bool = False) -> tuple[str, str]:
    """Centre of a cell from half, digits, lvl, ax, ay of a walk; or its mirror image."""
    a, b, c = R.CENTROID
    share = (a + c, b + c, -c) if mate else (a, b, c)
    out = []
    for k, shift in ((0, "ax"), (1, "ay")):
        local = _case([(num(sum(w * R.CORNERS[h][n][k] for w, n in zip(share, R.SECTOR_CORNERS[h, s], strict=True))), f"half = '{h}' AND right(digits, 1)::int % 3 = {s}") for h in R.HALF for s in range(3)])
        out.append(f"(({local}) / pow(3.0::double, lvl - 1) - {shift})")
    return out[0], out[1]


def global_sql(points: str = DIRECTIONS_SQL, level: int = 5, keep: tuple[str, ...] = ("vec_id", "label")) -> str:
    """As walk_sql, for directions x, y, z, ending in `globe`: paths and digits start with the root."""
    columns = "".join(f"{c}, " for c in keep)
    pole, meridian, side = "CASE WHEN z >= 0 THEN 'N' ELSE 'S' END", "CASE WHEN x >= 0 THEN 'P' ELSE 'A' END", "CASE WHEN y >= 0 THEN 'E' ELSE 'W' END"
    third = "(1.0::double/3.0::double)"
    inner = f"""SELECT {columns}root, ({{a}} - {{b}}) * {num(R.W / 2)} AS x, (CASE WHEN up THEN 1.0::double ELSE -1.0::double END) * ({{c}} - {third}) * {num(R.H)} AS y, CASE WHEN up THEN '021' ELSE '012' END AS c2"""
    pick = lambda a, b, c: f"(CASE k WHEN 0 THEN {a} WHEN 1 THEN {b} ELSE {c} END)"
    sql = inner.format(a=pick("bz", "bx", "bw"), b=pick("bx", "bw", "bz"), c=pick("bw", "bz", "bx"))
    pts = f"""{sql} FROM (SELECT *, {pick("pole || meridian", "meridian || side", "side || pole")} AS root FROM (
      SELECT *, CASE WHEN bz >= {third} AND bw < {third} THEN 0 WHEN bx >= {third} AND bz < {third} THEN 1 ELSE 2 END AS k FROM (
        SELECT *, {pole} AS pole, {meridian} AS meridian, {side} AS side,
          ((CASE WHEN x >= 0 THEN 0 ELSE 1 END) + (CASE WHEN y >= 0 THEN 0 ELSE 1 END) + (CASE WHEN z >= 0 THEN 0 ELSE 1 END)) % 2 = 1 AS up,
          abs(x) / (abs(x) + abs(y) + abs(z)) AS bx, abs(y) / (abs(x) + abs(y) + abs(z)) AS bw, abs(z) / (abs(x) + abs(y) + abs(z)) AS bz
        FROM ({points}))))"""
    walked = walk_sql(pts, level, (*keep, "root"), first_sector=True)
    named = f"globe AS (SELECT {columns}root, lvl, root || substring(digits, 2) AS digits, half, root || substring(path, 2) AS path FROM cells)"
    return walked.rstrip() + ", " + named + "\n"
