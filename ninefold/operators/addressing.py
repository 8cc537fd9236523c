"""Cell addresses: points to cells and back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ninefold.functions import rules as R

_DIGITS = np.array([[R.digit(c, s) for s in range(3)] for c in range(6)], np.uint8)
_NAMES = {"dx": None, "wx": R.WX, "h3": R.H / 3}


def _test(rule: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A rule of the table over arrays."""
    names = _NAMES | {"dx": R.R3 * x, "x": x, "y": y}
    out = np.ones(len(x), bool)
    for part in rule.split(" AND "):
        out &= eval(part, {"__builtins__": {}}, names)  # noqa: S307  the rules are constants of this package
    return out


def _first(choices: list[tuple[int, str | None]], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.full(len(x), -1)
    for value, rule in choices:
        open_ = out < 0
        out[open_ & (_test(rule, x, y) if rule else True)] = value
    return out


def walk(x: np.ndarray, y: np.ndarray, code: np.ndarray, level: int, first_sector: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Digits and identities (points x level) from local coordinates and the first identity.

    With first_sector, every point is taken to lie in sector 0 at first."""
    x, y, code = x.astype(np.float64), y.astype(np.float64), code.astype(np.int64)
    digits = np.zeros((len(x), level), np.uint8)
    codes = np.zeros((len(x), level), np.uint8)
    for n in range(level):
        codes[:, n] = code
        new_x, new_y, new = x.copy(), y.copy(), code.copy()
        for half in R.HALF:
            here = np.flatnonzero(code // 3 == R.HALF.index(half))
            if not len(here):
                continue
            sector = _first(R.SECTORS[half], x[here], y[here])
            if n == 0 and first_sector:
                sector[:] = 0
            digits[here, n] = _DIGITS[code[here], sector]
            for s in range(3):
                at = here[sector == s]
                rows = R.CHILDREN[half, s]
                child = _first([(k, rule) for k, (_, rule, _) in enumerate(rows)], x[at], y[at])
                for k, (name, _, (a, b)) in enumerate(rows):
                    to = at[child == k]
                    new_x[to], new_y[to], new[to] = (x[to] + a * R.U) * 3, (y[to] + b * R.V) * 3, R.C2.index(name)
        x, y, code = new_x, new_y, new
    return digits, codes


_TEXTS = ("digits", "half", "path")


def _text(digits: np.ndarray, codes: np.ndarray, wanted: tuple[str, ...] = _TEXTS) -> list[pa.Array]:
    """digits, half and path, or those that are wanted, as strings."""
    n, level = digits.shape
    letters = np.where(codes // 3 == 0, ord("Λ"), ord("V")).astype(np.uint32)
    path = np.empty((n, 2 * level), np.uint32)
    path[:, 0::2], path[:, 1::2] = digits + 48, letters
    as_text = lambda a: pa.array(np.ascontiguousarray(a.astype(np.uint32)).view(f"<U{a.shape[1]}").reshape(-1), pa.string())
    made = {"digits": lambda: digits + np.uint32(48), "half": lambda: letters[:, -1:], "path": lambda: path}
    return [as_text(made[n]()) for n in wanted]


def assign_cells(points: DataFrame, level: int, x: str = "x", y: str = "y", c2: str | Column = "c2", only: tuple[str, ...] | None = None) -> DataFrame:
    """The points with digits, half and path of their cell in one triangle (null where x or y is null);
    with `only`, these columns and no others come back from Python.

    An Arrow kernel over whole batches; it needs no shuffle and reads x, y and c2 only. Columns named
    digits, half or path are replaced."""
    if not 1 <= level <= R.MAX_LEVEL:
        raise ValueError(f"level must be from 1 to {R.MAX_LEVEL}")
    code = F.array_position(F.array(*map(F.lit, R.C2)), F.col(c2) if isinstance(c2, str) else c2).cast("int") - 1
    return _kernel(points.drop("digits", "half", "path").withColumn("__code", code), level, x, y, None, only)


def _kernel(points: DataFrame, level: int, x: str, y: str, root: str | None, only: tuple[str, ...] | None = None) -> DataFrame:
    kept = [f for f in points.schema if f.name != "__code" and (only is None or f.name in only)]
    wanted = tuple(n for n in _TEXTS if only is None or n in only)
    schema = T.StructType(kept + [T.StructField(n, T.StringType()) for n in wanted])
    names = points.columns

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            column = lambda n: batch.column(names.index(n))
            px, py, code = (column(n).to_numpy(zero_copy_only=False).astype(np.float64) for n in (x, y, "__code"))
            known = np.isfinite(px) & np.isfinite(py) & ~np.isnan(code) & (code >= 0)
            digits, codes = walk(np.where(known, px, 0.0), np.where(known, py, 0.0), np.where(known, code, 0), level, root is not None)
            texts = _text(digits, codes, wanted)
            if root is not None:  # the root's name stands for the first digit
                name = column(root)
                rest = [pa.compute.utf8_slice_codeunits(t, 1) for t in (texts[0], texts[2])]
                texts[0] = pa.compute.binary_join_element_wise(name, rest[0], "")
                texts[2] = pa.compute.binary_join_element_wise(name, rest[1], "")
            mask = pa.array(~known)
            texts = [pa.compute.if_else(mask, pa.scalar(None, pa.string()), t) for t in texts]
            yield pa.RecordBatch.from_arrays([column(f.name) for f in kept] + texts, schema.names)

    return points.mapInArrow(run, schema)


def assign_cells_columns(points: DataFrame, level: int, x: str = "x", y: str = "y", c2: str = "c2") -> DataFrame:
    """The same addresses by a chain of select steps, without Python; for few levels."""
    lit = lambda v: f"{v!r}D"
    names = {"dx": f"({lit(R.R3)} * __x)", "wx": lit(R.WX), "h3": lit(R.H / 3), "x": "__x", "y": "__y"}

    def sql(rule: str) -> str:
        return " ".join(names.get(w.lstrip("-"), w) if not w.startswith("-") else f"-{names.get(w[1:], w[1:])}" for w in rule.split())

    def case(rows: list[tuple[str, str | None]]) -> str:
        return "CASE " + " ".join(f"WHEN {t} THEN {v}" if t else f"ELSE {v}" for v, t in rows) + " END"

    half = f"CASE WHEN __c2 IN ({', '.join(map(repr, R.C2[:3]))}) THEN 'Λ' ELSE 'V' END"
    out = points.selectExpr("*", f"CAST({x} AS DOUBLE) AS __x", f"CAST({y} AS DOUBLE) AS __y", f"{c2} AS __c2", "'' AS digits", "'' AS path")
    base = points.columns
    for _ in range(level):
        sector = case([(case([(str(s), sql(r) if r else None) for s, r in R.SECTORS[h]]), f"__half = '{h}'") for h in R.HALF])
        out = out.selectExpr(*base, "__x", "__y", "__c2", "digits", "path", f"{half} AS __half")
        out = out.selectExpr("*", f"{sector} AS __s")
        child = case([(case([(repr(c), sql(r) if r else None) for c, r, _ in rows]), f"__half = '{h}' AND __s = {s}") for (h, s), rows in R.CHILDREN.items()])
        out = out.selectExpr("*", f"{child} AS __child", "CAST(CAST(substring(__c2, __s + 1, 1) AS INT) * 3 + __s AS STRING) AS __d")
        move = [case([(lit(sh[k] * (R.U, R.V)[k]), f"__half = '{h}' AND __s = {s} AND __child = '{c}'") for (h, s), rows in R.CHILDREN.items() for c, _, sh in rows]) for k in range(2)]
        out = out.selectExpr(*base, f"(__x + {move[0]}) * 3 AS __x", f"(__y + {move[1]}) * 3 AS __y", "__child AS __c2", "concat(digits, __d) AS digits", "concat(path, __d, __half) AS path")
    return out.select(*base, "digits", F.expr("right(path, 1)").alias("half"), "path")


# -- from cells back -----------------------------------------------------------------------------------

_PARENT = np.zeros((9, 9, 2), np.int64)
for (_p, _c, _h), _half in R.PARENT_HALF.items():
    _PARENT[_p, _c, R.HALF.index(_h)] = R.HALF.index(_half)
_CODE = np.array([[R.code_of(h, d) for d in range(9)] for h in R.HALF])
_SHIFT = np.zeros((2, 3, 6, 2))
for (_half, _sector), _rows in R.CHILDREN.items():
    for _child, _, _ in _rows:
        _SHIFT[R.HALF.index(_half), _sector, R.C2.index(_child)] = R.shift(_half, _sector, _child)


def _centre_table(share: tuple[float, float, float]) -> np.ndarray:
    corners = [[[R.CORNERS[h][n] for n in R.SECTOR_CORNERS[h, s]] for s in range(3)] for h in R.HALF]
    return np.einsum("hsnk,n->hsk", np.array(corners), np.array(share))


_CENTRE = _centre_table(R.CENTROID)
# Mirrored over the long edge from A to B: C's share changes sign, and the point moves along the height.
_MATE = _centre_table((R.CENTROID[0] + R.CENTROID[2], R.CENTROID[1] + R.CENTROID[2], -R.CENTROID[2]))


def halves(digits: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The half (place in HALF) of every level, from digits (cells x levels) and the last half."""
    out = np.empty(digits.shape, np.int64)
    out[:, -1] = last
    for k in range(digits.shape[1] - 1, 0, -1):
        out[:, k - 1] = _PARENT[digits[:, k - 1], digits[:, k], out[:, k]]
    return out


def centres(digits: np.ndarray, half: np.ndarray, mate: bool = False) -> np.ndarray:
    """Centres (cells x 2) in their triangle, from digits and halves of every level; with mate, their
    mirror images over the cells' long edges."""
    codes, sectors = _CODE[half, digits], digits % 3
    at = (_MATE if mate else _CENTRE)[half[:, -1], sectors[:, -1]]
    for k in range(digits.shape[1] - 2, -1, -1):
        at = at / 3 - _SHIFT[half[:, k], sectors[:, k], codes[:, k + 1]]
    return at


def _parsed(digits: list[str], last: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Digits (cells x levels) and halves of cells of one level; a missing last half is V."""
    found = np.array(digits, f"<U{len(digits[0])}").view(np.uint32).reshape(len(digits), -1).astype(np.int64) - 48
    return found, halves(found, np.array([R.HALF.index(h or "V") for h in last]))


def unravel_path(digits: str, half: str | None) -> str:
    """Digits and last half (missing: V) to the path with every half."""
    return "".join(d + R.HALF[h] for d, h in zip(digits, _parsed([digits], [half])[1][0], strict=True))


def centroid(digits: str, half: str, mate: bool = False) -> tuple[float, float]:
    """Centre of a cell in its triangle; with mate, its mirror image over the cell's long edge."""
    x, y = centres(*_parsed([digits], [half]), mate)[0]
    return float(x), float(y)


def _per_cell(cells: DataFrame, schema: str, function, root: bool = False) -> DataFrame:
    """The columns that function(digits, halves, roots) gives for arrays of different cells, joined
    back. With root, digits start with the two letters of a root, whose own digit is 0."""
    once = cells.select("digits", "half").filter("digits is not null").distinct()
    names = ["digits", "half", *[p.split()[0] for p in schema.split(", ")]]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            digits, half = (np.array(batch.column(k).to_pylist(), object) for k in range(2))
            lengths = np.fromiter(map(len, digits), np.int64, len(digits))
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                own = ["0" + d[2:] if root else d for d in digits[at]]
                columns = function(*_parsed(own, list(half[at])), [d[:2] for d in digits[at]] if root else None)
                yield pa.RecordBatch.from_arrays([pa.array(list(digits[at]), pa.string()), pa.array(list(half[at]), pa.string()), *map(pa.array, columns)], names)

    solved = once.mapInArrow(run, f"digits string, half string, {schema}")
    return cells.join(solved, ["digits", "half"])


def cell_centroids(cells: DataFrame) -> DataFrame:
    """The cells of a triangle with cx, cy, the centre of their half-hexagon."""
    return _per_cell(cells, "cx double, cy double", lambda digits, half, _: list(centres(digits, half).T))


def unravel(cells: DataFrame, root: bool = False) -> DataFrame:
    """One row for each level of each cell: level, digit, level_half. With root, for cells on the
    sphere, the digit of level 1 is the name of the root."""
    letters = np.array(R.HALF)
    join = lambda digits, half, _: [["".join(x) for x in letters[half]]]
    paths = _per_cell(cells, "unravelled string", join, root)
    each = paths.select(*cells.columns, F.explode(F.sequence(F.lit(1), F.length("unravelled"))).alias("level"), "unravelled")
    digit = F.expr("substring(digits, level, 1)") if not root else F.expr("CASE WHEN level = 1 THEN substring(digits, 1, 2) ELSE substring(digits, level + 1, 1) END")
    return each.select(*cells.columns, "level", digit.alias("digit"), F.expr("substring(unravelled, level, 1)").alias("level_half"))


def ravel(levels: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of unravel() back to digits and half, for each key."""
    rows = levels.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("level", "digit", "level_half"))).alias("rows"))
    return rows.select(*keys, F.array_join(F.col("rows.digit"), "").alias("raveled"), F.element_at(F.col("rows.level_half"), -1).alias("raveled_half"))


def children(cells: DataFrame) -> DataFrame:
    """The half-hexagon children of each cell by path: child_path, nine for a half-hexagon."""
    pairs = [(p, h, c, ch) for p in range(9) for h in R.HALF for c in range(9) for ch in R.HALF if R.PARENT_HALF[p, c, ch] == h]
    table = cells.sparkSession.createDataFrame(pairs, "__digit int, __half string, child int, child_half string")
    keyed = cells.withColumn("__digit", F.expr("CAST(substring(path, length(path) - 1, 1) AS INT)")).withColumn("__half", F.expr("right(path, 1)"))
    return keyed.join(F.broadcast(table), ["__digit", "__half"]).withColumn("child_path", F.concat("path", F.col("child").cast("string"), "child_half")).drop("__digit", "__half")


def _mirrored(digits: np.ndarray, half: np.ndarray, c2: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digits and last half of the cells beyond the long edges, and whether those lie in the triangle."""
    third, up = R.H / 3, R.C2.index(c2) < 3
    x, y = centres(digits, half, mate=True).T
    side = 2 * third - np.abs(R.R3 * x)
    inside = (y > -third) & (y <= side) if up else (y <= third) & (y > -side)
    other, codes = walk(x, y, np.full(len(x), R.C2.index(c2)), digits.shape[1])
    return other, codes[:, -1] // 3, inside


def _names(digits: np.ndarray) -> list[str]:
    return ["".join(map(str, d)) for d in digits.tolist()]


def canonical_cells(cells: DataFrame, c2: str = "021") -> DataFrame:
    """Cells of one triangle with canonical, the address that names their hexagon.

    Of the two halves of a hexagon the V one names it. The other half is found by mirroring the
    centroid over the long edge and addressing that point. A Λ half whose mate lies outside the
    triangle keeps its own address."""

    def named(digits: np.ndarray, half: np.ndarray, _) -> list:
        other, last, inside = _mirrored(digits, half, c2)
        keeps = (half[:, -1] == 1) | ~inside
        chosen, last = np.where(keeps[:, None], digits, other), np.where(keeps, half[:, -1], last)
        return [[d + R.HALF[h] for d, h in zip(_names(chosen), last.tolist(), strict=True)]]

    return _per_cell(cells, "canonical string", named)


def mates(cells: DataFrame, c2: str = "021") -> DataFrame:
    """Cells of one triangle with mate and mate_half, the other half of their hexagon; null where that
    lies outside the triangle."""

    def found(digits: np.ndarray, half: np.ndarray, _) -> list:
        other, last, inside = _mirrored(digits, half, c2)
        pick = lambda values: [v if ok else None for v, ok in zip(values, inside.tolist(), strict=True)]
        return [pa.array(pick(_names(other)), pa.string()), pa.array(pick([R.HALF[h] for h in last.tolist()]), pa.string())]

    return _per_cell(cells, "mate string, mate_half string", found)


def hexagon_children(cells: DataFrame, c2: str = "021") -> DataFrame:
    """The half-hexagons of one level below that make up each cell's hexagon, a row for each: hexagon
    (its name), digits, half, canonical (the name of the child's own hexagon) and owned.

    A hexagon has two halves, and each half has its own address, also where they lie under different
    parents; children follow the half that they lie in. Six child hexagons lie inside. Those on the
    edges (digits 6, 7 and 8) are shared with a neighbour and belong to the one that holds the half
    which names them (owned). Cells of any levels may be mixed; a hexagon counts once."""
    named = canonical_cells(cells.select("digits", "half").distinct(), c2).select(F.col("canonical").alias("hexagon")).distinct()
    first = named.select("hexagon", F.expr("left(hexagon, length(hexagon) - 1)").alias("digits"), F.expr("right(hexagon, 1)").alias("half"))
    other = mates(first, c2).filter("mate is not null").select("hexagon", F.col("mate").alias("digits"), F.col("mate_half").alias("half"))
    return _owned(_half_children(first.unionByName(other)), lambda kids: canonical_cells(kids, c2))


def _half_children(halves_: DataFrame) -> DataFrame:
    """hexagon, digits and half of the half-hexagons below each half."""
    pairs = [(p, h, f"{c}", ch) for (p, c, ch), h in R.PARENT_HALF.items()]
    table = halves_.sparkSession.createDataFrame(pairs, "__digit int, __half string, child string, child_half string")  # fixed and small
    # On the sphere a root's own digit is 0.
    keyed = halves_.withColumn("__digit", F.coalesce(F.expr("try_cast(right(digits, 1) AS INT)"), F.lit(0))).withColumnRenamed("half", "__half")
    return keyed.join(F.broadcast(table), ["__digit", "__half"]).select("hexagon", F.concat("digits", "child").alias("digits"), F.col("child_half").alias("half"))


def _owned(kids: DataFrame, canonical) -> DataFrame:
    """The children with their hexagons' names; owned where the half of that name is among them too."""
    named = canonical(kids).select("hexagon", "digits", "half", "canonical")
    own = F.max((F.concat("digits", "half") == F.col("canonical")).cast("int")).over(Window.partitionBy("hexagon", "canonical"))
    return named.withColumn("owned", own == 1)
