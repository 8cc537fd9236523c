"""Functions for SQL: register(spark) gives a session the addressing kernels and table functions.

    cell_of(x, y, c2, level)        -> struct<digits, half, path>, null where a coordinate is
    cell_centre(digits, half)       -> struct<cx, cy>
    global_cell_centre(digits, half)-> struct<cx, cy, cz>, digits starting with a root
    LATERAL cell_children(path)     -> child_path: the nine half-hexagons of a half-hexagon
    LATERAL cell_ancestors(path)    -> level, cell, from the root down
    triangle_children(TABLE(t), depth) -> key, path, p0, p1, p2: 9^depth spherical triangles of each row
                                       of t (key, p0, p1, p2)

Scalar functions and triangle_children work on whole Arrow batches; table functions behind LATERAL get
rows, as Spark asks, and share the tables of the DataFrame operators.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udf, arrow_udtf, udtf

from ninefold.functions import rules as R
from ninefold.operators import addressing as A
from ninefold.operators.globe import _directions
from ninefold.operators.mesh import CHILD_TRIANGLES, MAX_DEPTH

#: Triangles that a call of triangle_children holds at a time.
CHUNK = 65_536


def _cell_of(x: pa.Array, y: pa.Array, c2: pa.Array, level: pa.Array) -> pa.Array:
    px, py = (a.cast(pa.float64()).to_numpy(zero_copy_only=False) for a in (x, y))
    code = np.array([R.C2.index(c) if c in R.C2 else -1 for c in c2.to_pylist()], np.int64)
    known = np.isfinite(px) & np.isfinite(py) & (code >= 0)
    levels = level.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
    known &= (levels >= 1) & (levels <= R.MAX_LEVEL)
    out = np.empty((len(px), 3), object)
    for n in np.unique(levels[known]):
        at = np.flatnonzero(known & (levels == n))
        found = A._text(*A.walk(px[at], py[at], code[at], int(n)))
        out[at] = np.array([t.to_pylist() for t in found], object).T
    return pa.StructArray.from_arrays([pa.array(list(out[:, k]), pa.string()) for k in range(3)], ["digits", "half", "path"], mask=pa.array(~known))


def _by_length(digits: pa.Array, half: pa.Array, width: int, solve, lead: int = 0) -> pa.Array:
    """solve(digits, halves, names) for cells of one level at a time; null where a cell is."""
    names, halves_ = digits.to_pylist(), half.to_pylist()
    known = np.array([d is not None and h in R.HALF and d[lead:].isdigit() for d, h in zip(names, halves_, strict=True)], bool)
    lengths = np.array([len(d or "") for d in names])
    out = np.zeros((len(names), width))
    for n in np.unique(lengths[known]):
        at = np.flatnonzero(known & (lengths == n))
        own = ["0" + names[k][2:] if lead else names[k] for k in at]
        out[at] = solve(*A._parsed(own, [halves_[k] for k in at]), [names[k][:2] for k in at])
    return pa.StructArray.from_arrays([pa.array(out[:, k]) for k in range(width)], ["cx", "cy", "cz"][:width], mask=pa.array(~known))


def _cell_centre(digits: pa.Array, half: pa.Array) -> pa.Array:
    return _by_length(digits, half, 2, lambda d, h, _: A.centres(d, h))


def _global_cell_centre(digits: pa.Array, half: pa.Array) -> pa.Array:
    return _by_length(digits, half, 3, lambda d, h, roots: np.stack(_directions(A.centres(d, h), h[:, 0] == 0, roots), axis=1), lead=2)


_CHILDREN = {(p, h): [f"{c}{x}" for c in range(9) for x in R.HALF if R.PARENT_HALF[p, c, x] == h] for p in range(9) for h in R.HALF}


class CellChildren:
    def eval(self, path: str) -> Iterator[tuple[str]]:
        for child in _CHILDREN[int(path[-2]), path[-1]] if path else ():
            yield (path + child,)


class CellAncestors:
    def eval(self, path: str) -> Iterator[tuple[int, str]]:
        root = len(path or "") % 2  # on the sphere the name of the root has one letter more
        for n in range(1, len(path or "") // 2 + 1):
            yield n, path[: 2 * n + root]


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=-1, keepdims=True)


def _thirds(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    angle = np.arccos(np.clip((a * b).sum(-1, keepdims=True), -1, 1))
    with np.errstate(invalid="ignore"):
        return [_unit((np.sin(angle * (1 - t)) * a + np.sin(angle * t) * b) / np.sin(angle)) for t in (1 / 3, 2 / 3)]


def _nine(triangles: np.ndarray) -> np.ndarray:
    """n x 3 corners to n x 9 x 3 corners."""
    i, j, k = (triangles[:, c] for c in range(3))
    ten = np.stack([_unit((i + j + k) / 3), i, *_thirds(i, j), j, *_thirds(j, k), k, *_thirds(k, i)], axis=1)
    return ten[:, np.array(CHILD_TRIANGLES)]


def _descend(keys: np.ndarray, paths: np.ndarray, triangles: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for first in range(0, len(keys), CHUNK):
        here = slice(first, first + CHUNK)
        if not depth:
            yield keys[here], paths[here], triangles[here]
            continue
        below = _nine(triangles[here]).reshape(-1, 3, 3)
        names = np.char.add(np.repeat(paths[here], 9), np.tile(np.arange(9).astype("<U1"), len(keys[here])))
        yield from _descend(np.repeat(keys[here], 9), names, below, depth - 1)


class TriangleChildren:
    def eval(self, batch: pa.RecordBatch, depth) -> Iterator[pa.Table]:
        levels = int(depth[0].as_py() if isinstance(depth, (pa.Array, pa.ChunkedArray)) else depth.as_py() if isinstance(depth, pa.Scalar) else depth)
        if not 0 <= levels <= MAX_DEPTH:
            raise ValueError(f"depth must be from 0 to {MAX_DEPTH}")
        if len(batch):
            keys = batch.column("key").cast(pa.int64()).to_numpy(zero_copy_only=False)
            corners = np.stack([batch.column(f"p{c}").flatten().to_numpy(zero_copy_only=False).reshape(-1, 3) for c in range(3)], axis=1)
            for k, names, some in _descend(keys, np.full(len(keys), "", "<U8"), corners, levels):
                points = [pa.ListArray.from_arrays(np.arange(0, 3 * len(k) + 1, 3, dtype=np.int32), pa.array(np.ascontiguousarray(some[:, c]).reshape(-1))) for c in range(3)]
                yield pa.table([pa.array(k), pa.array(names.astype(str), pa.string()), *points], ["key", "path", "p0", "p1", "p2"])


def register(spark: SparkSession) -> None:
    """Make the functions above known to the session's SQL."""
    spark.udf.register("cell_of", arrow_udf(_cell_of, "struct<digits: string, half: string, path: string>"))
    spark.udf.register("cell_centre", arrow_udf(_cell_centre, "struct<cx: double, cy: double>"))
    spark.udf.register("global_cell_centre", arrow_udf(_global_cell_centre, "struct<cx: double, cy: double, cz: double>"))
    spark.udtf.register("cell_children", udtf(CellChildren, returnType="child_path string", useArrow=True))
    spark.udtf.register("cell_ancestors", udtf(CellAncestors, returnType="level int, cell string", useArrow=True))
    spark.udtf.register("triangle_children", arrow_udtf(TriangleChildren, returnType="key long, path string, p0 array<double>, p1 array<double>, p2 array<double>"))
