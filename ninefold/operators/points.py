"""Points on the sphere: rotation, fitted rotations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ninefold.functions.columns import dot, latitude, longitude, unit_vector


def rotation(ax: float, ay: float, az: float) -> list[list[float]]:
    """Rx @ Ry @ Rz, angles in degrees."""
    (sx, cx), (sy, cy), (sz, cz) = ((math.sin(math.radians(a)), math.cos(math.radians(a))) for a in (ax, ay, az))
    rx, ry, rz = [[1, 0, 0], [0, cx, -sx], [0, sx, cx]], [[cy, 0, sy], [0, 1, 0], [-sy, 0, cy]], [[cz, -sz, 0], [sz, cz, 0], [0, 0, 1]]
    times = lambda a, b: [[sum(a[i][k] * b[k][j] for k in range(3)) for j in range(3)] for i in range(3)]
    return times(times(rx, ry), rz)


def rotate_points(points: DataFrame, ax: float, ay: float, az: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """The points with lat and lon after a rotation, and moved, the angle between old and new in degrees."""
    m, v = rotation(ax, ay, az), unit_vector(F.col(lat), F.col(lon))
    new = [dot([F.lit(float(c)) for c in row], v) for row in m]
    out = points.withColumns({"__x": v[0], "__y": v[1], "__z": v[2], "__u": new[0], "__v": new[1], "__w": new[2]})
    old, now = [F.col(c) for c in ("__x", "__y", "__z")], [F.col(c) for c in ("__u", "__v", "__w")]
    moved = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(old, now)))))
    return out.withColumns({lat: latitude(*now), lon: longitude(now[0], now[1]), "moved": moved}).drop("__x", "__y", "__z", "__u", "__v", "__w")


def fit_rotation(pairs: DataFrame) -> DataFrame:
    """The matrix that takes u to v in the least squares sense: m00..m22, determinant, rms of the residuals.

    One aggregate of products, then arithmetic on one row; the pairs are (ux, uy, uz, vx, vy, vz)."""
    u, v = [F.col(f"u{c}") for c in "xyz"], [F.col(f"v{c}") for c in "xyz"]
    sums = {f"a{i}{j}": F.sum(u[i] * u[j]) for i in range(3) for j in range(3)} | {f"b{i}{j}": F.sum(v[i] * u[j]) for i in range(3) for j in range(3)}
    row = pairs.agg(*[s.alias(n) for n, s in sums.items()], F.count("*").alias("n"), F.sum(dot(v, v)).alias("vv"))
    a = lambda i, j: F.col(f"a{i % 3}{j % 3}")
    cof = lambda i, j: a(i + 1, j + 1) * a(i + 2, j + 2) - a(i + 1, j + 2) * a(i + 2, j + 1)
    det = a(0, 0) * cof(0, 0) + a(0, 1) * cof(0, 1) + a(0, 2) * cof(0, 2)
    row = row.withColumn("__det", det)
    row = row.withColumns({f"i{i}{j}": cof(j, i) / F.col("__det") for i in range(3) for j in range(3)})
    row = row.withColumns({f"m{i}{j}": sum((F.col(f"b{i}{k}") * F.col(f"i{k}{j}") for k in range(1, 3)), F.col(f"b{i}0") * F.col(f"i0{j}")) for i in range(3) for j in range(3)})
    m = lambda i, j: F.col(f"m{i % 3}{j % 3}")
    mcof = lambda i, j: m(i + 1, j + 1) * m(i + 2, j + 2) - m(i + 1, j + 2) * m(i + 2, j + 1)
    # sum |v - M u|^2 = sum v.v - sum over M * B, as M solves the normal equations.
    fitted = sum((F.col(f"m{i}{j}") * F.col(f"b{i}{j}") for i in range(3) for j in range(3) if (i, j) != (0, 0)), F.col("m00") * F.col("b00"))
    return row.select(*[f"m{i}{j}" for i in range(3) for j in range(3)], (m(0, 0) * mcof(0, 0) + m(0, 1) * mcof(0, 1) + m(0, 2) * mcof(0, 2)).alias("determinant"), F.sqrt(F.greatest(F.lit(0.0), F.col("vv") - fitted) / F.col("n")).alias("rms"))


def rotation_residuals(pairs: DataFrame, fitted: DataFrame) -> DataFrame:
    """The pairs with rx, ry, rz (v less the fitted image of u) and residual, its length. `fitted` is the one
    row of fit_rotation, which is sent to all rows."""
    m = [[f"m{i}{j}" for j in range(3)] for i in range(3)]
    rows = pairs.crossJoin(F.broadcast(fitted.select(*[c for r in m for c in r])))  # one row
    off = [F.col(f"v{a}") - sum((F.col(m[i][j]) * F.col(f"u{b}") for j, b in enumerate("xyz") if j), F.col(m[i][0]) * F.col("ux")) for i, a in enumerate("xyz")]
    out = rows.withColumns({f"r{a}": o for a, o in zip("xyz", off, strict=True)}).select(*pairs.columns, "rx", "ry", "rz")
    return out.withColumn("residual", F.sqrt(F.col("rx") * F.col("rx") + F.col("ry") * F.col("ry") + F.col("rz") * F.col("rz")))
