"""Column helpers: coordinates on the unit sphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit_vector(lat: Column, lon: Column) -> list[Column]:
    """x, y, z of a place given in degrees."""
    phi, theta = F.radians(lat), F.radians(lon)
    return [F.cos(phi) * F.cos(theta), F.cos(phi) * F.sin(theta), F.sin(phi)]


def latitude(x: Column, y: Column, z: Column) -> Column:
    return F.degrees(F.atan2(z, F.sqrt(x * x + y * y)))


def longitude(x: Column, y: Column) -> Column:
    return F.degrees(F.atan2(y, x))


def dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def normalised(v: list[Column]) -> list[Column]:
    n = F.sqrt(dot(v, v))
    return [c / n for c in v]


def slerp(a: list[Column], b: list[Column], t: Column) -> list[Column]:
    """The unit vector that lies the share t of the way along the great circle from a to b."""
    angle = F.acos(dot(a, b))
    whole = F.sin(angle)
    weights = F.sin(angle * (1.0 - t)) / whole, F.sin(angle * t) / whole
    return [weights[0] * start + weights[1] * end for start, end in zip(a, b, strict=True)]
