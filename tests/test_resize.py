"""Resizing of rasters whose sizes' product is beyond 32 bits."""

import math

import pytest

from ninefold.operators import raster as X


@pytest.mark.parametrize("scale", [1.5, 0.7])
def test_tall_rasters(spark, scale):
    height, width, new = 2_000_000, 4, int(scale * 2_000_000)
    rows = [0, 1, 1_234_567, height - 2, height - 1]
    image = spark.createDataFrame([(r, c, r, c, 0) for r in rows for c in range(width)], "row int, col int, r int, g int, b int")
    found = X.resize(image, scale, height, width).collect()
    source = lambda t, old, size: min(old - 1, math.floor(t * (old / size)))
    near = {t for r in rows for t in range(max(0, int(r * scale) - 3), min(new, int(r * scale) + 4))}
    expected = {(t, c): (source(t, height, new), source(c, width, int(scale * width))) for t in near if source(t, height, new) in rows for c in range(int(scale * width))}
    assert len(found) == len(expected) and {(r["row"], r["col"]): (r["r"], r["g"]) for r in found} == expected
