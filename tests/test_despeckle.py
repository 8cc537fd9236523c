"""Despeckling against loops over pixels, across the seams of tiles."""

import math
import random

import numpy as np
import pytest

from ninefold.operators import raster as X

H, W = 41, 38


def picture(seed=6):
    """Smooth colours with lines and speckles."""
    rng = random.Random(seed)
    image = [[[(3 * y + 2 * x) % 256, 120 + (y // 9) * 10, 40 + (x // 7) * 20] for x in range(W)] for y in range(H)]
    for y in range(H):
        image[y][17] = [5, 5, 5]
    for x in range(W):
        image[23][x] = [250, 240, 250]
    for _ in range(160):
        image[rng.randrange(H)][rng.randrange(W)] = [rng.randrange(256) for _ in range(3)]
    return image


def at(grid, y, x):
    return grid[min(max(y, 0), len(grid) - 1)][min(max(x, 0), len(grid[0]) - 1)]


def threshold(grid, k, c):
    """255 above the Gaussian mean of the k x k surroundings less c."""
    sigma = 0.3 * ((k - 1) * 0.5 - 1) + 0.8
    weight = [math.exp(-((i - k // 2) ** 2) / (2 * sigma * sigma)) for i in range(k)]
    whole = sum(weight) ** 2
    out = []
    for y in range(len(grid)):
        out.append([])
        for x in range(len(grid[0])):
            mean = sum(weight[i] * weight[j] * at(grid, y + i - k // 2, x + j - k // 2) for i in range(k) for j in range(k)) / whole
            out[-1].append(255 if grid[y][x] > round(mean) - c else 0)
    return out


def expected(image):
    dark = [[255 - max(p) for p in row] for row in image]
    inverse = [[255 - v for v in row] for row in threshold(dark, 9, 17)]
    second = threshold(inverse, 5, 9)
    out = {}
    for y in range(H):
        for x in range(W):
            edge = min(255, max(0, second[y][x] - inverse[y][x]))
            around = [at(image, y + i, x + j) for i in range(-4, 5) for j in range(-4, 5)]
            out[y, x] = tuple(image[y][x]) if edge else tuple(sorted(p[b] for p in around)[40] for b in range(3))
    return out


@pytest.mark.parametrize("tile", [16, 256])
def test_equals_loops_over_pixels(spark, monkeypatch, tile):
    monkeypatch.setattr(X, "TILE", tile)
    image = picture()
    df = spark.createDataFrame([(y, x, *image[y][x]) for y in range(H) for x in range(W)], "row int, col int, r int, g int, b int")
    found = {(r["row"], r["col"]): (r["r"], r["g"], r["b"]) for r in X.despeckle(df).collect()}
    mine = expected(image)
    assert found == mine and any(mine[y, x] == tuple(image[y][x]) != (5, 5, 5) for y in range(H) for x in range(W))
    assert sum(mine[y, x] != tuple(image[y][x]) for y in range(H) for x in range(W)) > H * W / 3


@pytest.mark.parametrize("spread", [3, 200, 5000])
def test_medians(monkeypatch, spread):
    rng = np.random.default_rng(spread)
    values = rng.integers(-1, spread, (30, 23))
    brute = np.array([[sorted(values[y : y + 9, x : x + 9].reshape(-1).tolist())[40] for x in range(15)] for y in range(22)])
    assert (X._medians(values, 9) == brute).all()
    monkeypatch.setattr(X, "HISTOGRAM_BINS", 2)
    assert (X._medians(values, 9) == brute).all()
