"""Hard negatives against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ninefold.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int"


def expected(rows, anchor, positives=5, count=5, scale=256):
    usable = {(i, tuple(v), c) for i, v, c in rows if i is not None and v is not None and c is not None and all(x is not None and math.isfinite(x) for x in v)}
    usable = sorted((i, [math.floor(scale * x) for x in v], c) for i, v, c in usable)
    out = []
    for i, v, c in usable:
        if anchor(i):
            scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j, d) for j, w, d in usable if j != i)
            for p, j, _ in [x for x in scored if x[2] == c][:positives]:
                good = [x for x in scored if x[2] != c and 80 * -p <= 100 * -x[0] <= 100 * -p][:count]
                out += [(i, j, k + 1, n, -p, -s) for k, (s, n, _) in enumerate(good)]
    return sorted(out)


def found(df, anchors="vec_id % 100 = 0", **more):
    return sorted(tuple(r) for r in negatives.hard_negatives(df, anchors, **more).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def clouds(n=900, d=8, seed=4):
    """Clusters of directions with lengths over two orders of size, and many ties."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    v = centres[rng.integers(0, 12, n)] + 0.15 * rng.normal(size=(n, d))
    v *= np.exp(rng.normal(size=(n, 1)))
    v[rng.random(n) < 0.2] = v[0]
    return [(int(i), x.tolist(), int(c)) for i, (x, c) in enumerate(zip(v, rng.integers(0, 4, n), strict=True))]


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(negatives, "GROUP_ROWS", 60)
        monkeypatch.setattr(negatives, "ANCHOR_ROWS", 4)
        monkeypatch.setattr(negatives, "BUCKET_ROWS", 16)
        monkeypatch.setattr(negatives, "SLICE_ROWS", 3)
    rows = clouds()
    assert found(spark.createDataFrame(rows, SCHEMA), "vec_id % 30 = 0") == expected(rows, lambda i: i % 30 == 0)


def test_buckets_give_all_that_reach_the_floor():
    rng = np.random.default_rng(1)
    v = np.floor(256 * (rng.normal(size=(3, 12))[rng.integers(0, 3, 400)] + 0.2 * rng.normal(size=(400, 12))))
    norms = np.sqrt((v**2).sum(1))
    bucket = negatives.Bucket(np.arange(400), v, norms)
    scores = (v @ v.T).astype(np.int64)
    for share in (0.5, 0.9, 0.99, 1.0):
        floors = share * norms * norms.max()
        met = {(int(a), int(r)): int(s) for x in bucket.meet(v, norms, floors) for a, r, s in zip(*x, strict=True)}
        assert all(met[a, r] == scores[a, r] for a, r in zip(*np.nonzero(scores >= floors[:, None]), strict=True))
        assert all(scores[k] == s for k, s in met.items())
    assert len(met) < 0.1 * 400 * 400  # ranges of coordinates leave few rows to verify
    assert not list(bucket.meet(v, norms, 1.01 * norms * norms.max()))


def test_large_components_are_exact(spark):
    rows = [(k * 50, [1e6 + k, -1e6 + k % 7, 3e5 * k], k % 2) for k in range(8)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == expected(rows, lambda i: i % 100 == 0)
    assert negatives.inner_products(np.array([[2.0**60, 1.0]]), np.array([[2.0**60, 3.0], [1.0, 5.0]])).tolist() == [[2**63 - 1, 2**60 + 5]]


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.5], 0), (0, [1.0, 0.5], 0), (0, [0.5, 1.0], 0), (1, [1.0, 0.4], 0), (2, [1.0, 0.4], 1), (2, [1.0, 0.4], 1), (3, [0.9, 0.4], 1), (4, [0.0, 0.0], 0), (5, [0.0, 0.0], 1), (6, None, 0), (7, [1.0, 1.0], None), (8, [nan, 1.0], 0), (9, [inf, 1.0], 1), (10, [None, 1.0], 1), (None, [1.0, 1.0], 0), (100, [0.0, 0.0], 2), (200, [-1.0, 0.0], 3), (201, [1.0, 0.0], 3)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("anchor", F.lit("clash")).withColumn("v", F.lit(1)).withColumn("norm", F.lit("x")).withColumn("grp", F.lit(3))
    assert found(df) == expected(rows, lambda i: i % 100 == 0)
    assert found(df.union(spark.createDataFrame([(11, [1.0, 2.0, 3.0], 0)], SCHEMA).withColumns({c: F.lit(None) for c in ("anchor", "v", "norm", "grp")}))) == found(df)
    assert found(df.limit(0)) == [] and found(df, "false") == [] and found(df.filter("label = 0")) == []
