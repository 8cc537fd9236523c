"""Approximate nearest neighbours with a forest of sorted hash strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

TREES = 32
#: Length of each hash string, in bits.
BITS = 64
#: Rows of a block, and queries that search it in one task; larger tables have more of both.
BLOCK_ROWS = 8192
QUERY_ROWS = 4096
#: Recall that the calibration asks for, on a sample of so many rows and queries at most.
RECALL = 0.97
SAMPLE_ROWS = 8192
SAMPLE_QUERIES = 128
LEAST_CANDIDATES = 256


class Forest:
    """The hash strings of some vectors, sorted in each tree.

    A string is the signs of BITS random projections. Rows that share a prefix with a query lie side
    by side in the tree's array, so a binary search finds how many there are at every depth.
    """

    def __init__(self, vectors: np.ndarray, centre: np.ndarray, trees: int = TREES):
        self.vectors, self.centre, self.trees = vectors, centre, trees
        self.order, self.keys = [], []
        for t in range(trees):
            keys = self._strings(vectors, t)
            order = np.argsort(keys, kind="stable")
            self.order.append(order)
            self.keys.append(keys[order])

    def _strings(self, vectors: np.ndarray, tree: int) -> np.ndarray:
        planes = np.random.default_rng([7, tree, vectors.shape[1]]).normal(size=(vectors.shape[1], BITS))
        bits = ((vectors - self.centre) @ planes) > 0
        return np.packbits(bits, axis=1).view(">u8").astype(np.uint64).reshape(-1)

    def _ranges(self, strings: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """strings: trees x queries. First and last place, in each tree, of rows that share `depth` bits."""
        if depth == 0:
            return np.zeros(strings.shape, np.int64), np.full(strings.shape, len(self.vectors), np.int64)
        rest = np.uint64((1 << (BITS - depth)) - 1)
        low, high = strings & ~rest, strings | rest
        return tuple(np.stack([np.searchsorted(self.keys[t], x[t], side) for t in range(self.trees)]) for x, side in ((low, "left"), (high, "right")))

    def candidates(self, queries: np.ndarray, least: int) -> Iterator[np.ndarray]:
        """For each query the rows that share its longest prefixes, at least `least` if there are so many.

        All trees are descended to the longest match, then left one bit at a time together until
        enough different rows are found."""
        least = min(least, len(self.vectors))
        strings = np.stack([self._strings(queries, t) for t in range(self.trees)])
        levels: dict[int, tuple] = {}
        at = lambda d: levels.setdefault(d, None) or levels.update({d: self._ranges(strings, d)}) or levels[d]
        depth = np.zeros(len(queries), np.int64)
        for d in range(BITS, 0, -1):
            low, high = at(d)
            depth = np.where((depth == 0) & ((high - low).sum(0) >= least), d, depth)
            if depth.all():
                break
        for q in range(len(queries)):
            d = int(depth[q])
            while True:
                low, high = at(d)
                if d == 0:
                    yield np.arange(len(self.vectors))
                    break
                hit = np.zeros(len(self.vectors), bool)
                for t in range(self.trees):
                    hit[self.order[t][low[t, q] : high[t, q]]] = True
                rows = np.flatnonzero(hit)
                if len(rows) >= least:
                    yield rows
                    break
                d -= 1


def _nearest(vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, query: np.ndarray, query_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    rows = rows[ids[rows] != query_id]
    distance = np.sqrt(((vectors[rows] - query) ** 2).sum(axis=1))
    if len(rows) > 4 * k:
        near = np.flatnonzero(distance <= np.partition(distance, k - 1)[k - 1])
        rows, distance = rows[near], distance[near]
    best = np.lexsort((ids[rows], distance))[:k]
    return ids[rows[best]], distance[best]


def _usable(vector: Column, dimension: int) -> Column:
    """Vectors of that length with finite components that are not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return vector.isNotNull() & (F.size(vector) == dimension) & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)


def _calibrate(rows: DataFrame, n: int, k: int) -> tuple[np.ndarray, float]:
    """The centre of a bounded sample, and the share of a block to look at for the wanted recall."""
    pick = F.pmod(F.xxhash64(F.lit(11), "vec_id"), F.lit(1 << 20)) < F.lit(int(min(1.0, SAMPLE_ROWS / max(n, 1)) * (1 << 20)) + 1)
    sample = rows.filter(pick).orderBy("vec_id").limit(SAMPLE_ROWS).toPandas()
    if len(sample) <= 4 * k:
        return (np.stack(sample["v"]).mean(0) if len(sample) else np.zeros(1)), 1.0
    vectors, ids = np.stack(sample["v"]).astype(np.float64), sample["vec_id"].to_numpy()
    centre = vectors.mean(0)
    forest = Forest(vectors, centre)
    queries = np.linspace(0, len(ids) - 1, min(SAMPLE_QUERIES, len(ids))).astype(int)
    everything = np.arange(len(ids))
    true = [set(_nearest(vectors, ids, everything, vectors[q], ids[q], k)[0]) for q in queries]
    for share in (0.002, 0.005, 0.01, 0.02, 0.04, 0.08, 0.12, 0.18, 0.25, 0.35, 0.45, 0.55, 0.65, 0.75, 0.85):
        least = max(LEAST_CANDIDATES, int(share * len(ids)))
        found = [len(true[i] & set(ids[rows_])) / max(1, len(true[i])) for i, rows_ in enumerate(forest.candidates(vectors[queries], least))]
        if np.mean(found) >= RECALL:
            return centre, share
    return centre, 1.0


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows of `vectors` nearest to each row of `queries` that a forest of hash strings finds.

    Returns query_id, rank (from 1), vec_id and score, the Euclidean distance in double precision;
    ties go to the smaller vec_id. Vectors are dealt by a hash of their id into blocks, and queries
    into parts, of bounded size; each block meets each part in a task that indexes it by TREES sorted
    arrays of long hash strings, so memory is bounded whatever the tables' sizes, and any task can be
    computed again alone. Each gives k rows a query at most, which are cut to k before the shuffle. How many candidates a block must give is calibrated once against brute
    force on a bounded sample (SAMPLE_ROWS, SAMPLE_QUERIES), for RECALL.

    Null keys, null, zero or non-finite vectors and those of another length than the commonest take
    no part. A row that repeats in full counts once. A query never finds rows with its own id. With
    fewer than k candidates all are returned; with none, or an empty table, no rows. Other columns
    are ignored.
    """
    clean = lambda df: df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).filter("vec_id is not null")
    rows = clean(vectors)
    sizes = rows.filter("v is not null").groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    dimension, n = (sizes[0]["d"], sizes[0]["n"]) if sizes else (0, 0)
    rows = rows.filter(_usable(F.col("v"), dimension))
    centre, share = _calibrate(rows, n, k)
    asked = clean(queries).filter(_usable(F.col("v"), dimension)).distinct()
    deal = lambda n: F.pmod(F.xxhash64(F.lit(5), "vec_id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    blocks, parts = max(1, -(-n // BLOCK_ROWS)), max(1, -(-asked.count() // QUERY_ROWS))
    indexed = rows.withColumn("block", deal(blocks)).withColumn("part", each(parts))
    asked = asked.withColumn("part", deal(parts)).withColumn("block", each(blocks))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def search(index: pa.Table, wanted: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(index) and len(wanted):
            frame = lambda t: (t.column("vec_id").to_numpy(), t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1))
            ids, block = frame(index)
            once = ~pd.DataFrame(np.column_stack([ids.view(np.float64), block])).duplicated().to_numpy() if len(np.unique(ids)) < len(ids) else slice(None)
            ids, block = ids[once], block[once]
            query_ids, points = frame(wanted)
            forest = Forest(block, centre)
            least = max(LEAST_CANDIDATES, 4 * k, int(np.ceil(share * len(ids))))
            for at in range(0, len(points), 256):
                part = slice(at, at + 256)
                for q, p, candidates in zip(query_ids[part], points[part], forest.candidates(points[part], least), strict=True):
                    out += [(q, i, s) for i, s in zip(*_nearest(block, ids, candidates, p, q, k), strict=True)]
        return pa.Table.from_arrays([pa.array([x[j] for x in out], f.type) for j, f in enumerate(schema)], schema=schema)

    found = indexed.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.filter("vec_id % 100 = 0"))
