"""Hard negatives by inner products, found in length buckets with pruning by coordinates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, table

#: Rows of a group and anchors that meet it in one task; larger tables have more of both.
GROUP_ROWS = 1 << 17
ANCHOR_ROWS = 1 << 14
#: Rows of a length bucket inside a group, and anchors that it is held against at a time.
BUCKET_ROWS = 4096
SLICE_ROWS = 256
#: Coordinates of an anchor whose feasible ranges are looked up, the largest ones.
FOCUS = 4
#: An anchor whose narrowest range holds a larger share of a bucket is held against the whole bucket.
NARROW = 0.25
_SLACK = 1e-9


class Bucket:
    """Rows of one label and similar length, with a sorted list of each coordinate of their directions."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray):
        self.ids, self.vectors, self.longest = ids, vectors, float(norms.max())
        self.directions = np.divide(vectors, norms[:, None], out=np.zeros_like(vectors), where=(norms > 0)[:, None])
        self._lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def list_of(self, coordinate: int) -> tuple[np.ndarray, np.ndarray]:
        if coordinate not in self._lists:
            order = np.argsort(self.directions[:, coordinate], kind="stable")
            self._lists[coordinate] = order, self.directions[order, coordinate]
        return self._lists[coordinate]

    def least_cosine(self, floors: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """The least cosine with which a row of this bucket can reach an anchor's floor; above 1: none can."""
        reach = self.longest * norms
        with np.errstate(invalid="ignore", divide="ignore"):
            cosine = np.where(np.isfinite(reach) & (reach > 0), floors / reach, np.where(reach == 0, np.where(floors > 0, np.inf, -1.0), -1.0))
        return np.maximum(cosine, -1.0)

    def meet(self, vectors: np.ndarray, norms: np.ndarray, floors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Anchors (by number), rows and scores; all rows that reach an anchor's floor are among them."""
        cosine = self.least_cosine(floors, norms)
        able = np.flatnonzero(cosine <= 1 + _SLACK)
        if not len(able):
            return
        directions = np.divide(vectors[able], norms[able, None], out=np.zeros_like(vectors[able]), where=(norms[able] > 0)[:, None])
        focus = np.argsort(-np.abs(directions), axis=1, kind="stable")[:, : min(FOCUS, directions.shape[1])]
        # Two directions within an angle: their angles with an axis differ by no more than it.
        angle = np.arccos(np.clip(np.take_along_axis(directions, focus, 1), -1, 1))
        wide = np.arccos(np.clip(cosine[able], -1, 1))[:, None]
        low, high = np.cos(np.minimum(np.pi, angle + wide)) - _SLACK, np.cos(np.maximum(0, angle - wide)) + _SLACK
        first, last = np.zeros(focus.shape, np.int64), np.full(focus.shape, len(self.ids))
        for f in np.unique(focus):
            at = np.nonzero(focus == f)
            values = self.list_of(int(f))[1]
            first[at], last[at] = np.searchsorted(values, low[at], "left"), np.searchsorted(values, high[at], "right")
        best = (last - first).argmin(axis=1)
        fewest = np.take_along_axis(last - first, best[:, None], 1)[:, 0]
        whole = fewest > NARROW * len(self.ids)
        if whole.any():
            scores = inner_products(vectors[able[whole]], self.vectors)
            yield np.repeat(able[whole], len(self.ids)), np.tile(np.arange(len(self.ids)), int(whole.sum())), scores.reshape(-1)
        for k in np.flatnonzero(~whole & (fewest > 0)):
            b = best[k]
            rows = self.list_of(int(focus[k, b]))[0][first[k, b] : last[k, b]]
            for c in range(focus.shape[1]):
                if c != b:
                    value = self.directions[rows, focus[k, c]]
                    rows = rows[(value >= low[k, c]) & (value <= high[k, c])]
            if len(rows):
                yield np.full(len(rows), able[k]), rows, inner_products(vectors[able[k]][None], self.vectors[rows])[0]


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of integer-valued rows; beyond a long they stay at its ends."""
    most = lambda m: float(np.abs(m).max(initial=0))
    if most(a) * most(b) * max(1, a.shape[1]) < 2**53:
        return (a @ b.T).astype(np.int64)
    exact = lambda m: np.array([[int(x) for x in r] for r in m], object).reshape(m.shape)
    return np.clip(exact(a) @ exact(b).T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _first(k: int, of: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Places of the first k with `ok` for each value of `of`, which is sorted."""
    places = np.flatnonzero(ok)
    own = of[places]
    begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    return places[np.arange(len(own)) - np.repeat(begin, np.diff(np.append(begin, len(own)))) < k]


def _matrix(t: pa.Table) -> np.ndarray:
    return t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)


def _numbers(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


def _buckets(rows: pa.Table) -> Iterator[tuple[int, Bucket]]:
    """A group's buckets, of each label the longest rows first."""
    if not len(rows):
        return
    label, norm, ids, vectors = _numbers(rows, "label"), _numbers(rows, "norm"), _numbers(rows, "vec_id"), _matrix(rows)
    order = np.lexsort((ids, -norm, label))
    begins = np.flatnonzero(np.concatenate([[True], label[order][1:] != label[order][:-1]]))
    for first, last in zip(begins, np.append(begins[1:], len(order)), strict=True):
        for at in range(first, last, BUCKET_ROWS):
            some = order[at : min(last, at + BUCKET_ROWS)]
            yield int(label[some[0]]), Bucket(ids[some], vectors[some], norm[some])


def _anchor_slices(anchors: pa.Table, label: int, same: bool) -> Iterator[np.ndarray]:
    own = np.flatnonzero((_numbers(anchors, "label") == label) == same)
    for at in range(0, len(own), SLICE_ROWS):
        yield own[at : at + SLICE_ROWS]


def _positives(k: int):
    """Of one group, each anchor's best k other rows of its label that reach its floor."""

    def search(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(rows) and len(anchors):
            q, norm, own, key = _matrix(anchors), _numbers(anchors, "norm"), _numbers(anchors, "vec_id"), _numbers(anchors, "anchor")
            floors = anchors.column("floor").combine_chunks().fill_null(float("-inf")).to_numpy(zero_copy_only=False).copy()
            for label, bucket in _buckets(rows):
                for some in _anchor_slices(anchors, label, True):
                    for a, r, score in bucket.meet(q[some], norm[some], floors[some]):
                        good = (score >= floors[some][a]) & (bucket.ids[r] != own[some][a])
                        a, r, score = a[good], r[good], score[good]
                        order = np.lexsort((bucket.ids[r], -score, a))
                        a, r, score = a[order], r[order], score[order]
                        kept = _first(k, a, np.ones(len(a), bool))
                        out.append((key[some][a[kept]], bucket.ids[r[kept]], score[kept]))
                        a, score = a[kept], score[kept]
                        kth = np.flatnonzero(a[k - 1 :] == a[: max(0, len(a) - k + 1)]) + k - 1
                        floors[some[a[kth]]] = np.maximum(floors[some[a[kth]]], score[kth])  # for the next buckets
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("anchor", "positive_id", "positive_score"), columns, strict=True)})

    return search


def _negatives(k: int):
    """Of one group, the best k rows of other labels inside each range of each anchor."""

    def search(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(rows) and len(anchors):
            q, norm, key, floors = _matrix(anchors), _numbers(anchors, "norm"), _numbers(anchors, "anchor"), _numbers(anchors, "floor")
            ranges = anchors.column("ranges").to_pylist()
            most = max(map(len, ranges))
            table_ = lambda name: np.array([[r[name] for r in x] + [1 if name == "low" else 0] * (most - len(x)) for x in ranges], np.int64)
            low, high = table_("low"), table_("high")  # a missing range is empty: from 1 to 0
            for label, bucket in _buckets(rows):
                for some in _anchor_slices(anchors, label, False):
                    for a, r, score in bucket.meet(q[some], norm[some], floors[some]):
                        good = (score >= floors[some][a]) & (score <= high[some].max(axis=1)[a])
                        a, r, score = a[good], r[good], score[good]
                        order = np.lexsort((bucket.ids[r], -score, a))
                        a, r, score = a[order], r[order], score[order]
                        for place in range(most):
                            kept = _first(k, a, (score >= low[some, place][a]) & (score <= high[some, place][a]))
                            out.append((key[some][a[kept]], np.full(len(kept), place), bucket.ids[r[kept]], score[kept]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("anchor", "place", "negative_id", "negative_score"), columns, strict=True)})

    return search


def _scaled(rows: DataFrame, scale: float) -> DataFrame:
    """Components times the scale, rounded down, and the length of the result."""

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            v = batch.column("v")
            values = np.floor(v.flatten().to_numpy(zero_copy_only=False) * scale)
            with np.errstate(over="ignore"):
                norms = np.sqrt((values.reshape(len(v), -1) ** 2).sum(axis=1)) if len(v) else np.zeros(0)
            lists = pa.ListArray.from_arrays(pa.array((v.offsets.to_numpy() - v.offsets[0].as_py()).astype(np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), lists, pa.array(norms)], ["vec_id", "label", "v", "norm"])

    return rows.mapInArrow(work, "vec_id long, label long, v array<double>, norm double")


def hard_negatives(vectors: DataFrame, anchors: str, *, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """For each anchor (rows for which the SQL condition `anchors` holds) and each of its `positives` best
    rows of the same label, the best `negatives` rows of other labels whose score is from `low` to
    `high` percent of the positive's.

    Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score and negative_score. The
    score is the inner product of components times `scale`, rounded down; ties go to the smaller key.

    Rows are dealt by length into groups, the longest first, and each task cuts its group into buckets
    of one label with sorted coordinate lists. The longest group gives each anchor a first floor; only
    groups that can reach its floor see the anchor again. In a bucket the floor over both lengths is
    the least cosine, which leaves a range for each of the anchor's largest coordinates; rows in all
    ranges are verified exactly (all rows of a bucket where no range is narrow).

    Null keys, null labels, null vectors, null or non-finite components and vectors of another length
    than the commonest take no part; zero vectors do. Rows that repeat in full count once; rows with
    one key and other contents are rows of their own, and never positives of each other. An anchor with
    no positive, or a positive below 0, has no negatives. Other columns are ignored; an empty table
    gives no rows.
    """
    spark = vectors.sparkSession
    finite = lambda x: x.isNotNull() & (F.abs(x * scale) < F.lit(float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.filter("vec_id is not null AND label is not null AND v is not null").filter(F.forall("v", lambda x: finite(x) & ~F.isnan(x)))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    rows = _scaled(rows.filter(F.size("v") == (sizes[0]["d"] if sizes else 0)).distinct(), scale)
    order = [F.desc("norm"), F.asc("vec_id")]
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    placed = checkpointed(dealt.withColumn("row", F.monotonically_increasing_id()).withColumn("grp", F.expr(f"shiftright(row, 33) * {1 << 33} + (row & {(1 << 33) - 1}) div {GROUP_ROWS}")))
    # One number for each group of many rows.
    lengths = sorted(((r["longest"], r["grp"]) for r in placed.groupBy("grp").agg(F.max("norm").alias("longest")).collect()), key=lambda x: (-x[0], x[1]))
    asked = placed.filter(anchors).select(F.col("row").alias("anchor"), *[F.col(c).alias(c) for c in ("vec_id", "label", "v", "norm")])
    parts = max(1, -(-asked.count() // ANCHOR_ROWS))
    dealt_rows = placed.select("grp", "vec_id", "label", "v", "norm", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))

    def meet(who: DataFrame, groups: list[tuple[float, int]], search, schema: str) -> DataFrame:
        if not groups:
            return spark.createDataFrame([], schema)
        all_groups = F.array(*[F.struct(F.lit(float(n)).alias("longest"), F.lit(g).alias("grp")) for n, g in groups])
        able = F.filter(all_groups, lambda g: F.col("floor").isNull() | (g["longest"] * F.col("norm") * (1 + _SLACK) >= F.col("floor")))
        sent = who.withColumn("grp", F.explode(able)).withColumn("grp", F.col("grp.grp")).withColumn("part", F.pmod(F.xxhash64("anchor"), F.lit(parts)).cast("int"))
        return dealt_rows.groupBy("grp", "part").cogroup(sent.groupBy("grp", "part")).applyInArrow(search, schema)

    positive = "anchor long, positive_id long, positive_score long"
    first = checkpointed(meet(asked.withColumn("floor", F.lit(None).cast("double")), lengths[:1], _positives(positives), positive))
    best = lambda by, *ties: Window.partitionBy(*by).orderBy(*ties)
    top = best(["anchor"], F.desc("positive_score"), "positive_id")
    ranked = first.withColumn("place", F.row_number().over(top))
    floors = ranked.filter(F.col("place") == positives).select("anchor", F.col("positive_score").cast("double").alias("floor"))
    rest = meet(asked.join(floors, "anchor", "left"), lengths[1:], _positives(positives), positive)
    chosen = checkpointed(first.unionByName(rest).withColumn("place", F.row_number().over(top) - 1).filter(F.col("place") < positives))
    bounds = chosen.filter("positive_score >= 0").select("anchor", "place", F.expr(f"CAST(ceil(positive_score * CAST({low} AS DECIMAL(10)) / 100) AS LONG)").alias("low"), F.expr(f"CAST(floor(positive_score * CAST({high} AS DECIMAL(10)) / 100) AS LONG)").alias("high"))
    # Ranges stand at the places of their positives, which are the first ones of the anchor.
    ranges = bounds.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "low", "high"))).alias("ranges"), F.min("low").cast("double").alias("floor"))
    found = meet(asked.join(ranges, "anchor"), lengths, _negatives(negatives), "anchor long, place long, negative_id long, negative_score long")
    rank = F.row_number().over(best(["anchor", "place"], F.desc("negative_score"), "negative_id"))
    named = chosen.join(asked.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    return found.withColumn("rank", rank).filter(F.col("rank") <= negatives).join(named, ["anchor", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").selectExpr("vec_id", "embedding", "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label")
    return hard_negatives(rows, "vec_id % 100 = 0")
