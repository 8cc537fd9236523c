"""The Jaccard join and the neighbour search against brute force."""

import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from ninefold.llm import jaccard, neighbours

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected_components(rows, size=4, threshold=85):
    def shingles(text):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return frozenset([tuple(w)] if 0 < len(w) < size else zip(*(w[k:] for k in range(size)), strict=False)) if w else frozenset()

    sets = {k: shingles(t) for k, t in rows}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= threshold * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: (len(s), find(k)) for k, s in sets.items()}


def near_copies(seed=3, groups=12, copies=9):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = " ".join(rng.choices(words, k=30))
    rows = []
    for _ in range(groups):
        base = rng.choices(words, k=rng.choice([3, 20, 60, 150]))
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                text[rng.randrange(len(text))] = rng.choice(words).upper()
            rows.append(" ".join(text) + (" " + passage if rng.random() < 0.3 else ""))
    return [(k, t) for k, t in enumerate(rows)]


def test_components_equal_brute_force(spark, monkeypatch):
    rows = [*near_copies(), (1000, None), (1001, ""), (1002, "one"), (1003, "ONE"), (1004, "one two"), (1005, " \n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("id", F.lit(1))
    expected = expected_components(rows)
    check = lambda: {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df).collect()}
    assert check() == expected
    # Groups that are too large to pair or to open at once give the same links.
    monkeypatch.setattr(jaccard, "PAIRED_MEMBERS", 3)
    monkeypatch.setattr(jaccard, "GROUP_ROWS", 4)
    assert check() == expected


def test_joins_of_odd_rows(spark, odd_docs):
    rows = jaccard.jaccard_components(odd_docs).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == odd_docs.count() and by[1]["n_shingles"] == 0 and by[1]["component_id"] == 1
    assert by[5]["component_id"] == 4 and by[None]["component_id"] == 4
    kept = jaccard.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 7, 8, 9]  # the 6th has the shingles of the 4th and three more
    assert jaccard.jaccard_components(odd_docs.limit(0)).count() == 0


def test_rows_with_one_key_and_different_texts(spark):
    words = [f"w{k}" for k in range(40)]
    rows = [(1, " ".join(words)), (1, "quite another text than the first one"), (2, " ".join(words[:39])), (3, "quite another text than the first one"), (3, "a third text that stands alone here"), (None, " ".join(words)), (4, None), (4, "x y z")]
    found = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == [(0, 37, 1), (1, 4, 1), (1, 37, 1), (2, 36, 1), (3, 4, 1), (3, 4, 3), (4, 0, 4), (4, 1, 4)]


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 60)] + [(100, 101)], "a long, b long")
    found = {r["id"]: r["component"] for r in jaccard.components(links).collect()}
    assert found == {k: 1 for k in range(1, 61)} | {100: 100, 101: 100}


def brute_neighbours(ids, vectors, k):
    out = {}
    for q, v in zip(ids, vectors, strict=True):
        if q % 100 == 0:
            d = np.sqrt(((vectors - v) ** 2).sum(1))
            out[q] = [int(ids[i]) for i in sorted(range(len(ids)), key=lambda i: (d[i], ids[i])) if ids[i] != q][:k]
    return out


def test_recall(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = neighbours.nearest_neighbours(vectors, vectors.filter("vec_id % 100 = 0")).collect()
    data = vectors.orderBy("vec_id").toPandas()
    ids, matrix = data["vec_id"].to_numpy(), np.stack(data["embedding"]).astype(np.float64)
    true = brute_neighbours(ids, matrix, 10)
    found: dict = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append(r["vec_id"])
        assert abs(r["score"] - np.sqrt(((matrix[r["vec_id"]] - matrix[r["query_id"]]) ** 2).sum())) < 1e-12
    assert np.mean([len(set(found[q]) & set(t)) / len(t) for q, t in true.items()]) >= 0.9
    assert all([r["rank"] for r in rows if r["query_id"] == q].__len__() == 10 for q in true)


def test_small_blocks_and_parts_give_exact_ranks_with_ties(spark, monkeypatch):
    """Whole blocks as candidates, many equal distances: the ranks are those of brute force."""
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 40)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 2)
    rng = np.random.default_rng(8)
    ids, matrix = np.arange(700), rng.integers(-2, 3, size=(700, 3)).astype(np.float64)
    usable = (matrix != 0).any(1)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, matrix, strict=True)], "vec_id long, embedding array<double>")
    found: dict = {}
    for r in sorted(neighbours.nearest_neighbours(df, df.filter("vec_id % 100 = 0")).collect(), key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert found == brute_neighbours(ids[usable], matrix[usable], 10)


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0, 2.0]), (8, [1.0, 2.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (100, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")).withColumn("block", F.lit(9))
    found = neighbours.nearest_neighbours(df, df.filter("vec_id % 100 = 0")).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found) == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 8, 2.0)]
    assert neighbours.nearest_neighbours(df.limit(0), df).count() == 0
    assert neighbours.nearest_neighbours(df, df.limit(0)).count() == 0


def test_split_groups_stay_within_their_bound(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP_ROWS", 100)
    seats = spark.range(1500).selectExpr("7L AS grp", "id", "id >= 1200 AS asks")
    rows = jaccard._placed(seats).collect()
    tasks = {}
    for r in rows:
        tasks.setdefault((r["part"], r["share"]), ([], []))[r["asks"]].append(r["id"])
    assert max(len(side) for task in tasks.values() for side in task) <= 150
    met = {frozenset((a, b)) for members, askers in tasks.values() for a in members for b in [*members, *askers] if a != b}
    assert all(frozenset((a, b)) in met for a in range(1200) for b in range(a + 1, 1500))
