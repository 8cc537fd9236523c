"""Importance resampling against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ninefold.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [" ".join(w[k : k + n]) for n in range(1, longest + 1) for k in range(len(w) - n + 1)]


def expected(docs, target, longest=1, buckets=10_000, percent=10, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    raw = Counter(bucket(f) for _, t in docs for f in features(t, longest)[1])
    wanted = Counter(bucket(f) for t in target for f in features(t, longest)[1])
    big_s, big_t = raw.total(), wanted.total()
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (big_s + buckets) / ((raw[b] + 1) * (big_t + buckets))))
    rows, able = [], []
    for key, text in docs:
        n, found = features(text, longest)
        weight = sum(gain(bucket(f)) for f in found)
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append([key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
        if n >= least:
            able.append(rows[-1])
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = able[: percent * len(able) // 100]
    return sorted(map(repr, [(*r[:4], k + 1) for k, r in enumerate(drawn)] + [(*r, None) for r in rows if not any(r is d for d in drawn)]))


def found(df):
    return sorted(repr(tuple(r)) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect())


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_equals_brute_force(spark, docs, sf_dir, monkeypatch, longest):
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows, texts = [(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()]
    assert found(resampling.importance_resample(docs, target, longest=longest)) == expected(rows, texts, longest)
    # A head of a few entries and texts read in small portions give the same rows.
    monkeypatch.setattr(resampling, "HEAD", 20)
    monkeypatch.setattr(resampling, "HEAD_BYTES", 5)
    monkeypatch.setattr(resampling, "PORTION_BYTES", 500)
    assert found(resampling.importance_resample(docs, target, 37, longest=longest, least_words=5)) == expected(rows, texts, longest, percent=37, least=5)


def test_odd_rows(spark, odd_docs):
    clashing = odd_docs.withColumn("rank", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("part", F.lit(2)).withColumn("n_words", F.lit("x"))
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    target = clashing.filter("doc_id in (4, 8)")
    assert found(resampling.importance_resample(clashing, target, 60)) == expected(rows, [t for k, t in rows if k in (4, 8)], percent=60)
    # No target, no documents, and one row repeated many times: ranks stay 1, 2, 3.
    assert found(resampling.importance_resample(clashing, target.limit(0), 60)) == expected(rows, [], percent=60)
    assert resampling.importance_resample(clashing.limit(0), target).count() == 0
    same = spark.range(500).selectExpr("7L AS doc_id", "repeat('one two three four five ', 5) AS text")
    ranks = sorted(r["rank"] for r in resampling.importance_resample(same, target).collect() if r["rank"])
    assert ranks == list(range(1, 51))
