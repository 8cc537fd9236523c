"""Removal of repeated passages against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ninefold.llm import recompression

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string"


def expected(rows, window=50):
    words = [WORD.findall(t or "") for _, t in rows]
    order = lambda key: float("inf") if key is None else key
    least: dict = {}
    for (key, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - window + 1):
            at = tuple(w[i : i + window])
            least[at] = min(least.get(at, float("inf")), order(key))
    out = []
    for (key, _), w in zip(rows, words, strict=True):
        gone = {j for i in range(len(w) - window + 1) if least[tuple(w[i : i + window])] < order(key) for j in range(i, i + window)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((key, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(map(repr, out))


def found(df):
    return sorted(repr(tuple(r)) for r in recompression.remove_repeats(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())


def passages(seed=5):
    """Texts with shared passages of 45 to 120 words, near copies, periods and single runs."""
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    shared = [fresh(n) for n in (45, 49, 50, 51, 60, 75, 120)]
    texts = []
    for _ in range(60):
        text = fresh(rng.randrange(80))
        for _ in range(rng.randrange(3)):
            text += rng.choice(shared) + fresh(rng.randrange(40))
        texts.append(text)
    for base in list(texts[:8]):
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                if copy:
                    copy[rng.randrange(len(copy))] = "changed"
            texts.append(copy)
    texts += [["a"] * n for n in (49, 50, 51, 130, 200)] + [["a", "b"] * n for n in (24, 25, 40, 70)] + [["b", "a", "c"] * 60, ["c", *["b", "a", "c"] * 50], fresh(30) + ["a"] * 90 + fresh(30)]
    texts += [["x", *["a"] * 60, "y"] * 2, ["a"] * 25 + ["b"] * 25, ["a"] * 26 + ["b"] * 25, ["z"] * 20 + ["a"] * 26 + ["b"] * 25]
    rng.shuffle(texts)
    return [(k, " ".join(t)) for k, t in enumerate(texts)]


@pytest.mark.parametrize("hot", [False, True])
def test_equals_brute_force(spark, monkeypatch, hot):
    """With all symbols verified in groups, and with all of them summed up first."""
    monkeypatch.setattr(recompression, "HOT_WINDOWS", 0 if hot else 1 << 40)
    monkeypatch.setattr(recompression, "VERIFIED_WINDOWS", 300)
    rows = passages()
    assert found(spark.createDataFrame(rows, SCHEMA)) == expected(rows)


def test_long_texts_in_parts(spark, monkeypatch):
    monkeypatch.setattr(recompression, "PART_WORDS", 97)
    monkeypatch.setattr(recompression, "PART_BYTES", 301)
    rng = random.Random(9)
    long = [f"w{rng.randrange(300)}" for _ in range(3000)]
    rows = [(1, " ".join(long)), (2, " \n\t".join(long[1000:2100])), (3, " ".join(["new", *long[2900:], *long[:90]])), (4, " ".join(long[2500:2549])), (5, "  " + " ".join(long) + "\n")]
    assert found(spark.createDataFrame(rows, SCHEMA)) == expected(rows)


def test_real_texts(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert found(docs) == expected(rows)


def test_odd_rows(spark, odd_docs):
    clashing = odd_docs.withColumn("key", F.lit("clash")).withColumn("doc", F.lit(1)).withColumn("symbol", F.lit("x")).withColumn("spans", F.lit(2))
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    many = " ".join(f"u{k}" for k in range(60))
    rows += [(None, many), (None, many + " more"), (20, many), (20, many + " again"), (21, many), (21, many)]
    both = clashing.select("doc_id", "text", "key", "doc", "symbol", "spans").unionByName(spark.createDataFrame(rows[-6:], SCHEMA), allowMissingColumns=True)
    assert found(both) == expected(rows)
    assert recompression.remove_repeats(clashing.limit(0)).count() == 0


def test_symbols_depend_on_their_words_alone():
    """The same words inside other texts give the same symbols where those are fixed by the words."""
    rng = np.random.default_rng(3)
    inner = rng.integers(1, 40, 400).astype(np.uint64)
    zero = np.zeros(1, np.uint64)
    views = []
    for seed in (1, 2):
        around = np.random.default_rng(seed).integers(1, 40, (2, 70)).astype(np.uint64)
        names = np.concatenate([zero, around[0], inner, around[1], zero])
        at = 71
        views.append([{(int(low[k]) - at, int(high[k]) - at, int(symbols[k])) for k in range(len(symbols)) if low[k] >= at and high[k] <= at + 400} for symbols, low, high in recompression.rounds(names, 6)])
    assert views[0] == views[1] and all(len(x) > 20 for x in views[0])
    lengths = [len(symbols) for symbols, _, _ in recompression.rounds(np.concatenate([zero, inner, zero]), 6)]
    assert lengths == sorted(lengths, reverse=True) and lengths[-1] < len(inner) / 3
