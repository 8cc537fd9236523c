"""Importance resampling towards a target distribution of hashed word runs."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import pairwise
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, id_text, table

BUCKETS = 10_000
#: Entries of the broadcast head: words, and pairs where runs are longer; no entry has more bytes than this.
HEAD = 1 << 16
HEAD_BYTES = 64
#: Documents with fewer words are never drawn.
LEAST_WORDS = 20
#: Text that is counted at a time, in bytes.
PORTION_BYTES = 4 << 20

_TO_SPACE = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 128 and not chr(b).isalnum() else b for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Runs of a-z, 0-9 and everything beyond ASCII, after lower-casing A-Z."""
    return text.translate(_TO_SPACE).split()


def _portions(source: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """Keys and texts of each batch, some texts at a time."""
    for batch in source:
        ids, texts = batch.column(0), batch.column(1).cast(pa.large_binary())
        ends = np.cumsum(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False))
        first = 0
        while first < len(ids):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PORTION_BYTES, "right")))
            yield ids.slice(first, last - first).to_pylist(), texts.slice(first, last - first).to_pylist()
            first = last


class Head:
    """CRC states of frequent words, and buckets of frequent pairs; the tail is computed directly."""

    def __init__(self, words: Iterable[bytes], pairs: Iterable[tuple[bytes, bytes]], buckets: int):
        self.buckets = buckets
        self.states = {w: crc32(w) for w in words}
        self.pairs = {(a, b): self.state(b, self.state(a)) % buckets for a, b in pairs}

    def state(self, word: bytes, before: int | None = None) -> int:
        """The CRC of the word, or of a run that has the state `before` and goes on with the word."""
        if before is not None:
            return crc32(word, crc32(b" ", before))
        found = self.states.get(word)
        return crc32(word) if found is None else found

    def counts(self, words: list[bytes], longest: int) -> Counter:
        """Buckets of all runs of 1 to `longest` words, with their numbers."""
        out: Counter = Counter()
        for word, n in Counter(words).items():
            out[self.state(word) % self.buckets] += n
        if longest > 1:
            for pair, n in Counter(pairwise(words)).items():
                bucket = self.pairs.get(pair)
                out[self.state(pair[1], self.state(pair[0])) % self.buckets if bucket is None else bucket] += n
        for length in range(3, longest + 1):
            for run, n in Counter(zip(*(words[k:] for k in range(length)), strict=False)).items():
                state = self.state(run[0])
                for word in run[1:]:
                    state = self.state(word, state)
                out[state % self.buckets] += n
        return out


def _trimmed(counts: Counter, size: int) -> Counter:
    """A frequent-items summary: the largest counts, less the first that is left out."""
    if len(counts) <= size:
        return counts
    most = counts.most_common(size + 1)
    return Counter({k: n - most[-1][1] for k, n in most[:-1] if n > most[-1][1]})


def _head(texts: DataFrame, longest: int, buckets: int) -> Head:
    """Frequent words and pairs of all texts. Each task keeps a mergeable summary of bounded size; which
    entries it has changes the speed only, never a bucket."""
    kinds = min(longest, 2)

    def summarise(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [Counter() for _ in range(kinds)]
        for _, some in _portions(source):
            for text in some:
                words = words_of(text)
                kept[0].update(words)
                if kinds > 1:
                    kept[1].update(pairwise(words))
            kept = [_trimmed(c, 2 * HEAD) if len(c) > 8 * HEAD else c for c in kept]
        for kind, c in enumerate(kept):
            items = [(k if kind else (k,), n) for k, n in _trimmed(c, 2 * HEAD).items() if len(k if not kind else b"".join(k)) <= HEAD_BYTES]
            yield pa.RecordBatch.from_arrays([pa.array([x[0][0] for x in items], pa.binary()), pa.array([x[0][-1] if kind else b"" for x in items], pa.binary()), pa.array([x[1] for x in items], pa.int64()), pa.array([kind] * len(items), pa.int32())], ["a", "b", "n", "kind"])

    found = checkpointed(texts.mapInArrow(summarise, "a binary, b binary, n long, kind int").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")))
    # Numbers of entries by the size of their counts, in eighths of a doubling: from them the least size
    # with which no more than HEAD entries of a kind reach the driver.
    size = F.floor(8 * F.log2(F.col("n").cast("double"))).cast("int")
    entries = found.groupBy("kind", size.alias("size")).count().collect()
    most = []
    for kind in range(kinds):
        room, least = HEAD, 1 << 20
        for r in sorted((r for r in entries if r["kind"] == kind), key=lambda r: -r["size"]):
            room -= r["count"]
            if room < 0:
                break
            least = r["size"]
        most.append(found.filter((F.col("kind") == kind) & (size >= least)).collect())
    return Head([bytes(r["a"]) for r in most[0]], [(bytes(r["a"]), bytes(r["b"])) for r in most[1]] if kinds > 1 else [], buckets)


def _totals(texts: DataFrame, head, longest: int, buckets: int) -> np.ndarray:
    """Features of each bucket over all texts: each task sums its own, Spark adds them up."""

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for _, some in _portions(source):
            whole: Counter = Counter()
            for words in map(words_of, some):
                if longest == 1:  # words may be counted over texts, runs may not
                    whole.update(words)
                else:
                    for bucket, n in head.value.counts(words, longest).items():
                        sums[bucket] += n
            for word, n in whole.items():
                sums[head.value.state(word) % buckets] += n
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> list[int]:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the raw texts."""
    whole_raw, whole_target, size = float(raw.sum()), float(target.sum()), float(len(raw))
    return [math.floor(1000 * math.log((t + 1.0) * (whole_raw + size) / ((s + 1.0) * (whole_target + size)))) for s, t in zip(map(float, raw), map(float, target), strict=True)]


def noise(seed: int, key: int | None) -> int:
    """Gumbel noise in thousandths, from the seed and the key alone (a null key counts as empty)."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scored(docs: DataFrame, head, gains: list[int], longest: int, seed: int) -> DataFrame:
    buckets = len(gains)
    schema = pa.schema([("doc_id", pa.int64()), ("n_features", pa.int64()), ("n_words", pa.int64()), ("weight", pa.int64()), ("score", pa.int64())])

    def score(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = head.value

        class Gains(dict):
            def __missing__(self, word: bytes) -> int:
                return gains[crc32(word) % buckets]

        of_word = Gains({w: gains[state % buckets] for w, state in known.states.items()}).__getitem__
        for ids, some in _portions(source):
            rows = []
            for key, words in zip(ids, map(words_of, some), strict=True):
                if longest == 1:
                    n, weight = len(words), sum(map(of_word, words))
                else:
                    counts = known.counts(words, longest)
                    n, weight = counts.total(), sum(gains[b] * c for b, c in counts.items())
                rows.append((key, n, len(words), weight, weight + noise(seed, key)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.mapInArrow(score, "doc_id long, n_features long, n_words long, weight long, score long")


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = 10, *, longest: int = 1, buckets: int = BUCKETS, seed: int = 2024, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """Weigh every document by the target's likelihood ratio and draw `percent` of those with
    `least_words` words without replacement, by the highest scores (weight plus keyed Gumbel noise).

    Returns one row per input row: doc_id, n_features, weight, score and rank (from 1; null if not
    drawn). Features are runs of 1 to `longest` words, hashed to `buckets` by CRC-32. Frequent words
    and pairs are broadcast (HEAD entries of HEAD_BYTES at most) with their CRC states and buckets; all
    others take the CRC directly. Bucket totals cover all texts of both tables.

    Ties of scores go to the smaller key, null keys last; rows that repeat are documents of their own.
    Null, empty and wordless texts have weight 0 and are never drawn. An empty target weighs all
    buckets by the raw totals alone; an empty table gives no rows. Other columns are ignored.

    Ranks come from a range partitioning of the scored rows: a row's place in its partition plus the
    sizes of those before it, so no task sees all rows.
    """
    texts, spark = id_text(docs, id_col, text_col), docs.sparkSession
    wanted = target.select(F.lit(None).cast("long").alias("doc_id"), F.coalesce(F.col(target_col).cast("string"), F.lit("")).alias("text"))
    head = spark.sparkContext.broadcast(_head(texts, longest, buckets))
    gains = bucket_gains(_totals(texts, head, longest, buckets), _totals(wanted, head, longest, buckets))
    scored = checkpointed(_scored(texts, head, gains, longest, seed).withColumn("row", F.monotonically_increasing_id()))
    able = scored.filter(F.col("n_words") >= least_words)
    drawn = percent * able.count() // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = able.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = checkpointed(sorted_.select("doc_id", "n_features", "weight", "score", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place")))
    sizes = placed.groupBy("part").agg(F.count("*").alias("size"))  # a row for each partition
    before = sizes.select("part", F.coalesce(F.expr("sum(size) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"), F.lit(0)).alias("before"))
    rank = F.col("before") + F.col("place") + 1
    ranked = placed.join(F.broadcast(before), "part").select("doc_id", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))
    rest = scored.filter(F.col("n_words") < least_words).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return ranked.unionByName(rest)


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
