"""Cross-entropy difference: documents scored by two n-gram models that share one vocabulary."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, checkpointed, table

#: Least size of the shared vocabulary, with <s> and a place for the unseen, in the smoothing of
#: unigrams. All words of all texts are in the vocabulary, however many they are.
VOCABULARY = 2048
#: Weight of the unigram estimate in each bigram estimate, in counts.
WEIGHT = 20.0
#: Labels up to so many rows are broadcast (8 bytes each), larger tables are joined by a shuffle.
BROADCAST_LABELS = 2_000_000
#: A block of documents ends after so many tokens. Counts leave it once for each of its words and bigrams.
BLOCK_TOKENS = 4_000_000
#: Bytes of text for each part that the words and bigrams of all blocks are dealt into by hash.
PART_BYTES = 16_000_000
#: Tokens of documents that are scored at a time (or one longer document).
SCORED_TOKENS = 500_000
_WORD = re.compile(r"[^\W_]+|[^\w\s]|_")
_WORDS, _PAIRS, _BODY = range(3)


class _Index(dict):
    """Numbers words in the order in which they come; 0 stands for <s>."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self) + 1
        return number


def _hash(word: str) -> int:
    return int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _pack(a: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(a).tobytes(), 1)


def _unpack(data: bytes, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), kind)


def _before(tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    before = np.empty(len(tokens), np.int64)
    before[1:] = tokens[:-1]
    before[(np.cumsum(lengths) - lengths)[lengths > 0]] = 0
    return before


def _pairs(tokens: np.ndarray, lengths: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct bigrams of a block in order of their keys: previous and next word, key, and the
    place of each token's bigram among them."""
    code, at = np.unique(_before(tokens, lengths) * len(keys) + tokens, return_inverse=True)
    previous, after = code // len(keys), code % len(keys)
    mixed = keys[previous] * np.uint64(0x9E3779B97F4A7C15) + (keys[after] ^ (keys[after] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    order = np.argsort(mixed, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return previous[order], after[order], mixed[order], place[at]


def _blocks(marked: DataFrame) -> DataFrame:
    """Blocks of documents: the keys of a block's words, the lengths of its documents, which of them
    are wanted, and the number of each word in their texts."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, number = Memo(_hash), TaskContext.get().partitionId() << 32
        index, ids, wanted, lengths, tokens, total = _Index(), [], [], [], [], 0

        def close() -> pa.RecordBatch:
            keys = np.array([0, *map(code.__getitem__, index)], np.uint64)
            packed = [[x] for x in (keys.tobytes(), _pack(np.array(lengths, np.int64)), _pack(np.array(wanted, bool)), _pack(np.concatenate(tokens)))]
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), *(pa.array(x, pa.binary()) for x in packed)], ["block", "ids", "keys", "lengths", "wanted", "tokens"])

        for batch in source:
            for i, t, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = _WORD.findall((t or "").lower())
                ids.append(i)
                wanted.append(w)
                lengths.append(len(words))
                tokens.append(np.fromiter(map(index.__getitem__, words), np.int32, len(words)))
                total += len(words)
                if total >= BLOCK_TOKENS or len(ids) >= BLOCK_TOKENS:
                    yield close()
                    number += 1
                    index, ids, wanted, lengths, tokens, total = _Index(), [], [], [], [], 0
        if ids:
            yield close()

    return marked.mapInArrow(run, "block long, ids array<bigint>, keys binary, lengths binary, wanted binary, tokens binary")


def _counted(blocks: DataFrame, kind: int, parts: int) -> DataFrame:
    """For each block and part its words (as next and as previous one) or its bigrams, with their
    counts in target and all documents."""
    bounds = np.array([-(-(p << 64) // parts) for p in range(1, parts)], np.uint64)

    def rows(keys: bytes, lengths: bytes, wanted: bytes, tokens: bytes) -> Iterator[tuple]:
        words, n, word = np.frombuffer(keys, np.uint64), _unpack(lengths), _unpack(tokens, np.int32).astype(np.int64)
        if not len(word):
            return
        chosen = np.repeat(_unpack(wanted, bool), n)
        if kind == _WORDS:
            order = np.argsort(words, kind="stable")
            key = words[order]
            counts = np.stack([np.bincount(w, minlength=len(words))[order] for x in (word, _before(word, n)) for w in (x[chosen], x)])
        else:
            _, _, key, at = _pairs(word, n, words)
            counts = np.stack([np.bincount(w, minlength=len(key)) for w in (at[chosen], at)])
        cuts = [0, *np.searchsorted(key, bounds).tolist(), len(key)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if a < b:
                # Differences of sorted keys, byte by byte: the upper bytes are zero.
                yield p, _pack(np.diff(key[a:b], prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T), _pack(counts[:, a:b])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for block, *body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = list(rows(*body))
                if found:
                    at, keys, counts = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([block] * len(found), pa.int64()), pa.array([kind] * len(found), pa.int32()), pa.array(at, pa.int32()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], ["block", "kind", "part", "keys", "counts"])

    return blocks.select("block", "keys", "lengths", "wanted", "tokens").mapInArrow(run, "block long, kind int, part int, keys binary, counts binary")


def _summed(counted: DataFrame) -> DataFrame:
    """The counts of each block's words and bigrams over all blocks, in the order of the block; n, t
    and b of a part (its words, target and all tokens) stand in one of its rows."""

    def add(key: tuple, group: pa.Table) -> pa.Table:
        kind = key[0].as_py()
        steps = [_unpack(k, np.uint8).reshape(8, -1).T for k in group.column("keys").to_pylist()]
        keys = [np.cumsum(np.ascontiguousarray(k).view(np.uint64).reshape(-1)) for k in steps]
        counts = np.concatenate([_unpack(c).reshape(4 if kind == _WORDS else 2, -1) for c in group.column("counts").to_pylist()], axis=1)
        known, at = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.stack([np.bincount(at, c, minlength=len(known)).astype(np.int64) for c in counts])
        cuts = np.cumsum([0, *map(len, keys)])
        out = [_pack(sums[:, at[a:b]]) for a, b in zip(cuts, cuts[1:], strict=False)]
        first = lambda x: [int(x), *[0] * (len(out) - 1)]
        n = np.count_nonzero(sums[1]) if kind == _WORDS else 0
        return pa.table({"block": group.column("block"), "kind": group.column("kind"), "part": group.column("part"), "counts": pa.array(out, pa.binary()), "n": first(n), "t": first(sums[0].sum()), "b": first(sums[1].sum())})

    return counted.groupBy("kind", "part").applyInArrow(add, "block long, kind int, part int, counts binary, n long, t long, b long")


def _losses(after: np.ndarray, before: np.ndarray, pair: np.ndarray, lengths: np.ndarray, own: np.ndarray, as_next: np.ndarray, as_previous: np.ndarray, pairs: np.ndarray, total: int, size: int, scale: float) -> tuple[list, list]:
    """Documents (by number, those with tokens) and their mean loss under a model without what the
    document itself has counted, where `own` says that it did. Counts are taken times `scale`."""
    doc, n = np.repeat(np.arange(len(lengths)), lengths), np.repeat(lengths * own, lengths)
    counted = own[doc]

    def others(counts: np.ndarray, item: np.ndarray) -> np.ndarray:
        if not counted.any():
            return counts[item] * scale
        _, at, mine = np.unique(doc * len(counts) + item, return_inverse=True, return_counts=True)
        return (counts[item] - mine[at] * counted) * scale

    single = (others(as_next, after) + 0.5) / ((total - n) * scale + 0.5 * size)
    loss = -np.log((others(pairs, pair) + WEIGHT * single) / (others(as_previous, before) + WEIGHT))
    some = np.flatnonzero(lengths)
    starts = (np.cumsum(lengths) - lengths)[some]
    return some.tolist(), (np.add.reduceat(loss, starts) / lengths[some]).tolist() if len(some) else []


def _scored(blocks: DataFrame, summed: DataFrame, size: int, totals: tuple[int, int], hold_out: bool) -> DataFrame:
    def score(key: tuple, group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: (r["kind"], r["part"] or 0))
        body = rows.pop()
        lengths = _unpack(body["lengths"])
        losses = [[None] * len(lengths) for _ in totals]
        if rows:
            keys, tokens = np.frombuffer(body["keys"], np.uint64), _unpack(body["tokens"], np.int32).astype(np.int64)
            sums = {k: np.concatenate([_unpack(r["counts"]).reshape(4 if k == _WORDS else 2, -1) for r in rows if r["kind"] == k], axis=1) for k in (_WORDS, _PAIRS)}
            words = np.empty_like(sums[_WORDS])
            words[:, np.argsort(keys, kind="stable")] = sums[_WORDS]
            pair, before, wanted = _pairs(tokens, lengths, keys)[3], _before(tokens, lengths), _unpack(body["wanted"], bool)
            ends, first = np.cumsum(lengths), 0
            while first < len(lengths):  # some documents at a time
                begin = ends[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(ends, begin + SCORED_TOKENS, "right")))
                here, many = slice(begin, ends[last - 1]), lengths[first:last]
                for k, own in enumerate((wanted[first:last] & hold_out, np.full(last - first, hold_out))):
                    for i, x in zip(*_losses(tokens[here], before[here], pair[here], many, own, words[k], words[2 + k], sums[_PAIRS][k], totals[k], size, totals[0] / totals[1] if k and totals[0] else 1.0), strict=True):
                        losses[k][first + i] = x
                first = last
        return pa.table({"doc_id": pa.array(body["ids"], pa.int64()), "n_tokens": pa.array(lengths), "loss_target": pa.array(losses[0], pa.float64()), "loss_background": pa.array(losses[1], pa.float64())})

    both = blocks.select("block", F.lit(_BODY).alias("kind"), "keys", "ids", "lengths", "wanted", "tokens").unionByName(summed.select("block", "kind", "part", "counts"), allowMissingColumns=True)
    return both.groupBy("block").applyInArrow(score, "doc_id long, n_tokens long, loss_target double, loss_background double")


def cross_entropy_difference(docs: DataFrame, wanted: DataFrame, id_col: str = "doc_id", text_col: str = "text", hold_out: bool = False) -> DataFrame:
    """Score every document against a target: the documents whose key is in `wanted`.

    Returns doc_id, n_tokens, loss_target, loss_background (nats per token) and score, their
    difference. A lower score means closer to the target. Two bigram models, of the target documents
    and of all, have the same vocabulary (every word of all texts), order and smoothing; their counts
    are a table in parts by hash and grow with the input. Counts of the background are scaled to the
    size of the target, so that smoothing weighs alike in both. With `hold_out` each document is held
    out of the models that score it: its own counts are subtracted. Null, empty and wordless texts have no
    tokens and null losses. Without any target document the target model is uniform over the
    vocabulary. Keys that repeat in `wanted` count once. One row per input row; other columns are
    ignored; an empty table gives no rows.

    Texts are split once, into blocks. Words and bigrams leave a block once each, with their counts,
    so that no common bigram makes a part large, and come back with the counts of all blocks.
    """
    keys = wanted.select(F.col(id_col).cast("long").alias("__key")).filter("__key is not null").distinct().withColumn("__wanted", F.lit(True))
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"))
    if keys.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        keys = F.broadcast(keys)
    marked = rows.join(keys, F.col("__id") == F.col("__key"), "left").select("__id", "__text", F.coalesce("__wanted", F.lit(False)).alias("__wanted"))
    parts = 16 + (rows.agg(F.sum(F.octet_length("__text"))).first()[0] or 0) // PART_BYTES
    blocks = checkpointed(_blocks(marked))
    words = checkpointed(_summed(_counted(blocks, _WORDS, parts)))
    n, t, b = (x or 0 for x in words.agg(F.sum("n"), F.sum("t"), F.sum("b")).first())
    return _scored(blocks, words.unionByName(_summed(_counted(blocks, _PAIRS, parts))), max(VOCABULARY, n + 2), (t, b), hold_out).withColumn("score", F.col("loss_target") - F.col("loss_background"))


def op4_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").filter("quality = 1 and toxic = 0")
    return cross_entropy_difference(table(spark, sf_dir, "documents"), good)
