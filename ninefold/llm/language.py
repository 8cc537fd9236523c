"""Language identification as inference of a mixture of languages in each document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, table

ORDER = 4
BUCKETS = 1 << 16
#: Bound of the training sample, in expectation: so many documents of each language.
SAMPLE_PER_LANGUAGE = 2000
SMOOTHING = 0.05
ROUNDS = 12
#: A further language must raise the log likelihood by so many times log(number of n-grams).
PENALTY = 6.0
#: Least share of a text's n-grams that the learned languages must explain better than chance does.
LEAST_KNOWN = 0.25
UNKNOWN = "und"


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no model may learn from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def _grams(text: str) -> np.ndarray:
    """Bucket of each n-gram of the lower-cased UTF-8 bytes, with a space at either end."""
    b = np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8).astype(np.uint32)
    while len(b) < ORDER:
        b = np.append(b, np.uint32(32))
    code = b[: len(b) - ORDER + 1].copy()
    for k in range(1, ORDER):
        code = (code << np.uint32(8)) | b[k : len(b) - ORDER + 1 + k]
    return (code * np.uint32(2654435769)) >> np.uint32(16)


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages and log P(n-gram bucket | language), from a sample of about `sample` rows of each.

    Rows are taken by a hash of their key and text, whole texts each. Null texts and languages take no
    part, and without any there are no languages. Executors sum the counts; the driver gets one row
    of 4 * BUCKETS bytes (256 KB) for each language.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("k"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text is not null and lang is not null")
    sizes = rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(sample)) / F.count("*")).alias("share"))
    hashed = F.xxhash64("k", "text")  # keys that repeat, or are null, do not come or stay away together
    taken = rows.join(F.broadcast(sizes), "lang").filter(F.pmod(hashed, F.lit(1 << 20)) < F.col("share") * (1 << 20)).repartition(hashed)

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in source:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[lang] = sums.get(lang, 0) + np.bincount(_grams(text), minlength=BUCKETS)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], ["lang", "bucket", "n"])

    def finish(key: tuple, group: pa.Table) -> pa.Table:
        n = np.zeros(BUCKETS)
        n[group.column("bucket").to_numpy()] = group.column("n").to_numpy()
        log_p = np.log((n + SMOOTHING) / (n.sum() + SMOOTHING * BUCKETS)).astype(np.float32)
        return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "log_p": pa.array([log_p.tobytes()], pa.binary())})

    taken = taken.select("lang", "text")
    summed = taken.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = sorted(summed.groupBy("lang").applyInArrow(finish, "lang string, log_p binary").collect(), key=lambda r: r["lang"])
    table_ = np.stack([np.frombuffer(r["log_p"], np.float32) for r in found], axis=1) if found else np.zeros((BUCKETS, 0), np.float32)
    return [r["lang"] for r in found], table_


def _mixture(p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions by expectation-maximisation over likelihoods p (n-grams x languages) of n-grams
    seen n times, and the log likelihood."""
    k = p.shape[1]
    share = np.full(k, 1 / k)
    if k > 1:
        for _ in range(ROUNDS):
            weighted = p * share
            new = (n / weighted.sum(1)) @ weighted
            new /= new.sum()
            if np.abs(new - share).max() < 1e-4:
                share = new
                break
            share = new
    return share, float(n @ np.log(p @ share))


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text and how often each occurs."""
    grams, seen = np.unique(_grams(text), return_counts=True)
    return grams, seen.astype(np.float64)


def infer(text: str, log_p: np.ndarray) -> tuple[list[int], np.ndarray]:
    """The chosen languages' indexes and their proportions, largest first."""
    return _infer(*counted(text), log_p)


def _infer(grams: np.ndarray, n: np.ndarray, log_p: np.ndarray) -> tuple[list[int], np.ndarray]:
    logs = log_p[grams].astype(np.float64)
    first = int(np.argmax(n @ logs))
    p = np.exp(logs - logs.max(1, keepdims=True))
    base = n @ np.log(np.maximum(p[:, first], 1e-30))
    price = PENALTY * np.log(n.sum() + 1)
    chosen, share, best = [first], np.ones(1), float(base)
    rest: set[int] = set()
    if p.shape[1] > 1:
        # All languages in one mixture; those that it leaves next to nothing cannot pay their price.
        whole, _ = _mixture(p, n)
        rest = set(np.flatnonzero(whole > 0.04 / p.shape[1]).tolist()) - {first}
    while rest:
        tried = {k: _mixture(p[:, [*chosen, k]], n) for k in sorted(rest)}
        k = max(tried, key=lambda k: tried[k][1])
        if tried[k][1] - best <= price:
            break
        chosen, (share, best) = [*chosen, k], tried[k]
        rest.remove(k)
    by = sorted(range(len(chosen)), key=lambda i: (-share[i], chosen[i]))
    return [int(chosen[i]) for i in by], np.array([share[i] for i in by])


def known_share(grams: np.ndarray, n: np.ndarray, log_p: np.ndarray, chosen: list[int], share: np.ndarray) -> float:
    """Share of the n-grams that the mixture explains better than a background in which all n-grams
    are equally likely, by expectation-maximisation over the two."""
    mixed = np.exp(log_p[grams][:, chosen].astype(np.float64)) @ share
    return float(_mixture(np.stack([mixed, np.full(len(mixed), 1 / BUCKETS)], axis=1), n)[0][0])


def identify_languages(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Languages of every whole text: doc_id, lang_pred, score, languages, proportions.

    The set of languages is grown from the likeliest one while each further language raises the
    likelihood of the mixture by more than its price; lang_pred is the one with the largest share,
    score its share. `und` with score 0 and no languages if the text is null, has no letter, or
    nothing was learned. Equal shares go to the language that sorts first. One row per input row;
    other columns are ignored; an empty table gives no rows.
    """
    languages, log_p = model
    shared = docs.sparkSession.sparkContext.broadcast(log_p)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            out: list[tuple] = []
            for text in batch.column(1).to_pylist():
                if not languages or not any(map(str.isalpha, text)):
                    out.append((UNKNOWN, 0.0, [], []))
                    continue
                found, share = infer(text, shared.value)
                out.append((languages[found[0]], float(min(1.0, max(0.0, share[0]))), [languages[k] for k in found], share.tolist()))
            pred, score, names, shares = zip(*out, strict=True) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(names, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))], ["doc_id", "lang_pred", "score", "languages", "proportions"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double, languages array<string>, proportions array<double>")


def language_filter(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", least: float = 0.3, known: float = LEAST_KNOWN) -> DataFrame:
    """The rows, with all their columns, whose text is in the learned languages: these explain at least
    the share `known` of its n-grams better than a background without any language does (which
    gibberish and scripts that were not learned fail), and one of them has at least the share `least`.

    Null, empty and letterless texts go; if nothing was learned, all texts with letters stay. Repeated
    rows fare alike, columns of any name stay as they are, and an empty table gives no rows."""
    languages, log_p = model
    shared = docs.sparkSession.sparkContext.broadcast(log_p)

    def keeps(text: str | None) -> bool:
        if not text or not any(map(str.isalpha, text)):
            return False
        if not languages:
            return True
        grams, n = counted(text)
        chosen, share = _infer(grams, n, shared.value)
        return bool(share[0] >= least and known_share(grams, n, shared.value, chosen, share) >= known)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            texts = batch.column(batch.schema.names.index(text_col)).to_pylist()
            yield batch.filter(pa.array(map(keeps, texts), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs.filter(~held_out()))
    return identify_languages(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
