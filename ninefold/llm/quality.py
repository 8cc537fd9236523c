"""Quality rules with thresholds that adapt to each language and source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, table

#: Name -> (numerator, denominator) of the shares that get adaptive upper bounds, and the bound: so
#: many distances (that quantile less median) above the median. Symbols mark whole bad sources, so they
#: go by a quantile that those leave alone; the others are rare in good texts too and go by the tail.
SHARES = {
    "symbols": ("n_symbols", "word_chars", 0.75, 6.0),
    "capitals": ("n_capitals", "word_chars", 0.99, 2.0),
    "marks": ("n_marks", "word_chars", 0.99, 2.0),
    "dup_lines": ("n_dup_lines", "n_lines", 0.99, 2.0),
    "repeats": ("n_repeat_words", "n_words", 0.99, 2.0),
    "word_chars": ("word_chars", "n_words", 0.99, 2.0),
}
#: A count k of a text is taken as k less so many times its square root: what it shows beyond chance. So
#: a few marks in a text weigh nothing where a group has none, and no bound needs a least value.
CHANCE = 3.0
#: Weight, in documents, of the bound of the language in the bound of a group, and of the bound of all
#: documents in that of a language: a group of n documents weighs n / (n + PRIOR_DOCS).
PRIOR_DOCS = 200
#: A table of thresholds up to so many rows is broadcast (under 2 MB), a larger one is not.
BROADCAST_GROUPS = 10_000
MIN_WORDS = 50

_METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks"]
_SPACE, _SYMBOLS, _CAPITALS, _MARKS = b" \t\n\v\f\r", b"#*$%&|<>", bytes(range(65, 91)), b"!?"


def _measure(text: str) -> tuple[int, ...]:
    data = text.encode("utf-8", "surrogatepass")
    without = lambda these: len(data) - len(data.translate(None, these))
    words = data.split()
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    n = len(words)
    repeated = 0
    if n > 3:
        h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        windows = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + (h[1:-1] ^ (h[1:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + (h[2:] ^ (h[2:] >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        order = np.sort(windows)
        twice = order[1:][order[1:] == order[:-1]]
        if len(twice):
            hit = np.isin(windows, twice)
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : n - 2 + k] |= hit
            repeated = int(covered.sum())
    return n, len(text) - without(_SPACE), without(_SYMBOLS), len(lines) - len(set(lines)), repeated, len(lines), without(_CAPITALS), without(_MARKS)


def free_prefix(columns: list[str]) -> str:
    """A prefix that no column has."""
    prefix = "__q_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def with_metrics(docs: DataFrame, text_col: str = "text", prefix: str = "__q_", keep_text: bool = True) -> DataFrame:
    """The rows with their counts in columns of that prefix, which no other column may have."""
    docs = docs.withColumn(text_col, F.col(text_col).cast("string"))
    names = [c for c in docs.columns if keep_text or c != text_col]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(prefix + m, T.LongType()) for m in _METRICS])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            texts = batch.column(batch.schema.names.index(text_col)).to_pylist()
            counts = np.array([_measure(t or "") for t in texts], np.int64).reshape(len(texts), len(_METRICS))
            columns = [batch.column(batch.schema.names.index(c)) for c in names]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(counts[:, k]) for k in range(len(_METRICS))], names + [prefix + m for m in _METRICS])

    return docs.mapInArrow(run, schema)


def _share(kind: str, prefix: str) -> Column:
    above, below, *_ = SHARES[kind]
    counted = F.col(prefix + above).cast("double")
    if kind != "word_chars":
        counted = F.greatest(F.lit(0.0), counted - CHANCE * F.sqrt(counted))
    return F.when(F.col(prefix + below) > 0, counted / F.col(prefix + below)).otherwise(F.lit(0.0))


def base_failed(prefix: str = "__q_") -> Column:
    return (F.col(prefix + "n_words") < MIN_WORDS) | (100 * F.col(prefix + "n_repeat_words") > 50 * F.col(prefix + "n_words"))


def _keys(lang_col: str, source_col: str, prefix: str) -> dict[str, Column]:
    return {prefix + n: F.coalesce(F.col(c).cast("string"), F.lit("")) for n, c in (("lang", lang_col), ("source", source_col))}


def adaptive_thresholds(measured: DataFrame, lang_col: str = "lang", source_col: str = "source", prefix: str = "__q_") -> DataFrame:
    """Upper bounds per language and source: lang, source, and max_<share> for each share, with the prefix.

    One KLL sketch per share and group, built with partial aggregation so that a source with a third
    of all rows shuffles one sketch per task; sketches merge to those of languages and of all.
    Documents that fail the base rules are left out. The bound of a group is drawn towards that of its
    language, and this towards that of all, by their numbers of documents. A KLL sketch is random
    beyond some hundred values, so bounds may differ slightly between runs over the same table.
    """
    lang, source = prefix + "lang", prefix + "source"
    rows = measured.select(*[c.alias(n) for n, c in _keys(lang_col, source_col, prefix).items()], base_failed(prefix).alias("failed"), *[_share(k, prefix).alias(k) for k in SHARES])
    sketch = lambda k: F.kll_sketch_agg_double(F.when(~F.col("failed"), F.col(k))).alias(k)
    groups = checkpointed(rows.groupBy(lang, source).agg(F.sum((~F.col("failed")).cast("long")).alias("n"), *[sketch(k) for k in SHARES]))
    merged = lambda over, tag: groups.groupBy(*over).agg(F.sum("n").alias(f"n{tag}"), *[F.kll_merge_agg_double(k).alias(f"{k}{tag}") for k in SHARES])
    joined = groups.join(merged([lang], "_l"), lang).crossJoin(F.broadcast(merged([], "_a")))  # one row

    def bound(kind: str) -> Column:
        quantile, spreads = SHARES[kind][2:]

        def own(tag: str) -> Column:
            at = lambda q: F.kll_sketch_get_quantile_double(F.col(kind + tag), F.lit(q))
            return F.when(F.col("n" + tag) > 0, at(0.5) + spreads * (at(quantile) - at(0.5)))

        drawn = own("_a")
        for tag in ("_l", ""):
            weight = F.col("n" + tag) / (F.col("n" + tag) + PRIOR_DOCS)
            drawn = F.coalesce(weight * own(tag) + (1 - weight) * drawn, drawn)
        return drawn.alias(f"{prefix}max_{kind}")

    return joined.select(lang, source, *[bound(k) for k in SHARES])


def judged(measured: DataFrame, thresholds: DataFrame, lang_col: str = "lang", source_col: str = "source", prefix: str = "__q_") -> DataFrame:
    """The measured rows with base_failed and kept (with the prefix), by a join with the thresholds."""
    thresholds = checkpointed(thresholds)
    small = thresholds.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    keys = _keys(lang_col, source_col, prefix)
    joined = measured.withColumns(keys).join(F.broadcast(thresholds) if small else thresholds, list(keys), "left")
    within = F.lit(True)
    for k in SHARES:
        within &= F.coalesce(_share(k, prefix) <= F.col(f"{prefix}max_{k}"), F.lit(True))
    return joined.withColumn(prefix + "base_failed", base_failed(prefix)).withColumn(prefix + "kept", ~F.col(prefix + "base_failed") & within)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Measure every whole text and judge it by thresholds learned per language and source.

    Returns doc_id, the counts, base_failed and kept, one row per input row; other columns are
    ignored. A null text has no words and fails. Null languages and sources form a group of their
    own. Repeated rows are judged one by one and alike, ties at a threshold are kept, and an empty
    table gives no rows. Only the counts, never texts, are written to the checkpoint and joined.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    measured = checkpointed(with_metrics(rows, keep_text=False))
    out = judged(measured, adaptive_thresholds(measured))
    return out.select("doc_id", *[F.col(f"__q_{m}").alias(m) for m in (*_METRICS, "base_failed", "kept")])


def quality_filter(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows, with all their columns, that the quality rules keep.

    Texts are measured twice (for the thresholds, then for the verdict) so that none is shuffled. Null
    and empty texts fail the base rules and go; null languages and sources form a group of their own;
    repeated rows are judged alike; columns of any name stay as they are; an empty table gives no rows."""
    prefix = free_prefix(docs.columns)
    narrow = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    thresholds = adaptive_thresholds(checkpointed(with_metrics(narrow, keep_text=False, prefix=prefix)), prefix=prefix)
    return judged(with_metrics(docs, text_col, prefix), thresholds, lang_col, source_col, prefix).filter(F.col(prefix + "kept")).select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
