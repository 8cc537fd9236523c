"""Removal of long passages that earlier documents have, found by recompression of word sequences."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table

WINDOW = 50
#: Rounds of naming. More give longer symbols, of which more are found and fewer are shared by chance.
ROUNDS = 5
#: Words that go through the rounds together, and bytes that are split at a time; longer texts in parts.
PART_WORDS = 60_000
PART_BYTES = 1 << 20
#: Windows that are verified together, about; a symbol with more than HOT_WINDOWS (some 50 MB in a task)
#: never comes into one task but is summed up first.
VERIFIED_WINDOWS = 200_000
HOT_WINDOWS = 1 << 20

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_STEP, _FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _FIRST
    x = (x ^ (x >> np.uint64(27))) * _SECOND
    return x ^ (x >> np.uint64(31))


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text in parts of about PART_BYTES, cut at white space."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + PART_BYTES)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def word_names(text: bytes) -> np.ndarray:
    """A 64-bit name for each word, from the word alone; never 0."""
    parts = [np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, piece.split())), np.uint64) for piece in _pieces(text)]
    names = np.concatenate([*parts, np.zeros(0, np.uint64)])
    return np.where(names == 0, np.uint64(1), names)


def rounds(names: np.ndarray, number: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Symbols of each round over word names, in which 0 stands between texts and never joins.

    Each round gives every symbol a side by its name, joins maximal runs of one symbol, and joins a
    run of a left symbol with a run of a right one that follows it. The new name comes from the names
    and lengths of both runs, so all tasks give equal runs and pairs one name without an exchange.
    Yields names, and the words [low, high) that fix each symbol: within any texts that agree on those
    words, the same symbol arises there.
    """
    low = np.arange(len(names), dtype=np.int64)
    high = low + 1
    yield names, low, high
    with np.errstate(over="ignore"):
        for k in range(1, number + 1):
            left = (_mixed(names ^ (_STEP * np.uint64(k))) & np.uint64(1)) == 1
            joined = ((names[:-1] == names[1:]) | (left[:-1] & ~left[1:])) & (names[:-1] != 0) & (names[1:] != 0)
            first = np.flatnonzero(np.concatenate([[True], ~joined]))
            last = np.append(first[1:], len(names)) - 1
            several = np.flatnonzero(last > first)
            a, b = first[several], last[several]
            size = b - a + 1
            same = np.concatenate([[0], np.cumsum(np.concatenate([[True], names[1:] != names[:-1]]))])  # runs up to a place
            ends = np.append(np.flatnonzero(np.diff(same[1:]) != 0), len(names) - 1)
            of_left = np.minimum(ends[same[a + 1] - 1], b) - a + 1  # length of the run at the left
            new = _mixed(_mixed(names[a] + of_left.astype(np.uint64) * _STEP) + _mixed(names[b] ^ _SECOND) * _FIRST + (size - of_left).astype(np.uint64))
            low, high = np.concatenate([[-1], low])[first], np.append(high, high[-1:] + 1)[last + 1]
            names = names[first]
            names[several] = np.where(new == 0, np.uint64(1), new)
            yield names, low, high


def chosen_symbols(names: np.ndarray, starts: np.ndarray, number: int = ROUNDS) -> np.ndarray:
    """For each window of WINDOW words that begins at `starts`, the name of a symbol that its own words
    fix: of those of the latest round that has any, the one whose name comes first in a mixed order."""
    levels = []
    for symbols, low, high in rounds(names, number):
        before = np.cumsum(np.bincount(low + 1, minlength=len(names) + 2))  # symbols with low < a place
        within = np.cumsum(np.bincount(np.minimum(high, len(names) + 1), minlength=len(names) + 2))
        levels.append((symbols, before, within))
    out, open_ = np.zeros(len(starts), np.uint64), np.arange(len(starts))
    for symbols, before, within in reversed(levels):
        at = before[starts[open_]]
        n = within[starts[open_] + WINDOW] - at
        has = n > 0
        done, at, n = open_[has], at[has], n[has]
        if len(done):
            order = _mixed(symbols + _FIRST)
            depth = np.frexp(n.astype(np.float64))[1] - 1
            least = order  # of 1, 2, 4, ... symbols from each place on
            for d in range(depth.max() + 1):
                if d:
                    least = np.minimum(least, np.append(least[1 << (d - 1) :], np.full(min(1 << (d - 1), len(least)), np.iinfo(np.uint64).max, np.uint64)))
                here = np.flatnonzero(depth == d)
                out[done[here]] = np.minimum(least[at[here]], least[at[here] + n[here] - (1 << d)])
        open_ = open_[~has]
        if not len(open_):
            break
    return out


def _bounds(change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of stretches, from where a new one begins."""
    first = np.flatnonzero(change)
    return first, np.append(first[1:], len(change)) - 1


def _stretches(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text (by number) the symbols that its windows choose, and the first and last window of
    each stretch with one symbol. Texts share an array; parts of long ones overlap by a window."""
    parts: list[tuple[int, int, np.ndarray]] = []

    def flush() -> Iterator[tuple]:
        names = np.concatenate([x for _, _, own in parts for x in (np.zeros(1, np.uint64), own)] + [np.zeros(1, np.uint64)])
        begin = np.cumsum([1, *(len(own) + 1 for *_, own in parts)])[:-1]
        many = np.array([len(own) - WINDOW + 1 for *_, own in parts])
        part = np.repeat(np.arange(len(parts)), many)
        inside = np.arange(len(part)) - np.repeat(np.cumsum(many) - many, many)
        symbols = chosen_symbols(names, begin[part] + inside)
        first, last = _bounds(np.concatenate([[True], (symbols[1:] != symbols[:-1]) | (part[1:] != part[:-1])]))
        for k in range(len(parts)):
            here = slice(*np.searchsorted(part[first], [k, k + 1]))
            text, offset, _ = parts[k]
            yield text, symbols[first[here]], inside[first[here]] + offset, inside[last[here]] + offset
        parts.clear()

    size = 0
    for k, text in enumerate(texts):
        names = word_names(text)
        for at in range(0, len(names) - WINDOW + 1, PART_WORDS - WINDOW + 1):
            parts.append((k, at, names[at : at + PART_WORDS]))
            size += len(parts[-1][2])
            if size >= PART_WORDS:
                yield from flush()
                size = 0
    if parts:
        yield from flush()


def window_names(names: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit name of each window of WINDOW words that begins at `at`, from its words alone."""
    with np.errstate(over="ignore"):
        power = lambda base: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(names), base)]))
        sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(names * power(_STEP)[:-1])])
        return _mixed((sums[at + WINDOW] - sums[at]) * power(_BACK)[at])


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows of the batch some at a time, with their texts."""
    texts = batch.column("text").cast(pa.large_binary())
    ends = np.cumsum(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PART_BYTES, "right")))
        yield batch.slice(first, last - first), texts.slice(first, last - first).to_pylist()
        first = last


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*values, np.zeros(0, np.int64)]), kind))


def _order() -> Column:
    """The order of documents: by key, null keys last."""
    return F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc")


def _parsed(texts: DataFrame) -> DataFrame:
    """Symbols of each text, with the first and last window of each stretch that chooses them."""

    def parse(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for part, own in _slices(batch):
                found: dict[int, list] = {}
                for k, *columns in _stretches(own):
                    found.setdefault(k, []).append(columns)
                rows = sorted(found)
                values = [[np.concatenate([x[c] for x in found[k]]) for k in rows] for c in range(3)]
                arrays = [_lists([x.view(np.int64) for x in values[0]], pa.int64()), *(_lists(v, pa.int32()) for v in values[1:])]
                yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(rows, pa.int64())), part.column("doc").take(pa.array(rows, pa.int64())), *arrays], ["key", "doc", "symbols", "firsts", "lasts"])

    return texts.mapInArrow(parse, "key long, doc long, symbols array<long>, firsts array<int>, lasts array<int>")


def _windows(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The names of all windows of the wanted stretches (key; array of symbol, first, last) of the texts."""

    def name(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for part, own in _slices(batch):
                keys, docs, out = part.column("key").to_numpy(), part.column("doc").to_numpy(), []
                for k, (text, stretches) in enumerate(zip(own, part.column("stretches"), strict=True)):
                    symbols, first, last = (stretches.values.field(c).to_numpy() for c in ("symbol", "first", "last"))
                    many = last.astype(np.int64) - first + 1
                    at = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
                    out.append((symbols, np.full(len(symbols), keys[k]), np.full(len(symbols), docs[k]), first, many, window_names(word_names(text), at).view(np.int64)))
                columns = [np.concatenate(c) for c in zip(*out, strict=True)]
                begin = np.cumsum(columns[4]) - columns[4]
                with np.errstate(over="ignore"):  # the names of a stretch, in order, under one name
                    inside = (np.arange(len(columns[5])) - np.repeat(begin, columns[4])).astype(np.uint64)
                    whole = np.add.reduceat(_mixed(columns[5].view(np.uint64) + inside * _STEP), begin) if len(begin) else np.zeros(0, np.uint64)
                names = pa.ListArray.from_arrays(pa.array(np.append(begin, len(columns[5])).astype(np.int32)), pa.array(columns[5]))
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns[:4]), pa.array(whole.view(np.int64)), names], ["symbol", "key", "doc", "first", "whole", "names"])

    return texts.join(wanted.hint("shuffle_hash"), "key").select("key", _order(), "text", "stretches").mapInArrow(name, "symbol long, key long, doc long, first int, whole long, names array<long>")


def _repeated(group: pa.Table) -> pa.Table:
    """Of the windows of some symbols, the stretches that a document with a smaller number has: key,
    begin and end in words."""
    lists = group.column("names").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    many = lists.value_lengths().to_numpy()
    row = np.repeat(np.arange(len(many)), many)
    symbol, doc, first = (group.column(c).to_numpy()[row] for c in ("symbol", "doc", "first"))
    names, at = lists.flatten().to_numpy(), first + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    order = np.lexsort((names, symbol))
    new = np.ones(len(order), bool)
    new[1:] = (symbol[order][1:] != symbol[order][:-1]) | (names[order][1:] != names[order][:-1])
    hit = np.zeros(len(order), bool)
    if len(order):
        least = np.minimum.reduceat(doc[order], np.flatnonzero(new))
        hit[order] = doc[order] > least[np.cumsum(new) - 1]
    hits = np.flatnonzero(hit)
    begins = np.ones(len(hits), bool)
    begins[1:] = (np.diff(hits) != 1) | (row[hits][1:] != row[hits][:-1])
    begin, end = np.flatnonzero(begins), np.flatnonzero(np.append(begins[1:], True)[: len(hits)])
    return pa.table({"key": group.column("key").to_numpy()[row[hits[begin]]], "begin": pa.array(at[hits[begin]], pa.int32()), "end": pa.array(at[hits[end]] + WINDOW, pa.int32())})


def _kept(texts: DataFrame, removed: DataFrame) -> DataFrame:
    """One row per text: words, removed words and the digest of the rest."""

    def cut(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for part, own in _slices(batch):
                n_words, n_removed, digests = [], [], []
                for text, spans in zip(own, part.column("spans"), strict=True):
                    digest, seen, kept, steps = hashlib.sha256(), 0, 0, None
                    if spans.is_valid and len(spans.values):
                        begin, end = (spans.values.field(c).to_numpy() for c in ("begin", "end"))
                        steps = np.zeros(int(end.max()) + 1, np.int32)
                        np.add.at(steps, begin, 1)
                        np.add.at(steps, end, -1)
                        steps = np.cumsum(steps) == 0
                    for piece in _pieces(text):
                        words = piece.split()
                        left = words if steps is None else [*compress(words, steps[seen : seen + len(words)]), *words[max(0, len(steps) - seen) :]]
                        if left:
                            digest.update(b" " * (kept > 0) + b" ".join(left))
                        seen, kept = seen + len(words), kept + len(left)
                    n_words.append(seen)
                    n_removed.append(seen - kept)
                    digests.append(digest.hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return texts.join(removed.hint("shuffle_hash"), "key", "left").select("doc_id", "text", "spans").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every word that a window of WINDOW words covers which also begins in a document with a
    smaller key; windows are judged on the whole input, and so the first document keeps its words.

    Returns one row per input row: doc_id, n_words, n_removed and kept_sha256, the digest of the kept
    words joined by one space. Rounds of naming runs and pairs give equal passages equal symbols inside
    (`rounds`); each window chooses one that its own words fix, so equal windows choose alike. Symbols
    that one key alone has are dropped; windows of the others are named from all their words and held
    against each other: those of common symbols by sums over equal stretches, then over equal windows,
    the rest in bounded groups. Windows are equal if their symbols and their 64-bit names are.

    Null texts have no words. Null keys come after all others and take nothing from each other. Rows
    that repeat, or have one key, take nothing from each other either. Texts with fewer words than a
    window stay as they are. Other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    # All joins with texts take the same columns of them, so that Spark deals the texts out once.
    texts = rows.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")
    parsed = checkpointed(_parsed(texts.select("key", _order(), "text")))
    stretches = parsed.select("key", "doc", F.explode(F.arrays_zip("symbols", "firsts", "lasts")).alias("s")).select("key", "doc", F.col("s.symbols").alias("symbol"), F.col("s.firsts").alias("first"), F.col("s.lasts").alias("last"))
    many = F.sum(F.col("last").cast("long") - F.col("first") + 1)
    shared = stretches.groupBy("symbol").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), many.alias("windows")).filter("least < most").select("symbol", (F.col("windows") > HOT_WINDOWS).alias("hot"))
    found = checkpointed(stretches.join(shared, "symbol").groupBy("key", "hot").agg(F.collect_set(F.struct("symbol", "first", "last")).alias("stretches")))
    total = found.filter("not hot").agg(F.sum(F.aggregate("stretches", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1))).first()[0] or 0
    groups = 1 + total // VERIFIED_WINDOWS
    few = _windows(texts, found.filter("not hot").select("key", "stretches")).groupBy(F.pmod(F.xxhash64("symbol"), F.lit(groups)).alias("part")).applyInArrow(_repeated, "key long, begin int, end int")
    # Symbols with many windows: stretches that agree as a whole are settled at once, by the first of
    # them, and only that one's windows are held against those of other stretches.
    hot = _windows(texts, found.filter("hot").select("key", "stretches"))
    met = hot.join(hot.groupBy("symbol", "whole").agg(F.min("doc").alias("least")), ["symbol", "whole"])
    copies = met.filter("doc > least").select("key", F.col("first").alias("begin"), (F.col("first") + F.size("names") + WINDOW - 1).alias("end"))
    names = met.filter("doc = least").select("symbol", "key", "doc", "first", F.posexplode("names").alias("n", "name"))
    least = names.groupBy("symbol", "name").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).filter("least < most").drop("most")
    begin = F.col("first") + F.col("n")
    common = names.join(least, ["symbol", "name"]).filter("doc > least").select("key", begin.alias("begin"), (begin + WINDOW).alias("end"))
    removed = few.unionByName(copies).unionByName(common).groupBy("key").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    return _kept(texts, removed)


def op13_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
