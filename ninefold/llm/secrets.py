"""Scan for secrets: known shapes, and strings that a tokenizer finds hard to encode."""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_text, rank_encoding, table, vocabulary

#: The shapes of secrets, and the least length of what each must match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_VALUE = 12
KINDS = ("assign", "access", "hex", "random")
#: A text without any of these, in lower case, has no assignment.
_HINTS = (b"passw", b"secret", b"token", b"api")

#: Runs that the token-efficiency test looks at, and what may join a secret to words within one.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
JOINTS = "+/_=-"
_PART = re.compile(r"[A-Za-z0-9]+")
#: Random strings take more tokens than one for so many characters; words take fewer.
CHARS_PER_TOKEN = 1.75
#: Least characters of a stretch that the test judges.
WINDOW = 16
#: Digests (MD5, SHA-1, SHA-2, in either case), UUIDs, and plain numbers are known and no secrets.
KNOWN = re.compile(r"(?<![A-Za-z0-9])(?:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[0-9a-f]{128}|[0-9a-f]{96}|[0-9a-f]{64}|[0-9a-f]{56}|[0-9a-f]{40}|[0-9a-f]{32}|[0-9/_+=-]+)(?![A-Za-z0-9])", re.IGNORECASE)


def _outside(start: int, end: int, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What is left of a stretch outside the taken ones, which are sorted and do not overlap."""
    for k in range(bisect.bisect_right(taken, (start, start)) - 1, len(taken)):
        if k < 0 or taken[k][1] <= start:
            continue
        if taken[k][0] >= end:
            break
        if taken[k][0] > start:
            yield start, taken[k][0]
        start = taken[k][1]
    if start < end:
        yield start, end


def _merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _random(value: str, tokens, chars_per_token: float) -> list[tuple[int, int]]:
    """Stretches of a string with at most so many characters a token: the whole, or windows of WINDOW
    characters at least, grown to the part between joints that they mostly fill."""
    ids = tokens.encode_ordinary(value)
    dense = lambda s, e: sum(map(str.isalnum, value[s:e])) * 5 >= (e - s) * 4  # noqa: E731  letters and digits, not joints
    if len(value) <= chars_per_token * len(ids):
        return [(0, len(value))] if dense(0, len(value)) else []
    ends = list(itertools.accumulate(len(tokens.decode_single_token_bytes(i)) for i in ids))
    found, j = [], 0
    for i in range(len(ids)):
        start = ends[i - 1] if i else 0
        while j < len(ids) and ends[j] - start < WINDOW:
            j += 1
        if j == len(ids):
            break
        if ends[j] - start <= chars_per_token * (j - i + 1):
            found.append((start, ends[j]))
    if not found:
        return []
    merged = _merged(found)
    for m in _PART.finditer(value):
        if sum(min(e, m.end()) - max(s, m.start()) for s, e in merged if s < m.end() and m.start() < e) * 2 >= m.end() - m.start():
            found.append(m.span())
        elif m.end() - m.start() >= WINDOW:  # words that a window only touches stay
            found = [(s, e) for s, e in found if not (s < m.start() < e and e - m.start() < 4)]
    out = []
    for s, e in _merged(found):
        s, e = s + len(value[s:e]) - len(value[s:e].lstrip(JOINTS)), e - len(value[s:e]) + len(value[s:e].rstrip(JOINTS))
        if e - s >= WINDOW and dense(s, e):
            out.append((s, e))
    return out


def find_spans(text: str, tokens, chars_per_token: float = CHARS_PER_TOKEN) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then by kind in the order of KINDS; code points, end exclusive."""
    low = text.encode("utf-8", "surrogatepass").lower()
    found = []
    if any(h in low for h in _HINTS):
        found += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(1, m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    base = _merged((s, e) for _, s, e in found)
    for m in CANDIDATE.finditer(text):
        taken = _merged([*base_in(base, *m.span()), *((m.start() + k.start(), m.start() + k.end()) for k in KNOWN.finditer(m[0]))])
        for start, end in _outside(*m.span(), taken):
            if end - start >= WINDOW:
                found += [(3, start + s, start + e) for s, e in _random(text[start:end], tokens, chars_per_token)]
    return [(KINDS[k], s, e) for k, s, e in sorted(found, key=lambda x: (x[1], x[0]))]


def base_in(base: list[tuple[int, int]], start: int, end: int) -> list[tuple[int, int]]:
    """The spans, of sorted ones that do not overlap, that meet a stretch."""
    first = max(0, bisect.bisect_right(base, (start, start)) - 1)
    return [x for x in base[first : bisect.bisect_left(base, (end, end))] if x[1] > start]


def masked(text: str, spans: list[tuple[str, int, int]], mask: str) -> str:
    out, at = [], 0
    for _, start, end in spans:
        if end > at:
            out += [text[at : max(at, start)], mask] if start >= at else []
            at = max(at, end)
    return "".join(out) + text[at:]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, ranks: str = "byte_bpe_50k.tiktoken", chars_per_token: float = CHARS_PER_TOKEN) -> DataFrame:
    """Find the secrets of every whole text: doc_id and spans, an array of (kind, start, end).

    Spans of the known shapes (assign, access, hex) come from leftmost matches of each shape. The
    token-efficiency test adds `random` spans: stretches with few characters per token in what runs
    of letters, digits and joints leave outside those spans and outside known digests and
    identifiers, so that neither words nor a shape beside it hide a secret. Null and empty texts
    have no spans. One row per input row, repeated rows alike; other columns are ignored; an empty
    table gives no rows.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = rank_encoding(vocabulary(ranks))
        for batch in source:
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t, tokens, chars_per_token)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPANS)], ["doc_id", "spans"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def mask_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mask: str = "[secret]", *, ranks: str = "byte_bpe_50k.tiktoken", chars_per_token: float = CHARS_PER_TOKEN) -> DataFrame:
    """The rows with all their columns, each secret in the text replaced by `mask` and the length
    column, if there is one, brought up to date. Null texts stay null and empty ones empty, spans that
    overlap share one mask, repeated rows fare alike, other columns of any name stay as they are, and
    an empty table gives no rows."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = rank_encoding(vocabulary(ranks))
        for batch in source:
            at = batch.schema.names.index(text_col)
            texts = [t and masked(t, find_spans(t, tokens, chars_per_token), mask) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    docs = docs.withColumn(text_col, F.col(text_col).cast("string"))
    out = docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema]))
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.coalesce(F.length(text_col).cast("long"), F.col(length_col)))
    return out


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda these: F.concat_ws(",", F.transform(these, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    base = F.filter("spans", lambda s: s["kind"] != KINDS[3])
    return spans.select("doc_id", count("assign"), count("access"), count("hex"), count("random"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
