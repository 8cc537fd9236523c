"""Byte-level BPE with Spark's higher-order functions."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, rank_encoding, table, vocabulary

#: Text of a block, which lists its distinct words once: so many characters at most (or one longer document).
BLOCK_CHARS = 32_000_000
#: Words over so many characters are cut wherever two bytes meet that no token holds side by side; no
#: merge can cross such a place, so the ids stay the same.
CUT = 64
#: What is left over so many bytes goes to the public encoder: the fold is quadratic in a word.
LONGEST = 4096
#: Bytes of text for each part that the distinct words of all blocks are dealt into by hash.
PART_BYTES = 16_000_000
_BUCKETS = 1 << 16
_NONE = 1 << 30
_PLACES = 1 << 20

#: The public splitting pattern for texts that hold ASCII and Latin letters only, where Python's own
#: classes agree with it; other texts are split by the pattern itself.
_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_OTHER = re.compile("[\x1c-\x1f\x80-\xbfɐ-\U0010ffff]")


def _splitter():
    import public_tokenizers
    import regex

    general = regex.compile(public_tokenizers.PATTERN)
    return lambda text: (general if _OTHER.search(text) else _PLAIN).findall(text)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _cutter(ranks: dict[bytes, int]):
    """A function that cuts the bytes of a word where no token spans."""
    joint = np.zeros((256, 256), bool)
    for piece in ranks:
        b = np.frombuffer(piece, np.uint8)
        joint[b[:-1], b[1:]] = True

    def cut(word: bytes) -> list[bytes]:
        b = np.frombuffer(word, np.uint8)
        at = [0, *(np.flatnonzero(~joint[b[:-1], b[1:]]) + 1).tolist(), len(word)]
        return [word[x:y] for x, y in zip(at, at[1:], strict=False)]

    return cut


# -- the fold -----------------------------------------------------------------------------------------


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _bucket(first, second):
    return (first * 40503 + second * 30011) % _BUCKETS


def merge_ranks(ranks: dict[bytes, int]) -> Column:
    """The rank map as a literal: for two neighbouring tokens the rank of their joined bytes, in an
    array of small maps by a hash of the two (one map alone is searched from end to end)."""
    maps: list[dict[str, int]] = [{} for _ in range(_BUCKETS)]
    for piece, rank in ranks.items():
        for k in range(1, len(piece)):
            first, second = ranks.get(piece[:k]), ranks.get(piece[k:])
            if first is not None and second is not None:
                maps[_bucket(first, second)][str(first << 17 | second)] = rank
    return F.from_json(F.lit(json.dumps(maps)), "array<map<string,bigint>>")


def encode_word(word: Column, ranks: dict[bytes, int], map_: Column) -> Column:
    """Ids of the bytes of a word: of all neighbours the two with the lowest rank, leftmost first, are
    merged until no two have a rank. The state of the fold is the ids and the ranks of neighbours."""
    none = F.array().cast("array<bigint>")
    of_byte = F.from_json(F.lit(json.dumps([ranks[bytes([k])] for k in range(256)])), "array<bigint>")

    def rank(first: Column, second: Column) -> Column:
        return F.coalesce(F.get(map_, _bucket(first, second).cast("int"))[(first * (1 << 17) + second).cast("string")], F.lit(_NONE).cast("bigint"))

    def merge(state: Column, lowest: Column) -> Column:
        """The state after the merge of the lowest rank, given as rank and place in one number."""

        def at(state: Column, place: Column) -> Column:
            ids, joined, n = state["ids"], F.shiftright(lowest, 20), F.size(state["ids"])
            left = F.when(place > 0, F.array(rank(F.get(ids, place - 1), joined))).otherwise(none)
            right = F.when(place + 2 < n, F.array(rank(joined, F.get(ids, place + 2)))).otherwise(none)
            before, after = F.slice(state["ranks"], F.lit(1), F.greatest(place - 1, F.lit(0))), F.slice(state["ranks"], place + 3, n)
            return F.struct(F.concat(F.slice(ids, F.lit(1), place), F.array(joined), F.slice(ids, place + 3, n)).alias("ids"), F.concat(before, left, right, after).alias("ranks"))

        ended = F.struct(state["ids"].alias("ids"), none.alias("ranks"))
        return F.when(lowest >= _NONE * _PLACES, ended).otherwise(F.aggregate(F.array((lowest % _PLACES).cast("int")), state, at))

    def step(state: Column) -> Column:
        lowest = F.array_min(F.transform(state["ranks"], lambda r, i: r * _PLACES + i))
        return F.when(F.size(state["ranks"]) == 0, state).otherwise(F.aggregate(F.array(lowest), state, merge))

    def folded(ids: Column) -> Column:
        n = F.size(ids)
        start = F.struct(ids.alias("ids"), F.zip_with(F.slice(ids, F.lit(1), n - 1), F.slice(ids, F.lit(2), n), rank).alias("ranks"))
        return F.when(n < 2, ids).otherwise(F.aggregate(F.sequence(F.lit(2), n), start, lambda state, _: step(state), lambda state: state["ids"]))

    letters = F.split(F.decode(word, "ISO-8859-1"), "")
    return _let(F.transform(letters, lambda c: F.get(of_byte, F.ascii(c))), folded)


def decode_ids(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The pieces of the ids, put together."""
    pieces = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex()
    known = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
    return F.aggregate(ids, F.unhex(F.lit("")), lambda all_, i: F.concat(all_, F.unhex(F.get(known, i.cast("int")))))


# -- blocks of documents, parts of words --------------------------------------------------------------


def _pack(a: np.ndarray | bytes) -> bytes:
    return zstandard.compress(a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes(), 3)


def _unpack(data: bytes, kind=None):
    plain = zstandard.decompress(data)
    return plain if kind is None else np.frombuffer(plain, kind)


def _pack_bytes(items: list[bytes]) -> tuple[bytes, bytes]:
    return _pack(b"".join(items)), _pack(np.fromiter(map(len, items), np.int32, len(items)))


def _unpack_bytes(data: bytes, sizes: bytes) -> list[bytes]:
    plain, ends = _unpack(data), np.cumsum(_unpack(sizes, np.int32)).tolist()
    return [plain[x:y] for x, y in zip([0, *ends], ends, strict=False)]


def _take(values: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the rows, one after the other, and how many each has; row k has sizes[k] of them."""
    starts, many = np.cumsum(sizes, dtype=np.int64) - sizes, sizes[rows].astype(np.int64)
    at = np.repeat(starts[rows] - (np.cumsum(many) - many), many)
    at += np.arange(len(at))
    return values[at], many


class _Index(dict):
    def __missing__(self, word) -> int:
        self[word] = number = len(self)
        return number


def _blocks(rows: DataFrame, ranks: str) -> DataFrame:
    """Blocks of documents: their keys, how many words each has, the places of these words among the
    block's distinct words, and these."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, cut, number = _splitter(), _cutter(read_ranks(vocabulary(ranks))), TaskContext.get().partitionId() << 32
        index, keys, lengths, places, chars = _Index(), [], [], [], 0

        def close() -> pa.RecordBatch:
            at = np.concatenate(places)
            planes = np.ascontiguousarray(at.view(np.uint8).reshape(-1, 4).T)  # by significance: smaller
            packed = [_pack(np.array(lengths, np.int64)), _pack(planes), *_pack_bytes([w.encode() if isinstance(w, str) else w for w in index])]
            columns = [pa.array([number], pa.int64()), pa.array([keys], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in packed)]
            return pa.RecordBatch.from_arrays(columns, ["block", "keys", "lengths", "places", "words", "sizes"])

        for batch in source:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if keys and chars + len(text) > BLOCK_CHARS:
                    yield close()
                    number += 1
                    index, keys, lengths, places, chars = _Index(), [], [], [], 0
                words = split(text)
                if max(map(len, words), default=0) > CUT:
                    words = [x for w in words for x in (cut(w.encode()) if len(w) > CUT else (w,))]
                keys.append(key)
                lengths.append(len(words))
                places.append(np.fromiter(map(index.__getitem__, words), np.int32, len(words)))
                chars += len(text)
        if keys:
            yield close()

    return rows.mapInArrow(run, "block long, keys array<bigint>, lengths binary, places binary, words binary, sizes binary")


def _dealt(blocks: DataFrame, parts: int) -> DataFrame:
    """The words of each block dealt into parts by hash, with their places in the block."""
    import zlib

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for block, data, sizes in zip(*(batch.column(n).to_pylist() for n in ("block", "words", "sizes")), strict=True):
                words = _unpack_bytes(data, sizes)
                if not words:
                    continue
                part = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % parts
                order = np.argsort(part, kind="stable")
                there, first = np.unique(part[order], return_index=True)
                out = []
                for p, x, y in zip(there.tolist(), first, [*first[1:], len(order)], strict=True):
                    out.append((p, block, _pack(np.diff(order[x:y], prepend=0).astype(np.int32)), *_pack_bytes([words[k] for k in order[x:y].tolist()])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["part", "block", "steps", "words", "sizes"])

    return blocks.mapInArrow(run, "part long, block long, steps binary, words binary, sizes binary")


def _distinct(ranks: str):
    """The words of a part, each once. Whole tokens have their id, and words over LONGEST bytes have the
    ids of the public encoder; the others are left to the fold."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        known, public = read_ranks(vocabulary(ranks)), rank_encoding(vocabulary(ranks))
        words = sorted(set().union(*map(_unpack_bytes, group.column("words").to_pylist(), group.column("sizes").to_pylist())))
        ids = [[known[w]] if w in known else public._encode_single_piece(w) if len(w) > LONGEST else None for w in words]
        return pa.table({"part": pa.array([key[0].as_py()] * len(words), pa.int64()), "word": pa.array(words, pa.binary()), "given": pa.array(ids, pa.list_(pa.int64()))})

    return run


def _sent_back(key: tuple, coded: pa.Table, dealt: pa.Table) -> pa.Table:
    """For each block its words of a part, coded and decoded, with their places."""
    out: list[tuple] = []
    plain = coded.column("plain").to_pylist()
    place = {w: k for k, w in enumerate(plain)}  # a word is what its ids decode to
    lists = coded.column("ids").combine_chunks()
    ids, sizes = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32), np.diff(lists.offsets.to_numpy())
    for r in dealt.to_pylist():
        rows = np.fromiter(map(place.__getitem__, _unpack_bytes(r["words"], r["sizes"])), np.int64)
        found, many = _take(ids, sizes, rows)
        out.append((r["block"], r["steps"], _pack(found), _pack(4 * many.astype(np.int32)), *_pack_bytes([plain[k] for k in rows.tolist()])))
    return pa.Table.from_arrays([pa.array([x[k] for x in out], pa.int64() if not k else pa.binary()) for k in range(6)], ["block", "steps", "ids", "n_ids", "plain", "n_plain"])


def _strung(ranks: str):
    """The documents of a block: the ids of their words and what these decode to, strung together."""

    def run(key: tuple, coded: pa.Table, block: pa.Table) -> pa.Table:
        out = []
        rows = coded.to_pylist()
        for r in block.to_pylist():
            words = _unpack_bytes(r["words"], r["sizes"])
            ids, plain = [b""] * len(words), [b""] * len(words)
            for c in rows:
                at = np.cumsum(_unpack(c["steps"], np.int32)).tolist()
                for k, i, x in zip(at, _unpack_bytes(c["ids"], c["n_ids"]), _unpack_bytes(c["plain"], c["n_plain"]), strict=True):
                    if k < len(words):
                        ids[k], plain[k] = i, x
            if plain != words:  # the input came in another order when a lost task was run again
                public, pieces = rank_encoding(vocabulary(ranks)), {v: k for k, v in read_ranks(vocabulary(ranks)).items()}
                for k in (k for k, w in enumerate(words) if plain[k] != w):
                    found = public._encode_single_piece(words[k])
                    ids[k], plain[k] = np.array(found, np.int32).tobytes(), b"".join(pieces[i] for i in found)
            values = [(np.frombuffer(b"".join(x), t), np.fromiter(map(len, x), np.int64, len(x)) // t().itemsize) for x, t in ((ids, np.int32), (plain, np.uint8))]
            lengths = _unpack(r["lengths"], np.int64)
            places = np.ascontiguousarray(_unpack(r["places"], np.uint8).reshape(4, -1).T).view(np.int32).reshape(-1)
            ends, first = np.cumsum(lengths), 0
            while first < len(lengths):  # some documents at a time
                begin = ends[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(ends, begin + 300_000, "right")))
                cuts = np.r_[0, ends[first:last] - begin]
                columns = [pa.array(r["keys"][first:last], pa.int64())]
                for known, sizes in values:
                    data, many = _take(known, sizes, places[begin : ends[last - 1]])
                    offsets = (np.r_[0, np.cumsum(many)][cuts] * data.itemsize).astype(np.int32)
                    columns.append(pa.Array.from_buffers(pa.binary(), last - first, [None, pa.py_buffer(offsets), pa.py_buffer(data)]))
                out.append(pa.RecordBatch.from_arrays(columns, schema=_CODED))
                first = last
        return pa.Table.from_batches(out, schema=_CODED)

    return run


_CODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Encode every whole text and decode it again: doc_id, ids (binary, little-endian unsigned 32
    bit), decoded (binary).

    Texts are split once, by the public pattern, into blocks that hold each distinct word once and
    each document as places of words; these go through one shuffle, which both later uses read.
    Words leave the blocks, dealt into parts by hash, and each distinct word of all blocks is encoded
    and decoded once by Spark expressions. The parts go back to the blocks, where the ids of each
    document and the bytes that these decode to are strung together. No text is shuffled, and a word
    that every document has is one row of each block. A block that came out otherwise when a lost
    task was run again finds words that were not sent back to it, and has these encoded there.

    Null and empty texts have no ids. One row per input row, null keys and repeated rows included;
    other columns are ignored; an empty table gives no rows. Words over CUT characters are cut where
    no merge can cross; a piece that is still over LONGEST bytes is encoded by the public encoder.
    """
    known, rows = read_ranks(vocabulary(ranks)), id_text(docs, id_col, text_col)
    parts = 1 + (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES
    blocks = _blocks(rows, ranks).repartition("block")  # whole rows in both uses, so that they share the exchange
    dealt = _dealt(blocks, parts)
    words = dealt.groupBy("part").applyInArrow(_distinct(ranks), "part long, word binary, given array<bigint>")
    coded = words.select("part", F.coalesce("given", _let(merge_ranks(known), lambda m: encode_word(F.col("word"), known, m))).alias("ids"))
    coded = coded.select("part", "ids", decode_ids(F.col("ids"), known).alias("plain"))
    back = coded.groupBy("part").cogroup(dealt.groupBy("part")).applyInArrow(_sent_back, "block long, steps binary, ids binary, n_ids binary, plain binary, n_plain binary")
    return back.groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(_strung(ranks), "doc_id long, ids binary, decoded binary")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_documents(table(spark, sf_dir, "documents"))
    return coded.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
