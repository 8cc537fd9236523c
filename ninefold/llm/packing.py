"""Best-fit packing of token sequences, in bounded space and one pass."""

from __future__ import annotations

import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, id_text, rank_encoding, table, vocabulary, words_with_space

CAPACITY = 1024
OPEN_BINS = 4096
END_ID = 2
#: Sequences that one task can number.
_PER_TASK = 1 << 36


class BestFit:
    """Online best fit over at most `open_bins` open bins.

    Open bins lie in stacks by free space; a bit set tells which stacks hold any, so the tightest
    bin for a length is the lowest bit at or above it. When too many are open, the fullest closes.
    """

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.limit = capacity, open_bins
        self.stacks: list[list] = [[] for _ in range(capacity + 1)]
        self.bits = 0
        self.open = 0

    def _take(self, free: int) -> list:
        stack = self.stacks[free]
        bin_ = stack.pop()
        if not stack:
            self.bits ^= 1 << free
        self.open -= 1
        return bin_

    def add(self, length: int, item) -> list | None:
        """Put the item into a bin; return the items of the bin that closes thereby, if one does."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            bin_ = self._take(free)
        else:
            free, bin_ = self.capacity, []
        bin_.append(item)
        free -= length
        if free <= 0:
            return bin_
        self.stacks[free].append(bin_)
        self.bits |= 1 << free
        self.open += 1
        if self.open > self.limit:
            return self._take((self.bits & -self.bits).bit_length() - 1)
        return None

    def rest(self) -> Iterator[list]:
        while self.bits:
            yield self._take((self.bits & -self.bits).bit_length() - 1)


@lru_cache(maxsize=2)
def _encoder(json_path: str, ranks_path: str):
    """Text -> little-endian 32-bit ids. Texts are cut at single spaces and equal parts encoded once
    (with the rank file of the same vocabulary, the faster on short strings); others go to the
    tokenizer whole."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(json_path)
    whole.encode_special_tokens = False
    special = [t.content for t in whole.get_added_tokens_decoder().values()]
    ranks = rank_encoding(ranks_path)

    def encode(word: str) -> bytes:
        last = word[-1:]
        if len(word) > 1 and (last == "\n" or last in ".,;:!?" and word[-2].isalpha()):
            return memo[word[:-1]] + memo[last]
        return array.array("I", ranks.encode_ordinary(word)).tobytes()

    memo = Memo(encode)
    get = memo.__getitem__

    def of(text: str) -> bytes:
        words = words_with_space(text)
        if words is None or any(s in text for s in special):
            return array.array("I", whole.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(get, words))

    return of


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken", end_id: int = END_ID, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Pack the token ids of every text, each followed by `end_id`, into sequences of at most `capacity`.

    Returns one row per piece: doc_id, piece (int, from 0), start (ids of the document before it),
    length, ids (binary, little-endian unsigned 32 bit), sequence_id, offset. A document longer than
    `capacity` is cut into full pieces, of which the first may be shorter; nothing else is cut.

    Each task packs its own input partition in one pass without a shuffle, a batch of rows at a time,
    of which the longest pieces come first. At any time it keeps at most `open_bins` open sequences,
    and closes the fullest where that would be too many. Null and empty texts give one piece that holds
    `end_id` alone. Rows that repeat a key are packed as documents of their own, a null key stays
    null, other columns are ignored, and an empty table gives no rows. `tokenizer` and `ranks` name
    one vocabulary in its two public forms.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary(tokenizer), vocabulary(ranks))
        end = array.array("I", [end_id]).tobytes()
        packer, number = BestFit(capacity, open_bins), TaskContext.get().partitionId() * _PER_TASK
        out: list[tuple] = []

        def close(bin_: list) -> None:
            nonlocal number
            at = 0
            for doc, piece, start, ids in bin_:
                out.append((doc, piece, start, len(ids) >> 2, ids, number, at))
                at += len(ids) >> 2
            number += 1

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES.values(), strict=True)], list(_TYPES))
            out.clear()
            return batch

        for batch in source:
            pieces: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text) + end
                n = len(ids) >> 2
                start, stop, piece = 0, n if n <= capacity else n % capacity or capacity, 0
                while start < n:
                    pieces.append((doc, piece, start, ids[4 * start : 4 * stop]))
                    start, stop, piece = stop, min(n, stop + capacity), piece + 1
            pieces.sort(key=lambda x: -len(x[3]))
            for x in pieces:
                if (full := packer.add(len(x[3]) >> 2, x)) is not None:
                    close(full)
                if len(out) >= 4096:
                    yield flush()
        for bin_ in packer.rest():
            close(bin_)
            if len(out) >= 4096:
                yield flush()
        if out:
            yield flush()

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long")


_TYPES = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids": pa.binary(), "sequence_id": pa.int64(), "offset": pa.int64()}


def op1_columns(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_columns(pack_documents(table(spark, sf_dir, "documents")))
