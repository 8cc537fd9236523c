"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ninefold.functions.storage import checkpointed, shared_folder  # noqa: F401  for the operators

#: Two white-space characters side by side (or a NUL): such texts cannot be cut at single spaces.
_SIDE_BY_SIDE = re.compile(r"\s\s|\0")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the session names; only on one machine (tests) one is made."""
    shared_folder(spark)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The key as a long and the whole text; a null text counts as empty, flagged in is_null."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))


def batches(columns: list[pa.Array] | list, names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(columns, types, strict=True)], names)


@lru_cache(maxsize=2)
def rank_encoding(path: str):
    """The tiktoken encoding of a rank file; made once in each Python worker."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def words_with_space(text: str) -> list[str] | None:
    """The text cut before each space and after each line end, or None where white space runs together.

    No match of the splitting pattern of the byte-level vocabularies spans such a cut if no two
    white-space characters touch, so the parts can be encoded one by one and each only once.
    """
    if _SIDE_BY_SIDE.search(text):
        return None
    return text.replace(" ", "\0 ").replace("\n", "\n\0").split("\0")


class Memo(dict):
    """A bounded memo of a function of one string; it is emptied when full."""

    def __init__(self, function, limit: int = 150_000):
        super().__init__()
        self.function, self.limit = function, limit

    def __missing__(self, word: str):
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.function(word)
        return value
