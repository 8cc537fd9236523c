"""The corpus pipeline: documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a
DataFrame that run() writes as Parquet and reads again for the next stage. All stages but the last
return the columns of `documents`. Null, empty and letterless texts leave in the first stage; rows
that repeat are treated alike by each stage, and the join keeps one key of each linked group; an
empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ninefold.llm.common import ensure_checkpoint_dir, table
from ninefold.llm.jaccard import one_of_each
from ninefold.llm.language import fit_languages, held_out, language_filter
from ninefold.llm.packing import op1_columns, pack_documents
from ninefold.llm.quality import quality_filter
from ninefold.llm.secrets import mask_secrets


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters, texts that no learned language explains better than chance, and
    texts in which no language has three tenths of the mixture."""
    return language_filter(docs, fit_languages(docs.filter(~held_out())))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what fails the base rules or the thresholds of its language and source."""
    return quality_filter(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest key of each group that the n-gram Jaccard join links (five words, 0.8)."""
    return one_of_each(docs, size=5, threshold=80)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, its secrets masked."""
    return mask_secrets(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset."""
    return op1_columns(pack_documents(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("jaccard_join", drop_near_copies),
    ("secret_scan", hide_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written to the shared folder and read again."""
    ensure_checkpoint_dir(spark)
    root = f"{spark.sparkContext.getCheckpointDir() or spark.conf.get('spark.checkpoint.dir')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs


#: No SQL expresses the learned stages. tests/llm holds the join, the packing, the mixture and the quality
#: verdict against brute force, and the masking against planted secrets.
ORACLE_SQL: str | None = None
