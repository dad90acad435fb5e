"""A corpus pipeline over the documents table: filter, dedup, decontaminate and mix.

Every stage works on all that the stage before it kept, as a table written in
the folder that all executors share.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import decontaminate, jaccard_trie, line_dedup, mixing, quality
from weftline.llm.store import shared_folder, table


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that pass the base rules and the robust outlier rule."""
    return quality.keep_good(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without the lines that repeat an earlier one; those with nothing left go."""
    return line_dedup.dedup_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group of near-duplicates."""
    return jaccard_trie.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, folder, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """How many words of every document the mix takes."""
    return mixing.taken(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", dedup_documents),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
]

#: SQL can express neither the outlier rule nor MinHash; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the last stage over the documents table of a folder."""
    docs = table(spark, folder, "documents")
    place = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        out = f"{place}/{i}"
        stage(spark, docs, folder).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
