"""A corpus pipeline of five stages, each written as Parquet and read again as the next one's documents.

Every stage but the last returns the columns of its documents, of whatever names, with the values they had; only
repeated passages changes text and n_chars. Defined cases, for all stages: null and empty texts are clean, of no group
and without passages, and stay up to packing, where they are one end token each; a row without an id is packed, and no
stage before drops it but for toxicity; texts of any length are read whole; of ties between copies the smallest id
stays; rows that share an id share what becomes of it in the stages that judge by id (2 and 4), and are judged one by
one by toxicity; an empty table stays empty."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilspark.llm import decontamination, ngram_jaccard, queries, substring_dedup, toxicity


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain rejects go."""
    return toxicity.without_toxic(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group stays."""
    return ngram_jaccard.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from all documents but the first; a document of which nothing is left goes."""
    return substring_dedup.left_over(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def leaked_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences."""
    return queries.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("benchmark_decontamination", leaked_benchmarks),
    ("packing", packed),
]

#: Toxicity and packing can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What stages return is kept in the shared folder."""
    from veilspark.llm import shared

    folder = os.path.join(shared.folder(spark), f"pipeline-{uuid.uuid4().hex}")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
