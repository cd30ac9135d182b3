"""The corpus pipeline: cleaning and packing stages over ``documents``, and the queries of its operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``docs``, with ``n_chars`` following the text where a stage changes it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import line_dedup, pii, queries, simhash
from textloom.llm.common import materialize, read, text_batches

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus has."""
    text_batches(spark)
    return queries.identified(docs).where("language.kept").drop("language")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines repeated across documents stay in one."""
    return _measured(line_dedup.dedup_lines(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    text_batches(spark)
    return simhash.deduplicate(docs)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values give way to pseudonyms."""
    text_batches(spark)
    done = docs.withColumn("__done", pii.pseudonymise(F.col("text"), pii.job_key(spark)))
    return _measured(done.withColumn("text", F.col("__done.text")).drop("__done"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences."""
    text_batches(spark)
    return queries.packed_pieces(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", near_dedup),
    ("pii", pseudonymise),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs


# Tokenisation and pseudonyms are beyond SQL; tests compare the stages with plain Python.
ORACLE_SQL = None

QUERIES = {**queries.QUERIES, "pipeline": run}
SQL = dict(queries.SQL)
