"""A corpus, from raw documents to piece ids: each stage works on all that the one before it kept.

Stages take (spark, docs, sf_dir) and give a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last give the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm import decontam, langid, linededup, minhash, pieces
from quernel.llm.queries import PIECE_MODEL
from quernel.store import saved

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has no language (null, or without a letter) go."""
    return langid.identified(docs).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of repeated passages go, and n_chars follows the text; every document stays."""
    clean = linededup.dedup_lines(docs)
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", changed).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of equal or near-equal texts, the document of smallest doc_id stays."""
    return minhash.one_of_each(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, and whether decoding the ids gives the text back."""
    coded = pieces.round_trip(docs, PIECE_MODEL, ["doc_id"])
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "restored")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("piece_ids", piece_ids),
]

#: Near-duplicate groups, learned languages and piece ids are beyond SQL; tests hold run() against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
