"""The corpus pipeline: from raw documents to packed training sequences.

Five stages, each over all that the one before has kept: toxic documents go,
one document of each group of near-duplicates stays, repeated passages are cut
out of texts, sources are mixed to target weights, and the mix is packed into
sequences. Every stage's result is written as Parquet and read again.

All stages take null ids, null, empty and very long texts, repeated rows, empty
tables and further columns. Columns are carried along as they are, but
``n_chars``, which follows the text; the last stage returns pieces instead.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm._tables import free_name, quoted, shared_folder, table
from quillspark.llm.minhash_dedup import drop_near_duplicates
from quillspark.llm.mixing import mix_documents, repeat_rows
from quillspark.llm.packing import pack_documents
from quillspark.llm.substring_dedup import remove_repeats
from quillspark.llm.toxicity import add_toxicity

#: Documents as likely toxic as this, or likelier, are rejected.
TOXIC = 0.5


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that aren't likely toxic; null and empty texts have no toxic term and stay. Without toxic labels all stay."""
    score = free_name("toxicity", docs.columns)
    scored = add_toxicity(docs, table(spark, sf_dir, "labels"), score_column=score)
    return scored.filter(F.col(score) < TOXIC).select(*quoted(docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class, that of the smallest id; rows of null text all stay, of empty texts one."""
    return drop_near_duplicates(docs).select(*quoted(docs.columns))


def with_text(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` with the length column brought up to date, should there be one."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select(*quoted(columns))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; a text that loses words is its other words, joined by a space, and any other text is unchanged."""
    cut = remove_repeats(docs)
    return with_text(cut.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))), docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, the border row of a source with its first words; a null source is one of its own."""
    return with_text(repeat_rows(mix_documents(docs)), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences; null and empty texts are an end token each."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: The stages are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
