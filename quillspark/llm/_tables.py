"""Reading tables, cutting lineage and small helpers of the subpackage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: what stands between white space of the ASCII range.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that all executors share: what spark.checkpoint.dir names.

    Where that is unset, a temporary folder serves a local master; a cluster must name one.
    """
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="quillspark-")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder, so that a lost executor costs no earlier stage."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def free_name(wanted: str, taken: list[str]) -> str:
    """``wanted``, with underscores before it until no column has that name (names ignore case)."""
    taken = {x.lower() for x in taken}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def quoted(names: list[str]) -> list[str]:
    """Names as column references; dots and back-ticks in them stay part of the names."""
    return [f"`{x.replace('`', '``')}`" for x in names]


def small_batches(spark: SparkSession, most: int = 1000) -> None:
    """From now on Arrow batches have so many rows at most: a batch of whole texts is held several times, in the JVM and in Python."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < rows <= most:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(most))


def by_place(df: DataFrame) -> DataFrame:
    """``df`` with columns named c0, c1 ...: Arrow functions can't be given columns with dots in their names."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def fold(doc_id, n: int):
    """crc32 of the id written as text, modulo ``n``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def labelled_sample(labels: DataFrame, target: str, where, most: int) -> DataFrame:
    """At most ``most`` labelled ids (doc_id, y), the same at every run: those whose id hashes lowest.

    An id with several labels takes the largest.
    """
    return (
        labels.filter(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & where)
        .groupBy("doc_id")
        .agg(F.max(target).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
