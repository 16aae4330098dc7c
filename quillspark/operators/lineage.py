"""Cutting lineage, and spreading small inputs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of a table's files for each task of a costly detector, so that tasks grow in number and not in length.
PART = 1 << 20
#: Places in a manuscript that are numbered together, in one task.
BLOCK = 1 << 16
#: Rows that are dealt to a task together, on average, and rows of a counted table that is broadcast.
PART_ROWS, MOST_BROADCAST = 100_000, 200_000


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


def settle(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder: what follows reads it, and a lost executor costs no earlier stage."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder as a table: what follows reads the columns that it needs."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame) -> DataFrame:
    """``df`` written once and, if it has MOST_BROADCAST rows at most, marked to be broadcast: what is large beside it stays where it is."""
    kept = settle(df)
    return F.broadcast(kept) if kept.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else kept


def in_blocks(df: DataFrame, place: str) -> tuple[DataFrame, DataFrame]:
    """``df`` dealt by session and ``_block`` (of the column ``place``), in parts of about PART_ROWS rows, and (_session, _of, _before): the rows before each block.

    Parts grow in number with the rows, not in size. ``df`` is read twice, the first time for session and place alone.
    """
    block = F.coalesce(F.floor(F.col(place) / BLOCK), F.lit(-(1 << 62))).cast("long")  # nulls come first
    sizes = df.select("session_id", block.alias("_block")).groupBy("session_id", "_block").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.partitionBy("session_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counted(sizes.select(F.col("session_id").alias("_session"), F.col("_block").alias("_of"), before.alias("_before"), "_rows"))
    rows = starts.agg(F.sum("_rows")).first()[0] or 0
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // PART_ROWS))
    return df.withColumn("_block", block).repartition(parts, "session_id", "_block"), starts.drop("_rows")


def number_blocks(rows: DataFrame, starts: DataFrame, name: str, place: str, *order: str) -> DataFrame:
    """Rows of ``in_blocks`` with numbers from 1 within each session, in the order of ``place`` and then of ``order``."""
    nth = F.row_number().over(Window.partitionBy("session_id", "_block").orderBy(place, *order))
    joined = rows.withColumn("_nth", nth).join(starts, F.col("session_id").eqNullSafe(F.col("_session")) & (F.col("_block") == F.col("_of")))
    return joined.withColumn(name, (F.col("_before") + F.col("_nth")).cast("int")).drop("_block", "_nth", "_session", "_of", "_before")


def with_number(df: DataFrame, name: str, place: str, *order: str) -> DataFrame:
    """``df`` with numbers from 1 within each session, in the order of the column ``place`` and then of ``order``.

    Rows are numbered in blocks of places, after the rows of the blocks before; so a session is no task of its own.
    """
    return number_blocks(*in_blocks(df, place), name, place, *order)


#: Rows of a session up to which it is settled in one task.
SMALL_SESSION = 200_000


def by_size(rows: DataFrame, small: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of sessions of up to ``small`` rows, and those of larger ones (None without any)."""
    large = settle(rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > small).select("session_id"))
    if large.isEmpty():
        return rows, None
    return rows.join(large, "session_id", "left_anti"), rows.join(large, "session_id", "left_semi")


def spread(df: DataFrame, *by: str | Column) -> DataFrame:
    """``df`` dealt over all cores, by the columns ``by`` if there are any, in parts of PART of its input at most: files have few row groups, which aren't split."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(cores, -(-size // PART)), *by)
