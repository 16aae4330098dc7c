"""Tables that are written session by session.

A table is Parquet, partitioned by session. A write first goes to a staging folder
in full, and a line to the log says so; then the staged sessions replace their
partitions (a dynamic partition overwrite), and a second line says that it is done.
Other sessions' files are never touched. After a crash, ``recover`` does the writes
again that were staged and not done; doing one twice changes nothing. A deleted
session keeps a partition with one row that marks it as deleted, which reading
leaves out.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.stores import upsert

LOG = "commit string, table_name string, staged string, state string, at timestamp"
DELETED = "_deleted"
#: The partition column; the key itself is among the columns, so that it keeps its type.
PARTITION = "session_part"


def _log(spark: SparkSession, folder: str, commit: str, table: str, staged: str, state: str) -> None:
    row = spark.createDataFrame([(commit, table, staged, state)], "commit string, table_name string, staged string, state string")
    row.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{folder}/_log")


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    try:
        return spark.read.schema(LOG).parquet(f"{folder}/_log")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG)


def _apply(spark: SparkSession, folder: str, table: str, staged: str) -> None:
    rows = spark.read.parquet(staged)
    # rebalanced by session: small ones share a task, a large one is split among several
    rows.hint("rebalance", PARTITION).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PARTITION).parquet(f"{folder}/{table}")


def _save(spark: SparkSession, folder: str, table: str, rows: DataFrame, key: str) -> str:
    recover(spark, folder)
    commit = uuid.uuid4().hex
    staged = f"{folder}/_staged/{table}-{commit}"
    rows.withColumn(PARTITION, F.coalesce(F.col(key).cast("string"), F.lit(""))).write.parquet(staged)
    _log(spark, folder, commit, table, staged, "staged")
    _apply(spark, folder, table, staged)
    _log(spark, folder, commit, table, staged, "done")
    return commit


def save_sessions(spark: SparkSession, folder: str, table: str, rows: DataFrame, key: str = "session_id") -> str:
    """The sessions in ``rows`` hold these rows from now on, and no others; other sessions are as they were.

    One writer at a time. Returns the commit's name. A null key is a session of its own.
    """
    return _save(spark, folder, table, rows.withColumn(DELETED, F.lit(False)), key)


def delete_sessions(spark: SparkSession, folder: str, tables: list[str], sessions: DataFrame, key: str = "session_id") -> list[str]:
    """The sessions are gone from all ``tables``, those whose rows the others refer to last."""
    commits = []
    for table in tables:
        held = spark.read.parquet(f"{folder}/{table}").drop(PARTITION)
        gone = sessions.select(key).distinct()
        empty = gone.select(*(F.col(key).cast(f.dataType).alias(f.name) if f.name == key else F.lit(f.name == DELETED).alias(f.name) if f.name == DELETED else F.lit(None).cast(f.dataType).alias(f.name) for f in held.schema))
        commits.append(_save(spark, folder, table, empty, key))
    return commits


def read_sessions(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}").filter(~F.col(DELETED)).drop(DELETED, PARTITION)


def sessions_of(spark: SparkSession, folder: str, table: str, sessions: list[str]) -> DataFrame:
    """The rows of a few sessions; only their partitions are read."""
    return spark.read.parquet(f"{folder}/{table}").filter(F.col(PARTITION).isin(sessions) & ~F.col(DELETED)).drop(DELETED, PARTITION)


def upsert_sessions(spark: SparkSession, folder: str, table: str, changes: DataFrame, keys: list[str], order: str, key: str = "session_id") -> str:
    """Changes by key, merged with the rows of their sessions alone; null cells keep what is there, the last change of a key by ``order`` counts."""
    touched = changes.select(key).distinct()
    held = read_sessions(spark, folder, table).join(touched, key, "left_semi")
    return save_sessions(spark, folder, table, upsert(held, changes, keys, order), key)


def recover(spark: SparkSession, folder: str) -> int:
    """Finish writes that were staged and not done, in their order; returns their number."""
    lines = log_lines(spark, folder)
    done = lines.filter("state = 'done'").select("commit")
    open_ones = lines.filter("state = 'staged'").join(done, "commit", "left_anti").orderBy("at").collect()  # one after a crash, since each write begins here
    for r in open_ones:
        _apply(spark, folder, r.table_name, r.staged)
        _log(spark, folder, r.commit, r.table_name, r.staged, "done")
    return len(open_ones)
