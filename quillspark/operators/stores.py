"""Keyed tables as DataFrame transformations: replace, upsert, cascading delete, caches and the source library.

Each returns the new table; writing it is the caller's, as a dynamic partition
overwrite where the table is partitioned by session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def replace_sessions(table: DataFrame, new: DataFrame, key: str = "session_id") -> DataFrame:
    """All rows of the sessions in ``new`` are replaced by its rows."""
    return table.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows by key; of a key's changes the last by ``order`` wins over the table's row, and null cells keep the old value."""
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order))) == 1
    new = changes.withColumn("_last", last).filter("_last").drop("_last", order)
    rest = [c for c in table.columns if c not in keys]
    joined = table.alias("t").join(new.alias("n"), keys, "full")
    return joined.select(*keys, *(F.coalesce(F.col(f"n.{c}"), F.col(f"t.{c}")).alias(c) if c in new.columns else F.col(f"t.{c}") for c in rest))


def delete_keys(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return table.join(keys.select(*on).distinct(), on, "left_anti")


def cascade_delete(tables: dict[str, DataFrame], sessions: DataFrame, key: str = "session_id") -> dict[str, DataFrame]:
    """Every table without the rows of the given sessions."""
    return {name: delete_keys(t, sessions, [key]) for name, t in tables.items()}


def update_sessions(table: DataFrame, changes: DataFrame, order: str, now: Column) -> DataFrame:
    """Session rows with the last change of each, stamped with ``now`` as updated_at; others keep theirs. Changes to unknown sessions are ignored."""
    known = changes.join(table.select("session_id"), "session_id", "left_semi")
    stamped = known.drop("updated_at").withColumn("updated_at", now)
    return upsert(table, stamped, ["session_id"], order)


def cache_key(prefix: str, data: Column) -> Column:
    """prefix and the first 16 hex digits of SHA-256."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(data.cast("binary"), 256), 1, 16))


def cache_get(requests: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """Requests (key) with the cached value; an expired entry is a miss."""
    live = cache.filter(F.col("expires_at") > now)
    return requests.join(live.select("key", "value"), "key", "left").withColumn("hit", F.col("value").isNotNull())


def cache_put(cache: DataFrame, entries: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """The cache with ``entries`` (cache, key, value) that live for so long; an entry of the same key is replaced."""
    new = entries.groupBy("cache", "key").agg(F.max("value").alias("value")).withColumn("expires_at", now + F.make_dt_interval(secs=F.lit(ttl_seconds)))
    return cache.join(new.select("cache", "key"), ["cache", "key"], "left_anti").unionByName(new)


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.groupBy("cache").agg(F.count(F.lit(1)).alias("entries"), F.sum(F.octet_length("value")).alias("bytes"))


def library_key(doi: Column, title: Column, ref_id: Column) -> Column:
    """Key of a source: of its DOI, else of its title, else its number."""
    some = lambda c: c.isNotNull() & (F.trim(c) != "")
    return F.when(some(doi), cache_key("doi", F.lower(F.trim(doi)))).when(some(title), cache_key("title", F.lower(F.trim(title)))).otherwise(F.concat(F.lit("ref_"), ref_id.cast("string")))


def enrich_from_library(references: DataFrame, library: DataFrame) -> DataFrame:
    """References without a source get the library's path of their key."""
    return references.join(library.select("lib_key", "path"), "lib_key", "left").withColumn("pdf_path", F.coalesce("pdf_path", "path")).drop("path")


def populate_library(library: DataFrame, references: DataFrame) -> DataFrame:
    """New library rows: sources whose keys the library lacks, the first of each key."""
    new = references.filter(F.col("pdf_path").isNotNull()).join(library.select("lib_key"), "lib_key", "left_anti")
    return new.groupBy("lib_key").agg(F.min("pdf_path").alias("path"))


def library_stats(library: DataFrame) -> DataFrame:
    return library.agg(F.count(F.lit(1)).alias("n_files"), F.round(F.sum("bytes") / 1048576, 1).alias("total_mb"))


def add_columns(table: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Additive migration: nullable columns that the table lacks."""
    return table.withColumns({c: F.lit(None).cast(kind) for c, kind in columns.items() if c not in table.columns})
