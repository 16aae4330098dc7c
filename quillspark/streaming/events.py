"""Pipeline events: status of each stage, replay without doubles, and session activity, in batch and as streams.

An event has session_id, event_id, ts, stage, status, message and elapsed.
Stream versions keep state by key under a watermark; batch versions answer the
same from a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STAGES = 7


def stage_status(events: DataFrame) -> DataFrame:
    """Latest status of each session's stages, with the last elapsed time and message that weren't null."""
    order = F.struct("ts", "event_id")
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c)
    return events.filter(F.col("stage") > 0).groupBy("session_id", "stage").agg(F.max_by("status", order).alias("status"), last("elapsed"), last("message"), F.count_if(F.col("status") == "needs_input").alias("interventions"))


def session_state(events: DataFrame) -> DataFrame:
    """Whether each session has ended, and how: complete, error of the whole run, or running."""
    ended = F.max(F.col("status") == "pipeline_complete")
    failed = F.max((F.col("status") == "error") & (F.coalesce("stage", F.lit(0)) == 0))
    return events.groupBy("session_id").agg(F.when(ended, "complete").when(failed, "error").otherwise("running").alias("state"), F.max("ts").alias("last_ts"))


def without_doubles(events: DataFrame, watermark: str | None = None) -> DataFrame:
    """Events once each, by id; a replayed event may come again within the watermark of a stream."""
    if watermark:
        return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])


def activity(events: DataFrame, gap: str = "30 minutes", watermark: str | None = None) -> DataFrame:
    """Bursts of a session's events that are no more than ``gap`` apart."""
    events = events.withWatermark("ts", watermark) if watermark else events
    return events.groupBy("session_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("session_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def to_rows(events: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with their nested columns as JSON text, for storage: events, references, claims, verifications."""
    return events.withColumns({c: F.to_json(c) for c in columns})


def from_rows(rows: DataFrame, schemas: dict[str, str]) -> DataFrame:
    """The inverse of ``to_rows``."""
    return rows.withColumns({c: F.from_json(c, s) for c, s in schemas.items()})


def append_stream(events: DataFrame, path: str, checkpoint: str):
    """Write a stream of events to a table, each once, until the input is used up."""
    return events.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
