"""The state of each session's stages, kept as events come in.

A session's state holds, for each stage, the latest status, the latest elapsed time
and message that weren't null, each with its time and id, and how often input was
needed. Events may come in any order, and more than once: an id that was counted
before changes nothing. Events later than the watermark are left out. A session
that has not ended and says nothing for the given time of the watermark's clock
becomes stalled; an event wakes it again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RUNNING, STALLED, COMPLETE, FAILED = "running", "stalled", "complete", "error"
ROWS = "session_id string, version long, state string, stage int, status string, elapsed double, message string, interventions long"


def _later(old: list | None, at: list, value) -> list | None:
    """[time, id, value] of the later of two; null values never count."""
    return old if value is None or (old is not None and old[:2] >= at) else [*at, value]


def _fold(known: dict, events: pd.DataFrame) -> None:
    for e in events.itertuples():
        at = [int(e.ts.value) // 1000, int(e.event_id)]
        if known["last"] is None or at[0] > known["last"]:
            known["last"] = at[0]
        stage = None if pd.isna(e.stage) else int(e.stage)
        if e.status == "pipeline_complete":
            known["complete"] = True
        if e.status == "error" and not stage:
            known["failed"] = True
        if stage is not None and stage > 0:
            own = known["stages"].setdefault(str(stage), {"status": None, "elapsed": None, "message": None, "asked": {}})
            own["status"] = _later(own["status"], at, e.status)
            own["elapsed"] = _later(own["elapsed"], at, None if pd.isna(e.elapsed) else float(e.elapsed))
            own["message"] = _later(own["message"], at, None if pd.isna(e.message) else e.message)
            if e.status == "needs_input":
                own["asked"][str(at[1])] = True


def _rows(key: tuple, known: dict, state: str) -> pd.DataFrame:
    value = lambda x: None if x is None else x[2]
    stages = sorted(known["stages"].items(), key=lambda x: int(x[0])) or [(None, {"status": None, "elapsed": None, "message": None, "asked": {}})]
    return pd.DataFrame(
        {
            "session_id": pd.Series([key[0]] * len(stages), dtype="object"),
            "version": pd.Series([known["version"]] * len(stages), dtype="int64"),
            "state": state,
            "stage": pd.Series([None if s is None else int(s) for s, _ in stages], dtype="Int32"),
            "status": pd.Series([value(x["status"]) for _, x in stages], dtype="object"),
            "elapsed": pd.Series([value(x["elapsed"]) for _, x in stages], dtype="float64"),
            "message": pd.Series([value(x["message"]) for _, x in stages], dtype="object"),
            "interventions": pd.Series([len(x["asked"]) for _, x in stages], dtype="int64"),
        }
    )


def stage_states(events: DataFrame, watermark: str = "1 hour", silent_ms: int = 30 * 60 * 1000) -> DataFrame:
    """Rows (``ROWS``) of a session's stages whenever something changes; the largest ``version`` of a session is its present state.

    ``events``: session_id, event_id, ts, stage, status, elapsed, message, as a stream.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = json.loads(state.get[0]) if state.exists else {"version": 0, "last": None, "complete": False, "failed": False, "stages": {}}
        if not state.hasTimedOut:
            for events in batches:
                _fold(known, events)
        known["version"] += 1
        ended = COMPLETE if known["complete"] else FAILED if known["failed"] else None
        state.update((json.dumps(known),))
        if ended is None and not state.hasTimedOut:
            state.setTimeoutTimestamp(max(known["last"] // 1000, state.getCurrentWatermarkMs()) + silent_ms)
        yield _rows(key, known, ended or (STALLED if state.hasTimedOut else RUNNING))

    some = events.select("session_id", "event_id", "ts", F.col("stage").cast("int").alias("stage"), "status", F.col("elapsed").cast("double").alias("elapsed"), "message")
    return some.withWatermark("ts", watermark).groupBy("session_id").applyInPandasWithState(update, ROWS, "known string", "update", GroupStateTimeout.EventTimeTimeout)


def present(states: DataFrame) -> DataFrame:
    """The present rows of each session, from all rows that a stream has given."""
    latest = states.groupBy("session_id").agg(F.max("version").alias("version"))
    return states.join(latest, ["session_id", "version"]).drop("version")


def write_states(states: DataFrame, folder: str, checkpoint: str):
    """Write what the stream gives to Parquet under ``folder``, a folder for each batch, so that a batch that is done again replaces its rows."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return states.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()
