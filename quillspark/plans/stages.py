"""Runs in stages that can be resumed, with counts of what went in and out of each.

A stage's rows are written to a folder of their own under the run's folder, and
then a line to the run's manifest: the stage's fingerprint, the folder, schema and
number of rows, and its counts. The manifest line is written last, so that a run
that ends in the middle of a stage leaves no line for it. A later run takes a
stage from its folder if there is a line with its fingerprint whose table has
the schema and rows that the line says. The fingerprint is made of the stage's
name and version, of the fingerprints of what it reads, and for the inputs of
their rows. So a changed input or stage, and all that follows, is made again.

Counts of stages are observed while their rows are written; they cost no scan of their own.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

MANIFEST = "stage string, fingerprint string, path string, schema string, rows long, rows_in long, counts map<string,long>, written_at timestamp"


@dataclass(frozen=True)
class Stage:
    """A step of a run: ``make`` gets the tables named in ``reads`` and gives a DataFrame.

    ``version`` is to be changed with what the step does. ``counts`` are conditions, as SQL or
    columns, whose rows are counted.
    """

    name: str
    reads: tuple[str, ...]
    make: Callable[..., DataFrame]
    version: str = "1"
    counts: dict[str, str | Column] = field(default_factory=dict)


def rows_fingerprint(df: DataFrame) -> tuple[str, int]:
    """Of a table's schema and rows in any order (their number, and a sum and an exclusive or of their hashes), and their number."""
    cells = [f"`{c.replace('`', '``')}`" for c in df.columns]
    cells = [F.to_json(F.struct(c)) if _has_map(df.schema[i].dataType) else F.col(c) for i, c in enumerate(cells)]
    row = df.select(F.xxhash64(*cells).alias("h"), F.xxhash64(F.lit(1), *cells).alias("g")).agg(F.count(F.lit(1)), F.sum(F.col("h").cast("decimal(38,0)")), F.bit_xor("g")).first()
    return hashlib.sha256(f"{df.schema.json()}|{tuple(row)}".encode()).hexdigest(), row[0]


def _has_map(kind) -> bool:
    return "map<" in kind.simpleString()


def stage_fingerprint(stage: Stage, of: dict[str, str]) -> str:
    parts = [stage.name, stage.version, *(f"{n}={of[n]}" for n in stage.reads), *sorted(stage.counts)]
    return hashlib.sha256("|".join(parts).encode()).hexdigest()


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of a run's folder; none if nothing has been written yet."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def _still_good(spark: SparkSession, line) -> DataFrame | None:
    """The table of a manifest line, or None if it isn't there as the line says."""
    try:
        table = spark.read.parquet(line.path)
    except AnalysisException:
        return None
    return table if table.schema.simpleString() == line.schema and table.count() == line.rows else None


def run_stages(spark: SparkSession, folder: str, inputs: dict[str, DataFrame], stages: list[Stage]) -> dict[str, DataFrame]:
    """The tables of all stages by name. ``folder`` is one that all executors share; the same folder resumes a run."""
    tables, found_of = dict(inputs), {name: rows_fingerprint(df) for name, df in inputs.items()}
    of, rows_of = {name: f for name, (f, _) in found_of.items()}, {name: n for name, (_, n) in found_of.items()}
    lines: dict[tuple[str, str], list] = {}
    for r in read_manifest(spark, folder).orderBy("written_at").collect():
        lines.setdefault((r.stage, r.fingerprint), []).append(r)
    for stage in stages:
        of[stage.name] = fingerprint = stage_fingerprint(stage, of)
        found = next(((t, r) for r in reversed(lines.get((stage.name, fingerprint), [])) if (t := _still_good(spark, r)) is not None), None)
        if found is None:
            found = _write(spark, folder, stage, fingerprint, [tables[n] for n in stage.reads], rows_of.get(stage.reads[0]) if stage.reads else None)
        tables[stage.name], rows_of[stage.name] = found[0], found[1].rows
    return {s.name: tables[s.name] for s in stages}


def _write(spark: SparkSession, folder: str, stage: Stage, fingerprint: str, tables: list[DataFrame], rows_in: int | None):
    path = f"{folder}/{stage.name}/{uuid.uuid4().hex}"
    written = Observation()
    made = stage.make(*tables)
    counts = [F.count_if(F.expr(condition) if isinstance(condition, str) else condition).alias(name) for name, condition in stage.counts.items()]
    made.observe(written, F.count(F.lit(1)).alias("_rows"), *counts).write.parquet(path)
    table, seen = spark.read.parquet(path), written.get
    values = {k: int(v) for k, v in seen.items() if k != "_rows"}
    line = (stage.name, fingerprint, path, table.schema.simpleString(), int(seen["_rows"]), rows_in, values)
    row = spark.createDataFrame([line], "stage string, fingerprint string, path string, schema string, rows long, rows_in long, counts map<string,long>")
    row.withColumn("written_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
    return table, row.first()


def stage_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """(stage, rows_in, rows, name, n, percent): the counts of each stage's latest line, and their share of its rows."""
    lines = read_manifest(spark, folder)
    latest = lines.groupBy("stage").agg(F.max_by(F.struct("rows_in", "rows", "counts"), "written_at").alias("l")).select("stage", "l.*")
    named = latest.select("stage", "rows_in", "rows", F.explode_outer("counts").alias("name", "n"))
    return named.withColumn("percent", F.round(100.0 * F.col("n") / F.nullif(F.col("rows"), F.lit(0)), 1))
