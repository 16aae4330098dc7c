"""Manuscripts end to end: paragraphs to verified, counted and flagged claims, as one chain of DataFrames."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import citations, mapping, records, results, scopes
from quillspark.operators.claims import units_to_claims
from quillspark.operators.lineage import settle, shared_folder, stored
from quillspark.operators.references import parse_references
from quillspark.operators.sections import flatten_paragraphs
from quillspark.plans.citations import paragraphs
from quillspark.plans.stages import Stage, run_stages, stage_metrics
from quillspark.plans.stand_ins import REFERENCES, for_duckdb, load, stand_in
from quillspark.sources import docx


def verification_units(text: DataFrame, references: DataFrame) -> DataFrame:
    """Units to verify of all sessions: detected, mapped and scoped citations with reference, type and priority."""
    found = citations.detect_citations(text, citations.detect_style(text), with_spans=True)
    cited = citations.numbered(citations.with_sentence(citations.first_wins(found)))
    # the cascade reads the citations many times
    keyed = stored(scopes.resolve_scopes(cited).withColumn("cit_key", F.concat_ws(":", "session_id", F.col("cit_id").cast("string"))))
    mapped = mapping.map_citations(keyed, references)
    return mapping.with_reference(keyed, mapped, references)


def found_citations(text: DataFrame) -> DataFrame:
    """Citations with their sentences, numbered within each session."""
    found = citations.detect_citations(text, citations.detect_style(text), with_spans=True)
    return citations.numbered(citations.with_sentence(citations.first_wins(found)))


def scoped_units(cited: DataFrame) -> DataFrame:
    return scopes.resolve_scopes(cited).withColumn("cit_key", F.concat_ws(":", "session_id", F.col("cit_id").cast("string")))


#: The chain from paragraphs and references to claims and their coverage, for ``stages.run_stages``.
STAGES = [
    Stage("citations", ("paragraphs",), found_citations, counts={"by_number": "number IS NOT NULL"}),
    Stage("units", ("citations",), scoped_units, counts={p: f"priority = '{p}'" for p in results.PRIORITY}),
    Stage("mapped", ("units", "references"), mapping.map_citations, counts={"unresolved": "method = 'unresolved'"}),
    Stage("verification", ("units", "mapped", "references"), mapping.with_reference, counts={"without_reference": "ref_num = 0"}),
    Stage("claims", ("verification",), units_to_claims),
    Stage("coverage", ("verification",), lambda units: coverage(units)),
]


def claims_of_files(files: DataFrame) -> DataFrame:
    """Claims of DOCX files (path, content): sections, paragraphs, citations, scopes, and references by number or name."""
    found = settle(docx.paragraphs(files))
    parts = settle(docx.sections(found))
    raw = docx.raw_references(found, parts)
    refs = parse_references(raw).select("session_id", F.col("ref_id").cast("long").alias("ref_num"), "authors", "title", "year")
    return units_to_claims(verification_units(flatten_paragraphs(parts), settle(refs)))


def coverage(units: DataFrame) -> DataFrame:
    """Per session: units, how many have a reference, and how many of each priority."""
    return units.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("units"), F.count_if(F.col("ref_num") > 0).alias("mapped"), *(F.count_if(F.col("priority") == p).alias(p) for p in results.PRIORITY)
    )


def p01_manuscripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = stand_in(spark, sf_dir, REFERENCES).select("session_id", "ref_num", "year", "title", F.array(F.concat(F.lit("A. "), "surname"), F.lit("Green, B.")).alias("authors"))
    return coverage(verification_units(paragraphs(spark, sf_dir), refs))


def staged(spark: SparkSession, sf_dir: str, folder: str) -> dict[str, DataFrame]:
    refs = stand_in(spark, sf_dir, REFERENCES).select("session_id", "ref_num", "year", "title", F.array(F.concat(F.lit("A. "), "surname"), F.lit("Green, B.")).alias("authors"))
    return run_stages(spark, folder, {"paragraphs": paragraphs(spark, sf_dir), "references": refs}, STAGES)


def p02_staged_manuscripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as p01, each stage written and read again."""
    return staged(spark, sf_dir, f"{shared_folder(spark)}/manuscripts-{uuid.uuid4().hex}")["coverage"]


def p03_stage_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run in stages has counted."""
    folder = f"{shared_folder(spark)}/manuscripts-{uuid.uuid4().hex}"
    staged(spark, sf_dir, folder)
    return stage_metrics(spark, folder)


def a12_clean_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.when(F.col("p_partkey") % 2 == 0, "Abstract: ").otherwise(""), F.when(F.col("p_partkey") % 3 == 0, "12 34").otherwise(F.concat_ws(" ", "p_name", "p_type")), F.when(F.col("p_partkey") % 5 == 0, " https://x.org/y").otherwise(""))
    return load(spark, sf_dir, "part").select("p_partkey", records.clean_title(text).alias("title"))


def a13_file_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/lib/Kim"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("-"), (2000 + F.col("p_size")).cast("string"), F.lit("-"))).otherwise("_x_"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".pdf"))
    return load(spark, sf_dir, "part").select("p_partkey", records.file_title(path).alias("title"))


def a19_work_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = stand_in(spark, sf_dir, REFERENCES)
    answer = F.to_json(F.struct(F.when(F.col("p_partkey") % 9 > 0, F.array("title")).alias("title"), F.col("doi").alias("DOI"), F.array(F.lit("J Test")).alias("container-title"), F.struct(F.array(F.array(F.col("year").cast("int"), F.lit(5))).alias("date-parts")).alias("published")))
    return refs.select("p_partkey", records.crossref_work(answer).alias("r")).select("p_partkey", "r.title", "r.year", "r.doi", "r.journal", "r.found")


def i12_pubmed_retractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("Retracted Publication", "Published Erratum", "Expression of Concern", "Journal Article")))
    xml = F.concat(F.lit("<PublicationType>"), F.get(kinds, (F.col("p_partkey") % 4).cast("int")), F.lit("</PublicationType>"))
    return load(spark, sf_dir, "part").select("p_partkey", records.pubmed_retraction(xml).alias("status"))


def k23_distinct_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.array(F.upper("p_type"), F.col("p_brand"))
    return load(spark, sf_dir, "part").select("p_partkey", F.array_join(records.distinct_quotes(first, F.array(F.lower("p_type"), F.col("p_name"))), "|").alias("quotes"))


def l31_fill_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = load(spark, sf_dir, "supplier").agg(F.max("s_suppkey")).scalar()
    models = load(spark, sf_dir, "supplier").select(F.col("s_name").alias("model"), F.when(F.col("s_suppkey") < last, 0).otherwise(3).alias("tier"), F.col("s_suppkey").alias("ord"))
    return records.fill_tiers(models)


QUERIES = {f.__name__: f for f in (p01_manuscripts, p02_staged_manuscripts, p03_stage_metrics, a12_clean_titles, a13_file_titles, a19_work_records, i12_pubmed_retractions, k23_distinct_quotes, l31_fill_tiers)}
_REF = for_duckdb(REFERENCES)
ORACLE = {
    "a12_clean_titles": """WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '12 34' ELSE p_name || ' ' || p_type END AS t FROM part)
      SELECT p_partkey, CASE WHEN length(t) < 10 THEN '' ELSE t END AS title FROM t""",
    "a13_file_titles": """WITH t AS (SELECT p_partkey, replace(p_name, ' ', '_') AS n, 'Kim' || CASE WHEN p_partkey % 2 = 0 THEN '-' || (2000 + p_size) || '-' ELSE '_x_' END AS k FROM part)
      SELECT p_partkey, translate(CASE WHEN p_partkey % 2 = 0 AND length(n) > 10 THEN n ELSE k || n END, '_-', '  ') AS title FROM t""",
    "a19_work_records": f"SELECT p_partkey, CASE WHEN p_partkey % 9 > 0 THEN title ELSE '' END AS title, year, doi, 'J Test' AS journal, p_partkey % 9 > 0 AS found FROM ({_REF})",
    "i12_pubmed_retractions": "SELECT p_partkey, ['retracted', 'corrected', 'expression_of_concern', 'ok'][p_partkey % 4 + 1] AS status FROM part",
    "k23_distinct_quotes": "SELECT p_partkey, upper(p_type) || '|' || p_brand || '|' || p_name AS quotes FROM part",
    "l31_fill_tiers": """WITH m AS (SELECT s_name AS model, row_number() OVER (ORDER BY s_suppkey) - 1 AS o, s_suppkey = (SELECT max(s_suppkey) FROM supplier) AS is_last FROM supplier)
      SELECT 0 AS tier, o AS nth, model FROM m WHERE NOT is_last UNION ALL SELECT 1, o, model FROM m WHERE o < 2 UNION ALL SELECT 2, 0, model FROM m WHERE o = 0 UNION ALL SELECT 3, 0, model FROM m WHERE is_last""",
}
