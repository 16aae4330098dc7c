"""Queries of override histories, citation coverage, ambiguous citations, and spans held apart."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import coverage as V
from quillspark.operators import results as R
from quillspark.operators.intervals import interval_join
from quillspark.operators.matching import SEVERITY, retraction_report
from quillspark.plans.results import CHANGES, CHANGES_AGAIN, CLAIMS, VERIFICATIONS
from quillspark.plans.stand_ins import PARAGRAPHS, REFERENCES, for_duckdb, load, stand_in

#: Both batches of changes, with reasons and times.
DATED = f"""
SELECT claim_id, new_verdict, 'first look' AS reason, 100 + CAST(claim_id % 7 AS BIGINT) AS changed_at FROM ({CHANGES}) a
UNION ALL SELECT claim_id, new_verdict, 'second look' AS reason, 200 + CAST(claim_id % 7 AS BIGINT) AS changed_at FROM ({CHANGES_AGAIN}) b"""
#: Citations by number: some of numbers that no list has, some of none.
CITED = """
SELECT concat('s', CAST(l_orderkey % 50 AS STRING)) AS session_id, CASE CAST(l_linenumber % 4 AS INT) WHEN 0 THEN 'Introduction' WHEN 1 THEN 'Methods' WHEN 2 THEN 'Results' ELSE 'Discussion' END AS section,
  CASE WHEN l_suppkey % 9 = 0 THEN NULL WHEN l_suppkey % 11 = 0 THEN 0 ELSE 1 + l_partkey % 60 END AS ref_num FROM {lineitem}"""
#: References of few authors and years, so that several have the same, and citations of them with and without letters.
NAMESAKES = "SELECT session_id, ref_num, surname, 2000 + CAST(year % 5 AS INT) AS year FROM (REFERENCES) r".replace("REFERENCES", REFERENCES)
NAMED = """
SELECT o_orderkey AS cit_key, concat('s', CAST(o_custkey % 50 AS STRING)) AS session_id,
  CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN 'Ring' WHEN 1 THEN 'Gear' WHEN 2 THEN 'Bolt' WHEN 3 THEN 'Plate' ELSE 'Nobody' END AS surname,
  concat(CAST(1999 + o_orderkey % 7 AS STRING), CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN '' WHEN 1 THEN 'a' WHEN 2 THEN 'b' ELSE 'j' END) AS year FROM {orders}"""


def verifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stand_in(spark, sf_dir, VERIFICATIONS)


def m82_override_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.override_history(verifications(spark, sf_dir), stand_in(spark, sf_dir, DATED), "row_id")


def m83_verdicts_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a report of the time between the batches said."""
    history = R.override_history(verifications(spark, sf_dir), stand_in(spark, sf_dir, DATED), "row_id")
    return R.verdicts_at(history, F.lit(103)).select("claim_id", "row_id", "version", "verdict")


def c60_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.reconcile(stand_in(spark, sf_dir, CITED), stand_in(spark, sf_dir, REFERENCES))


def c61_citation_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.citation_coverage(stand_in(spark, sf_dir, CITED), stand_in(spark, sf_dir, REFERENCES))


def c62_reference_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.reference_coverage(stand_in(spark, sf_dir, CITED), stand_in(spark, sf_dir, REFERENCES))


def e30_suffix_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = stand_in(spark, sf_dir, NAMESAKES).select("session_id", "ref_num", F.array("surname").alias("authors"), "year")
    return V.candidates(stand_in(spark, sf_dir, NAMED).select("cit_key", "session_id", F.array("surname").alias("authors"), "year"), listed)


def spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(windows, markers) of all paragraphs: windows of 40 characters, one over the whole, and bracketed markers."""
    text = stand_in(spark, sf_dir, PARAGRAPHS).select("para_idx", "text")
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.length("text") / 40)), lambda i: F.struct((i * 40).alias("start"), F.least((i + 1) * 40, F.length("text").cast("long")).alias("end")))
    whole = F.struct(F.lit(0).cast("long").alias("start"), F.length("text").cast("long").alias("end"))
    windows = text.select("para_idx", F.explode(F.concat(pieces, F.array(whole))).alias("s")).select("para_idx", "s.start", "s.end")
    marker = F.regexp_extract("text", r"\[[^\]]*\]", 0)
    markers = text.withColumn("m", marker).filter("m <> ''").select("para_idx", (F.instr("text", F.col("m")) - 1).alias("start"), (F.instr("text", F.col("m")) - 1 + F.length("m")).alias("end"))
    return windows, markers


def d25_markers_in_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interval_join(*spans(spark, sf_dir), ["para_idx"], "starts_in", width=8)


def u03_overlapping_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interval_join(*spans(spark, sf_dir), ["para_idx"], width=8)


def m05_sorted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of 20 in every order."""
    rows, claimed = verifications(spark, sf_dir), stand_in(spark, sf_dir, CLAIMS)
    pages = [R.result_page(rows, claimed, "row_id", sort=s, number=2, per_page=20, min_confidence=0.6).select(F.lit(s).alias("sort"), "row_id", "verdict", "confidence", "priority", "reference_id") for s in ("verdict", "confidence", "priority", "ref_id")]
    return reduce(DataFrame.unionByName, pages)


def i07_retraction_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = stand_in(spark, sf_dir, REFERENCES).select(F.col("p_partkey").alias("ref_key"), F.when(F.col("p_partkey") % 3 > 0, F.col("doi")).alias("doi"), F.when(F.col("p_partkey") % 5 == 0, "77").alias("pmid"))
    grades = F.array(*map(F.lit, SEVERITY))
    notices = load(spark, sf_dir, "lineitem").filter("l_linenumber <= 2").groupBy(F.col("l_partkey").alias("ref_key"), F.col("l_linenumber").alias("service_ord")).agg(F.max(F.col("l_suppkey") % 5).cast("int").alias("g"))
    return retraction_report(refs, notices.select("ref_key", "service_ord", F.get(grades, F.col("g")).alias("status"), F.concat(F.lit("by "), F.col("service_ord").cast("string")).alias("detail")))


_SPANS = f"""t AS (SELECT para_idx, text, regexp_extract(text, '\\[[^\\]]*\\]') AS m FROM ({for_duckdb(PARAGRAPHS)})),
  w AS (SELECT para_idx, unnest(range(0, length(text) // 40 + 1)) * 40 AS s, length(text) AS n FROM t),
  l AS (SELECT para_idx, s AS l_start, greatest(least(s + 40, n), s + 1) AS l_end FROM w UNION ALL SELECT para_idx, 0, length(text) FROM t),
  r AS (SELECT para_idx, instr(text, m) - 1 AS r_start, instr(text, m) - 1 + length(m) AS r_end FROM t WHERE m <> '')"""
_HISTORY = f"""v AS ({for_duckdb(VERIFICATIONS)}), ch AS ({for_duckdb(DATED)}),
  one AS (SELECT claim_id, min(row_id) AS row_id FROM v GROUP BY claim_id),
  a AS (SELECT claim_id, row_id, verdict, NULL::VARCHAR AS reason, NULL::BIGINT AS valid_from FROM v
    UNION ALL SELECT claim_id, row_id, new_verdict, reason, changed_at FROM ch JOIN one USING (claim_id)),
  h AS (SELECT claim_id, row_id, row_number() OVER w - 1 AS version, verdict, reason, valid_from, lead(valid_from) OVER w AS valid_to FROM a WINDOW w AS (PARTITION BY claim_id, row_id ORDER BY valid_from NULLS FIRST, verdict, reason))"""
_BOTH = f"""c AS (SELECT session_id, section, nullif(ref_num, 0) AS ref_num FROM ({for_duckdb(CITED)})), f AS (SELECT session_id, ref_num FROM ({for_duckdb(REFERENCES)})),
  n AS (SELECT session_id, ref_num, count(*) AS n FROM c GROUP BY ALL)"""
_STATE = "s AS (SELECT session_id, f.ref_num, CASE WHEN n IS NULL THEN 'never_cited' ELSE 'cited' END AS state, coalesce(n, 0) AS n FROM f LEFT JOIN n USING (session_id, ref_num) UNION ALL SELECT session_id, ref_num, 'unresolved', n FROM n WHERE (session_id, coalesce(ref_num, -1)) NOT IN (SELECT session_id, ref_num FROM f))"

QUERIES = {f.__name__: f for f in (m82_override_history, m83_verdicts_at, c60_reconciliation, c61_citation_coverage, c62_reference_coverage, e30_suffix_candidates, m05_sorted_pages, i07_retraction_report, d25_markers_in_windows, u03_overlapping_spans)}
ORACLE = {
    "m82_override_history": f"WITH {_HISTORY} SELECT * FROM h",
    "m83_verdicts_at": f"WITH {_HISTORY} SELECT claim_id, row_id, version, verdict FROM h WHERE coalesce(valid_from, 0) <= 103 AND coalesce(valid_to, 104) > 103",
    "c60_reconciliation": f"WITH {_BOTH}, {_STATE} SELECT session_id, ref_num, state, n AS citations FROM s",
    "c61_citation_coverage": f"""WITH {_BOTH}, k AS (SELECT c.*, f.ref_num AS known FROM c LEFT JOIN f ON f.session_id = c.session_id AND f.ref_num = c.ref_num)
      SELECT session_id, section, grouping(session_id, section)::INT AS level, count(*) AS total, count(known) AS mapped, count(*) - count(known) AS unresolved, round(100.0::DOUBLE * count(known) / count(*), 1) AS mapped_percent,
        count(DISTINCT CASE WHEN known IS NOT NULL THEN session_id || '/' || known END) AS cited_references FROM k GROUP BY ROLLUP (session_id, section)""",
    "c62_reference_coverage": f"""WITH {_BOTH}, {_STATE} SELECT session_id, count(*) FILTER (state <> 'unresolved') AS listed, count(*) FILTER (state = 'cited') AS cited, count(*) FILTER (state = 'never_cited') AS never_cited,
        coalesce(sum(n) FILTER (state = 'unresolved'), 0)::BIGINT AS unresolved_citations, round(100.0::DOUBLE * count(*) FILTER (state = 'cited') / nullif(count(*) FILTER (state <> 'unresolved'), 0), 1) AS cited_percent FROM s GROUP BY session_id""",
    "e30_suffix_candidates": f"""WITH f AS (SELECT *, row_number() OVER (PARTITION BY session_id, surname, year ORDER BY ref_num) AS place, count(*) OVER (PARTITION BY session_id, surname, year) AS n FROM ({for_duckdb(NAMESAKES)})),
      c AS (SELECT cit_key, session_id, surname, left(year, 4)::INT AS year, nullif(substr(year, 5), '') AS suffix FROM ({for_duckdb(NAMED)})),
      m AS (SELECT *, coalesce(ascii(suffix) - 96 <= n, false) AS by_letter FROM c JOIN f USING (session_id, surname, year))
      SELECT cit_key, ref_num, suffix, CASE WHEN by_letter THEN 1 ELSE n END AS n_candidates, NOT by_letter AND n > 1 AS is_ambiguous FROM m WHERE NOT by_letter OR place = ascii(suffix) - 96""",
    "m05_sorted_pages": f"""WITH v AS ({for_duckdb(VERIFICATIONS)}), j AS (SELECT row_id, verdict, confidence, coalesce(priority, '') AS priority, reference_id FROM v LEFT JOIN ({for_duckdb(CLAIMS)}) USING (claim_id) WHERE confidence >= 0.6),
      r AS (SELECT *, list_position({list(R.SEVERITY)}, verdict) AS sv, coalesce(list_position({list(R.PRIORITY)}, priority), 9) AS sp FROM j),
      k AS (SELECT *, row_number() OVER (ORDER BY sv, row_id) AS a, row_number() OVER (ORDER BY confidence DESC, row_id) AS b, row_number() OVER (ORDER BY sp, row_id) AS c, row_number() OVER (ORDER BY reference_id, row_id) AS d FROM r)
      SELECT sort, row_id, verdict, confidence, priority, reference_id FROM (SELECT *, unnest(['verdict', 'confidence', 'priority', 'ref_id']) AS sort, unnest([a, b, c, d]) AS nth FROM k) WHERE nth BETWEEN 21 AND 40""",
    "i07_retraction_report": f"""WITH f AS (SELECT p_partkey AS ref_key, p_partkey % 3 > 0 OR p_partkey % 5 = 0 AS has FROM ({for_duckdb(REFERENCES)})), n AS (SELECT l_partkey AS ref_key, l_linenumber AS o, max(l_suppkey % 5) AS g FROM lineitem WHERE l_linenumber <= 2 GROUP BY ALL),
      w AS (SELECT ref_key, {list(SEVERITY)} AS names, min(g) AS g, arg_min(o, g * 10 + o) AS o FROM n GROUP BY ref_key)
      SELECT ref_key, CASE WHEN NOT has THEN 'unknown' WHEN g IS NULL THEN 'ok' ELSE names[g + 1] END AS status, CASE WHEN NOT has THEN 'No DOI or PMID available' WHEN g IS NULL THEN 'No retraction info found' ELSE 'by ' || o END AS detail FROM f LEFT JOIN w USING (ref_key)""",
    "d25_markers_in_windows": f"WITH {_SPANS} SELECT * FROM l JOIN r USING (para_idx) WHERE r_start >= l_start AND r_start < l_end",
    "u03_overlapping_spans": f"WITH {_SPANS} SELECT * FROM l JOIN r USING (para_idx) WHERE r_start < l_end AND l_start < r_end",
}
