"""Queries of matching, gap resolution, evidence, claims and event operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import json as J
from quillspark.functions import text as T
from quillspark.functions.fold import nfc
from quillspark.operators import claims as CL
from quillspark.operators import evidence as E
from quillspark.operators import matching as M
from quillspark.operators.lineage import shared_folder
from quillspark.plans.stand_ins import REFERENCES, VOTES, for_duckdb, load, stand_in
from quillspark.streaming import events as S
from quillspark.streaming import sessions as SS

#: Sources to match: parts again, some with a reference's DOI, all with a title that is nearly one.
PDFS = """
SELECT concat('s', CAST(p_partkey % 50 AS STRING)) AS session_id, CAST(floor(p_partkey / 50) AS BIGINT) AS pdf_ord,
  CASE WHEN p_partkey % 2 = 0 THEN concat('https://doi.org/10.', CAST(1000 + p_partkey % 97 AS STRING), '/', upper(replace(p_brand, '#', '.')), '.', CAST(p_partkey AS STRING), '.') END AS doi,
  concat(split_part(p_name, ' ', 2), ' ', split_part(p_name, ' ', 1), ' ', lower(p_type), ' ', lower(replace(p_brand, '#', ' '))) AS title FROM {part}"""
#: Sources of the whole cascade: some with DOIs that no reference has, some of them with titles that say nothing.
SCANS = """
SELECT concat('s', CAST(p_partkey % 50 AS STRING)) AS session_id, CAST(floor(p_partkey / 50) AS BIGINT) AS pdf_ord,
  CASE CAST(p_partkey % 6 AS INT) WHEN 0 THEN concat('10.', CAST(1000 + p_partkey % 97 AS STRING), '/', replace(p_brand, '#', '.'), '.', CAST(p_partkey AS STRING)) WHEN 1 THEN concat('10.9999/x', CAST(p_partkey AS STRING))
    WHEN 2 THEN concat('10.9999/y', CAST(p_partkey AS STRING)) END AS doi,
  CASE WHEN p_partkey % 6 = 1 THEN concat('scan ', CAST(p_partkey AS STRING)) ELSE concat(split_part(p_name, ' ', 2), ' ', split_part(p_name, ' ', 1), ' ', lower(p_type), ' ', lower(replace(p_brand, '#', ' '))) END AS title FROM {part}"""
#: Titles by DOI, as a service knows them.
KNOWN_TITLES = "SELECT concat('https://doi.org/10.9999/X', CAST(p_partkey AS STRING)) AS doi, concat(p_name, ' ', lower(p_type)) AS title FROM {part} WHERE p_partkey % 12 = 1"
#: Looked-up records from three services: one gives PMIDs, one DOIs and urls, one DOIs.
LOOKUPS = [
    ("first", "SELECT p_partkey AS ref_key, CASE p_partkey % 4 WHEN 0 THEN 'found' WHEN 1 THEN 'not_found' WHEN 2 THEN 'api_error' END AS status, CAST(NULL AS STRING) AS doi, CAST(1000000 + p_partkey AS STRING) AS pmid, CAST(NULL AS STRING) AS url FROM {part}"),
    ("second", "SELECT p_partkey AS ref_key, CASE p_partkey % 3 WHEN 0 THEN 'found' WHEN 1 THEN 'not_found' END AS status, CASE WHEN p_partkey % 2 = 0 THEN concat('10.2/b', CAST(p_partkey AS STRING)) END AS doi, CAST(NULL AS STRING) AS pmid, concat('https://x.org/', CAST(p_partkey AS STRING)) AS url FROM {part} WHERE p_size > 10"),
    ("third", "SELECT p_partkey AS ref_key, CASE WHEN p_partkey % 5 = 0 THEN 'found' WHEN p_partkey % 7 = 0 THEN 'api_error' ELSE 'not_found' END AS status, concat('10.3/c', CAST(p_partkey AS STRING)) AS doi, CAST(NULL AS STRING) AS pmid, CAST(NULL AS STRING) AS url FROM {part} WHERE p_size < 40"),
]
#: Every document is the source of a claim: a benchmark text, dealt out in turn.
CLAIMS = "SELECT d.doc_id AS claim_id, b.text AS claim_text, d.doc_id AS source_id FROM {documents} d JOIN (SELECT text, row_number() OVER (ORDER BY item_id) - 1 AS nth, count(*) OVER () AS n FROM {benchmark}) b ON b.nth = d.doc_id % b.n"
EVENTS = """
SELECT concat('u', CAST(user_id AS STRING)) AS session_id, event_id, ts, CAST(event_id % 8 AS INT) AS stage,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'needs_input' WHEN 'purchase' THEN 'complete' ELSE 'running' END AS status,
  CASE WHEN event_type <> 'view' THEN value END AS elapsed, CASE WHEN event_type = 'error' THEN props END AS message, props FROM {events}"""


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stand_in(spark, sf_dir, REFERENCES)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stand_in(spark, sf_dir, EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))


def h01_doi_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.match_by_doi(references(spark, sf_dir), stand_in(spark, sf_dir, PDFS))


def h02_title_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.classify(M.match_by_title(references(spark, sf_dir), stand_in(spark, sf_dir, PDFS)))


def h03_match_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.match_sources(references(spark, sf_dir), stand_in(spark, sf_dir, SCANS), stand_in(spark, sf_dir, KNOWN_TITLES))
    return found.select("session_id", "ref_num", "pdf_ord", "method", "confidence", "status", F.array_join("alternatives", ",").alias("alternatives"))


def h07_apply_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    pdfs = stand_in(spark, sf_dir, PDFS).withColumn("path", F.concat(F.lit("/src/"), F.col("pdf_ord").cast("string")))
    matches = M.match_by_doi(references(spark, sf_dir), pdfs).join(pdfs.select("session_id", "pdf_ord", "path"), ["session_id", "pdf_ord"])
    return M.apply_matches(references(spark, sf_dir), matches).select("session_id", "ref_num", "pdf_path")


def i01_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = references(spark, sf_dir).withColumns({"ref_key": F.col("p_partkey"), "doi": F.when(F.col("ref_num") % 2 == 0, F.col("doi")), "pmid": F.when(F.col("ref_num") % 5 == 0, F.lit("77"))})
    out = M.resolve_gaps(refs, [(name, stand_in(spark, sf_dir, sql)) for name, sql in LOOKUPS])
    return out.select("ref_key", "source_status", "resolved_by", "doi", "pmid", "journal_url", "pdf_path")


def i02_retraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    notices = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("ref_key"), F.get(F.array(*map(F.lit, M.SEVERITY)), (F.col("l_suppkey") % 5).cast("int")).alias("status"))
    return M.retraction_status(notices)


def i09_crossref_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("new_version", "Correction", "retraction", "expression_of_concern", "erratum")))
    rows = load(spark, sf_dir, "part").select("p_partkey", F.array(F.get(kinds, (F.col("p_partkey") % 5).cast("int")), F.get(kinds, (F.col("p_size") % 5).cast("int"))).alias("u"))
    return rows.select("p_partkey", M.crossref_update(F.col("u")).alias("status"))


def j01_filter_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("s"), (F.col("l_orderkey") % 50).cast("string")).alias("session_id"), F.col("l_orderkey").alias("claim_id")).agg(F.array_sort(F.collect_set(F.col("l_partkey") % 60)).alias("reference_ids"))
    return CL.keep_valid_references(lines, references(spark, sf_dir)).select("session_id", "claim_id", F.array_join(F.transform("reference_ids", lambda x: x.cast("string")), ",").alias("reference_ids"))


def j02_distinct_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("p_partkey") % 2 == 0
    text = F.split_part("p_name", F.lit(" "), F.lit(1))
    ids = F.when(even, F.array(F.col("p_size") % 3, F.lit(7))).otherwise(F.array(F.lit(7), F.col("p_size") % 3))
    rows = load(spark, sf_dir, "part").select(F.concat(F.lit("s"), (F.col("p_partkey") % 50).cast("string")).alias("session_id"), F.col("p_partkey").alias("claim_id"), F.when(F.col("p_partkey") % 4 < 2, F.concat(F.upper(text), F.lit(" \n"))).otherwise(text).alias("claim_text"), ids.alias("reference_ids"))
    return CL.distinct_claims(rows).select("session_id", "claim_id", "claim_number")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stand_in(spark, sf_dir, CLAIMS)


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "text")


def k01_top5_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.relevant_sections(claims(spark, sf_dir), sources(spark, sf_dir), separator="\n")
    return found.select("claim_id", "rank", F.round("score", 6).alias("score"), F.length("section").alias("n_chars"))


def k02_quotes_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    return E.contained_quotes(quotes, sources(spark, sf_dir)).withColumnRenamed("quote_id", "item_id")


def k03_locate_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = load(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("kind"), "item_id", "text")
    whole = items.unionByName(load(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("item_id"), "text"))
    # a quote from anywhere in the text
    quote = F.expr("substring(text, int(1 + pmod(xxhash64(item_id), greatest(length(text) - 39, 1))), 40)")
    quotes = whole.select("kind", "item_id", quote.alias("quote"), F.regexp_replace("text", "tion", "tino").alias("text"))
    return E.locate_quotes(quotes).select("kind", "item_id", "start", "end", F.round("similarity", 4).alias("similarity"), "match_type")


def k04_match_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.concat(F.lit("gain of "), (F.col("l_partkey") % 5).cast("string"), F.lit("% in 3 groups")).alias("a"), F.concat(F.lit("a gain of "), (F.col("l_suppkey") % 5).cast("string"), F.lit("%, 3 groups")).alias("b"), (F.col("l_partkey") % 8 / 8).alias("similarity"))
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "similarity", E.match_class(F.col("a"), F.col("b"), F.col("similarity")).alias("match_type"))


def k05_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources(spark, sf_dir).select("source_id", nfc(T.sanitize(F.col("text"))).alias("text"))


def k07_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources(spark, sf_dir).filter("text is not null").select("source_id", T.guess_heading(F.col("text")).alias("heading"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = stand_in(spark, sf_dir, VOTES)
    kind = F.get(F.array(*map(F.lit, ("background", "contrast", "factual"))), (F.col("unit_id") % 3).cast("int"))
    return votes.select(F.col("unit_id").alias("claim_id"), "vote_ord", "verdict", "confidence", kind.alias("claim_type"), F.lit(False).alias("needs_review"))


def k21_apply_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("claim_id"), (F.col("l_quantity") < 45).alias("found"))
    return E.apply_validation(results(spark, sf_dir), checks).select("claim_id", "vote_ord", "confidence", "needs_review")


def k24_claim_type_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.apply_claim_type(results(spark, sf_dir)).select("claim_id", "vote_ord", "verdict", "needs_review")


def l43_json_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrap = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 5 == 1, F.concat(F.lit("Here: "), "props", F.lit(" done"))).when(F.col("event_id") % 5 == 2, F.concat(F.lit("list ["), "props", F.lit("]"))).when(F.col("event_id") % 5 == 3, F.lit("no json")).otherwise(F.col("props"))
    return load(spark, sf_dir, "events").select("event_id", J.field(J.extract_object(wrap), "k", "int").alias("k"))


def n01_stage_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stage_status(events(spark, sf_dir)).select("session_id", "stage", "status", "elapsed", "message", "interventions")


def n02_event_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    replayed = events(spark, sf_dir).select("session_id", "event_id", "status")
    return S.without_doubles(replayed.union(replayed.filter("event_id % 3 = 0")))


def n03_session_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.session_state(events(spark, sf_dir)).select("session_id", "state")


def n04_session_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.activity(events(spark, sf_dir)).select("session_id", F.unix_micros("started").alias("started"), "n")


def n05_streamed_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status of stages from a stream of the events, its state kept by session."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    # a pattern, since a stream is of a folder or of what a pattern finds, and the table may be a file
    raw = spark.readStream.schema(load(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")
    stream = spark.sql(EVENTS, events=raw).withColumn("ts", F.col("ts").cast("timestamp"))
    SS.write_states(SS.stage_states(stream, "365 days"), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    states = SS.present(spark.read.parquet(f"{folder}/out").drop("batch"))
    return states.filter("stage IS NOT NULL").select("session_id", "stage", "status", "elapsed", "message", "interventions")


_R, _P, _C, _E = (for_duckdb(x) for x in (REFERENCES, PDFS, CLAIMS, EVENTS))
_LOOK = ", ".join(f"{name} AS ({for_duckdb(sql)})" for name, sql in LOOKUPS)
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_RESULTS = f"r AS (SELECT unit_id AS claim_id, verdict, confidence, ['background', 'contrast', 'factual'][unit_id % 3 + 1] AS claim_type, vote_ord FROM ({for_duckdb(VOTES)}))"

QUERIES = {
    f.__name__: f
    for f in (
        h01_doi_assign, h02_title_assign, h03_match_sources, h07_apply_matches, i01_cascade, i02_retraction, i09_crossref_updates, j01_filter_references, j02_distinct_claims, k01_top5_sections, k02_quotes_exact,
        k03_locate_quotes, k04_match_class, k05_sanitize, k07_headings, k21_apply_validation, k24_claim_type_rules, l43_json_salvage, n01_stage_status, n02_event_dedupe, n03_session_state, n04_session_activity, n05_streamed_status,
    )
}
_NORM = r"lower(rtrim(regexp_replace(trim(doi), '(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)', ''), '.,;: '))"
_DOIS = f"""a AS (SELECT session_id, {_NORM} AS k, min(ref_num) AS ref_num FROM ({_R}) GROUP BY ALL), b AS (SELECT session_id, {_NORM} AS k, min(pdf_ord) AS pdf_ord FROM ({_P}) WHERE doi IS NOT NULL GROUP BY ALL)"""
ORACLE = {
    "h01_doi_assign": f"WITH {_DOIS} SELECT session_id, ref_num, pdf_ord, 0.99::DOUBLE AS confidence FROM a JOIN b USING (session_id, k)",
    "h07_apply_matches": f"WITH {_DOIS}, m AS (SELECT session_id, ref_num, arg_max('/src/' || pdf_ord, pdf_ord) AS p FROM a JOIN b USING (session_id, k) GROUP BY ALL) SELECT session_id, ref_num, coalesce(p, pdf_path) AS pdf_path FROM ({_R}) LEFT JOIN m USING (session_id, ref_num)",
    "i01_cascade": f"""WITH {_LOOK}, r AS (SELECT p_partkey AS ref_key, source_status AS old, pdf_path, journal_url AS old_url, CASE WHEN ref_num % 2 = 0 THEN doi END AS doi, CASE WHEN ref_num % 5 = 0 THEN '77' END AS pmid FROM ({_R})),
      j AS (SELECT r.*, a.status AS s1, a.pmid AS p1, b.status AS s2, b.doi AS d2, b.url AS u2, c.status AS s3, c.doi AS d3 FROM r LEFT JOIN first a USING (ref_key) LEFT JOIN second b USING (ref_key) LEFT JOIN third c USING (ref_key)),
      w AS (SELECT *, CASE WHEN pdf_path IS NOT NULL THEN NULL WHEN s1 = 'found' THEN 'first' WHEN s2 = 'found' THEN 'second' WHEN s3 = 'found' THEN 'third' END AS resolved_by FROM j),
      d AS (SELECT *, CASE resolved_by WHEN 'second' THEN coalesce(d2, doi) WHEN 'third' THEN coalesce(d3, doi) ELSE doi END AS new_doi, CASE resolved_by WHEN 'first' THEN p1 ELSE pmid END AS new_pmid FROM w)
      SELECT ref_key, CASE WHEN pdf_path IS NOT NULL THEN old WHEN resolved_by IS NOT NULL THEN 'found' WHEN s1 = 'api_error' OR s2 = 'api_error' OR s3 = 'api_error' THEN 'api_error' ELSE 'not_found' END AS source_status, resolved_by, new_doi AS doi, new_pmid AS pmid,
        CASE WHEN pdf_path IS NOT NULL THEN old_url WHEN new_doi IS NOT NULL THEN 'https://doi.org/' || new_doi WHEN resolved_by = 'second' THEN u2 ELSE old_url END AS journal_url, pdf_path FROM d""",
    "i02_retraction": "SELECT l_partkey AS ref_key, ['unknown', 'ok', 'corrected', 'expression_of_concern', 'retracted'][max(4 - l_suppkey % 5) + 1] AS status FROM lineitem GROUP BY l_partkey",
    "i09_crossref_updates": """WITH u AS (SELECT p_partkey, ['ok', 'corrected', 'retracted', 'expression_of_concern', 'corrected'][p_partkey % 5 + 1] AS a, ['ok', 'corrected', 'retracted', 'expression_of_concern', 'corrected'][p_size % 5 + 1] AS b FROM part)
      SELECT p_partkey, CASE WHEN a <> 'ok' THEN a ELSE b END AS status FROM u""",
    "j01_filter_references": f"""WITH c AS (SELECT DISTINCT 's' || (l_orderkey % 50) AS session_id, l_orderkey AS claim_id, l_partkey % 60 AS ref_num FROM lineitem)
      SELECT session_id, claim_id, string_agg(ref_num::VARCHAR, ',' ORDER BY ref_num) AS reference_ids FROM c JOIN ({_R}) USING (session_id, ref_num) GROUP BY session_id, claim_id""",
    "j02_distinct_claims": """WITH c AS (SELECT 's' || (p_partkey % 50) AS session_id, min(p_partkey) AS claim_id FROM part GROUP BY p_partkey % 50, lower(split_part(p_name, ' ', 1)), p_size % 3)
      SELECT session_id, claim_id, row_number() OVER (PARTITION BY session_id ORDER BY claim_id) AS claim_number FROM c""",
    "k01_top5_sections": rf"""WITH c AS (SELECT claim_id, source_id, list_filter(list_distinct(regexp_extract_all(lower(claim_text), '[a-z]{{3,}}')), lambda w: w NOT IN ({_STOP})) AS ws, list_distinct(regexp_extract_all(claim_text, '\d+\.?\d*%?')) AS ns FROM ({_C})),
      p AS (SELECT doc_id AS source_id, generate_subscripts(ls, 1) AS pos, trim(unnest(ls), E' \t\n\r\f\x0b') AS p FROM (SELECT doc_id, string_split(text, E'\n') AS ls FROM documents WHERE length(text) >= 2000)),
      s AS (SELECT claim_id, pos, p, len(list_filter(ws, lambda w: contains(lower(p), w))) / len(ws) + least(len(list_filter(ns, lambda n: contains(p, n))) * 0.15, 0.3) AS score FROM c JOIN p USING (source_id) WHERE length(p) > 50 AND len(ws) > 0),
      t AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, pos) AS rank FROM s WHERE score > 0.1),
      d AS (SELECT claim_id, text FROM c JOIN documents ON doc_id = source_id WHERE text <> '')
      SELECT claim_id, rank, round(score, 6)::DOUBLE AS score, length(CASE WHEN len(string_split(trim(regexp_replace(p, '\s+', ' ', 'g')), ' ')) > 2000 THEN array_to_string(string_split(trim(regexp_replace(p, '\s+', ' ', 'g')), ' ')[1:2000], ' ') || E'\n[truncated]' ELSE trim(regexp_replace(p, '[ \t]+', ' ', 'g')) END) AS n_chars FROM t WHERE rank <= 5
      UNION ALL SELECT claim_id, 1, NULL, length(text) FROM d WHERE length(text) < 2000
      UNION ALL SELECT claim_id, 1, NULL, length(trim(regexp_replace(regexp_replace(left(text, 500), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), E' \t\n\r\f\x0b')) FROM d WHERE length(text) >= 2000 AND claim_id NOT IN (SELECT claim_id FROM t)""",
    "k02_quotes_exact": """SELECT item_id, doc_id AS source_id, instr(d.text, b.text) - 1 AS start, instr(d.text, b.text) - 1 + length(b.text) AS "end" FROM benchmark b JOIN documents d ON contains(d.text, b.text)""",
    "k04_match_class": """WITH x AS (SELECT *, (l_partkey % 8) / 8 AS similarity, list_sort(list_distinct([(l_partkey % 5) || '%', '3'])) = list_sort(list_distinct([(l_suppkey % 5) || '%', '3'])) AS same FROM lineitem)
      SELECT l_orderkey, l_linenumber, l_partkey, similarity::DOUBLE AS similarity, CASE WHEN NOT same THEN 'numeric_mismatch' WHEN similarity >= 0.95 THEN 'direct' WHEN similarity >= 0.75 THEN 'paraphrased' ELSE 'absent' END AS match_type FROM x""",
    "k05_sanitize": r"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', E'\n\n', 'g') AS t FROM documents),
      w AS (SELECT *, string_split(trim(regexp_replace(t, '\s+', ' ', 'g')), ' ') AS ws FROM a)
      SELECT doc_id AS source_id, nfc_normalize(trim(CASE WHEN len(ws) > 2000 THEN array_to_string(ws[1:2000], ' ') || E'\n[truncated]' ELSE t END, E' \t\n\r\f\x0b')) AS text FROM w""",
    "k07_headings": rf"""WITH l AS (SELECT doc_id AS source_id, trim(split_part(text, chr(10), 1)) AS line FROM documents WHERE text IS NOT NULL), h AS (SELECT *, regexp_extract(line, '{T.HEADINGS}', 1) AS h FROM l)
      SELECT source_id, CASE WHEN h <> '' THEN upper(left(h, 1)) || lower(substr(h, 2)) WHEN length(line) < 60 AND regexp_matches(line, '^\p{{Lu}}') THEN line ELSE 'Source Section' END AS heading FROM h""",
    "k21_apply_validation": f"""WITH {_RESULTS}, b AS (SELECT DISTINCT l_orderkey AS claim_id FROM lineitem WHERE l_quantity >= 45)
      SELECT r.claim_id, vote_ord, CASE WHEN b.claim_id IS NOT NULL THEN round(greatest(0.0, confidence - 0.2), 3) ELSE confidence END AS confidence, b.claim_id IS NOT NULL AS needs_review FROM r LEFT JOIN b ON b.claim_id = r.claim_id""",
    "k24_claim_type_rules": f"""WITH {_RESULTS} SELECT claim_id, vote_ord, CASE WHEN claim_type = 'background' AND confidence >= 0.5 AND verdict IN ('partially_supported', 'cannot_verify') THEN 'supported' ELSE verdict END AS verdict, claim_type = 'contrast' AS needs_review FROM r""",
    "l43_json_salvage": "SELECT event_id, CASE WHEN event_id % 5 <> 3 THEN (props->>'$.k')::INT END AS k FROM events",
    "n01_stage_status": f"""WITH e AS ({_E}) SELECT session_id, stage, arg_max(status, struct_pack(a := ts, b := event_id)) AS status, arg_max(elapsed, struct_pack(a := ts, b := event_id)) FILTER (elapsed IS NOT NULL) AS elapsed,
      arg_max(message, struct_pack(a := ts, b := event_id)) FILTER (message IS NOT NULL) AS message, count(*) FILTER (status = 'needs_input') AS interventions FROM e WHERE stage > 0 GROUP BY session_id, stage""",
    "n02_event_dedupe": f"SELECT session_id, event_id, status FROM ({_E})",
    "n03_session_state": f"SELECT session_id, CASE WHEN max(status = 'pipeline_complete') THEN 'complete' WHEN max(status = 'error' AND stage = 0) THEN 'error' ELSE 'running' END AS state FROM ({_E}) GROUP BY session_id",
    "n04_session_activity": f"""WITH e AS (SELECT session_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM ({_E}) WINDOW w AS (PARTITION BY session_id ORDER BY ts)),
      s AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
      SELECT session_id, epoch_us(min(ts)) AS started, count(*) AS n FROM s GROUP BY session_id, s""",
}
ORACLE["n05_streamed_status"] = ORACLE["n01_stage_status"]
