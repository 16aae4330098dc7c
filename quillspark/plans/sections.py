"""Queries of section, claim-unit, consensus and look-up operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import json as J
from quillspark.operators import citations as C
from quillspark.operators import claims as CL
from quillspark.operators import evidence as E
from quillspark.operators import matching as M
from quillspark.operators import records, scopes, voting
from quillspark.operators import sections as S
from quillspark.plans.citations import paragraphs
from quillspark.plans.stand_ins import PARAGRAPHS, REFERENCES, VOTES, for_duckdb, load, stand_in
from quillspark.streaming import events as EV

#: Sections of fifty manuscripts, one per order: some of references, some without a heading, two paragraphs or one.
SECTIONS = """
SELECT concat('s', CAST(o_custkey % 50 AS STRING)) AS session_id, o_orderkey AS section_ord,
  CASE CAST(o_orderkey % 7 AS INT) WHEN 0 THEN 'Introduction' WHEN 1 THEN 'References' WHEN 2 THEN NULL WHEN 3 THEN ' Funding ' WHEN 4 THEN 'works cited' WHEN 5 THEN 'Conflicts  of interest' ELSE 'Results' END AS heading,
  concat('  First of ', o_orderpriority, CASE WHEN o_orderkey % 3 = 0 THEN concat(' [', CAST(1 + o_orderkey % 9 AS STRING), '-', CAST(3 + o_orderkey % 9 AS STRING), '], as in Table 2.') ELSE '.' END, chr(10), ' ', chr(10),
    CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 4 = 1 THEN concat('Second (Smith, ', CAST(1990 + o_orderkey % 30 AS STRING), ') and (Gear et al., 2001).') ELSE 'Nothing to see here' END, chr(10), chr(10), chr(10)) AS text
FROM {orders}"""
#: Answers of models, in all the wrappings that they come in.
ANSWERS = """
SELECT event_id, CASE CAST(event_id % 7 AS INT) WHEN 0 THEN concat('  ', props, ' ') WHEN 1 THEN concat('So: ```json', chr(10), props, chr(10), '``` done') WHEN 2 THEN concat('Here ', props, ' it is')
  WHEN 3 THEN concat('a list [', props, ', ', props, '] of two') WHEN 4 THEN 'no json at all ' WHEN 5 THEN concat('[', CAST(event_id AS STRING), ']') ELSE concat('broken ', chr(123), props, ' and [1, 2]') END AS answer FROM {events}"""


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stand_in(spark, sf_dir, SECTIONS)


def d06_flatten_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.flatten_paragraphs(sections(spark, sf_dir))


def j14_all_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.flatten_paragraphs(sections(spark, sf_dir), skip_references=False).select("session_id", "para_idx", "section", F.length("text").alias("n_chars"))


def j11_sections_for_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sections_for_claims(sections(spark, sf_dir)).select("session_id", "section_ord", "heading")


def c17_manuscript_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return sections(spark, sf_dir).select("section_ord", S.manuscript_style(F.concat(text, F.repeat(text, (F.col("section_ord") % 2).cast("int")))).alias("style"), S.style_of_text(text).alias("detectors"))


def c19_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sections(spark, sf_dir).select("section_ord", F.explode(S.markers_in(F.col("text"))).alias("m"))
    return found.select("section_ord", "m.position", "m.raw_text", F.array_join(F.transform("m.reference_ids", lambda n: n.cast("string")), ",").alias("reference_ids"))


def d02_single_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs read one by one: which detectors run depends on each paragraph alone."""
    found = C.detect_in_paragraphs(paragraphs(spark, sf_dir), S.style_of_text(F.col("text")))
    return found.groupBy("para_idx").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("style") == "numbered_bracket").alias("numbered"))


def e18_units_to_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bracketed citations of paragraphs as units, then as claims with places."""
    text = paragraphs(spark, sf_dir)
    found = C.with_sentence(C.first_wins(C.detect_citations(text.withColumn("style", F.lit("numbered")), with_spans=True)))
    units = scopes.resolve_scopes(C.numbered(found)).withColumn("ref_num", F.when(F.col("number") < 9, F.col("number")))
    made = CL.units_to_claims(units)
    return made.select("session_id", "section", F.get("reference_ids", F.lit(0)).alias("ref_num"), "location.para_idx", "location.char_start", "location.char_end", F.array_join("location.citation_markers", ",").alias("markers"))


def j05_to_decompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.get(F.array(*map(F.lit, CL.PRIORITY_OF_TYPE)), (F.col("o_orderkey") % 6).cast("int"))
    rows = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim_id"), kind.alias("claim_type"), F.when(F.col("o_custkey") % 2 == 0, "high").otherwise("low").alias("priority"))
    return CL.to_decompose(rows)


def j02_reference_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = stand_in(spark, sf_dir, REFERENCES)
    authors = F.when(F.col("ref_num") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("surname", F.lit("Brown"), F.lit("Gear"), F.lit("Ring")))
    return CL.reference_list(refs.select("session_id", "ref_num", authors.alias("authors"), "title", F.when(F.col("ref_num") % 3 == 0, "J Test").alias("journal"), F.when(F.col("ref_num") % 4 > 0, F.col("year")).alias("year")))


def j19_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second half of every paragraph as a claim, with its place."""
    start = F.floor(F.length("text") / 2).cast("int")
    rows = sections(spark, sf_dir).withColumn("start", start).withColumn("claim", F.substring(F.col("text"), F.col("start") + 1, F.lit(1000)))
    place = CL.location(F.col("section_ord"), F.col("start"), F.length("text"), F.col("claim"), F.col("text"), F.col("heading"))
    return rows.select(place.alias("l")).select("l.para_idx", "l.char_start", "l.char_end", F.array_join("l.citation_markers", ";").alias("markers"), "l.in_figure_or_table")


def j16_located_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence of each of a session's paragraphs, found again in the first paragraph that holds it."""
    text = paragraphs(spark, sf_dir).select("session_id", "para_idx", "section", "text")
    claims = text.select("session_id", F.col("para_idx").alias("claim_id"), F.substring("text", 5, 30).alias("claim_text"))
    return CL.located_claims(claims, text).select("session_id", "claim_id", "location.para_idx", "location.char_start", "location.char_end")


def j17_misspelt_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence of each paragraph with letters missing, doubled or exchanged, found by its likeness."""
    text = paragraphs(spark, sf_dir).select("session_id", "para_idx", "section", "text")
    wrong = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.substring("text", 3, 44), "(?<=[a-z])e", ""), "in", "ni"), "([sp])(?=[a-z])", "$1$1")
    found = CL.place_claims(text.select("session_id", F.col("para_idx").alias("claim_id"), wrong.alias("claim_text")), text)
    return found.select("session_id", "claim_id", "para_idx", "start", F.round("similarity", 6).alias("similarity"))


def k09_source_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim_id"))
    lines = load(spark, sf_dir, "lineitem").filter("l_quantity > 40").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_linestatus").alias("mode"), F.max("l_returnflag").alias("flag"))
    found = E.source_texts(claims, lines.select(F.col("l_orderkey").alias("claim_id"), F.col("l_linenumber").cast("int").alias("rank"), F.col("mode").alias("heading"), F.col("flag").alias("section")))
    return found.select("claim_id", "text", "coverage", F.array_join("headings", ",").alias("headings"))


def k10_evidence_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes in sections: one as it stands, one that is like nothing, and blanks."""
    secs = sections(spark, sf_dir).select(F.col("section_ord").alias("claim_id"), F.lit(1).alias("rank"), "heading", F.col("text").alias("section"))
    quote = F.get(F.array(F.lit("First of"), F.lit("@@@@@@@@@@@@@@@@"), F.lit("  "), F.lit("to see here")), F.col("n"))
    quotes = secs.select("claim_id", F.explode(F.array(*map(F.lit, range(4)))).alias("n")).select("claim_id", F.col("n").alias("quote_ord"), quote.alias("quote"))
    claims = secs.select("claim_id", F.lit("a claim of 5").alias("claim_text"))
    found = E.evidence_sections(secs, quotes.filter("claim_id % 4 > 1"), claims)
    return found.select("claim_id", F.array_join(F.transform("highlights", lambda h: F.concat_ws(":", h["quote"], h["start"].cast("string"), h["end"].cast("string"), h["match_type"])), ";").alias("highlights"))


def k25_cannot_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("claim_id"), F.col("l_partkey").alias("ref_num"), "l_linestatus")
    return E.cannot_verify(pairs, F.concat(F.lit("no text by "), "l_linestatus"))


def l04_results_of_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.get(F.array(*map(F.lit, (*voting.VERDICTS, "escalate", "maybe"))), (F.col("p_partkey") % 7).cast("int"))
    rows = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("unit_id"), verdict.alias("verdict"), (F.col("p_size") / 32.0 - 0.25).cast("double").alias("confidence"))
    return voting.results_of_consensus(rows)


def l23_finalize_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("unit_id"), F.lit(0).alias("claim_id"), F.lit(0).alias("ref_num"), F.lit("supported").alias("verdict"), F.lit(1).alias("tier"))
    pairs = load(spark, sf_dir, "part").filter("p_size > 20").select(F.col("p_partkey").alias("unit_id"), F.col("p_partkey").alias("claim_id"), F.col("p_size").alias("ref_num"))
    return voting.finalize_single(rows, pairs)


def l30_available_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = load(spark, sf_dir, "supplier").select(F.col("s_name").alias("model"), (F.col("s_suppkey") % 6).alias("provider"), (F.col("s_suppkey") % 4).alias("tier"), F.col("s_suppkey").alias("ord"))
    keys = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("provider"), (F.col("n_nationkey") % 2 == 0).alias("has_key"))
    return voting.available_models(models, keys)


def l44_json_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stand_in(spark, sf_dir, ANSWERS).select("event_id", J.extract_text(F.col("answer")).alias("json"))


def a08_source_doi(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, doi = F.col("p_partkey"), F.col("doi")
    at = lambda n, value: F.when(k % 6 == n, value)
    meta = F.create_map(F.lit("doi"), at(0, doi), F.lit("subject"), at(1, F.concat(F.lit("see "), doi, F.lit("."))), F.lit("keywords"), at(2, F.concat(F.lit("x; "), doi, F.lit(";"))), F.lit("title"), F.col("title"))
    page_1, page_2 = at(3, F.concat(F.lit("(https://doi.org/"), doi, F.lit(")"))), F.when(k % 6 < 5, F.concat(F.lit("second 10.5555/"), k.cast("string"), F.lit("];")))
    return stand_in(spark, sf_dir, REFERENCES).select("p_partkey", records.doi_of_source(meta, F.coalesce(page_1, F.lit("")), F.coalesce(page_2, F.lit(""))).alias("doi"))


def a18_lookup_by_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = stand_in(spark, sf_dir, REFERENCES).select(F.col("p_partkey").alias("ref_key"), "title")
    known = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("rec_key"), F.concat_ws(" ", F.lower("p_type"), F.reverse(F.split("p_name", " "))[0], F.split("p_name", " ")[0]).alias("title"))
    return M.lookup_by_title(refs, known)


def stored_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = stand_in(spark, sf_dir, REFERENCES).select("session_id", "ref_num", F.when(F.col("ref_num") % 4 > 0, F.array("surname", F.lit('O"Neil'))).alias("authors"))
    return EV.to_rows(refs, ["authors"])


def o01_reference_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_references(spark, sf_dir)


def o02_references_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = EV.from_rows(stored_references(spark, sf_dir), {"authors": "array<string>"})
    return back.select("session_id", "ref_num", F.size("authors").alias("n"), F.array_join("authors", "; ").alias("authors"))


def stored_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.when(F.col("o_orderkey") % 3 > 0, F.struct(F.col("o_custkey").alias("para_idx"), F.array(F.lit("[1]")).alias("citation_markers")))
    rows = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim_id"), F.array("o_custkey", F.lit(7)).alias("reference_ids"), place.alias("location"))
    return EV.to_rows(rows, ["reference_ids", "location"])


def o03_claim_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_claims(spark, sf_dir)


def o04_claims_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = EV.from_rows(stored_claims(spark, sf_dir), {"reference_ids": "array<long>", "location": "struct<para_idx:long,citation_markers:array<string>>"})
    return back.select("claim_id", F.get("reference_ids", F.lit(0)).alias("first_id"), "location.para_idx", F.array_join("location.citation_markers", ",").alias("markers"))


def stored_verifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = stand_in(spark, sf_dir, VOTES)
    one = F.struct("vote_ord", "verdict", "confidence")
    rows = votes.groupBy(F.col("unit_id").alias("claim_id")).agg(F.array_sort(F.collect_list(one)).alias("votes"))
    return EV.to_rows(rows, ["votes"])


def o05_verification_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_verifications(spark, sf_dir)


def o06_verifications_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = EV.from_rows(stored_verifications(spark, sf_dir), {"votes": "array<struct<vote_ord:int,verdict:string,confidence:double>>"})
    return back.select("claim_id", F.size("votes").alias("n"), F.aggregate("votes", F.lit(0.0), lambda a, v: a + v["confidence"]).alias("confidence"))


_S, _A, _R = (for_duckdb(x) for x in (SECTIONS, ANSWERS, REFERENCES))
_WHITE = r"E' \t\n\r\f\x0b'"
_PARTS = rf"""SELECT session_id, section_ord, coalesce(heading, '') AS section, generate_subscripts(ps, 1) AS pos, trim(unnest(ps), {_WHITE}) AS text
  FROM (SELECT *, regexp_split_to_array(text, '\n\s*\n') AS ps FROM ({_S}))"""
_FLAT = "SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY section_ord, pos) - 1 AS para_idx, section, {} FROM p WHERE text <> '' {}"
_NUM, _AY = S.NUMBERED_MARKER, S.AUTHOR_YEAR_MARKER

QUERIES = {
    f.__name__: f
    for f in (
        d06_flatten_paragraphs, j14_all_paragraphs, j11_sections_for_claims, c17_manuscript_style, c19_markers, d02_single_paragraphs, e18_units_to_claims, j05_to_decompose, j02_reference_list, j19_locations, j16_located_claims, j17_misspelt_claims,
        k09_source_texts, k10_evidence_sections, k25_cannot_verify, o01_reference_rows, o02_references_read, o03_claim_rows, o04_claims_read, o05_verification_rows, o06_verifications_read, l04_results_of_consensus, l23_finalize_single, l30_available_models, l44_json_text, a08_source_doi, a18_lookup_by_title,
    )
}
ORACLE = {
    "d06_flatten_paragraphs": f"WITH p AS ({_PARTS}) " + _FLAT.format("text", "AND lower(section) NOT IN ('references', 'bibliography', 'works cited')"),
    "j14_all_paragraphs": f"WITH p AS ({_PARTS}) " + _FLAT.format("length(text) AS n_chars", ""),
    "j11_sections_for_claims": rf"""SELECT session_id, section_ord, heading FROM ({_S}) WHERE (heading IS NULL OR NOT regexp_matches(heading, '{S.NOT_BODY}')) AND ({' OR '.join(f"regexp_matches(text, '{p}')" for p in S.HAS_CITATIONS)})""",
    "c17_manuscript_style": rf"""WITH c AS (SELECT section_ord, (1 + section_ord % 2) * len(regexp_extract_all(text, '{_NUM}')) AS n, (1 + section_ord % 2) * len(regexp_extract_all(text, '{_AY}')) AS a,
        len(regexp_extract_all(text, '\([A-Z][a-z]+.*?\d{{4}}')) AS ay, len(regexp_extract_all(text, '\[\d+')) AS b FROM ({_S}))
      SELECT section_ord, CASE WHEN n > a AND n >= 2 THEN 'numbered' WHEN a > n AND a >= 2 THEN 'author_year' WHEN n >= 1 THEN 'numbered' WHEN a >= 1 THEN 'author_year' ELSE 'unknown' END AS style,
        CASE WHEN ay > 0 AND b > 0 THEN 'mixed' WHEN b > 0 THEN 'numbered' ELSE 'author_year' END AS detectors FROM c""",
    "c19_markers": rf"""WITH n AS (SELECT section_ord, text, unnest(regexp_extract_all(text, '{_NUM}')) AS m, 1 AS k FROM ({_S})), a AS (SELECT section_ord, text, unnest(regexp_extract_all(text, '{_AY}')) AS m, 2 AS k FROM ({_S}))
      SELECT section_ord, instr(text, m) - 1 AS position, m AS raw_text, CASE WHEN k = 1 THEN array_to_string(range(regexp_extract(m, '(\d+)', 1)::INT, regexp_extract(m, '(\d+)\]', 1)::INT + 1), ',') ELSE '' END AS reference_ids FROM (FROM n UNION ALL FROM a)""",
    "e18_units_to_claims": rf"""WITH p AS (SELECT session_id, para_idx, section, text, unnest(regexp_extract_all(text, '\[\d[^\]]*\]')) AS m FROM ({for_duckdb(PARAGRAPHS)})),
      k AS (SELECT *, list_distinct(CASE WHEN contains(m, '-') THEN [regexp_extract(m, '\[(\d+)', 1)::INT] || range(regexp_extract(m, '(\d+)-', 1)::INT, regexp_extract(m, '-(\d+)', 1)::INT + 1) ELSE [regexp_extract(m, '(\d+)', 1)::INT] END) AS ns FROM p), n AS (SELECT *, unnest(ns) AS n, len(ns) > 1 AS many FROM k)
      SELECT session_id, section, CASE WHEN n < 9 THEN n ELSE 0 END AS ref_num, para_idx, instr(text, m) - 1 AS char_start, instr(text, m) - 1 + length(m) AS char_end, CASE WHEN many THEN '[' || n || ']' ELSE m END AS markers FROM n""",
    "j05_to_decompose": """SELECT o_orderkey AS claim_id, ['factual', 'contrast', 'methodological', 'background', 'attribution', 'interpretive'][o_orderkey % 6 + 1] AS claim_type, 'high' AS priority FROM orders WHERE o_orderkey % 6 < 2 AND o_custkey % 2 = 0""",
    "j02_reference_list": f"""SELECT session_id, string_agg('[' || ref_num || ']' || CASE WHEN ref_num % 5 > 0 THEN ' ' || surname || ', Brown, Gear' ELSE '' END || ' ' || title || CASE WHEN ref_num % 3 = 0 THEN ' J Test' ELSE '' END || CASE WHEN ref_num % 4 > 0 THEN ' (' || year || ')' ELSE '' END, chr(10) ORDER BY ref_num) AS listing FROM ({_R}) GROUP BY session_id""",
    "j19_locations": rf"""WITH s AS (SELECT *, (length(text) // 2)::INT AS a, substr(text, (length(text) // 2)::INT + 1) AS claim FROM ({_S}))
      SELECT section_ord AS para_idx, a AS char_start, length(text) AS char_end, array_to_string(regexp_extract_all(claim, '{CL.MARKER_IDS}', 1), ';') AS markers, regexp_matches(substr(text, greatest(a - 50, 0) + 1, a + 50 - greatest(a - 50, 0)), '{CL.FIGURE}') AS in_figure_or_table FROM s""",
    "j16_located_claims": f"""WITH p AS (SELECT session_id, para_idx, text FROM ({for_duckdb(PARAGRAPHS)})), q AS (SELECT DISTINCT session_id, substr(text, 5, 30) AS claim FROM p), t AS (SELECT session_id, text, min(para_idx) AS para_idx FROM p GROUP BY ALL),
      f AS (SELECT q.session_id, claim, min(para_idx) AS at, arg_min(instr(text, claim) - 1, para_idx) AS char_start FROM q JOIN t ON t.session_id = q.session_id AND contains(text, claim) GROUP BY ALL)
      SELECT p.session_id, p.para_idx AS claim_id, f.at AS para_idx, char_start, char_start + 30 AS char_end FROM p JOIN f ON f.session_id = p.session_id AND f.claim = substr(text, 5, 30)""",
    "k09_source_texts": """WITH l AS (SELECT l_orderkey, l_linenumber, max(l_linestatus) AS m, max(l_returnflag) AS f FROM lineitem WHERE l_quantity > 40 GROUP BY ALL)
      SELECT o_orderkey AS claim_id, coalesce(string_agg(f, chr(10) || chr(10) ORDER BY l_linenumber), '') AS text, CASE WHEN count(f) > 0 THEN 'relevant_sections' ELSE 'no_source' END AS coverage, coalesce(string_agg(m, ',' ORDER BY l_linenumber), '') AS headings
      FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY o_orderkey""",
    "k10_evidence_sections": f"""WITH s AS (SELECT section_ord AS claim_id, text, section_ord % 4 > 1 AS asked FROM ({_S}))
      SELECT claim_id, CASE WHEN asked THEN 'First of:2:10:direct;to see here:' || (instr(text, 'to see here') - 1) || ':' || (instr(text, 'to see here') + 10) || ':direct' ELSE '' END AS highlights FROM s""",
    "k25_cannot_verify": "SELECT l_orderkey AS claim_id, l_partkey AS ref_num, 'cannot_verify' AS verdict, 0.0::DOUBLE AS confidence, 'no text by ' || l_linestatus AS reasoning, 1 AS tier, 'no_source' AS source_coverage FROM lineitem",
    "l04_results_of_consensus": """WITH v AS (SELECT p_partkey AS unit_id, coalesce(['supported', 'partially_supported', 'not_supported', 'contradicted'][p_partkey % 7 + 1], 'cannot_verify') AS verdict, least(1.0, greatest(0.0, p_size / 32.0 - 0.25))::DOUBLE AS confidence FROM part)
      SELECT *, verdict = 'contradicted' AS needs_review FROM v""",
    "l23_finalize_single": "SELECT p_partkey AS claim_id, p_size AS ref_num, 'supported' AS verdict, 2 AS tier FROM part WHERE p_size > 20",
    "l30_available_models": "SELECT s_name AS model, s_suppkey % 6 AS provider, s_suppkey % 4 AS tier, s_suppkey AS ord FROM supplier WHERE s_suppkey % 2 = 0",
    "l44_json_text": f"""WITH a AS (SELECT event_id, props, answer FROM ({_A}) JOIN events USING (event_id)) SELECT event_id, CASE event_id % 7 WHEN 3 THEN '[' || props || ', ' || props || ']' WHEN 4 THEN 'no json at all' WHEN 5 THEN answer WHEN 6 THEN '[1, 2]' ELSE props END AS json FROM a""",
    "a08_source_doi": f"""WITH d AS (SELECT p_partkey, doi FROM ({_R})) SELECT p_partkey, CASE WHEN p_partkey % 6 < 4 THEN doi WHEN p_partkey % 6 = 4 THEN '10.5555/' || p_partkey END AS doi FROM d""",
    "o01_reference_rows": f"SELECT session_id, ref_num, CASE WHEN ref_num % 4 > 0 THEN to_json([surname, 'O\"Neil'])::VARCHAR END AS authors FROM ({_R})",
    "o02_references_read": f"SELECT session_id, ref_num, CASE WHEN ref_num % 4 > 0 THEN 2 END AS n, CASE WHEN ref_num % 4 > 0 THEN surname || '; O\"Neil' END AS authors FROM ({_R})",
    "o03_claim_rows": "SELECT o_orderkey AS claim_id, '[' || o_custkey || ',7]' AS reference_ids, CASE WHEN o_orderkey % 3 > 0 THEN to_json({'para_idx': o_custkey, 'citation_markers': ['[1]']})::VARCHAR END AS location FROM orders",
    "o04_claims_read": "SELECT o_orderkey AS claim_id, o_custkey AS first_id, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS para_idx, CASE WHEN o_orderkey % 3 > 0 THEN '[1]' END AS markers FROM orders",
    "o05_verification_rows": f"""SELECT unit_id AS claim_id, '[' || string_agg(to_json({{'vote_ord': vote_ord, 'verdict': verdict, 'confidence': confidence}})::VARCHAR, ',' ORDER BY vote_ord) || ']' AS votes FROM ({for_duckdb(VOTES)}) GROUP BY unit_id""",
    "o06_verifications_read": f"SELECT unit_id AS claim_id, count(*) AS n, sum(confidence) AS confidence FROM ({for_duckdb(VOTES)}) GROUP BY unit_id",
}
