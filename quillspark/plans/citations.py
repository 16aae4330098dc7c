"""Queries of the reference, citation, scope and mapping operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.spans import find_all
from quillspark.operators import citations as C
from quillspark.operators import mapping, references, scopes
from quillspark.operators.lineage import spread, stored
from quillspark.plans.stand_ins import PARAGRAPHS, RAW_REFERENCES, REFERENCES, for_duckdb, load, stand_in


def raw_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stand_in(spark, sf_dir, RAW_REFERENCES)


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the orders are dealt, not the texts made of them
    orders = spread(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate"), "o_orderkey")
    return spark.sql(PARAGRAPHS, orders=orders).select("session_id", "para_idx", "section", "text")


def c01_doi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_references(spark, sf_dir).select("session_id", "ref_num", T.extract_doi(F.col("raw_text")).alias("doi"))


def c02_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_references(spark, sf_dir).select("session_id", "ref_num", T.extract_year(F.col("raw_text")).alias("year"))


def c03_pmid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_references(spark, sf_dir).select("session_id", "ref_num", T.extract_pmid(F.col("raw_text")).alias("pmid"))


def c04_doi_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = stand_in(spark, sf_dir, REFERENCES).select("session_id", "ref_num", "doi")
    raw = raw_references(spark, sf_dir).select("session_id", "ref_num", F.concat(F.lit("HTTPS://doi.org/"), F.upper(T.extract_doi(F.col("raw_text"))), F.lit(" .")).alias("other"))
    return refs.join(raw, ["session_id", "ref_num"]).select("session_id", "ref_num", T.dois_match(F.col("doi"), F.col("other")).alias("is_match"))


def c05_split_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_references(spark, sf_dir).withColumn("line", F.replace("raw_text", F.lit(". J Test"), F.lit(".\nJ Test")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ref_num", "line"))), lambda x: x["line"])
    return references.split_records(raw.groupBy("session_id").agg(F.array_join(lines, "\n").alias("text")))


def c06_authors_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = references.parse_references(raw_references(spark, sf_dir))
    return parsed.select("session_id", "ref_num", F.array_join("authors", "|").alias("authors"), "title")


def c07_page_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return load(spark, sf_dir, "pages").select("page_id", T.first_tag(html, "title").alias("title"), T.first_tag(html, "h1").alias("h1"))


def c08_url_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat("url", F.when(F.col("page_id") % 3 == 0, "/pdf/x").when(F.col("page_id") % 3 == 1, "/SI/full/").otherwise("/full/article/"))
    return load(spark, sf_dir, "pages").select("page_id", T.score_pdf_url(url).alias("score"))


def c01_reference_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, "Works  Cited ").when(F.col("p_partkey") % 5 == 1, " REFERENCES").otherwise(F.col("p_name")).alias("line"))
    return lines.select("p_partkey", T.is_reference_heading(F.col("line")).alias("is_heading"))


def d01_bracket_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = paragraphs(spark, sf_dir).select("para_idx", F.explode(find_all(F.col("text"), C.BRACKET)).alias("s"))
    return found.select("para_idx", "s.start", "s.end", F.col("s.text").alias("marker"))


def d02_expand_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.concat_ws("", F.col("l_linenumber").cast("string"), F.lit(", "), (F.col("l_partkey") % 9).cast("string"), F.lit("-"), (F.col("l_suppkey") % 9).cast("string")).alias("r"))
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(C.expand_numbers(F.col("r")), ",").alias("numbers"))


def d03_author_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.detect_citations(paragraphs(spark, sf_dir)).filter("style = 'author_year_parenthetical'")
    return found.groupBy("para_idx").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("/", F.array_join("authors", "+"), "year"))), ";").alias("found"))


def d04_narrative(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.detect_citations(paragraphs(spark, sf_dir)).filter("style = 'author_year_narrative'")
    return found.select("para_idx", "raw_marker", F.array_join("authors", "+").alias("authors"), "year", "start", "end")


def d05_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.detect_style(paragraphs(spark, sf_dir))


def d06_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.first_wins(C.detect_citations(paragraphs(spark, sf_dir)))
    return found.groupBy("style").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("para_idx").alias("paragraphs"), F.sum("number").alias("numbers"))


def d07_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = spread(load(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = text.select("doc_id", F.posexplode(T.sentence_spans(F.col("text"))).alias("nth", "s"))
    return spans.select("doc_id", "nth", "s.start", "s.end")


def cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = paragraphs(spark, sf_dir)
    return C.numbered(C.with_sentence(C.first_wins(C.detect_citations(text, C.detect_style(text), with_spans=True))))


def d24_sentence_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cited(spark, sf_dir).select("session_id", "cit_id", "para_idx", "raw_marker", "sent_start", "sent_end", "sentence")


def d08_claim_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = paragraphs(spark, sf_dir).select("para_idx", scopes.without_markers(F.col("text")).alias("scope"))
    return text.select("para_idx", "scope", scopes.claim_type(F.col("scope"), F.lit(False)).alias("t")).select("para_idx", "scope", "t.*")


def e11_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scopes.resolve_scopes(cited(spark, sf_dir)).select("session_id", "unit_id", "cit_id", "scope", "claim_type", "priority")


def mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.numbered(C.first_wins(C.detect_citations(paragraphs(spark, sf_dir))))
    keyed = stored(found.select(F.concat_ws(":", "session_id", F.col("cit_id").cast("string")).alias("cit_key"), "session_id", "number", "authors", "year"))
    refs = stand_in(spark, sf_dir, REFERENCES).select("session_id", "ref_num", "year", F.array(F.concat(F.lit("A. "), "surname"), F.lit("Green, B.")).alias("authors"))
    return mapping.map_citations(keyed, refs)


def e01_map_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped(spark, sf_dir)


def e02_mapping_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped(spark, sf_dir).groupBy("method", "confidence").agg(F.count(F.lit(1)).alias("n"))


def f01_missing_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = paragraphs(spark, sf_dir)
    sentences = text.filter(~F.lower("section").isin(*scopes.SKIPPED_SECTIONS)).select("para_idx", F.explode(F.split("text", r"\. ")).alias("sentence"))
    bare = sentences.filter(~F.col("sentence").rlike(r"\[\d|\(.*\d{4}"))
    return scopes.flag_missing(bare).select("para_idx", "sentence", "category", "reason", "confidence")


def f02_missing_in_manuscript(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = paragraphs(spark, sf_dir)
    sections = text.select("session_id", F.col("para_idx").alias("section_ord"), F.col("section").alias("heading"), "text")
    spans = cited(spark, sf_dir).select("session_id", "para_idx", "sent_start", "sent_end")
    return scopes.missing_citations(sections, spans).select("session_id", "missing_id", "para_idx", "sentence", "category", "reason")


def g01_duplicates_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = stand_in(spark, sf_dir, REFERENCES).select("session_id", "ref_num", F.concat(F.lit(" 10.1000/"), F.upper("surname"), (F.col("year") % 5).cast("string")).alias("doi"))
    return references.exact_duplicates(refs)


def g02_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.detect_duplicates(stand_in(spark, sf_dir, REFERENCES))


_RAW, _REF, _PAR = for_duckdb(RAW_REFERENCES), for_duckdb(REFERENCES), for_duckdb(PARAGRAPHS)
_DOI = r"rtrim(coalesce(nullif(regexp_extract(raw_text, '(?i)(?:doi[:\s]*|https?://(?:dx\.)?doi\.org/)(10\.\d{4,}/\S+)', 1), ''), nullif(regexp_extract(raw_text, '\b(10\.\d{4,}/\S+)', 1), '')), '.,;:')"


def _re2(pattern: str) -> str:
    return pattern.replace("À-ɏЀ-ӿ", r"\x{00C0}-\x{024F}\x{0400}-\x{04FF}").replace("'", "''")


def _spans(pattern: str, source: str) -> str:
    """(para_idx, start, end, marker) of all matches, by the lengths of pieces and matches before each."""
    p = _re2(pattern)
    return rf"""SELECT para_idx, (list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::INT AS start, (start + length(ms[i]))::INT AS "end", ms[i] AS marker
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT para_idx, regexp_split_to_array(text, '{p}') AS pieces, regexp_extract_all(text, '{p}') AS ms FROM ({source})))"""


_AUTHORS = r"array_to_string(list_filter(list_transform(regexp_split_to_array(trim(regexp_replace(regexp_split_to_array({0}, ',?\s*\d{{4}}')[1], '\s+et\s+al\.?', '', 'g')), '\s+(?:and|&)\s+|,\s*'), lambda n: trim(n)), lambda n: regexp_matches(n, '^[A-Z]')), '+')"
_FALSE = " AND ".join(f"NOT regexp_matches(marker, '{_re2(p)}')" for p in C.NOT_CITATIONS if "(?!" not in p)
_D03 = rf"""WITH s AS ({_spans(C.PARENTHETICAL, _PAR)}), ok AS (SELECT * FROM s WHERE {_FALSE}),
  g AS (SELECT para_idx, start, unnest(regexp_split_to_array(regexp_replace(marker, '^\(+|\)+$', '', 'g'), '\s*;\s*')) AS g FROM ok),
  c AS (SELECT para_idx, regexp_replace(trim(g), '(?i)^{_re2(C.LEAD_IN)}', '') AS g FROM g),
  y AS (SELECT para_idx, {_AUTHORS.format('g')} AS a, unnest(CASE WHEN len(regexp_extract_all(g, '\d{{4}}[a-z]?')) = 0 THEN [NULL] ELSE regexp_extract_all(g, '\d{{4}}[a-z]?') END) AS y FROM c)
  SELECT para_idx, count(*) AS n, array_to_string(list_sort(list(concat_ws('/', a, y))), ';') AS found FROM y GROUP BY para_idx"""
_NAMES_OF = r"list_filter(list_transform(regexp_split_to_array(trim(regexp_replace({0}, '\s+et\s+al\.?', '', 'g')), '\s+(?:and|&)\s+|,\s*'), lambda n: trim(n)), lambda n: regexp_matches(n, '^[A-Z]'))"
_NOT_AUTHORS = ", ".join(f"'{w}'" for w in C.NOT_AUTHORS)
_LEAD = r"regexp_split_to_array(marker, '\s+\(')[1]"
_NARR = rf"""SELECT *, {_NAMES_OF.format(_LEAD)} AS a, regexp_extract_all(marker, '\d{{4}}[a-z]?') AS ys
  FROM ({_spans(C.NARRATIVE, _PAR)}) WHERE lower(rtrim(regexp_split_to_array(marker, '\s+')[1], ',')) NOT IN ({_NOT_AUTHORS})"""
_D04 = f"""WITH n AS ({_NARR}), y AS (SELECT *, unnest(ys) AS y FROM n)
  SELECT para_idx, CASE WHEN len(ys) > 1 THEN array_to_string(a, ', ') || ' (' || y || ')' ELSE marker END AS raw_marker, array_to_string(a, '+') AS authors, y AS year, start, "end" FROM y"""
_D06 = rf"""WITH p AS (SELECT para_idx, start, "end", unnest(regexp_extract_all(marker, '\d{{4}}[a-z]?')) AS y FROM ({_spans(C.PARENTHETICAL, _PAR)}) WHERE {_FALSE}),
  n AS (SELECT para_idx, start, "end", unnest(ys) AS y FROM ({_NARR})),
  b AS (SELECT para_idx, start, "end", unnest(string_split(translate(marker, '[] ', ''), ',')) AS part FROM ({_spans(C.BRACKET, _PAR)})),
  k AS (SELECT para_idx, start, "end", unnest(CASE WHEN contains(part, '-') THEN range(split_part(part, '-', 1)::INT, split_part(part, '-', 2)::INT + 1) ELSE [part::BIGINT] END) AS n FROM b),
  u AS (SELECT DISTINCT 'author_year_parenthetical' AS style, para_idx, start, "end", y, NULL::BIGINT AS number FROM p UNION ALL SELECT DISTINCT 'author_year_narrative', para_idx, start, "end", y, NULL FROM n UNION ALL SELECT DISTINCT 'numbered_bracket', para_idx, start, "end", NULL, n FROM k)
  SELECT style, count(*) AS n, count(DISTINCT para_idx) AS paragraphs, sum(number)::BIGINT AS numbers FROM u GROUP BY style"""
_SCOPE = r"rtrim(trim(regexp_replace(regexp_replace(text, '\s*\([^)]*\d{4}[a-z]?[^)]*\)', '', 'g'), '\s*\[\d+[^\]]*\]', '', 'g')), '.')"
_ANY = lambda words: "(" + " OR ".join(f"contains(lower(scope), '{w}')" for w in words) + ")"
_D08 = rf"""WITH s AS (SELECT para_idx, {_SCOPE} AS scope FROM ({_PAR})),
  k AS (SELECT *, CASE WHEN regexp_matches(scope, '\d+\.?\d*\s*%') OR regexp_matches(scope, '(?i)n\s*=\s*\d+') THEN 1 WHEN {_ANY(scopes.CONTRAST)} THEN 2 WHEN {_ANY(scopes.ATTRIBUTION)} THEN 3 WHEN {_ANY(scopes.METHOD)} THEN 4 WHEN {_ANY(scopes.BACKGROUND)} THEN 5 ELSE 6 END AS rule FROM s)
  SELECT para_idx, scope, ['factual', 'contrast', 'attribution', 'methodological', 'background', 'factual'][rule] AS claim_type, ['high', 'high', 'medium', 'medium', 'low', 'medium'][rule] AS priority FROM k"""
_FLAG = lambda k: " ".join(f"WHEN regexp_matches(sentence, '{r[0]}') THEN '{r[k]}'" for r in scopes.NEEDS_CITATION)
_F01 = rf"""WITH s AS (SELECT para_idx, unnest(regexp_split_to_array(text, '\. ')) AS sentence FROM ({_PAR}) WHERE lower(section) NOT IN ('acknowledgments')),
  b AS (SELECT * FROM s WHERE NOT regexp_matches(sentence, '\[\d|\(.*\d{{4}}') AND length(sentence) >= 25 AND {' AND '.join(f"NOT regexp_matches(sentence, '{p}')" for p in scopes.NEEDS_NO_CITATION)}),
  f AS (SELECT *, CASE {_FLAG(1)} END AS category, CASE {_FLAG(2)} END AS reason FROM b)
  SELECT para_idx, sentence, category, reason, 0.8::DOUBLE AS confidence FROM f WHERE category IS NOT NULL"""

QUERIES = {
    f.__name__: f
    for f in (
        c01_doi, c01_reference_headings, c02_year, c03_pmid, c04_doi_match, c05_split_references, c06_authors_title, c07_page_tags, c08_url_score, d01_bracket_spans, d02_expand_ranges, d03_author_year, d04_narrative,
        d05_style, d06_first_wins, d07_sentences, d08_claim_type, d24_sentence_context, e01_map_citations, e02_mapping_summary, e11_scopes, f01_missing_citations, f02_missing_in_manuscript, g01_duplicates_exact, g02_duplicates,
    )
}
ORACLE = {
    "c01_doi": f"SELECT session_id, ref_num, {_DOI} AS doi FROM ({_RAW})",
    "c01_reference_headings": r"""SELECT p_partkey, regexp_matches(CASE p_partkey % 5 WHEN 0 THEN 'Works  Cited ' WHEN 1 THEN ' REFERENCES' ELSE p_name END,
      '(?i)^\s*(references|bibliography|works\s+cited|literature\s+cited|reference\s+list|cited\s+literature|sources)\s*$') AS is_heading FROM part""",
    "c02_year": rf"SELECT session_id, ref_num, list_filter(list_transform(regexp_extract_all(raw_text, '\b((?:19|20)\d{{2}})\b', 1), lambda y: y::INT), lambda y: y BETWEEN 1900 AND 2030)[1] AS year FROM ({_RAW})",
    "c03_pmid": rf"SELECT session_id, ref_num, nullif(regexp_extract(raw_text, '(?i)(?:PMID|PubMed)[:\s]*(\d{{6,9}})', 1), '') AS pmid FROM ({_RAW})",
    "c04_doi_match": f"SELECT r.session_id, r.ref_num, coalesce(lower(r.doi) = lower({_DOI}), false) AS is_match FROM ({_REF}) r JOIN ({_RAW}) w USING (session_id, ref_num)",
    "c05_split_references": f"SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY ref_num)::INT AS ref_id, trim(raw_text) AS raw_text FROM ({_RAW})",
    "c07_page_tags": r"SELECT page_id, trim(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)) AS title, trim(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)) AS h1 FROM pages",
    "c08_url_score": """WITH u AS (SELECT page_id, lower(url || CASE page_id % 3 WHEN 0 THEN '/pdf/x' WHEN 1 THEN '/SI/full/' ELSE '/full/article/' END) AS u FROM pages)
      SELECT page_id, CASE WHEN contains(u, '_si_') OR contains(u, 'supplement') OR contains(u, '/si/') OR contains(u, 'supporting') OR contains(u, 'appendix') THEN 10
        ELSE 50 + 20 * (contains(u, '/pdf/')::INT + contains(u, '/full/')::INT + contains(u, '/article/')::INT) END AS score FROM u""",
    "d01_bracket_spans": _spans(C.BRACKET, _PAR),
    "d02_expand_ranges": """SELECT l_orderkey, l_linenumber, l_partkey, concat_ws(',', l_linenumber::VARCHAR,
      CASE WHEN l_suppkey % 9 >= l_partkey % 9 THEN array_to_string(range(l_partkey % 9, l_suppkey % 9 + 1), ',') END) AS numbers FROM lineitem""",
    "d03_author_year": _D03,
    "d04_narrative": _D04,
    "d06_first_wins": _D06,
    "d05_style": rf"""WITH p AS (SELECT session_id, text, row_number() OVER (PARTITION BY session_id ORDER BY para_idx) AS n FROM ({_PAR})),
      c AS (SELECT session_id, sum(len(regexp_extract_all(text, '\([A-Z][a-z]+.*?\d{{4}}'))) AS a, sum(len(regexp_extract_all(text, '\[\d+'))) AS b FROM p WHERE n <= 20 GROUP BY session_id)
      SELECT session_id, CASE WHEN a + b = 0 OR a > 0.8 * (a + b) THEN 'author_year' WHEN b > 0.8 * (a + b) THEN 'numbered' ELSE 'mixed' END AS style FROM c""",
    "d08_claim_type": _D08,
    "f01_missing_citations": _F01,
    "g01_duplicates_exact": f"""WITH d AS (SELECT session_id, ref_num, min(ref_num) OVER (PARTITION BY session_id, lower(surname) || (year % 5)) AS duplicate_of FROM ({_REF}))
      SELECT * FROM d WHERE duplicate_of < ref_num""",
}
