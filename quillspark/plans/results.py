"""Queries of the result and store operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.operators import results as R
from quillspark.operators import stores as S
from quillspark.operators.lineage import spread
from quillspark.plans.stand_ins import REFERENCES, VOTES, for_duckdb, load, stand_in

#: A verification is a vote's row; claims are orders.
VERIFICATIONS = """
SELECT unit_id AS claim_id, unit_id * 100 + vote_ord AS row_id, vote_ord AS reference_id, verdict, confidence, tier AS final_tier, confidence < 0.7 AS needs_review FROM (VOTES) v""".replace("VOTES", VOTES)
CLAIMS = """
SELECT o_orderkey AS claim_id, concat('claim ', CAST(o_orderkey AS STRING)) AS claim_text,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' WHEN o_orderpriority = '3-MEDIUM' THEN 'medium' ELSE 'low' END AS priority,
  o_custkey AS para_idx FROM {orders} WHERE o_orderkey % 10 <> 0"""
#: Two batches of overrides; some claims are in both.
CHANGES = "SELECT o_orderkey AS claim_id, 'supported' AS new_verdict FROM {orders} WHERE o_orderkey % 17 = 0"
CHANGES_AGAIN = "SELECT o_orderkey AS claim_id, 'contradicted' AS new_verdict FROM {orders} WHERE o_orderkey % 34 = 0 OR o_orderkey % 19 = 0"


def verifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    # dealt by claim in parts of bounded size, which the windows and joins by claim keep
    columns = "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate", "l_returnflag", "l_linestatus"
    return spark.sql(VERIFICATIONS, lineitem=spread(load(spark, sf_dir, "lineitem").select(*columns), "l_orderkey"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stand_in(spark, sf_dir, CLAIMS)


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stand_in(spark, sf_dir, REFERENCES)


def m01_verdict_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.verdict_summary(verifications(spark, sf_dir))


def m02_results_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = R.result_page(verifications(spark, sf_dir), claims(spark, sf_dir), "row_id", priority="high", min_confidence=0.7, number=2)
    return got.select("row_id", "claim_id", "verdict", "confidence", "claim_text", "priority")


def m03_best_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.best_verdict(claims(spark, sf_dir), verifications(spark, sf_dir))


def m04_critical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.findings(verifications(spark, sf_dir), claims(spark, sf_dir), R.CRITICAL).select("row_id", "verdict", "claim_text", "priority", "percent")


def m05_minor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.findings(verifications(spark, sf_dir), claims(spark, sf_dir), R.MINOR).select("row_id", "verdict", "claim_text", "priority", "percent")


def m06_gap_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.gap_dashboard(references(spark, sf_dir), ["session_id"])


def overridden(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = R.override(verifications(spark, sf_dir), stand_in(spark, sf_dir, CHANGES), "row_id")
    return R.override(once, stand_in(spark, sf_dir, CHANGES_AGAIN), "row_id")


def m07_override_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.report_diff(overridden(spark, sf_dir))


def m08_tier_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.tier_stats(verifications(spark, sf_dir))


def m09_reference_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.reference_page(references(spark, sf_dir), "found", 2, 20).select("session_id", "ref_num", "title", "total")


def placed_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.when(F.col("claim_id") % 7 > 0, F.col("para_idx"))
    return claims(spark, sf_dir).select("claim_id", place.alias("para_idx"), (F.col("claim_id") % 90).alias("char_start"), (F.col("claim_id") % 90 + 10).alias("char_end"), F.array(F.lit("[1]")).alias("citation_markers"), F.array("para_idx").alias("reference_ids"))


def m10_manuscript_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    paragraphs = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("para_idx"))
    mine = placed_claims(spark, sf_dir)
    view = R.manuscript_view(paragraphs, mine, R.best_verdict(mine, verifications(spark, sf_dir)))
    text = lambda c: F.concat_ws(":", c["claim_id"].cast("string"), c["char_start"].cast("string"), c["char_end"].cast("string"), F.get(c["citation_markers"], F.lit(0)), c["verdict"], c["confidence"].cast("string"), F.get(c["reference_ids"], F.lit(0)).cast("string"))
    return view.select("para_idx", F.array_join(F.transform("claims", text), ";").alias("claims"), "n_claims")


def m32_manuscript_legend(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = placed_claims(spark, sf_dir)
    return R.manuscript_legend(mine, R.best_verdict(mine, verifications(spark, sf_dir)))


def m33_claim_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = references(spark, sf_dir).filter("session_id = 's1'").select("ref_num", "title", F.array("surname", F.lit("Brown")).alias("authors"))
    rows = verifications(spark, sf_dir).select("claim_id", "row_id", F.col("reference_id").alias("ref_num"), "verdict", "confidence")
    found = R.claim_evidence(claims(spark, sf_dir).select("claim_id", "claim_text"), rows, refs, "row_id")
    text = lambda v: F.concat_ws("|", v["ref_num"].cast("string"), v["verdict"], v["reference_title"], F.array_join(v["reference_authors"], "+"))
    return found.select("claim_id", "claim_text", F.array_join(F.transform("verifications", text), ";").alias("evidence"))


def m16_reference_page_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = R.reference_page(references(spark, sf_dir), "all", 3, 25, sort="status").select("session_id", "ref_num", "source_status", "total")
    return page.withColumn("nth", F.row_number().over(Window.orderBy("source_status", "session_id", "ref_num")))


def in_sessions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Overridden verifications and claims of fifty sessions."""
    session = F.concat(F.lit("s"), (F.col("claim_id") % 50).cast("string"))
    return overridden(spark, sf_dir).withColumn("session_id", session), claims(spark, sf_dir)


def m38_report_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, mine = in_sessions(spark, sf_dir)
    preview = R.report_preview(rows, mine, references(spark, sf_dir), "row_id")
    sizes = [F.size(c).alias(f"n_{c}") for c in ("critical", "minor", "retracted")]
    first = lambda c, f: F.coalesce(F.get(c, F.lit(0))[f], F.lit("")).alias(f"first_{c}")
    return preview.select("session_id", *R.SEVERITY, "total", "overrides", *sizes, first("critical", "claim_text"), first("minor", "percent"), first("retracted", "title"))


def m44_not_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = references(spark, sf_dir).withColumns({"raw_text": F.concat(F.lit("raw "), "surname"), "title": F.when(F.col("ref_num") % 2 == 0, "").otherwise(F.col("title")), "pmid": F.when(F.col("ref_num") % 3 == 0, F.lit("7"))})
    return R.not_found_references(refs)


def m53_cost_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.when(F.col("final_tier") == 0, "0").otherwise(F.concat(F.lit("0>"), F.col("final_tier").cast("string")))
    rows = verifications(spark, sf_dir).withColumns({"escalation_path": path, "models_consulted": F.col("reference_id") % 4, "session_id": F.col("claim_id") % 20})
    return R.cost_section(rows, ["session_id"])


def m53_consensus_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("reference_id") == 1, "").when(F.col("reference_id") < 4, "majority").otherwise("unanimous")
    return R.consensus_counts(verifications(spark, sf_dir).withColumn("consensus_type", kind))


def b10_update_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("session_id"), F.lit("running").alias("status"), F.timestamp_seconds(F.lit(0)).alias("updated_at"))
    changes = load(spark, sf_dir, "lineitem").select((F.col("l_suppkey") * 2).alias("session_id"), F.concat(F.lit("stage "), F.col("l_linenumber").cast("string")).alias("status"), F.expr("l_orderkey * 10000000 + l_partkey * 10 + l_linenumber").alias("seq"))
    one = changes.groupBy("session_id", "seq").agg(F.max("status").alias("status"))
    return S.update_sessions(table, one, "seq", F.timestamp_seconds(F.lit(86400))).select("session_id", "status", F.unix_seconds("updated_at").alias("updated_at"))


def b20_cache_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    key = lambda n: (F.col("event_id") % n).cast("string").alias("key")
    old = events.groupBy(F.lit("api").alias("cache"), key(900)).agg(F.max("props").alias("value")).withColumn("expires_at", F.timestamp_seconds(F.lit(50)))
    new = events.filter("event_type = 'purchase'").select(F.when(F.col("event_id") % 2 == 0, "api").otherwise("llm").alias("cache"), key(700), F.col("event_type").alias("value"))
    return S.cache_put(old, new, F.timestamp_seconds(F.lit(100)), 3600).select("cache", "key", "value", F.unix_seconds("expires_at").alias("expires_at"))


def m06_override_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overridden(spark, sf_dir).filter("overridden").select("claim_id", "row_id", "original_verdict", "original_confidence", "needs_review")


def m11_review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.review_queue(overridden(spark, sf_dir)).select("row_id", "claim_id", "verdict")


def m37_flagged_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.flagged_references(references(spark, sf_dir)).select("session_id", "ref_num", "title", "retraction_status")


def m43_pdf_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.report_table(R.pdf_status(references(spark, sf_dir)).withColumn("authors", F.array("surname", F.lit("Brown"), F.lit("Gear"))))


def u01_highlight_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("para_idx"), (F.col("l_partkey") % 200).alias("start"), (F.col("l_partkey") % 200 + F.col("l_linenumber") * 10).alias("end"))
    return R.sweep_highlights(spans)


def b01_replace_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = references(spark, sf_dir).select("session_id", "ref_num", "title")
    new = load(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), (F.col("s_suppkey") % 60).cast("string")).alias("session_id"), (F.col("s_suppkey") + 10000).alias("ref_num"), F.col("s_name").alias("title"))
    return S.replace_sessions(table, new)


def b02_cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    gone = orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("session_id"))
    left = S.cascade_delete({"claims": orders.withColumn("session_id", F.col("o_orderkey")), "votes": lines.withColumn("session_id", F.col("l_orderkey"))}, gone)
    one = lambda name: left[name].groupBy(F.lit(name).alias("table_name")).agg(F.count(F.lit(1)).alias("n"))
    return one("claims").union(one("votes"))


def b03_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = references(spark, sf_dir).select("session_id", "ref_num", "title", "pdf_path")
    changes = load(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("s"), (F.col("l_partkey") % 50).cast("string")).alias("session_id"),
        (F.floor(F.col("l_partkey") / 50) + 1).cast("long").alias("ref_num"),
        F.when(F.col("l_quantity") > 25, F.concat(F.lit("changed "), F.col("l_orderkey").cast("string"))).alias("title"),
        (F.col("l_orderkey") * 1000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )
    one = spread(changes, "session_id", "ref_num").groupBy("session_id", "ref_num", "seq").agg(F.max("title").alias("title"))
    return S.upsert(table, one, ["session_id", "ref_num"], "seq")


def i03_library_populate(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = references(spark, sf_dir).withColumn("lib_key", S.library_key(F.when(F.col("ref_num") % 2 == 0, F.col("doi")), F.when(F.col("ref_num") % 3 == 0, F.col("title")), F.col("p_partkey")))
    library = keyed.filter("ref_num <= 5 and pdf_path is not null").groupBy("lib_key").agg(F.min("pdf_path").alias("path"))
    return S.populate_library(library, keyed)


def b25_cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = load(spark, sf_dir, "events").select(F.col("event_type").alias("cache"), F.col("props").alias("value"))
    return S.cache_stats(cache)


_R = f"WITH r AS ({for_duckdb(VERIFICATIONS)}), c AS ({for_duckdb(CLAIMS)}), ch AS (SELECT claim_id, coalesce(b.new_verdict, a.new_verdict) AS new_verdict FROM ({for_duckdb(CHANGES)}) a FULL JOIN ({for_duckdb(CHANGES_AGAIN)}) b USING (claim_id)), f AS ({for_duckdb(REFERENCES)})"
_SEV = "CASE verdict WHEN 'contradicted' THEN 0 WHEN 'not_supported' THEN 1 WHEN 'partially_supported' THEN 2 WHEN 'cannot_verify' THEN 3 WHEN 'supported' THEN 4 ELSE 5 END"
_FINDINGS = _R + " SELECT row_id, verdict, coalesce(claim_text, '') AS claim_text, coalesce(priority, '') AS priority, printf('%.0f%%', confidence * 100) AS percent FROM r LEFT JOIN c USING (claim_id) WHERE verdict IN ({})"
_PLACED = "p AS (SELECT claim_id, CASE WHEN claim_id % 7 > 0 THEN para_idx END AS para_idx, claim_id % 90 AS s, para_idx AS ref FROM c)"
_BEST = f"b AS (SELECT c.claim_id, coalesce(['contradicted', 'not_supported', 'partially_supported', 'cannot_verify', 'supported'][min({_SEV}) FILTER (verdict IS NOT NULL) + 1], 'pending') AS verdict, coalesce(max(confidence), 0.0) AS confidence FROM c LEFT JOIN r USING (claim_id) GROUP BY c.claim_id)"
_OVER = "o AS (SELECT r.*, CASE WHEN row_number() OVER (PARTITION BY claim_id ORDER BY row_id) = 1 AND new_verdict IS NOT NULL THEN new_verdict END AS nv FROM r LEFT JOIN ch USING (claim_id))"

QUERIES = {
    f.__name__: f
    for f in (
        m01_verdict_summary, m02_results_page, m03_best_verdict, m04_critical, m05_minor, m06_gap_dashboard, m07_override_diff, m08_tier_stats, m09_reference_page, m10_manuscript_view,
        m32_manuscript_legend, m33_claim_evidence, m16_reference_page_by_status, m38_report_preview, m44_not_found, m53_cost_section, m53_consensus_types, b10_update_sessions, b20_cache_put, m06_override_confidence,
        m11_review_queue, m37_flagged_references, m43_pdf_status, u01_highlight_sweep, b01_replace_session, b02_cascade_delete, b03_upsert, b25_cache_stats, i03_library_populate,
    )
}
ORACLE = {
    "m01_verdict_summary": f"""{_R} SELECT count(*) FILTER (verdict = 'contradicted') AS contradicted, count(*) FILTER (verdict = 'not_supported') AS not_supported, count(*) FILTER (verdict = 'cannot_verify') AS cannot_verify,
      count(*) FILTER (verdict = 'partially_supported') AS partially_supported, count(*) FILTER (verdict = 'supported') AS supported, count(*) AS total FROM r""",
    "m02_results_page": f"{_R} SELECT row_id, claim_id, verdict, confidence, claim_text, priority FROM r JOIN c USING (claim_id) WHERE priority = 'high' AND confidence >= 0.7 ORDER BY {_SEV}, row_id LIMIT 50 OFFSET 50",
    "m03_best_verdict": f"{_R}, {_BEST} SELECT * FROM b",
    "m04_critical": _FINDINGS.format("'not_supported', 'contradicted'"),
    "m05_minor": _FINDINGS.format("'partially_supported'"),
    "m06_gap_dashboard": f"""{_R} SELECT session_id, count(*) AS total, count(*) FILTER (source_status = 'found') AS found, count(*) FILTER (source_status = 'not_found') AS not_found, count(pdf_path) AS with_pdf,
      count(*) FILTER (journal_url IS NOT NULL AND pdf_path IS NULL) AS paywalled, count(*) FILTER (retraction_status IN ('retracted', 'expression_of_concern')) AS flagged FROM f GROUP BY session_id""",
    "m07_override_diff": f"{_R}, {_OVER} SELECT claim_id, verdict AS original_verdict, nv AS new_verdict FROM o WHERE nv IS NOT NULL",
    "m08_tier_stats": f"{_R} SELECT final_tier, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM r), 1)::DOUBLE AS percent FROM r GROUP BY final_tier",
    "m09_reference_page": f"{_R} SELECT session_id, ref_num, title, (SELECT count(*) FROM f WHERE source_status = 'found') AS total FROM f WHERE source_status = 'found' ORDER BY session_id, ref_num LIMIT 20 OFFSET 20",
    "m10_manuscript_view": f"""{_R}, {_BEST}, {_PLACED}, l AS (SELECT para_idx, string_agg(claim_id || ':' || s || ':' || (s + 10) || ':[1]:' || b.verdict || ':' || b.confidence || ':' || ref, ';' ORDER BY claim_id) AS claims, count(*) AS n FROM p JOIN b USING (claim_id) WHERE para_idx IS NOT NULL GROUP BY para_idx)
      SELECT c_custkey AS para_idx, coalesce(claims, '') AS claims, coalesce(n, 0) AS n_claims FROM customer LEFT JOIN l ON para_idx = c_custkey""",
    "m32_manuscript_legend": f"{_R}, {_BEST}, {_PLACED} SELECT verdict, count(*) AS n, count(*) FILTER (para_idx IS NULL) AS unmapped FROM p JOIN b USING (claim_id) GROUP BY verdict",
    "m33_claim_evidence": f"""{_R}, t AS (SELECT ref_num, title, surname FROM f WHERE session_id = 's1'),
      e AS (SELECT claim_id, string_agg(reference_id || '|' || verdict || '|' || coalesce(title, '') || '|' || coalesce(surname || '+Brown', ''), ';' ORDER BY row_id) AS evidence FROM r LEFT JOIN t ON ref_num = reference_id GROUP BY claim_id)
      SELECT claim_id, claim_text, coalesce(evidence, '') AS evidence FROM c LEFT JOIN e USING (claim_id)""",
    "m16_reference_page_by_status": f"{_R}, p AS (SELECT session_id, ref_num, source_status, (SELECT count(*) FROM f) AS total FROM f ORDER BY session_id, ref_num LIMIT 25 OFFSET 50) SELECT *, row_number() OVER (ORDER BY source_status, session_id, ref_num) AS nth FROM p",
    "m38_report_preview": f"""{_R}, {_OVER}, v AS (SELECT 's' || (claim_id % 50) AS session_id, row_id, claim_id, coalesce(nv, verdict) AS verdict, confidence, nv IS NOT NULL AS overridden FROM o),
      w AS (SELECT v.*, coalesce(claim_text, '') AS claim_text, printf('%.0f%%', confidence * 100) AS percent FROM v LEFT JOIN c USING (claim_id)),
      x AS (SELECT session_id, count(*) AS n, arg_min(title, ref_num) AS title FROM f WHERE retraction_status NOT IN ('ok', 'unknown') GROUP BY session_id)
      SELECT session_id, count(*) FILTER (verdict = 'contradicted') AS contradicted, count(*) FILTER (verdict = 'not_supported') AS not_supported, count(*) FILTER (verdict = 'cannot_verify') AS cannot_verify, count(*) FILTER (verdict = 'partially_supported') AS partially_supported,
        count(*) FILTER (verdict = 'supported') AS supported, count(*) AS total, count(*) FILTER (overridden) AS overrides, count(*) FILTER (verdict IN ('not_supported', 'contradicted')) AS n_critical, count(*) FILTER (verdict = 'partially_supported') AS n_minor,
        coalesce(any_value(x.n), 0) AS n_retracted, coalesce(arg_min(claim_text, row_id) FILTER (verdict IN ('not_supported', 'contradicted')), '') AS first_critical, coalesce(arg_min(percent, row_id) FILTER (verdict = 'partially_supported'), '') AS first_minor, coalesce(any_value(x.title), '') AS first_retracted
      FROM w LEFT JOIN x USING (session_id) GROUP BY session_id""",
    "m44_not_found": f"{_R} SELECT session_id, ref_num, CASE WHEN ref_num % 2 = 0 THEN 'raw ' || surname ELSE title END AS display, doi AS searched_doi, CASE WHEN ref_num % 3 = 0 THEN '7' END AS searched_pmid FROM f WHERE source_status = 'not_found'",
    "m53_cost_section": f"{_R} SELECT claim_id % 20 AS session_id, count(*) AS total, sum(reference_id % 4)::BIGINT AS model_calls, count(*) FILTER (final_tier > 0) AS escalated, round(100.0 * count(*) FILTER (final_tier > 0) / count(*), 1)::DOUBLE AS escalated_percent FROM r GROUP BY claim_id % 20",
    "m53_consensus_types": f"{_R} SELECT CASE WHEN reference_id < 4 THEN 'majority' ELSE 'unanimous' END AS consensus_type, count(*) AS n FROM r WHERE reference_id <> 1 GROUP BY 1",
    "b10_update_sessions": """WITH k AS (SELECT l_suppkey * 2 AS session_id, arg_max('stage ' || l_linenumber, l_orderkey * 10000000 + l_partkey * 10 + l_linenumber) AS status FROM lineitem GROUP BY l_suppkey)
      SELECT s_suppkey AS session_id, coalesce(k.status, 'running') AS status, CASE WHEN k.status IS NULL THEN 0 ELSE 86400 END AS updated_at FROM supplier LEFT JOIN k ON session_id = s_suppkey""",
    "b20_cache_put": """WITH n AS (SELECT DISTINCT CASE WHEN event_id % 2 = 0 THEN 'api' ELSE 'llm' END AS cache, (event_id % 700)::VARCHAR AS key FROM events WHERE event_type = 'purchase'),
      o AS (SELECT 'api' AS cache, (event_id % 900)::VARCHAR AS key, max(props) AS value FROM events GROUP BY event_id % 900)
      SELECT cache, key, 'purchase' AS value, 3700 AS expires_at FROM n UNION ALL SELECT cache, key, value, 50 FROM o ANTI JOIN n USING (cache, key)""",
    "m06_override_confidence": f"{_R}, {_OVER} SELECT claim_id, row_id, verdict AS original_verdict, confidence AS original_confidence, false AS needs_review FROM o WHERE nv IS NOT NULL",
    "m11_review_queue": f"{_R}, {_OVER} SELECT row_id, claim_id, verdict FROM o WHERE needs_review AND nv IS NULL",
    "m37_flagged_references": f"{_R} SELECT session_id, ref_num, title, retraction_status FROM f WHERE retraction_status NOT IN ('ok', 'unknown')",
    "m43_pdf_status": f"{_R} SELECT session_id, ref_num, title, surname || ', Brown' AS authors, source_status, CASE WHEN pdf_path IS NOT NULL THEN 'pdf' WHEN journal_url IS NOT NULL THEN 'paywalled' ELSE 'missing' END AS pdf_status FROM f",
    "u01_highlight_sweep": """WITH s AS (SELECT l_orderkey AS p, l_partkey % 200 AS a, l_partkey % 200 + l_linenumber * 10 AS b FROM lineitem),
      m AS (SELECT p, greatest(a, coalesce(max(b) OVER (PARTITION BY p ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS a, b FROM s) SELECT p AS para_idx, a AS start, b AS "end" FROM m WHERE a < b""",
    "b01_replace_session": f"""{_R}, n AS (SELECT 's' || (s_suppkey % 60) AS session_id, s_suppkey + 10000 AS ref_num, s_name AS title FROM supplier)
      SELECT session_id, ref_num, title FROM f ANTI JOIN n USING (session_id) UNION ALL SELECT * FROM n""",
    "b02_cascade_delete": """SELECT 'claims' AS table_name, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' UNION ALL
      SELECT 'votes', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""",
    "b03_upsert": f"""{_R}, k AS (SELECT 's' || (l_partkey % 50) AS session_id, (l_partkey // 50) + 1 AS ref_num, l_orderkey * 1000 + l_suppkey * 10 + l_linenumber AS seq, max(CASE WHEN l_quantity > 25 THEN 'changed ' || l_orderkey END) AS t FROM lineitem GROUP BY ALL),
      n AS (SELECT session_id, ref_num, arg_max(struct_pack(t := t), seq) AS s FROM k GROUP BY session_id, ref_num)
      SELECT session_id, ref_num, coalesce(s.t, title) AS title, pdf_path FROM f FULL JOIN n USING (session_id, ref_num)""",
    "b25_cache_stats": "SELECT event_type AS cache, count(*) AS entries, sum(strlen(props))::BIGINT AS bytes FROM events GROUP BY event_type",
    "i03_library_populate": f"""{_R}, k AS (SELECT *, CASE WHEN ref_num % 2 = 0 THEN 'doi_' || substr(sha256(lower(trim(doi))), 1, 16) WHEN ref_num % 3 = 0 THEN 'title_' || substr(sha256(lower(trim(title))), 1, 16) ELSE 'ref_' || p_partkey END AS lib_key FROM f)
      SELECT lib_key, min(pdf_path) AS path FROM k WHERE pdf_path IS NOT NULL AND lib_key NOT IN (SELECT lib_key FROM k WHERE ref_num <= 5 AND pdf_path IS NOT NULL) GROUP BY lib_key""",
}
