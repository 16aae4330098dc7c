"""Result queries: summaries, filtered and sorted pages, severity, overrides, dashboards and report tables.

Paging never sorts a whole table into one task for its row numbers: a page is
a sort with offset and limit, which Spark runs as a top-k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Verdicts from most to least severe, and priorities.
SEVERITY = ("contradicted", "not_supported", "partially_supported", "cannot_verify", "supported")
PRIORITY = ("high", "medium", "low")
CRITICAL, MINOR = ("not_supported", "contradicted"), ("partially_supported",)


def rank(column: Column, order: tuple[str, ...]) -> Column:
    """Place in ``order``; values outside it come last."""
    out = F.lit(len(order))
    for i, v in reversed(list(enumerate(order))):
        out = F.when(column == v, i).otherwise(out)
    return out


def verdict_summary(verifications: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of each verdict, 0 where there is none, and the total."""
    return verifications.groupBy(*(by or [])).agg(*(F.count_if(F.col("verdict") == v).alias(v) for v in SEVERITY), F.count(F.lit(1)).alias("total"))


def with_claims(verifications: DataFrame, claims: DataFrame) -> DataFrame:
    """Verifications with their claims' text, type and priority; empty text where the claim is missing."""
    joined = verifications.join(claims, "claim_id", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit("")) for c in claims.columns if c != "claim_id"})


def filter_results(items: DataFrame, verdict: str = "", priority: str = "", min_confidence: float = 0.0) -> DataFrame:
    if verdict:
        items = items.filter(F.col("verdict") == verdict)
    if priority:
        items = items.filter(F.col("priority") == priority)
    if min_confidence > 0:
        items = items.filter(F.col("confidence") >= min_confidence)
    return items


def sort_keys(sort: str, row_id: str) -> list[Column]:
    """Order of a result page; ``row_id`` keeps equal rows in their first order."""
    keys = {
        "confidence": [F.desc("confidence")],
        "priority": [rank(F.col("priority"), PRIORITY)],
        "ref_id": [F.col("reference_id")],
    }
    return [*keys.get(sort, [rank(F.col("verdict"), SEVERITY)]), F.col(row_id)]


def page(df: DataFrame, keys: list[Column], number: int, per_page: int) -> DataFrame:
    """Rows of a page (from 1) in the order of ``keys``."""
    return df.orderBy(*keys).offset((number - 1) * per_page).limit(per_page)


def result_page(verifications: DataFrame, claims: DataFrame, row_id: str, sort: str = "verdict", number: int = 1, per_page: int = 50, **filters) -> DataFrame:
    """A filtered, sorted page of verifications with their claims."""
    if not filters.get("priority") and sort != "priority":
        # the claims decide nothing: join them to the page alone
        return with_claims(page(filter_results(verifications, **filters), sort_keys(sort, row_id), number, per_page), claims)
    return page(filter_results(with_claims(verifications, claims), **filters), sort_keys(sort, row_id), number, per_page)


def best_verdict(claims: DataFrame, verifications: DataFrame) -> DataFrame:
    """Each claim's most severe verdict and largest confidence; ``pending`` without a verification."""
    worst = verifications.groupBy("claim_id").agg(F.min(rank(F.col("verdict"), SEVERITY)).alias("r"), F.max("confidence").alias("confidence"))
    names = F.array(*map(F.lit, SEVERITY))
    return claims.select("claim_id").join(worst, "claim_id", "left").select(
        "claim_id", F.coalesce(F.get(names, F.col("r")), F.lit("pending")).alias("verdict"), F.coalesce("confidence", F.lit(0.0)).alias("confidence")
    )


def findings(verifications: DataFrame, claims: DataFrame, verdicts: tuple[str, ...]) -> DataFrame:
    """Verifications with one of ``verdicts``, with the claim's text and the confidence as a percentage."""
    return with_claims(verifications.filter(F.col("verdict").isin(*verdicts)), claims).withColumn("percent", F.concat(F.bround(F.col("confidence") * 100, 0).cast("int").cast("string"), F.lit("%")))


def gap_dashboard(references: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of found, missing and troubled references."""
    paywalled = F.col("journal_url").isNotNull() & F.col("pdf_path").isNull()
    return references.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("source_status") == "found").alias("found"),
        F.count_if(F.col("source_status") == "not_found").alias("not_found"),
        F.count_if(F.col("pdf_path").isNotNull()).alias("with_pdf"),
        F.count_if(paywalled).alias("paywalled"),
        F.count_if(F.col("retraction_status").isin("retracted", "expression_of_concern")).alias("flagged"),
    )


def pdf_status(references: DataFrame) -> DataFrame:
    """What a report says of each reference's source."""
    status = F.when(F.col("pdf_path").isNotNull(), "pdf").when(F.col("journal_url").isNotNull(), "paywalled").otherwise("missing")
    return references.withColumn("pdf_status", status)


def flagged_references(references: DataFrame) -> DataFrame:
    return references.filter(~F.col("retraction_status").isin("ok", "unknown"))


def override(verifications: DataFrame, changes: DataFrame, row_id: str) -> DataFrame:
    """Apply ``changes`` (claim_id, new_verdict): the first row of the claim changes and needs no review any more.

    Rows keep their very first verdict and confidence as the original ones, however often they are overridden, and what
    earlier changes did to other rows stays. ``override_history`` keeps all versions.
    """
    first = F.row_number().over(Window.partitionBy("claim_id").orderBy(row_id)) == 1
    marked = verifications.withColumn("is_first", first).join(changes, "claim_id", "left")
    hit = F.col("is_first") & F.col("new_verdict").isNotNull()
    had = lambda c, default: F.col(c) if c in verifications.columns else default
    before = had("overridden", F.lit(False))
    kept = lambda c: F.when(before, had(f"original_{c}", F.lit(None))).when(hit, F.col(c))
    now = {"original_verdict": kept("verdict"), "verdict": F.when(hit, F.col("new_verdict")).otherwise(F.col("verdict")), "overridden": before | hit}
    if "confidence" in verifications.columns:
        now["original_confidence"] = kept("confidence")
    if "needs_review" in verifications.columns:
        now["needs_review"] = F.col("needs_review") & ~hit
    return marked.withColumns(now).drop("is_first", "new_verdict")


def override_history(verifications: DataFrame, changes: DataFrame, row_id: str) -> DataFrame:
    """(claim_id, row_id, version, verdict, reason, valid_from, valid_to): what each row said, and from when to when.

    ``changes``: claim_id, new_verdict, reason, changed_at, in any number of batches together; changes of unknown claims
    are ignored, and of several at one time the last verdict by name counts last. Version 0 is a row as it was verified;
    the first row of a claim has a version more for each change. The open version's ``valid_to`` is null.
    """
    first = F.row_number().over(Window.partitionBy("claim_id").orderBy(row_id)) == 1
    rows = verifications.withColumn("is_first", first)
    none = lambda kind: F.lit(None).cast(kind)
    when = changes.schema["changed_at"].dataType
    made = rows.select("claim_id", row_id, "verdict", none("string").alias("reason"), none(when).alias("valid_from"))
    changed = rows.filter("is_first").select("claim_id", row_id).join(changes, "claim_id").select("claim_id", row_id, F.col("new_verdict").alias("verdict"), "reason", F.col("changed_at").alias("valid_from"))
    order = Window.partitionBy("claim_id", row_id).orderBy(F.col("valid_from").asc_nulls_first(), "verdict", "reason")
    return made.unionByName(changed).select("claim_id", row_id, (F.row_number().over(order) - 1).alias("version"), "verdict", "reason", "valid_from", F.lead("valid_from").over(order).alias("valid_to"))


def verdicts_at(history: DataFrame, moment: Column | None = None) -> DataFrame:
    """The versions of ``override_history`` that were valid at a moment (from ``valid_from`` on, before ``valid_to``), or are now."""
    if moment is None:
        return history.filter("valid_to IS NULL")
    return history.filter((F.col("valid_from").isNull() | (F.col("valid_from") <= moment)) & (F.col("valid_to").isNull() | (moment < F.col("valid_to"))))


def report_diff(verifications: DataFrame) -> DataFrame:
    """Overridden rows: original and new verdict."""
    return verifications.filter("overridden").select("claim_id", "original_verdict", F.col("verdict").alias("new_verdict"))


def review_queue(verifications: DataFrame) -> DataFrame:
    """Rows that need review and were not overridden."""
    return verifications.filter(F.col("needs_review") & ~F.col("overridden"))


def tier_stats(verifications: DataFrame) -> DataFrame:
    """Rows by final tier, with their share in percent (one digit)."""
    counts = verifications.groupBy("final_tier").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 1))


def cost_section(verifications: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals of a report's cost section: verifications, model calls, and those that went beyond one tier, with their share in percent."""
    escalated = F.count_if(F.size(F.split("escalation_path", ">")) > 1)
    totals = verifications.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("total"), F.sum("models_consulted").alias("model_calls"), escalated.alias("escalated"))
    return totals.withColumn("escalated_percent", F.round(100.0 * F.col("escalated") / F.col("total"), 1))


def consensus_counts(verifications: DataFrame) -> DataFrame:
    """(consensus_type, n), the most frequent first."""
    return verifications.filter(F.col("consensus_type") != "").groupBy("consensus_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "consensus_type")


def reference_page(references: DataFrame, status: str = "", number: int = 1, per_page: int = 50, sort: str = "id") -> DataFrame:
    """A page of one session's references by number, with the total before paging; ``sort="status"`` orders the page's rows only."""
    chosen = references.filter(F.col("source_status") == status) if status and status != "all" else references
    total = chosen.agg(F.count(F.lit(1)).alias("total"))
    keys = [F.col("session_id"), F.col("ref_num")]
    rows = page(chosen, keys, number, per_page).withColumn("total", total.scalar())
    return rows.orderBy("source_status", *keys) if sort == "status" else rows


def group_verifications(verifications: DataFrame, row_id: str) -> DataFrame:
    """(claim_id, verifications): each claim's rows in their first order."""
    rest = [c for c in verifications.columns if c not in ("claim_id", row_id)]
    return verifications.groupBy("claim_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(row_id, *rest))), lambda x: F.struct(*(x[c].alias(c) for c in rest))).alias("verifications"))


def manuscript_view(paragraphs: DataFrame, claims: DataFrame, best: DataFrame) -> DataFrame:
    """Paragraphs with their claims: structs of claim_id, place, markers, verdict, largest confidence and reference ids, in claim order.

    ``claims``: claim_id, para_idx, char_start, char_end, citation_markers, reference_ids; ``best``: claim_id, verdict, confidence.
    """
    placed = claims.filter("para_idx IS NOT NULL").join(best.select("claim_id", "verdict", "confidence"), "claim_id", "left")
    placed = placed.withColumns({"verdict": F.coalesce("verdict", F.lit("pending")), "confidence": F.coalesce("confidence", F.lit(0.0))})
    one = F.struct("claim_id", "char_start", "char_end", "citation_markers", "verdict", "confidence", "reference_ids")
    lists = placed.groupBy("para_idx").agg(F.array_sort(F.collect_list(one)).alias("claims"))
    joined = paragraphs.join(lists, "para_idx", "left")
    none = F.array().cast(lists.schema["claims"].dataType)
    return joined.withColumn("claims", F.coalesce("claims", none)).withColumn("n_claims", F.size("claims"))


def manuscript_legend(claims: DataFrame, best: DataFrame) -> DataFrame:
    """(verdict, n, unmapped): claims by verdict, and how many of them have no place."""
    known = claims.select("claim_id", "para_idx").join(best.select("claim_id", "verdict"), "claim_id", "left")
    return known.groupBy(F.coalesce("verdict", F.lit("pending")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("para_idx").isNull()).alias("unmapped"))


def unmapped_claims(claims: DataFrame) -> DataFrame:
    return claims.filter("para_idx IS NULL").select("claim_id")


def verification_evidence(verifications: DataFrame, references: DataFrame) -> DataFrame:
    """Verifications with their reference's title and authors, empty where the reference is missing."""
    chosen = references.select("ref_num", F.col("title").alias("reference_title"), F.col("authors").alias("reference_authors"))
    joined = verifications.join(chosen, "ref_num", "left")
    return joined.withColumns({"reference_title": F.coalesce("reference_title", F.lit("")), "reference_authors": F.coalesce("reference_authors", F.array().cast("array<string>"))})


def claim_evidence(claims: DataFrame, verifications: DataFrame, references: DataFrame, row_id: str) -> DataFrame:
    """Claims with an array of their verifications' evidence, in first order; empty without a verification."""
    grouped = group_verifications(verification_evidence(verifications, references), row_id)
    return claims.join(grouped, "claim_id", "left").withColumn("verifications", F.coalesce("verifications", F.array().cast(grouped.schema["verifications"].dataType)))


def report_preview(verifications: DataFrame, claims: DataFrame, references: DataFrame, row_id: str) -> DataFrame:
    """A row per session: verdict counts, critical findings, minor issues, troubled references and the number of overrides.

    Findings are structs of claim_id, claim_text, verdict and percent; a session's are as many as its manuscript has.
    """

    def listed(verdicts: tuple[str, ...], name: str) -> DataFrame:
        one = F.struct(row_id, "claim_id", "claim_text", "verdict", "percent")
        rows = findings(verifications, claims, verdicts).groupBy("session_id").agg(F.array_sort(F.collect_list(one)).alias("_l"))
        return rows.select("session_id", F.transform("_l", lambda x: F.struct(*(x[c].alias(c) for c in ("claim_id", "claim_text", "verdict", "percent")))).alias(name))

    totals = verifications.groupBy("session_id").agg(F.count_if("overridden").alias("overrides"))
    flagged = flagged_references(references).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("ref_num", "title", "retraction_status"))).alias("retracted"))
    out = verdict_summary(verifications, ["session_id"]).join(totals, "session_id")
    for part in (listed(CRITICAL, "critical"), listed(MINOR, "minor"), flagged):
        name = part.columns[1]
        out = out.join(part, "session_id", "left").withColumn(name, F.coalesce(name, F.array().cast(part.schema[name].dataType)))
    return out


def not_found_references(references: DataFrame) -> DataFrame:
    """References that no service knows, by title or else raw text, with the identifiers that were searched."""
    shown = F.coalesce(F.nullif("title", F.lit("")), "raw_text")
    return references.filter(F.col("source_status") == "not_found").select("session_id", "ref_num", shown.alias("display"), F.nullif("doi", F.lit("")).alias("searched_doi"), F.nullif("pmid", F.lit("")).alias("searched_pmid"))


def report_table(references: DataFrame) -> DataFrame:
    """Rows of the report's reference table: two authors at most."""
    return references.select("session_id", "ref_num", "title", F.array_join(F.slice("authors", 1, 2), ", ").alias("authors"), "source_status", "pdf_status")


def sweep_highlights(spans: DataFrame) -> DataFrame:
    """Spans (para_idx, start, end) without overlaps: each begins where those before it end; what nothing is left of goes."""
    before = Window.partitionBy("para_idx").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    clamped = F.greatest(F.col("start"), F.coalesce(F.max("end").over(before), F.lit(0)))
    return spans.withColumn("clamped", clamped).filter("clamped < end").select("para_idx", F.col("clamped").alias("start"), "end")
