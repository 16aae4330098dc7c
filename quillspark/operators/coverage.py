"""Citations against the reference list: what is cited, never cited or unresolved, and which citations are ambiguous.

Extensions: the reference specifies these reports and does not compute them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions.fold import last_name, plain_name
from quillspark.operators.mapping import year_number

CITED, NEVER_CITED, UNRESOLVED = "cited", "never_cited", "unresolved"


def reconcile(citations: DataFrame, references: DataFrame) -> DataFrame:
    """(session_id, ref_num, state, citations): the full outer join of what is cited and what is listed.

    ``citations``: session_id, ref_num, null or 0 where nothing was found. A number that the list doesn't have is
    unresolved, and so are, in one row a session under a null number, citations without any. They are counted before they meet.
    """
    number = F.nullif(F.col("ref_num").cast("long"), F.lit(0).cast("long"))
    cited = citations.groupBy("session_id", number.alias("ref_num")).agg(F.count(F.lit(1)).alias("citations"))
    listed = references.select("session_id", F.col("ref_num").cast("long").alias("ref_num")).distinct().withColumn("listed", F.lit(True))
    both = cited.join(listed, ["session_id", "ref_num"], "full")
    state = F.when(F.col("listed").isNull(), UNRESOLVED).when(F.col("citations").isNull(), NEVER_CITED).otherwise(CITED)
    return both.select("session_id", "ref_num", state.alias("state"), F.coalesce("citations", F.lit(0)).alias("citations"))


def share(part, whole):
    """In percent, one digit; null of nothing."""
    return F.round(100.0 * part / F.nullif(whole, F.lit(0)), 1)


def citation_coverage(citations: DataFrame, references: DataFrame) -> DataFrame:
    """(session_id, section, level, total, mapped, unresolved, mapped_percent, cited_references): by section, by session and in all.

    ``level``: 0 a section of a session, 1 a session, 3 everything. ``citations`` also has ``section``.
    """
    listed = references.select("session_id", F.col("ref_num").cast("long").alias("ref_num")).distinct().withColumn("listed", F.lit(True))
    some = citations.groupBy("session_id", "section", F.col("ref_num").cast("long").alias("ref_num")).agg(F.count(F.lit(1)).alias("n"))
    known = some.join(listed, ["session_id", "ref_num"], "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    totals = known.rollup("session_id", "section").agg(
        F.grouping_id().cast("int").alias("level"),
        F.sum("n").alias("total"),
        F.coalesce(F.sum(F.when(F.col("listed"), F.col("n"))), F.lit(0)).alias("mapped"),
        F.count_distinct(F.when(F.col("listed"), F.struct("session_id", "ref_num"))).alias("cited_references"),
    )
    return totals.select("session_id", "section", "level", "total", "mapped", (F.col("total") - F.col("mapped")).alias("unresolved"), share(F.col("mapped"), F.col("total")).alias("mapped_percent"), "cited_references")


def reference_coverage(citations: DataFrame, references: DataFrame) -> DataFrame:
    """(session_id, listed, cited, never_cited, unresolved_citations, cited_percent) of each session."""
    found = reconcile(citations, references)
    out = found.groupBy("session_id").agg(
        F.count_if(F.col("state") != UNRESOLVED).alias("listed"), F.count_if(F.col("state") == CITED).alias("cited"), F.count_if(F.col("state") == NEVER_CITED).alias("never_cited"),
        F.coalesce(F.sum(F.when(F.col("state") == UNRESOLVED, F.col("citations"))), F.lit(0)).alias("unresolved_citations"),
    )
    return out.withColumn("cited_percent", share(F.col("cited"), F.col("listed")))


def candidates(citations: DataFrame, references: DataFrame) -> DataFrame:
    """(cit_key, ref_num, suffix, n_candidates, is_ambiguous): the references that an author-year citation may mean.

    ``citations``: cit_key, session_id, authors, year. ``references``: session_id, ref_num, authors, year. References of
    one first author and year are ranked by number; a citation with a letter means the one of that rank. Without
    a letter, or with one that goes beyond the list, all of them come out, flagged if there are several.
    """
    refs = references.select("session_id", "ref_num", F.col("year").cast("int").alias("y"), plain_name(last_name(F.get("authors", F.lit(0)))).alias("name")).filter("y IS NOT NULL AND name IS NOT NULL")
    same = Window.partitionBy("session_id", "name", "y")
    ranked = refs.distinct().withColumns({"place": F.row_number().over(same.orderBy("ref_num")), "n": F.count(F.lit(1)).over(same)})
    letter = F.nullif(F.regexp_extract("year", r"\d([a-j])$", 1), F.lit(""))
    cits = citations.select("cit_key", "session_id", year_number(F.col("year")).alias("y"), plain_name(F.get("authors", F.lit(0))).alias("name"), letter.alias("suffix"))
    met = cits.withColumn("wanted", F.ascii("suffix") - 96).join(ranked, ["session_id", "name", "y"])
    by_letter = F.col("wanted").isNotNull() & (F.col("wanted") <= F.col("n"))
    meant = met.filter(~F.coalesce(by_letter, F.lit(False)) | (F.col("place") == F.col("wanted")))
    left = F.when(F.coalesce(by_letter, F.lit(False)), 1).otherwise(F.col("n"))
    return meant.select("cit_key", F.col("ref_num").cast("long").alias("ref_num"), "suffix", left.cast("long").alias("n_candidates"), (left > 1).alias("is_ambiguous"))
