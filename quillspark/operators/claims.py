"""Claims as a model gives them: checked, cleaned and placed in their paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions.similarity import window_match
from quillspark.functions.text import strip
from quillspark.operators.approximate_search import dealt, find_likest
from quillspark.operators.lineage import counted, stored

# Fixed values.
PRIORITY_OF_TYPE = {"factual": "high", "contrast": "high", "methodological": "medium", "background": "low", "attribution": "low", "interpretive": "low"}
LEAST_PARTIAL = 0.80
DECOMPOSED, NEAR_FIGURE = ("factual", "contrast"), 50
MARKER_IDS, FIGURE = r"\[(\d+(?:[,\-–\s]*\d+)*)\]", r"(?i)\b(?:Table|Figure|Fig\.)\s*\d*"
MOST_LISTED_AUTHORS = 3


def keep_valid_references(claims: DataFrame, references: DataFrame) -> DataFrame:
    """Claims (session_id, claim_id, reference_ids) with the ids that the session has, in order; claims without any go."""
    ids = claims.select("session_id", "claim_id", F.posexplode("reference_ids").alias("pos", "ref_num")).join(references.select("session_id", "ref_num").distinct(), ["session_id", "ref_num"])
    kept = ids.groupBy("session_id", "claim_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ref_num"))), lambda x: x["ref_num"]).alias("reference_ids"))
    return claims.drop("reference_ids").join(kept, ["session_id", "claim_id"])


def distinct_claims(claims: DataFrame) -> DataFrame:
    """The first claim of each session with the same text, ignoring case and outer white space, and the same reference ids, renumbered from 1."""
    key = [F.lower(strip(F.col("claim_text"))), F.array_sort("reference_ids")]
    nth = F.row_number().over(Window.partitionBy("session_id", *key).orderBy("claim_id"))
    once = claims.withColumn("_n", nth).filter("_n = 1").drop("_n")
    return once.withColumn("claim_number", F.row_number().over(Window.partitionBy("session_id").orderBy("claim_id")))


def default_priority(claims: DataFrame) -> DataFrame:
    out = F.lit("medium")
    for kind, priority in PRIORITY_OF_TYPE.items():
        out = F.when(F.col("claim_type") == kind, priority).otherwise(out)
    return claims.withColumn("priority", out)


def place_claims(claims: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(session_id, claim_id, para_idx, start, similarity): each claim's first paragraph that holds its text, else the one of the largest partial ratio (at least 0.8).

    The place within it is that of the likest window of the claim's length. Equal claims of a session are looked for once.
    Claims are stored, so that what makes their text runs once; paragraphs are read once, for their different texts.
    """
    asked = stored(claims.select("session_id", "claim_id", "claim_text"))
    found = find_likest(asked.select(F.col("session_id").alias("k"), F.col("claim_text").alias("query")), paragraphs.select(F.col("session_id").alias("k"), F.col("para_idx").alias("place"), "text"), 100 * LEAST_PARTIAL)
    at = F.instr("text", F.col("query"))
    exact = found.filter(at > 0).withColumn("start", at - 1)
    near = found.filter(at == 0)
    near = dealt(near, near.count(), "k", "query").withColumn("start", window_match(F.col("query"), F.col("text"))["start"])
    placed = exact.unionByName(near).select(F.col("k").alias("session_id"), F.col("query").alias("claim_text"), F.col("place").alias("para_idx"), "start", (F.col("score") / 100).alias("similarity"))
    return asked.join(counted(placed), ["session_id", "claim_text"]).drop("claim_text")


def explode_for_verification(claims: DataFrame, references: DataFrame) -> DataFrame:
    """A row per claim and reference id that exists, in order."""
    return claims.select("*", F.posexplode("reference_ids").alias("ref_pos", "ref_num")).join(references, ["session_id", "ref_num"])


def units_to_claims(units: DataFrame) -> DataFrame:
    """Claims of verification units: the scope is the claim, the unit's place its location, and its reference the only one."""
    location = F.struct("para_idx", F.col("start").alias("char_start"), F.col("end").alias("char_end"), F.array("raw_marker").alias("citation_markers"), F.col("section").alias("section_heading"))
    return units.select(
        "session_id", F.col("unit_id").alias("claim_id"), F.col("sentence").alias("manuscript_text"), F.col("scope").alias("claim_text"), "claim_type",
        F.array(F.coalesce("ref_num", F.lit(0)).cast("long")).alias("reference_ids"), "priority", "section", location.alias("location"),
    )


def marker_ids(text: Column) -> Column:
    """What stands in the bracketed markers of a text."""
    return F.regexp_extract_all(text, F.lit(MARKER_IDS), F.lit(1))


def near_figure(paragraph: Column, start: Column) -> Column:
    """Whether a figure or table is named within fifty characters of a place."""
    low = F.greatest(start - NEAR_FIGURE, F.lit(0))
    return F.substring(paragraph, low + 1, start + NEAR_FIGURE - low).rlike(FIGURE)


def location(para_idx: Column, start: Column, end: Column, claim: Column, paragraph: Column, heading: Column) -> Column:
    return F.struct(
        para_idx.alias("para_idx"), start.alias("char_start"), end.alias("char_end"), marker_ids(claim).alias("citation_markers"), heading.alias("section_heading"), near_figure(paragraph, start).alias("in_figure_or_table"),
    )


def located_claims(claims: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Claims with a ``location`` struct; null where no paragraph is like them."""
    found = place_claims(claims, paragraphs).join(paragraphs.select("session_id", "para_idx", "section", F.col("text").alias("_paragraph")), ["session_id", "para_idx"])
    joined = claims.join(found, ["session_id", "claim_id"], "left")
    end = F.least(F.col("start") + F.length("claim_text"), F.length("_paragraph"))
    placed = F.when(F.col("para_idx").isNotNull(), location(F.col("para_idx"), F.col("start"), end, F.col("claim_text"), F.col("_paragraph"), F.col("section")))
    return joined.withColumn("location", placed).select(*claims.columns, "location")


def to_decompose(claims: DataFrame) -> DataFrame:
    """Claims that are taken apart into atomic ones: factual or contrast, of high priority."""
    return claims.filter(F.col("claim_type").isin(*DECOMPOSED) & (F.col("priority") == "high"))


def reference_list(references: DataFrame) -> DataFrame:
    """(session_id, listing): a line per reference with three authors at most, title, journal and year, as a prompt shows it.

    A session's list is one value, as long as its manuscript's reference list.
    """
    some = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    names = F.nullif(F.array_join(F.slice("authors", 1, MOST_LISTED_AUTHORS), ", "), F.lit(""))
    line = F.concat_ws(" ", F.concat(F.lit("["), F.col("ref_num").cast("string"), F.lit("]")), names, some("title"), some("journal"), F.concat(F.lit("("), some("year"), F.lit(")")))
    lines = F.array_sort(F.collect_list(F.struct("ref_num", line.alias("line"))))
    return references.groupBy("session_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("listing"))
