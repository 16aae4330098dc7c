"""Citations to references: a cascade of joins, from the surest to the loosest.

Each step takes the citations that the steps before left open, so the costly
comparisons see few of them, and fuzzy ones compare different names, not rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.fold import last_name, plain_name
from quillspark.operators.similarity_join import similarity_join

# Confidence of each way of mapping, and the least ratio of names.
CONFIDENCE = {"number": 1.0, "exact_author_year": 0.95, "fuzzy_author_year": 0.85, "multi_author_year": 0.90, "author_only": 0.70}
LEAST_RATIO = 85.0


def year_number(year: Column) -> Column:
    """The year without its letter."""
    return F.rtrim(year, F.lit("abcdefghij")).try_cast("int")


def matched(found: DataFrame, method: str) -> DataFrame:
    return found.select("cit_key", F.col("ref_num").cast("long").alias("ref_num"), F.lit(method).alias("method"), F.lit(CONFIDENCE[method]).alias("confidence"))


def map_citations(citations: DataFrame, references: DataFrame) -> DataFrame:
    """(cit_key, ref_num, method, confidence) for each citation.

    ``citations``: cit_key, session_id, number, authors, year. ``references``: session_id, ref_num, authors, year.
    Unmapped citations have a null reference, method ``unresolved`` and confidence 0.
    """
    cits = citations.select("cit_key", "session_id", "number", "year", F.col("authors").alias("names"))
    cits = cits.withColumns({"y": year_number(F.col("year")), "name": plain_name(F.get("names", F.lit(0)))})
    refs = references.select("session_id", "ref_num", F.col("year").cast("int").alias("y"), F.col("authors").alias("ref_names"))
    first = refs.withColumn("name", plain_name(last_name(F.get("ref_names", F.lit(0)))))

    by_number = matched(cits.filter("number is not null").join(refs.select("session_id", F.col("ref_num").alias("number")), ["session_id", "number"]).withColumn("ref_num", F.col("number")), "number")
    left = cits.join(by_number.select("cit_key"), "cit_key", "left_anti").filter(F.size("names") > 0)

    earliest = first.filter("name is not null").groupBy("session_id", "name", "y").agg(F.min("ref_num").alias("ref_num"))
    exact = matched(left.join(earliest, ["session_id", "name", "y"]), "exact_author_year")
    left = left.join(exact.select("cit_key"), "cit_key", "left_anti")

    wanted = left.filter("y is not null").select("session_id", "y", "name").distinct()
    like = similarity_join(wanted.withColumnRenamed("name", "a"), earliest.withColumnRenamed("name", "b"), ["session_id", "y"], LEAST_RATIO, sort_tokens=False)
    pairs = like.withColumnsRenamed({"a": "name", "b": "other"}).join(earliest.withColumnRenamed("name", "other"), ["session_id", "y", "other"])
    best = pairs.groupBy("session_id", "y", "name").agg(F.min_by("ref_num", F.struct(-F.col("score"), "ref_num")).alias("ref_num"))
    fuzzy = matched(left.join(best, ["session_id", "y", "name"]), "fuzzy_author_year")
    left = left.join(fuzzy.select("cit_key"), "cit_key", "left_anti")

    # several names: all of them among the reference's surnames
    several = left.filter((F.size("names") > 1) & F.col("y").isNotNull()).select("cit_key", "session_id", "y", F.size(F.array_distinct("names")).alias("need"), F.explode(F.array_distinct("names")).alias("n"))
    several = several.withColumn("n", plain_name(F.col("n")))
    surnames = refs.select("session_id", "ref_num", "y", F.explode("ref_names").alias("n")).withColumn("n", plain_name(last_name(F.col("n")))).distinct()
    counted = several.join(surnames, ["session_id", "y", "n"]).groupBy("cit_key", "ref_num").agg(F.max("need").alias("need"), F.count(F.lit(1)).alias("have"))
    multi = matched(counted.filter("have >= need").groupBy("cit_key").agg(F.min("ref_num").alias("ref_num")), "multi_author_year")
    left = left.join(multi.select("cit_key"), "cit_key", "left_anti")

    names = left.filter("name is not null").select("session_id", "name").distinct()
    others = first.filter("name is not null").groupBy("session_id", "name").agg(F.min("ref_num").alias("ref_num")).withColumnRenamed("name", "other")
    near = similarity_join(names.withColumnRenamed("name", "a"), others.withColumnRenamed("other", "b"), ["session_id"], LEAST_RATIO, sort_tokens=False).withColumnsRenamed({"a": "name", "b": "other"})
    near = near.join(others, ["session_id", "other"]).groupBy("session_id", "name").agg(F.min("ref_num").alias("ref_num"))
    only = matched(left.join(near, ["session_id", "name"]), "author_only")

    mapped = by_number.unionByName(exact).unionByName(fuzzy).unionByName(multi).unionByName(only)
    return citations.select("cit_key").join(mapped, "cit_key", "left").withColumns({"method": F.coalesce("method", F.lit("unresolved")), "confidence": F.coalesce("confidence", F.lit(0.0))})


def with_reference(citations: DataFrame, mapped: DataFrame, references: DataFrame) -> DataFrame:
    """Citations with their reference's number, title and authors, and the way and confidence of the mapping; 0 and empty where there is none."""
    chosen = references.select("session_id", "ref_num", F.col("title").alias("ref_title"), F.col("authors").alias("ref_authors"))
    joined = citations.join(mapped, "cit_key").join(chosen, ["session_id", "ref_num"], "left")
    return joined.withColumns({"ref_num": F.coalesce("ref_num", F.lit(0)), "ref_title": F.coalesce("ref_title", F.lit("")), "ref_authors": F.coalesce("ref_authors", F.array().cast("array<string>"))})
