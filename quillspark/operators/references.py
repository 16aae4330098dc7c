"""Reference lists: sections into records, records into fields, duplicates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import text as T
from quillspark.operators.lineage import SMALL_SESSION, by_size, settle
from quillspark.operators.similarity_join import similarity_join

# Fixed values.
LONG_LINE = 20
AUTHOR = r"^(?:(?:[A-Z]\.-?){1,4}\s+[A-Z][\p{L}\p{N}_\-']+|[A-Z][\p{L}\p{N}_\-']+\s+(?:[A-Z]\.-?){1,4}$|(?i:et\s+al\.?)$)"
JOURNAL = r"^\d+\s*\(\d{4}\)"
SAME_TITLE, SAME_TITLE_AND_AUTHOR = 95.0, 85.0


def split_records(sections: DataFrame) -> DataFrame:
    """Records of reference sections (session_id, text): a numbered line opens one and other lines continue it.

    Where that gives fewer than two, lines of more than twenty characters are the records, if they are more.
    """
    lines = sections.select("session_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line", T.strip(F.col("line"))).filter("line <> ''")
    order = Window.partitionBy("session_id").orderBy("pos")
    lines = lines.withColumn("record", F.sum(F.col("line").rlike(T.NUMBERED_LINE).cast("int")).over(order))
    joined = lines.groupBy("session_id", "record").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), " ").alias("raw_text"), F.min("pos").alias("pos")
    )
    whole = Window.partitionBy("session_id")
    fallback = lines.filter(F.length("line") > LONG_LINE).select("session_id", "pos", F.col("line").alias("raw_text"), F.lit(1).alias("way"))
    both = joined.select("session_id", "pos", "raw_text", F.lit(0).alias("way")).unionByName(fallback)
    both = both.withColumn("n0", F.count_if(F.col("way") == 0).over(whole)).withColumn("n1", F.count_if(F.col("way") == 1).over(whole))
    chosen = F.when((F.col("n0") >= 2) | (F.col("n1") <= F.col("n0")), 0).otherwise(1)
    kept = both.filter(F.col("way") == chosen)
    return kept.withColumn("ref_id", F.row_number().over(order)).select("session_id", "ref_id", "raw_text")


def is_author(segment: Column) -> Column:
    plain = F.rtrim(F.trim(segment), F.lit("."))
    return (F.length(plain) >= 2) & plain.rlike(AUTHOR)


def authors_and_title(raw: Column) -> Column:
    """struct(authors, title): leading segments that look like authors; else split at the first sentence end; else all is title."""
    clean = T.strip(F.regexp_replace(raw, T.NUMBERED_LINE, ""))
    segments = F.transform(F.split(clean, r",\s*"), lambda s: F.trim(s))
    state = F.aggregate(
        segments, F.struct(F.lit(True).alias("open"), F.lit(0).alias("n")), lambda a, s: F.struct((a["open"] & is_author(s)).alias("open"), (a["n"] + (a["open"] & is_author(s)).cast("int")).alias("n"))
    )
    n = state["n"]
    rest = F.slice(segments, n + 1, F.greatest(F.size(segments) - n, F.lit(0)))
    journal = lambda s: s.rlike(JOURNAL) | (s.rlike(r"\(\d{4}\)") & (F.length(s) < 30))
    title_end = F.aggregate(
        rest, F.struct(F.lit(True).alias("open"), F.lit(0).alias("n")), lambda a, s: F.struct((a["open"] & ~(journal(s) & (a["n"] > 0))).alias("open"), (a["n"] + (a["open"] & ~(journal(s) & (a["n"] > 0))).cast("int")).alias("n"))
    )["n"]
    first = F.rtrim(F.trim(F.array_join(F.slice(rest, 1, title_end), ", ")), F.lit("."))
    parts = F.split(clean, r"(?<=[a-z])\.\s+", 3)
    names = F.filter(F.transform(F.split(F.rtrim(F.trim(F.regexp_replace(F.get(parts, F.lit(0)), r"\bet\s+al\.?", "")), F.lit(",")), r"[;,]\s*"), lambda s: F.trim(s)), lambda s: F.length(s) > 1)
    out = lambda a, t: F.struct(a.alias("authors"), t.alias("title"))
    return (
        F.when((n > 0) & (n < F.size(segments)), out(F.slice(segments, 1, n), first))
        .when(F.size(parts) >= 2, out(names, F.rtrim(F.get(parts, F.lit(1)), F.lit("."))))
        .otherwise(out(F.array().cast("array<string>"), clean))
    )


def parse_references(records: DataFrame) -> DataFrame:
    """Fields of raw references, all from the row itself."""
    raw = F.col("raw_text")
    return records.withColumns({"doi": T.extract_doi(raw), "pmid": T.extract_pmid(raw), "year": T.extract_year(raw), "at": authors_and_title(raw)}).select("*", "at.authors", "at.title").drop("at")


def exact_duplicates(references: DataFrame) -> DataFrame:
    """(session_id, ref_num, duplicate_of): references whose DOI an earlier one of the session has, ignoring case and blanks."""
    key = F.lower(F.trim("doi"))
    first = F.min("ref_num").over(Window.partitionBy("session_id", key))
    return references.filter(F.col("doi").isNotNull() & (F.trim("doi") != "")).withColumn("duplicate_of", first).filter("duplicate_of < ref_num").select("session_id", "ref_num", "duplicate_of")


def duplicate_pairs(references: DataFrame) -> DataFrame:
    """(session_id, a, b), a < b: same DOI, or like titles, or less alike with the same first author and year.

    Equal titles meet by key; titles that only resemble one another are compared as different titles, in blocks of a
    session, and only where their lengths allow the ratio.
    """
    refs = references.select("session_id", "ref_num", F.lower(F.trim("doi")).alias("doi"), F.lower(F.trim("title")).alias("title"), F.lower("surname").alias("author"), "year")
    a, b = refs.select("session_id", *(F.col(c).alias(f"{c}_a") for c in refs.columns[1:])), refs.select("session_id", *(F.col(c).alias(f"{c}_b") for c in refs.columns[1:]))
    later = F.col("ref_num_a") < F.col("ref_num_b")
    pair = ["session_id", F.col("ref_num_a").alias("a"), F.col("ref_num_b").alias("b")]
    same_doi = a.withColumnRenamed("doi_a", "k").filter("k <> ''").join(b.withColumnRenamed("doi_b", "k"), ["session_id", "k"]).filter(later).select(*pair)
    titles = refs.filter("title <> ''")
    like = similarity_join(titles.select("session_id", F.col("title").alias("a")), titles.select("session_id", F.col("title").alias("b")), ["session_id"], SAME_TITLE_AND_AUTHOR)
    both_ways = like.filter("a <> b").select("session_id", F.col("a").alias("title_a"), F.col("b").alias("title_b"), "score")
    equal = refs.filter("title <> ''").select("session_id", "title").distinct().select("session_id", F.col("title").alias("title_a"), F.col("title").alias("title_b"), F.lit(100.0).alias("score"))
    both_ways = both_ways.union(equal)
    same = (F.col("author_a") == F.col("author_b")) & (F.col("year_a") == F.col("year_b"))
    by_title = a.join(both_ways, ["session_id", "title_a"]).join(b, ["session_id", "title_b"]).filter(later & ((F.col("score") >= SAME_TITLE) | F.coalesce(same, F.lit(False)))).select(*pair)
    return same_doi.union(by_title).distinct()


def greedy_leaders(pairs: DataFrame, small: int = SMALL_SESSION) -> DataFrame:
    """(session_id, ref_num, duplicate_of): in order, each reference joins the first leader it is paired with; one that joins is no leader.

    Pairs (a, b) have a < b. A session of up to ``small`` pairs is settled in a task. In larger ones, in each round,
    references that no open pair has as its later one are leaders, what is paired with them is taken, and the pairs of
    those are closed. A taken reference's leader is the first of all.
    """
    few, many = by_size(settle(pairs.select("session_id", "a", "b").distinct()), small)
    found = few.groupBy("session_id").applyInPandas(_leaders_in_order, few.select("session_id", F.col("b").alias("ref_num"), F.col("a").alias("duplicate_of")).schema)
    return found if many is None else found.unionByName(_leaders_in_rounds(many))


def _leaders_in_order(pairs: pd.DataFrame) -> pd.DataFrame:
    leader: dict[int, int] = {}
    for a, b in sorted(zip(pairs.a.tolist(), pairs.b.tolist(), strict=True), key=lambda p: (p[1], p[0])):
        if a not in leader and b not in leader:  # all pairs that could take a have gone before
            leader[b] = a
    return pd.DataFrame({"session_id": pairs.session_id.iloc[0], "ref_num": list(leader), "duplicate_of": list(leader.values())})


def _leaders_in_rounds(every: DataFrame) -> DataFrame:
    left, taken = every, every.select("session_id", F.col("b").alias("ref_num")).limit(0)
    while not left.isEmpty():
        later = left.select("session_id", F.col("b").alias("a")).distinct()
        now = settle(left.join(later, ["session_id", "a"], "left_anti").select("session_id", F.col("b").alias("ref_num")).distinct())
        taken = taken.unionByName(now)
        first, second = (now.select("session_id", F.col("ref_num").alias(c)) for c in "ab")
        left = settle(left.join(first, ["session_id", "a"], "left_anti").join(second, ["session_id", "b"], "left_anti").select("session_id", "a", "b"))
    led = every.join(taken.select("session_id", F.col("ref_num").alias("a")), ["session_id", "a"], "left_anti")
    return led.groupBy("session_id", F.col("b").alias("ref_num")).agg(F.min("a").alias("duplicate_of"))


def detect_duplicates(references: DataFrame) -> DataFrame:
    """``greedy_leaders`` of ``duplicate_pairs``, without the pairs of copies.

    References of a session that agree in title, author, year, and in a DOI that others have too, are paired with one
    another and with the same others. So the first of them stands for all: where it leads, the rest join it, and where it
    joins a leader, they join the same.
    """
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    keyed = references.withColumns({"_doi": F.lower(F.trim("doi")), "_title": F.lower(F.trim("title")), "_author": F.lower("surname")})
    shared = keyed.filter(some("_doi")).groupBy("session_id", "_doi").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("session_id", "_doi", F.lit(True).alias("_shared"))
    kinds = keyed.join(shared, ["session_id", "_doi"], "left").withColumn("_doi", F.when(F.col("_shared"), F.col("_doi"))).filter(some("_title") | F.col("_doi").isNotNull())
    first = F.min("ref_num").over(Window.partitionBy("session_id", "_title", "_author", "year", "_doi"))
    kinds = settle(kinds.select("session_id", "ref_num", first.alias("_first"), "doi", "title", "surname", "year"))
    led = settle(greedy_leaders(duplicate_pairs(kinds.filter("ref_num = _first").drop("_first"))))
    members = kinds.filter("ref_num > _first").select("session_id", "ref_num", "_first")
    joined = members.join(led.select("session_id", F.col("ref_num").alias("_first"), "duplicate_of"), ["session_id", "_first"], "left")
    return led.unionByName(joined.select("session_id", "ref_num", F.coalesce("duplicate_of", "_first").alias("duplicate_of")))
