"""Evidence: sections that bear on a claim, quotes in sources, and highlights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import text as T
from quillspark.functions.spans import let
from quillspark.functions.similarity import quote_validation, window_match
from quillspark.operators.lineage import spread

# Fixed values.
LEAST_SCORE, MOST_SECTIONS, SHORT_TEXT, FALLBACK_CHARS, SHORT_PARAGRAPH = 0.1, 5, 2000, 500, 50
DIRECT, PARAPHRASED, LEAST_SIMILAR, VALID = 0.95, 0.75, 0.60, 0.85
QUOTE_PENALTY, TIER_PENALTY, SECOND_MODEL_PENALTY = 0.2, 0.15, 0.1
#: Quotes at most that are sent to all tasks.
MOST_BROADCAST = 20_000


def paragraphs_of(sources: DataFrame, separator: str = r"\n\s*\n") -> DataFrame:
    """(source_id, pos, paragraph): trimmed paragraphs of more than fifty characters."""
    parts = sources.select("source_id", F.posexplode(F.split("text", separator)).alias("pos", "paragraph"))
    return parts.withColumn("paragraph", T.strip(F.col("paragraph"))).filter(F.length("paragraph") > SHORT_PARAGRAPH)


def relevant_sections(claims: DataFrame, sources: DataFrame, most: int = MOST_SECTIONS, separator: str = r"\n\s*\n") -> DataFrame:
    """(claim_id, rank, heading, section, score): what a model is shown of a claim's source.

    ``claims``: claim_id, source_id, claim_text. Short sources come whole; else the best paragraphs above
    the least score, in order of score and place; else the source's first characters. Claims meet their texts once, and
    a text's paragraphs are ranked within its row.
    """
    words = claims.select("claim_id", "source_id", T.keywords(F.col("claim_text")).alias("words"), T.numbers(F.col("claim_text")).alias("figures"))
    met = words.join(spread(sources.filter("text <> ''").select("source_id", "text")), "source_id")
    is_long = F.length("text") >= SHORT_TEXT
    parts = F.transform(F.split("text", separator), lambda p, i: F.struct(i.alias("pos"), T.strip(p).alias("paragraph")))
    scored = F.transform(F.filter(parts, lambda x: F.length(x["paragraph"]) > SHORT_PARAGRAPH), lambda x: F.struct((-T.section_score(x["paragraph"], F.col("words"), F.col("figures"))).alias("below"), x["pos"].alias("pos"), x["paragraph"].alias("paragraph")))
    top = F.slice(F.array_sort(F.filter(scored, lambda x: x["below"] < -LEAST_SCORE)), 1, most)
    begin = F.when(is_long, F.substring("text", 1, FALLBACK_CHARS)).otherwise(F.col("text"))
    rows = met.select("claim_id", is_long.alias("is_long"), begin.alias("begin"), F.posexplode_outer(F.when(is_long, top)).alias("nth", "x"))
    found = F.col("x").isNotNull()
    paragraph = F.col("x.paragraph")
    return rows.select(
        "claim_id",
        (F.coalesce("nth", F.lit(0)) + 1).alias("rank"),
        F.when(found, T.guess_heading(paragraph)).when(F.col("is_long"), "Abstract").otherwise("Full Text").alias("heading"),
        F.when(found, T.sanitize(paragraph)).when(F.col("is_long"), T.sanitize(F.col("begin"))).otherwise(F.col("begin")).alias("section"),
        (-F.col("x.below")).alias("score"),
    )


def numbers_differ(claim: Column, matched: Column) -> Column:
    """Whether both have numbers, and not the same ones."""
    both = lambda a, b: (F.size(a) > 0) & (F.size(b) > 0) & (F.array_sort(a) != F.array_sort(b))
    return let(T.numbers(claim), lambda a: let(T.numbers(matched), lambda b: both(a, b)))


def match_class(claim: Column, matched: Column, similarity: Column) -> Column:
    """Numbers that differ from the claim's come first, however alike the texts are."""
    return F.when(numbers_differ(claim, matched), "numeric_mismatch").when(similarity >= DIRECT, "direct").when(similarity >= PARAPHRASED, "paraphrased").otherwise("absent")


def locate_quotes(pairs: DataFrame) -> DataFrame:
    """Pairs (quote, text) with start, end, similarity and match_type; null where nothing is similar enough.

    Numbers are compared with those of a column ``claim``, if there is one, else with the quote's.

    Exact places are found by Spark; only other pairs go through the window search.
    """
    at = F.instr("text", F.col("quote"))
    exact = pairs.withColumn("at", at)
    hit = exact.filter("at > 0").select(*pairs.columns, (F.col("at") - 1).alias("start"), (F.col("at") - 1 + F.length("quote")).alias("end"), F.lit(1.0).alias("similarity"))
    rest = exact.filter("at = 0").withColumn("w", window_match(F.col("quote"), F.col("text")))
    near = rest.select(*pairs.columns, F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.col("w.similarity").alias("similarity"))
    both = hit.unionByName(near)
    good = F.col("similarity") >= LEAST_SIMILAR
    part = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))
    return both.select(*pairs.columns, F.when(good, F.col("start")).alias("start"), F.when(good, F.col("end")).alias("end"), "similarity", F.when(good, match_class(F.col("claim" if "claim" in pairs.columns else "quote"), part, F.col("similarity"))).alias("match_type"))


def validate_quotes(pairs: DataFrame, least: float = VALID) -> DataFrame:
    """Pairs (quote, text) with found, similarity and best_match."""
    return pairs.withColumn("_v", quote_validation(F.col("quote"), F.col("text"), least)).select(*pairs.columns, "_v.found", "_v.similarity", "_v.best_match")


def apply_validation(results: DataFrame, validations: DataFrame, penalty: float = QUOTE_PENALTY) -> DataFrame:
    """Results lose confidence, and need review, where a quote of theirs isn't in the source."""
    bad = validations.filter("not found").select("claim_id").distinct().withColumn("bad", F.lit(True))
    joined = results.join(bad, "claim_id", "left")
    hit = F.coalesce("bad", F.lit(False))
    return joined.withColumns(
        {"confidence": F.when(hit, F.round(F.greatest(F.lit(0.0), F.col("confidence") - penalty), 3)).otherwise(F.col("confidence")), "needs_review": F.col("needs_review") | hit}
    ).drop("bad")


def validate_tier(results: DataFrame, texts: DataFrame, penalty: float = TIER_PENALTY) -> DataFrame:
    """Results (claim_id, quotes, confidence, needs_review, ...) of a tier, checked against their source (claim_id, text).

    One quote that the text doesn't have costs the penalty, and review; results without quotes or text stay as they are.
    """
    pairs = results.select("claim_id", F.explode(F.array_distinct("quotes")).alias("quote")).join(texts.filter("text <> ''"), "claim_id")
    return apply_validation(results, validate_quotes(pairs), penalty)


def apply_claim_type(results: DataFrame) -> DataFrame:
    """Background claims of fair confidence count as supported; contrasts need review."""
    lifted = (F.col("claim_type") == "background") & (F.col("confidence") >= 0.5) & F.col("verdict").isin("partially_supported", "cannot_verify")
    return results.withColumns({"verdict": F.when(lifted, "supported").otherwise(F.col("verdict")), "needs_review": F.col("needs_review") | (F.col("claim_type") == "contrast")})


def contained_quotes(quotes: DataFrame, sources: DataFrame, n: int = 4) -> DataFrame:
    """(quote_id, source_id, start, end): quotes of n + 2 words or more that stand in a source as they are.

    Candidates meet by the words after a quote's first, which any source that holds it has between
    blanks; so the work follows the length of the texts, not the number of pairs.
    """
    words = lambda text: F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))
    seeds = quotes.withColumn("w", words(F.col("quote"))).filter(F.size("w") >= n + 2).select("quote_id", "quote", F.array_join(F.slice("w", 2, n), " ").alias("seed"))
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
    wide = sources.withColumn("w", words(F.col("text"))).filter(F.size("w") >= n).select("source_id", F.explode(F.array_distinct(grams(F.col("w")))).alias("seed"))
    # few quotes go to the texts, so that no gram is shuffled; many meet them by hash
    pairs = wide.join(F.broadcast(seeds) if quotes.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else seeds, "seed").select("source_id", "quote_id", "quote")
    at = F.instr("text", F.col("quote"))
    return pairs.join(sources, "source_id").filter(at > 0).select("quote_id", "source_id", (at - 1).alias("start"), (at - 1 + F.length("quote")).alias("end"))


def source_texts(claims: DataFrame, sections: DataFrame) -> DataFrame:
    """(claim_id, text, coverage, headings, sections) of each claim: its sections by rank, joined; ``no_source`` without any.

    ``sections`` as of ``relevant_sections``, five for a claim at most.
    """
    parts = F.array_sort(F.collect_list(F.struct("rank", "heading", "section")))
    own = sections.groupBy("claim_id").agg(parts.alias("parts"))
    joined = claims.select("claim_id").join(own, "claim_id", "left").withColumn("parts", F.coalesce("parts", F.array().cast("array<struct<rank:int,heading:string,section:string>>")))
    of = lambda name: F.transform("parts", lambda x: x[name])
    return joined.select("claim_id", F.array_join(of("section"), "\n\n").alias("text"), F.when(F.size("parts") > 0, "relevant_sections").otherwise("no_source").alias("coverage"), of("heading").alias("headings"), of("section").alias("sections"))


def evidence_sections(sections: DataFrame, quotes: DataFrame, claims: DataFrame) -> DataFrame:
    """(claim_id, rank, heading, section, highlights): each section with the quotes that are found in it, in order.

    ``quotes``: claim_id, quote_ord, quote. A highlight is a struct of quote, start, end and match_type; blank quotes
    and quotes that are like no place of the section are left out.
    """
    asked = quotes.filter(T.strip(F.col("quote")) != "").join(claims.select("claim_id", F.col("claim_text").alias("claim")), "claim_id")
    pairs = sections.select("claim_id", "rank", F.col("section").alias("text")).filter("text <> ''").join(asked, "claim_id")
    located = locate_quotes(pairs).filter("start IS NOT NULL")
    mark = F.struct("quote_ord", "quote", "start", "end", "match_type")
    marks = located.groupBy("claim_id", "rank").agg(F.transform(F.array_sort(F.collect_list(mark)), lambda x: F.struct(x["quote"].alias("quote"), x["start"].alias("start"), x["end"].alias("end"), x["match_type"].alias("match_type"))).alias("highlights"))
    none = F.array().cast("array<struct<quote:string,start:int,end:int,match_type:string>>")
    return sections.join(marks, ["claim_id", "rank"], "left").select("claim_id", "rank", "heading", "section", F.coalesce("highlights", none).alias("highlights"))


def cannot_verify(pairs: DataFrame, reason: Column, coverage: str = "no_source") -> DataFrame:
    """Results of claims and references (claim_id, ref_num) that could not be checked."""
    return pairs.select(
        "claim_id", "ref_num", F.lit("cannot_verify").alias("verdict"), F.lit(0.0).alias("confidence"), reason.alias("reasoning"), F.lit(1).alias("tier"), F.lit(coverage).alias("source_coverage"),
    )
