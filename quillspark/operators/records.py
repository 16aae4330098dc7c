"""Records of look-up services, titles of sources, and checks of what was fetched. Answers come as columns of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions.similarity import partial
from quillspark.functions.text import clean_doi, first_tag, strip

# Fixed values.
SUPPLEMENT_WORDS = ("supplementary information", "supplementary material", "supplementary data", "supporting information", "supplemental figures")
LEAST_TEXT, LEAST_TITLE_RATIO, TITLE_WITHIN, LONG_TITLE, SIZES_TRIED = 2000, 70.0, 500, 15, 3
DOI_IN_SOURCE = r"""(10\.\d{4,}/[^\s,;"'>\]]+)"""
WORK = "struct<title:array<string>,DOI:string,URL:string,`container-title`:array<string>,published:struct<`date-parts`:array<array<int>>>>"
PAPER = "struct<title:string,year:int,externalIds:struct<DOI:string>,openAccessPdf:struct<url:string>,authors:array<struct<name:string>>>"
ACCESS = "struct<best_oa_location:struct<url_for_pdf:string>,oa_locations:array<struct<url_for_pdf:string>>>"


def crossref_work(answer: Column) -> Column:
    """struct(title, year, doi, journal, url, found) of a work in JSON."""
    w = F.from_json(answer, WORK)
    first = lambda a: F.get(a, F.lit(0))
    title = F.coalesce(first(w["title"]), F.lit(""))
    return F.struct(
        title.alias("title"), first(first(w["published"]["date-parts"])).alias("year"), w["DOI"].alias("doi"), F.coalesce(first(w["container-title"]), F.lit("")).alias("journal"), w["URL"].alias("url"), (title != "").alias("found")
    )


def pubmed_record(xml: Column) -> Column:
    """struct(title, journal, year, found) of a record in XML."""
    title = first_tag(xml, "ArticleTitle")
    return F.struct(title.alias("title"), first_tag(xml, "Title").alias("journal"), first_tag(xml, "Year").try_cast("int").alias("year"), (title != "").alias("found"))


def paper_record(answer: Column) -> Column:
    """struct(title, year, doi, pdf_url, authors, found) of a paper in JSON."""
    p = F.from_json(answer, PAPER)
    title = F.coalesce(p["title"], F.lit(""))
    return F.struct(title.alias("title"), p["year"].alias("year"), p["externalIds"]["DOI"].alias("doi"), p["openAccessPdf"]["url"].alias("pdf_url"), F.transform(p["authors"], lambda a: a["name"]).alias("authors"), (title != "").alias("found"))


def open_access_url(answer: Column) -> Column:
    """The best location's PDF, else the first location that has one."""
    j = F.from_json(answer, ACCESS)
    others = F.filter(F.transform(j["oa_locations"], lambda x: x["url_for_pdf"]), lambda u: u.isNotNull())
    return F.coalesce(j["best_oa_location"]["url_for_pdf"], F.get(others, F.lit(0)))


def update_date(parts: Column) -> Column:
    """A date's parts joined by hyphens; empty without any."""
    return F.coalesce(F.array_join(F.transform(F.get(parts, F.lit(0)), lambda p: p.cast("string")), "-"), F.lit(""))


def pubmed_retraction(xml: Column) -> Column:
    low = F.lower(xml)
    has = lambda words: F.contains(low, F.lit(words))
    return F.when(has("retracted publication"), "retracted").when(has("erratum"), "corrected").when(has("expression of concern"), "expression_of_concern").otherwise("ok")


def clean_title(text: Column) -> Column:
    """Without 'Abstract:' and a closing url; empty if short or only digits."""
    clean = F.regexp_replace(F.regexp_replace(strip(text), r"(?i)^Abstract\s*:?\s*", ""), r"\s*https?://\S+$", "")
    return F.when((F.length(clean) < 10) | F.replace(clean, F.lit(" "), F.lit("")).rlike(r"^\d+$"), "").otherwise(clean)


def metadata_title(title: Column) -> Column:
    """A title that metadata gives, unless it is short, a file name or an identifier."""
    t = strip(F.coalesce(title, F.lit("")))
    return F.when((F.length(t) > 10) & ~t.endswith(".pdf") & ~F.contains(F.substring(t, 1, 5), F.lit("10.")), t).otherwise("")


def file_title(path: Column) -> Column:
    """A title from a file name: author and year go, hyphens and underscores become blanks."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")
    clean = F.translate(F.regexp_replace(F.regexp_replace(stem, r"^\w+-\d{4}-", ""), r"^\w+_\d{4}_", ""), "_-", "  ")
    return F.when(F.length(clean) > 10, clean).otherwise(F.translate(stem, "_-", "  "))


def font_title(spans: DataFrame) -> DataFrame:
    """(source_id, title) from spans (source_id, pos, size, text) of first pages: the largest of three sizes whose text makes a title."""
    useful = spans.filter((F.length(F.trim("text")) > 3) & (F.col("size") > 0))
    joined = useful.groupBy("source_id", "size").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.trim("text").alias("t")))), lambda x: x["t"]), " ").alias("t"))
    ranked = joined.withColumn("nth", F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("size")))).filter(F.col("nth") <= SIZES_TRIED)
    titles = ranked.withColumn("title", clean_title(F.col("t"))).filter(F.length("title") > LONG_TITLE)
    return titles.groupBy("source_id").agg(F.min_by("title", "nth").alias("title"))


def source_title(metadata: Column, font: Column, path: Column) -> Column:
    """The first of metadata, largest font and file name that is long enough."""
    long = lambda t: F.when(F.length(t) > LONG_TITLE, t)
    return F.coalesce(long(metadata_title(metadata)), long(font), file_title(path))


def is_the_paper(first_page: Column, total_chars: Column, title: Column) -> Column:
    """Whether fetched text is the paper: no supplement, long enough, and with the title near its beginning."""
    page = F.lower(strip(first_page))
    supplement = F.lit(False)
    for words in SUPPLEMENT_WORDS:
        supplement = supplement | F.contains(page, F.lit(words))
    like = F.when(F.coalesce(title, F.lit("")) == "", True).otherwise(partial(F.lower(title), F.substring(page, 1, TITLE_WITHIN)) >= LEAST_TITLE_RATIO)
    return ~supplement & (total_chars >= LEAST_TEXT) & like


def distinct_quotes(first: Column, second: Column) -> Column:
    """Quotes of both lists in order, each once, ignoring case and outer blanks."""
    key = lambda q: F.lower(F.trim(q))
    return F.aggregate(
        F.concat(first, second),
        F.array().cast("array<string>"),
        lambda out, q: F.when(F.exists(out, lambda o: key(o) == key(q)), out).otherwise(F.concat(out, F.array(q))),
    )


def fill_tiers(models: DataFrame) -> DataFrame:
    """(tier, nth, model): models by tier, empty tiers filled from their neighbours; a single model serves all tiers.

    ``models`` is a registry (model, tier, ord) of a few rows.
    """
    lists = models.agg(*(F.transform(F.array_sort(F.collect_list(F.when(F.col("tier") == t, F.struct("ord", "model")))), lambda x: x["model"]).alias(f"t{t}") for t in range(4)), F.count(F.lit(1)).alias("n"), F.max("model").alias("only"))
    first = lambda a, n: F.slice(a, 1, n)
    some = lambda a: F.size(a) > 0
    lists = lists.withColumn("t0", F.when(~some("t0") & some("t1"), first(F.col("t1"), 2)).otherwise(F.col("t0")))
    lists = lists.withColumn("t1", F.when(~some("t1"), first(F.concat("t0", "t2"), 2)).otherwise(F.col("t1")))
    lists = lists.withColumn("t2", F.when(~some("t2"), first(F.concat("t1", "t3"), 1)).otherwise(F.col("t2")))
    lists = lists.withColumn("t3", F.when(~some("t3") & some("t2"), first(F.col("t2"), 1)).otherwise(F.col("t3")))
    tiers = [F.struct(F.lit(t).alias("tier"), F.when(F.col("n") == 1, F.array("only")).otherwise(F.col(f"t{t}")).alias("models")) for t in range(4)]
    return lists.select(F.explode(F.array(*tiers)).alias("x")).select("x.tier", F.posexplode("x.models").alias("nth", "model"))


def doi_of_source(metadata: Column, first_page: Column, second_page: Column) -> Column:
    """A source's DOI: of its metadata's doi, subject, keywords or title, else of its first or second page, without closing punctuation."""
    found = lambda c: F.nullif(F.regexp_extract(c, DOI_IN_SOURCE, 1), F.lit(""))
    first = F.coalesce(*(found(metadata[k]) for k in ("doi", "subject", "keywords", "title")), found(first_page), found(second_page))
    return clean_doi(first, ".,;:)")
