"""Sections of manuscripts: paragraphs, which sections to read, and citation styles of single texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions.spans import find_all, let
from quillspark.functions.text import strip
from quillspark.operators.citations import expand_numbers, style_counts

# Fixed values.
REFERENCE_SECTIONS = ("references", "bibliography", "works cited")
NOT_BODY = (
    r"(?i)^\s*(references|bibliography|works\s+cited|literature\s+cited|acknowledgment|acknowledgement|acknowledgments|acknowledgements|appendix|supplementary"
    r"|conflicts?\s+of\s+interest|funding|author\s+contributions|data\s+availability)\s*$"
)
HAS_CITATIONS = (r"\[\d+", r"\(\d{1,3}(?:\s*[-–,]\s*\d{1,3})*\)", r"\([A-Z][a-z]+(?:\s+et\s+al\.?)?,?\s*\d{4}\)", r"[a-z\.)]\d{1,3}(?:[,\s]|$)")
NUMBERED_MARKER = r"\[(\d+(?:\s*[-–]\s*\d+)?(?:\s*,\s*\d+(?:\s*[-–]\s*\d+)?)*)\]"
AUTHOR_YEAR_MARKER = r"\(([A-Z][a-z]+(?:\s+(?:et\s+al\.|&\s+[A-Z][a-z]+))?(?:,?\s*\d{4}))\)"


def split_paragraphs(text: Column) -> Column:
    """Trimmed pieces between blank lines, empty ones left out."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: strip(p)), lambda p: p != "")


def flatten_paragraphs(sections: DataFrame, skip_references: bool = True) -> DataFrame:
    """(session_id, para_idx, section, text) of sections (session_id, section_ord, heading, text).

    Paragraphs are numbered from 0 through a manuscript. Reference sections are left out, as detection and the viewer
    do; with ``skip_references=False`` they count, as where model claims are placed.
    """
    heading = F.coalesce("heading", F.lit(""))
    if skip_references:
        sections = sections.filter(~F.lower(heading).isin(*REFERENCE_SECTIONS))
    parts = sections.select("session_id", "section_ord", heading.alias("section"), F.posexplode(split_paragraphs(F.col("text"))).alias("pos", "text"))
    nth = F.row_number().over(Window.partitionBy("session_id").orderBy("section_ord", "pos"))
    return parts.select("session_id", (nth - 1).alias("para_idx"), "section", "text")


def has_citations(text: Column) -> Column:
    """Whether a text has markers in brackets, parentheses or as raised figures, or names with years."""
    out = F.lit(False)
    for p in HAS_CITATIONS:
        out = out | text.rlike(p)
    return out


def is_body(heading: Column) -> Column:
    """Whether a section is body text; one without a heading is."""
    return F.coalesce(~heading.rlike(NOT_BODY), F.lit(True))


def sections_for_claims(sections: DataFrame) -> DataFrame:
    return sections.filter(is_body(F.col("heading")) & has_citations(F.col("text")))


def style_of_text(text: Column) -> Column:
    """Which detectors a single text needs: mixed, numbered or author_year."""
    names, brackets = style_counts(text)
    return F.when((names > 0) & (brackets > 0), "mixed").when(brackets > 0, "numbered").otherwise("author_year")


def manuscript_style(text: Column) -> Column:
    """numbered or author_year by the more frequent markers, two at least; else by any; else unknown."""
    of = lambda n, a: F.when((n > a) & (n >= 2), "numbered").when((a > n) & (a >= 2), "author_year").when(n >= 1, "numbered").when(a >= 1, "author_year").otherwise("unknown")
    return let(F.regexp_count(text, F.lit(NUMBERED_MARKER)), lambda n: let(F.regexp_count(text, F.lit(AUTHOR_YEAR_MARKER)), lambda a: of(n, a)))


def markers_in(text: Column) -> Column:
    """array<struct<position, raw_text, reference_ids>> of all markers, by position; ranges are not limited."""
    one = lambda s, ids: F.struct(s["start"].alias("position"), s["text"].alias("raw_text"), ids.alias("reference_ids"))
    numbers = F.transform(find_all(text, NUMBERED_MARKER), lambda s: one(s, expand_numbers(F.translate(s["text"], "[]", ""), None)))
    names = F.transform(find_all(text, AUTHOR_YEAR_MARKER), lambda s: one(s, F.array().cast("array<int>")))
    return F.array_sort(F.concat(numbers, names))

