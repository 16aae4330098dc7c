"""Manuscripts in DOCX files: paragraphs with styles, sections, bibliographies and reference-manager marks.

Files are read by Spark's ``binaryFile`` source, so any store that Spark can
read will do; only unzipping and walking the XML is Python, a batch at a time.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions.text import is_reference_heading
from quillspark.operators.references import split_records

# Fixed values.
NAMESPACE = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
FIELD_MARKS = ("ADDIN ZOTERO_ITEM", "ADDIN EN.CITE", "ADDIN Mendeley", "CSL_CITATION")
BIBLIOGRAPHY_STYLES = ("endnote bibliography", "bibliography", "reference", "references", "works cited")


def document_paragraphs(content: bytes) -> list[tuple[str, str]]:
    """(style, text) of the paragraphs of a DOCX file; none where it can't be read."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            body = ElementTree.fromstring(archive.read("word/document.xml"))
            names = {}
            if "word/styles.xml" in archive.namelist():
                for style in ElementTree.fromstring(archive.read("word/styles.xml")).iter(f"{NAMESPACE}style"):
                    name = style.find(f"{NAMESPACE}name")
                    names[style.get(f"{NAMESPACE}styleId")] = name.get(f"{NAMESPACE}val") if name is not None else ""
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return []
    out = []
    for p in body.iter(f"{NAMESPACE}p"):
        style = p.find(f"{NAMESPACE}pPr/{NAMESPACE}pStyle")
        ident = style.get(f"{NAMESPACE}val") if style is not None else ""
        out.append((names.get(ident, ident), "".join(t.text or "" for t in p.iter(f"{NAMESPACE}t")).strip()))
    return out


def has_field_marks(content: bytes) -> bool:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            xml = archive.read("word/document.xml").decode("utf-8", "replace")
    except (zipfile.BadZipFile, KeyError):
        return False
    return any(mark in xml for mark in FIELD_MARKS)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select("path", "content")


def paragraphs(files: DataFrame) -> DataFrame:
    """(path, pos, style, text) of the files' paragraphs that aren't empty."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows = [(path, i, s, t) for i, (s, t) in enumerate(document_paragraphs(content)) if t]
                yield pd.DataFrame(rows, columns=["path", "pos", "style", "text"])

    return files.select("path", "content").mapInPandas(walk, "path string, pos int, style string, text string")


def sections(paragraphs: DataFrame) -> DataFrame:
    """(session_id, section_ord, heading, text): a heading opens a section, and a heading without text gives none."""
    is_heading = F.contains("style", F.lit("Heading"))
    number = F.sum(is_heading.cast("int")).over(Window.partitionBy("path").orderBy("pos"))
    ordered = F.array_sort(F.collect_list(F.when(~is_heading, F.struct("pos", "text"))))
    grouped = paragraphs.withColumn("n", number).groupBy("path", "n").agg(F.max(F.when(is_heading, F.col("text"))).alias("heading"), F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))
    kept = grouped.filter("text <> ''")
    return kept.select(F.col("path").alias("session_id"), (F.row_number().over(Window.partitionBy("path").orderBy("n")) - 1).alias("section_ord"), "heading", "text")


def raw_references(paragraphs: DataFrame, sections: DataFrame) -> DataFrame:
    """(session_id, ref_id, raw_text): two or more paragraphs of a bibliography style, else the first section under a reference heading."""
    style = F.lower("style")
    styled = style.contains(BIBLIOGRAPHY_STYLES[0])
    for name in BIBLIOGRAPHY_STYLES[1:]:
        styled = styled | style.contains(name)
    own = paragraphs.filter(styled).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("path"))).filter("n >= 2")
    first = own.select(F.col("path").alias("session_id"), F.row_number().over(Window.partitionBy("path").orderBy("pos")).alias("ref_id"), F.col("text").alias("raw_text"))
    headed = sections.filter(is_reference_heading(F.col("heading"))).groupBy("session_id").agg(F.min_by("text", "section_ord").alias("text"))
    return first.unionByName(split_records(headed.join(first.select("session_id").distinct(), "session_id", "left_anti")))


def warnings(files: DataFrame, paragraphs: DataFrame, references: DataFrame) -> DataFrame:
    """(session_id, warning) of files that can't be read or have no text, and of those without a reference section."""
    ids = files.select(F.col("path").alias("session_id"))
    texts, listed = (x.select(F.col(c).alias("session_id")).distinct() for x, c in ((paragraphs, "path"), (references, "session_id")))
    empty = ids.join(texts, "session_id", "left_anti").withColumn("warning", F.lit("no text"))
    return empty.unionByName(texts.join(listed, "session_id", "left_anti").withColumn("warning", F.lit("no references found")))


def field_marks(files: DataFrame) -> DataFrame:
    """(path, has_field_codes)."""
    return files.select("path", F.pandas_udf(lambda s: s.map(has_field_marks), "boolean")(F.col("content")).alias("has_field_codes"))


def is_pdf(content: Column) -> Column:
    return F.substring(content, 1, 4) == F.lit(b"%PDF")
