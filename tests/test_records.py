"""Service records, titles and checks by example."""

import pytest
from pyspark.sql import functions as F

from quillspark.operators import records as R


def one(spark, expression, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} {'long' if isinstance(v, int) else 'string'}" for i, v in enumerate(values)))
    return df.select(expression(*(F.col(c) for c in df.columns)).alias("y")).first()["y"]


def test_work_records(spark):
    got = one(spark, R.crossref_work, '{"title": ["T"], "DOI": "10.1/x", "container-title": [], "published": {"date-parts": [[2020, 3]]}}')
    assert (got.title, got.year, got.doi, got.journal, got.found) == ("T", 2020, "10.1/x", "", True)
    assert one(spark, R.crossref_work, "{}").found is False
    got = one(spark, R.paper_record, '{"title": "P", "year": 2019, "openAccessPdf": {"url": "u"}, "authors": [{"name": "A"}, {"name": "B"}]}')
    assert (got.title, got.year, got.doi, got.pdf_url, got.authors) == ("P", 2019, None, "u", ["A", "B"])
    got = one(spark, R.pubmed_record, "<a><ArticleTitle lang='e'>\n X </ArticleTitle><Title>J</Title><Year>2001</Year></a>")
    assert tuple(got) == ("X", "J", 2001, True)


@pytest.mark.parametrize(("answer", "url"), [('{"best_oa_location": {"url_for_pdf": "a"}}', "a"), ('{"best_oa_location": {}, "oa_locations": [{}, {"url_for_pdf": "b"}]}', "b"), ("{}", None)])
def test_open_access(spark, answer, url):
    assert one(spark, R.open_access_url, answer) == url


@pytest.mark.parametrize(("raw", "title"), [("Abstract: A proper title here", "A proper title here"), ("short", ""), ("1234567890 12", ""), ("A long title https://x.y/z", "A long title")])
def test_clean_titles(spark, raw, title):
    assert one(spark, R.clean_title, raw) == title


def test_title_cascade(spark):
    assert one(spark, R.source_title, "A good metadata title", "font title that is long", "/a/b.pdf") == "A good metadata title"
    assert one(spark, R.source_title, "paper.pdf", "font title that is long", "/a/b.pdf") == "font title that is long"
    assert one(spark, R.source_title, "10.1/abcdefghij", "", "/a/Kim-2016-On_the_growth-of cells.pdf") == "On the growth of cells"
    spans = spark.createDataFrame([(1, 0, 9.0, "running header of the journal"), (1, 1, 20.0, "A title in"), (1, 2, 20.0, "large letters"), (1, 3, 30.0, "12")], "source_id long, pos int, size double, text string")
    assert R.font_title(spans).first().title == "A title in large letters"


def test_fetched_papers(spark):
    assert one(spark, R.is_the_paper, "On growth of cells. By A.", 5000, "On growth of cells") is True
    assert one(spark, R.is_the_paper, "Supplementary Information for on growth of cells", 5000, "On growth of cells") is False
    assert one(spark, R.is_the_paper, "On growth of cells", 100, "On growth of cells") is False
    assert one(spark, R.is_the_paper, "xxxxxxxx", 5000, "On growth of cells") is False


def test_filled_tiers(spark):
    def fill(*models):
        out = {}
        for r in R.fill_tiers(spark.createDataFrame([(m, t, i) for i, (m, t) in enumerate(models)], "model string, tier int, ord int")).collect():
            out.setdefault(r.tier, []).append(r.model)
        return out

    assert fill(("a", 2)) == {0: ["a"], 1: ["a"], 2: ["a"], 3: ["a"]}
    assert fill(("a", 1), ("b", 1), ("c", 3)) == {0: ["a", "b"], 1: ["a", "b"], 2: ["a"], 3: ["c"]}
    assert fill(("a", 0), ("b", 2)) == {0: ["a"], 1: ["a", "b"], 2: ["b"], 3: ["b"]}
