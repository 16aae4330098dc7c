"""Results that only larger inputs tell apart: long lists, many copies, large groups."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.functions import similarity, spans
from quillspark.functions import text as text_functions
from quillspark.operators import citations, lineage, matching, references


def test_numbers_of_five_digits_open_records(spark):
    text = "[9999] First one\n[10000] Second one\ncontinues\n[123456] Third one\n(10001) Fourth one\n12345. is a page"
    got = references.split_records(spark.createDataFrame([("s", text)], "session_id string, text string"))
    assert [r.raw_text for r in got.orderBy("ref_id").collect()] == ["[9999] First one", "[10000] Second one continues", "[123456] Third one", "(10001) Fourth one 12345. is a page"]


def titled(spark, rng, n, name):
    kinds = ["growth of zinc in cells", "growth of zinc in cell", "growth of zinc cells", "iron and bolts", "iron and bolt", "quite another thing", "", None]
    return [("s" if rng.random() < 0.7 else "t", i, rng.choice(kinds)) for i in range(n)]


def test_copies_of_titles_are_matched_as_row_by_row(spark):
    """Many copies of few titles: the same as comparing and choosing row by row."""
    rng = random.Random(3)
    refs, pdfs = titled(spark, rng, 60, "ref_num"), titled(spark, rng, 50, "pdf_ord")
    r, p = spark.createDataFrame(refs, "session_id string, ref_num long, title string"), spark.createDataFrame(pdfs, "session_id string, pdf_ord long, title string")
    score = lambda a, b: similarity.token_sort_ratio(a, b) / 100 if a and b else 0.0
    best, taken, in_order = {}, set(), set()
    for s, pdf, b in pdfs:
        top, at, others = 0.0, None, []
        for s2, ref, a in refs:
            if s2 == s and score(a, b) >= matching.CONFIRM:
                if score(a, b) > top:
                    others += [] if at is None else [at]
                    top, at = score(a, b), ref
                else:
                    others.append(ref)
        if at is not None and (s, at) not in best:
            best[s, at] = (pdf, round(top * matching.TITLE_FACTOR, 3), [f"ref_{x}" for x in others])
        free = [(-score(a, b), ref) for s2, ref, a in refs if s2 == s and (s, ref) not in taken and score(a, b) >= matching.LOOKUP_LEAST]
        if free:
            taken.add((s, min(free)[1]))
            in_order.add((s, min(free)[1], pdf))
    got = {(x.session_id, x.ref_num): (x.pdf_ord, pytest.approx(x.confidence), x.alternatives) for x in matching.match_by_title(r, p).collect()}
    assert got == best and len(best) > 3
    pairs = matching.title_pairs(r, p, matching.LOOKUP_LEAST)
    assert pairs.count() <= 2 * 5 * 5  # of titles, not of rows
    for small in (1000, 1):
        assert {(x.session_id, x.ref_num, x.pdf_ord) for x in matching.match_titles_in_order(r, p, pairs, small).collect()} == in_order


def test_numbers_go_on_through_blocks(spark):
    rng = random.Random(5)
    places = [None, 0, lineage.BLOCK - 1, lineage.BLOCK, lineage.BLOCK + 1, 7 * lineage.BLOCK]
    rows = [(rng.choice(["s", "t", None]), rng.choice(places), i) for i in range(200)]
    df = spark.createDataFrame(rows, "session_id string, para_idx long, n int")
    want = df.withColumn("want", F.row_number().over(Window.partitionBy("session_id").orderBy("para_idx", "n")))
    got = lineage.with_number(want, "got", "para_idx", "n").collect()
    assert len(got) == 200 and all(r.got == r.want for r in got)


def test_costly_detectors_get_more_tasks_with_more_input(spark, tmp_path):
    spark.range(600_000).select(F.col("id"), F.rand(1).alias("x")).coalesce(1).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    for dealt in (lineage.spread(table), lineage.spread(table, "id")):
        sizes = [len(p) for p in dealt.select("id").rdd.glom().collect()]
        assert sum(sizes) == 600_000 and len(sizes) > spark.sparkContext.defaultParallelism and max(sizes) < 600_000 / 4


def test_texts_without_a_year_in_parentheses_skip_no_citation(spark):
    texts = ["(Smith, 2001)", "Smith (2001)", "(see Smith, n.d.)", "Smith (n.d.)", "(n = 2001", "(a (Smith, 2001a)", "Ring (2001, 2003b) and (Gear, 1999; Bolt et al., 2000)"]
    df = spark.createDataFrame([("s", i, t) for i, t in enumerate(texts)], "session_id string, para_idx long, text string")
    found = {(r.para_idx, r.style[12:]) for r in citations.detect_citations(df).collect()}
    assert found == {(0, "parenthetical"), (1, "narrative"), (2, "parenthetical"), (3, "narrative"), (5, "parenthetical"), (6, "narrative"), (6, "parenthetical")}


def test_parts_of_votes_and_changes_grow_with_input(spark, tmp_path, monkeypatch):
    from quillspark.plans import results
    from tests.conftest import SMALL

    monkeypatch.setattr(lineage, "PART", 1 << 12)
    assert results.verifications(spark, SMALL).rdd.getNumPartitions() > 2 * spark.sparkContext.defaultParallelism


def test_duplicates_of_many_copies_are_those_of_all_pairs(spark, monkeypatch):
    rng = random.Random(11)
    titles = ["growth of zinc in mouse cells", "growth of zinc in mouse cell", "growth of zinc in mice cells", "iron", "", None]
    rows = [(rng.choice("st"), i, rng.choice([None, "10.1/a", " 10.1/A", f"10.2/{i}"]) if rng.random() < 0.3 else f"10.3/{i}", rng.choice(titles), rng.choice(["Ring", "ring", None]), rng.choice([1999, 2000, None])) for i in range(150)]
    refs = spark.createDataFrame(rows, "session_id string, ref_num long, doi string, title string, surname string, year int")
    want = {tuple(r) for r in references.greedy_leaders(references.duplicate_pairs(refs)).select("session_id", "ref_num", "duplicate_of").collect()}
    seen, pairs = [], references.duplicate_pairs
    monkeypatch.setattr(references, "duplicate_pairs", lambda df: seen.append(df.count()) or pairs(df))
    assert {tuple(r) for r in references.detect_duplicates(refs).select("session_id", "ref_num", "duplicate_of").collect()} == want and len(want) > 50
    assert seen[0] < 110


def test_lists_of_alternatives_are_written_with_the_result_only(spark, monkeypatch):
    rng = random.Random(7)
    refs = spark.createDataFrame([(*r, None) for r in titled(spark, rng, 60, "ref_num")], "session_id string, ref_num long, title string, doi string")
    pdfs = spark.createDataFrame([(*p, f"10.5/{p[1]}") for p in titled(spark, rng, 50, "pdf_ord")], "session_id string, pdf_ord long, title string, doi string")
    written = []
    for name in ("settle", "stored"):
        monkeypatch.setattr(matching, name, lambda df, write=getattr(lineage, name): written.append(df.columns) or write(df))
    got = [r for r in matching.match_sources(refs, pdfs).collect() if r.method == "title"]
    assert any(len(r.alternatives) > 3 for r in got)
    assert written and not any("alternatives" in columns for columns in written)


def alike(spark, n, name):
    """Two sessions of n different titles each, all of them alike, and some copies."""
    rng = random.Random(23)
    rows = [(s, i, f"growth of zinc in cells {i % n:03d}" if i % 7 else f"cells in growth of zinc {rng.randrange(n):03d}", None) for s in "st" for i in range(n + 10)]
    return spark.createDataFrame(rows, f"session_id string, {name} long, title string, doi string")


def by_reading(refs, pdfs):
    """Title matches of one session, one by one: as the reference reads its list."""
    best = {}
    for pdf, b in pdfs:
        top, at, others = 0.0, None, []
        for ref, a in refs:
            score = similarity.token_sort_ratio(a.lower(), b.lower()) / 100
            if score > top:
                others += [at] if at is not None and top >= matching.CONFIRM else []
                top, at = score, ref
            elif score >= matching.CONFIRM:
                others.append(ref)
        if top >= matching.CONFIRM and at not in best:
            best[at] = (pdf, pytest.approx(round(top * matching.TITLE_FACTOR, 3)), [f"ref_{x}" for x in others])
    return best


def test_alike_titles_are_matched_without_keeping_their_pairs(spark, monkeypatch):
    from quillspark.operators import similarity_join

    refs, pdfs = alike(spark, 60, "ref_num"), alike(spark, 50, "pdf_ord")
    written = []
    for module, name in ((matching, "settle"), (matching, "stored"), (similarity_join, "settle")):
        monkeypatch.setattr(module, name, lambda df, write=getattr(lineage, name): written.append((kept := write(df)).count()) or kept)
    got = matching.match_by_title(refs, pdfs).collect()
    assert written and max(written) <= 2 * 70  # titles of both sessions; their pairs are 2 * 60 * 50
    sides = [[tuple(r)[1:3] for r in df.filter("session_id = 's'").sort(df.columns[1]).collect()] for df in (refs, pdfs)]
    assert {r.ref_num: (r.pdf_ord, r.confidence, r.alternatives) for r in got if r.session_id == "s"} == by_reading(*sides)
    assert sum(len(r.alternatives) for r in got) > 2000


def test_blocks_of_titles_are_matched_as_whole_sessions(spark, monkeypatch):
    refs, pdfs = alike(spark, 30, "ref_num"), alike(spark, 25, "pdf_ord")
    want = {(r.session_id, r.ref_num, r.pdf_ord, r.confidence, tuple(r.alternatives)) for r in matching.match_by_title(refs, pdfs).collect()}
    monkeypatch.setattr(matching, "LISTED", 50)
    monkeypatch.setattr(similarity, "TABLE_CELLS", 64)
    won = matching.title_winners(refs, pdfs, 7)
    assert {(r.session_id, r.ref_num, r.pdf_ord, r.confidence, tuple(r.alternatives)) for r in matching.with_alternatives(won, refs, 4).collect()} == want and len(want) > 20


def test_what_is_left_is_matched_in_order_without_keeping_pairs(spark, monkeypatch):
    """The third pass: the same as one by one, over many copies, in tasks and by pairs."""
    from quillspark.operators import similarity_join

    refs, pdfs = alike(spark, 20, "ref_num"), alike(spark, 22, "pdf_ord").withColumn("title", F.when(F.col("pdf_ord") % 5 == 0, "growth of zinc in cells").otherwise(F.col("title")))
    want, lists = [], [df.sort("session_id", df.columns[1]).collect() for df in (refs, pdfs)]
    taken = set()
    for p in lists[1]:
        free = [(-similarity.token_sort_ratio(r.title, p.title) / 100, r.ref_num) for r in lists[0] if r.session_id == p.session_id and (r.session_id, r.ref_num) not in taken]
        if free and -min(free)[0] >= matching.LOOKUP_LEAST:
            taken.add((p.session_id, min(free)[1]))
            want.append((p.session_id, min(free)[1], p.pdf_ord, pytest.approx(min(round(-min(free)[0] * 0.95, 3), 0.98))))
    monkeypatch.setattr(matching, "TABLE_CELLS", 60)  # three sources at a time
    order = lambda rows: sorted(rows, key=lambda r: r[:2])
    for small in (1000, 10):
        got = matching.match_left_in_order(refs, pdfs, small).select("session_id", "ref_num", "pdf_ord", "confidence").collect()
        assert order(map(tuple, got)) == order(want) and len(got) > 50
    written = []
    for module, name in ((matching, "settle"), (matching, "stored"), (similarity_join, "settle")):
        monkeypatch.setattr(module, name, lambda df, write=getattr(lineage, name): written.append((kept := write(df)).count()) or kept)
    known = pdfs.select(F.concat(F.lit("10.5/"), "session_id", "pdf_ord").alias("doi"), "title")
    found = matching.match_sources(refs, pdfs.withColumn("doi", F.concat(F.lit("10.5/"), "session_id", "pdf_ord")), known).collect()
    assert {r.method for r in found} == {"title", "lookup"} and max(written) <= 2 * 64  # rows of both sessions, not their pairs


def test_titles_that_are_just_alike_enough_are_looked_up(spark):
    refs = spark.createDataFrame([("s", 1, None, "abcdefghijkxxxxxxxxx")], "session_id string, ref_num long, doi string, title string")
    pdfs = spark.createDataFrame([("s", 0, "10.5/z", "abcdefghijkyyyyyyyyy")], "session_id string, pdf_ord long, doi string, title string")
    assert similarity.token_sort_ratio("abcdefghijkxxxxxxxxx", "abcdefghijkyyyyyyyyy") / 100 == matching.LOOKUP_LEAST
    assert [r.method for r in matching.match_sources(refs, pdfs).collect()] == ["lookup"]
    assert matching.title_pairs(refs, pdfs, matching.LOOKUP_LEAST).count() == 1


def test_compared_strings_have_the_ratios_of_pairs(monkeypatch):
    rng = random.Random(29)
    monkeypatch.setattr(similarity, "ABREAST", 16)
    for longest in (5, 32, 70, 200):
        a, b = (["", *("".join(rng.choice("abcd\u00e9 \u6f22\0" + more) for _ in range(rng.randrange(longest))) for _ in range(40))] for more in ("", "z"))
        table = similarity.Compared(a).ratios(b)
        assert [[similarity.ratio(x, y) for x in a] for y in b] == table.tolist()
        parts = {i: row for some, rows in similarity.Compared(a).tables(b) for i, row in zip(some, rows.tolist(), strict=True)}
        assert [parts[i] for i in range(len(b))] == table.tolist()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_abbreviations_are_masked_as_by_one_scan(spark):
    """Dots looked at from behind: the same as trying all abbreviations at every character."""
    rng = random.Random(17)
    parts = [*text_functions.ABBREVIATIONS, ".", ".", " ", "i", "e", "g", "sc", "x", "A", "1", "\n"]
    texts = ["Sci.e.g. x", "i.e.g. x", "sci.e. x", "NEUROSCI.e.g.", "e.g.", "i.e. J. Biol. A. B. 1.2.3 No.", *("".join(rng.choice(parts) for _ in range(12)) for _ in range(3000))]
    names = "|".join(a.replace(".", r"\.") for a in text_functions.ABBREVIATIONS)
    t = F.col("t")
    want = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, rf"(?i)({names})\.", "$1†"), r"(\d)\.(\d)", "$1†$2"), r"\b([A-Z])\.(?=\s*[A-Z]\.)", "$1†")
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select("t", want.alias("want"), text_functions.mask_abbreviations(t).alias("got")).collect()
    assert [r for r in rows if r.want != r.got] == [] and sum(r.t != r.got for r in rows) > 500


def test_detectors_compile_no_pattern_for_each_row_and_sentences_are_not_cut_from_the_whole_text(spark):
    df = spark.createDataFrame([("s", 1, "Ring (2001) saw it. So did others! And (Gear, 1999).")], "session_id string, para_idx long, text string")
    assert "split(" not in plan_of(df.select(spans.find_all(F.col("text"), citations.NARRATIVE)))
    found = df.select(text_functions.sentence_spans(F.col("text")).alias("s"))
    assert "substring(" not in plan_of(found)
    assert [tuple(x) for x in found.first().s] == [(0, 20), (20, 35), (35, 52)]


def test_citations_are_told_apart_where_paragraphs_lie_and_blocks_grow_in_number(spark, monkeypatch):
    rows = spark.range(3000).select(F.lit("s").alias("session_id"), F.col("id").alias("para_idx"), F.lit("Ring (2001) saw it. Gear saw it [1, 2].").alias("text")).repartition(7, "para_idx")
    found = citations.first_wins(citations.detect_citations(rows, citations.detect_style(rows)))
    assert "hashpartitioning(session_id" not in plan_of(found)
    monkeypatch.setattr(lineage, "PART_ROWS", 100)
    assert lineage.in_blocks(found, "para_idx")[0].rdd.getNumPartitions() == found.count() // 100
