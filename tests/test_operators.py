"""Voting, matching, stores, sources and streams by example."""

import io
import random
import zipfile

from pyspark.sql import functions as F

from quillspark.operators import citations, claims, evidence, mapping, matching, results, scopes, sections, stores, voting
from quillspark.plans import manuscripts
from quillspark.sources import docx
from quillspark.streaming import events as E
from tests.conftest import SMALL

VOTE = "unit_id long, vote_ord long, tier int, verdict string, confidence double, reasoning string, quote string"


def votes(spark, *lists):
    return spark.createDataFrame([(u, i, t, v, c, f"r{i}", f"q{i % 2}") for u, own in enumerate(lists) for i, (t, v, c) in enumerate(own)], VOTE)


S, P, N, C, X = "supported", "partially_supported", "not_supported", "cannot_verify", "contradicted"


def test_consensus_rules(spark):
    got = {r.unit_id: (r.verdict, r.confidence, r.consensus_type, r.agreement_ratio) for r in voting.determine_consensus(votes(
        spark, [(0, S, 0.8), (0, S, 0.9), (0, C, 0.1)], [(0, S, 0.8), (0, S, 0.6), (0, N, 0.9)], [(0, S, 0.8), (0, N, 0.9)], [(0, S, 0.9), (0, X, 0.9)], [(0, C, 0.9)],
        [(0, S, 0.5), (0, S, 0.5), (0, S, 0.8), (0, N, 0.9), (0, P, 0.9)],
    )).collect()}
    assert got[0] == (S, 0.9, "unanimous", 1.0) and got[1] == (S, 0.7, "supermajority", 0.667) and got[2][2] == got[3][2] == "escalate"
    assert got[4] == (C, 0.0, "all_abstain", 1.0) and got[5] == (S, 0.57, "majority", 0.6)


def test_escalation_accumulates_votes(spark):
    got = {r.unit_id: (r.verdict, r.consensus_type, r.final_tier, r.escalation_path) for r in voting.escalate(votes(
        spark, [(0, S, 0.8)], [(0, S, 0.8), (0, N, 0.8), (1, S, 0.9)], [(0, X, 0.8), (1, S, 0.9), (2, C, 0.4)], [(0, S, 0.8), (0, N, 0.9), (3, P, 0.3)], [(0, S, 0.8), (0, N, 0.9)],
    )).collect()}
    assert got[0] == (S, "unanimous", 0, "0") and got[1] == (S, "supermajority", 1, "0>1") and got[2] == (C, "tiebreaker", 2, "0>1>2")
    assert got[3] == (P, "tiebreaker", 3, "0>3") and got[4] == (N, "fallback", 0, "0")


def test_evidence_of_agreeing_votes(spark):
    table = votes(spark, [(0, S, 0.8), (0, N, 0.99), (0, S, 0.9), (0, S, 0.9)])
    got = voting.merge_evidence(table, spark.createDataFrame([(0, S)], "unit_id long, verdict string")).first()
    assert (got.reasoning, got.quotes) == ("r2", "q0 | q1")


def indel(a, b):
    rows = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, rows[j] = rows[j], before + 1 if x == y else max(rows[j], rows[j - 1])
    return 2 * rows[-1] / (len(a) + len(b)) if a or b else 1.0


def brute_matches(refs, pdfs, known):
    """The three passes, source by source."""
    likeness = lambda a, b: indel(" ".join(sorted(a.lower().split())), " ".join(sorted(b.lower().split())))
    out, taken, done = {}, set(), set()
    for pdf, doi, _ in pdfs:
        r = next((n for n, d, _ in refs if d and doi and d.lower() == doi.lower()), None)
        if r is not None and r not in taken:
            out[r], _ = (pdf, "doi", 0.99, ""), (taken.add(r), done.add(pdf))
    open_refs = [r for r in refs if r[0] not in taken]
    for pdf, _, title in pdfs:
        if pdf in done:
            continue
        best, best_ref, others = 0.0, None, []
        for n, _, t in open_refs:
            s = likeness(title, t)
            if s > best:
                others += [best_ref] if best_ref is not None and best >= 0.6 else []
                best, best_ref = s, n
            elif s >= 0.6:
                others.append(n)
        if best >= 0.6 and best_ref not in taken:
            out[best_ref], _ = (pdf, "title", round(best * 0.95, 3), ",".join(f"ref_{n}" for n in others)), (taken.add(best_ref), done.add(pdf))
    open_refs = [r for r in refs if r[0] not in taken]
    for pdf, doi, title in pdfs:
        if pdf in done or not doi:
            continue
        scores = [(-likeness(known.get(doi.lower(), title), t), n) for n, _, t in open_refs if n not in taken]
        if scores and -min(scores)[0] >= 0.55:
            s, r = min(scores)
            out[r], _ = (pdf, "lookup", min(round(-s * 0.95, 3), 0.98), ""), (taken.add(r), done.add(pdf))
    return out


def test_sources_are_matched_as_one_by_one(spark):
    rng = random.Random(12)
    word = lambda: rng.choice(["alpha", "alps", "beta", "betas", "gamma", "gamut", "delta", "deltoid", "omega"])
    for _ in range(3):
        refs = [(n, f"10.1/{rng.randrange(30)}" if rng.random() < 0.5 else None, " ".join(word() for _ in range(4))) for n in range(1, 25)]
        pdfs = [(n, f"10.1/{rng.randrange(60)}" if rng.random() < 0.7 else None, " ".join(word() for _ in range(4))) for n in range(30)]
        known = {f"10.1/{i}": " ".join(word() for _ in range(4)) for i in range(0, 60, 3)}
        got = matching.match_sources(
            spark.createDataFrame([("s", *r) for r in refs], "session_id string, ref_num long, doi string, title string"),
            spark.createDataFrame([("s", *p) for p in pdfs], "session_id string, pdf_ord long, doi string, title string"),
            spark.createDataFrame(list(known.items()), "doi string, title string"),
        )
        assert {r.ref_num: (r.pdf_ord, r.method, r.confidence, ",".join(r.alternatives)) for r in got.collect()} == brute_matches(refs, pdfs, known)


def test_a_source_without_doi_has_no_third_pass(spark):
    refs = spark.createDataFrame([("s", 1, None, "abcdefg klmnop")], "session_id string, ref_num long, doi string, title string")
    pdfs = lambda doi: spark.createDataFrame([("s", 0, doi, "abcdefg qrstuv")], "session_id string, pdf_ord long, doi string, title string")
    assert 0.55 <= indel("abcdefg klmnop", "abcdefg qrstuv") < 0.6 and matching.match_sources(refs, pdfs(None)).count() == 0
    assert [r.method for r in matching.match_sources(refs, pdfs("10.5/z")).collect()] == ["lookup"]


def test_mapping_cascade(spark):
    refs = spark.createDataFrame([("s", 1, 2018, ["Smith, J.", "Lee K"]), ("s", 2, 2018, ["John Smith"]), ("s", 3, 2019, ["A. Schmidt"]), ("s", 4, 2020, ["Paul Marks", "Ann Zöller"])], "session_id string, ref_num long, year int, authors array<string>")
    rows = [("n", 3, [], None), ("e", None, ["Smith"], "2018b"), ("f", None, ["Schmitd"], "2019"), ("m", None, ["Zoller", "Marks"], "2020"), ("a", None, ["Schmidt"], "1999"), ("u", None, ["Nobody"], "2001"), ("x", 99, [], None)]
    cits = spark.createDataFrame([(k, "s", n, a, y) for k, n, a, y in rows], "cit_key string, session_id string, number int, authors array<string>, year string")
    got = {r.cit_key: (r.ref_num, r.method) for r in mapping.map_citations(cits, refs).collect()}
    assert got == {"n": (3, "number"), "e": (1, "exact_author_year"), "f": (3, "fuzzy_author_year"), "m": (4, "multi_author_year"), "a": (3, "author_only"), "u": (None, "unresolved"), "x": (None, "unresolved")}


def test_sources_are_matched_one_to_one(spark):
    refs = spark.createDataFrame([("s", 1, "10.1/A", "alpha beta gamma"), ("s", 2, None, "delta epsilon zeta"), ("s", 3, None, "qqq www xxx jjj")], "session_id string, ref_num long, doi string, title string")
    pdfs = spark.createDataFrame([("s", 0, "doi:10.1/a.", "whatever"), ("s", 1, None, "zeta delta epsilon"), ("s", 2, None, "delta epsilon zetta"), ("s", 3, None, "unlike all of them")], "session_id string, pdf_ord long, doi string, title string")
    got = {r.ref_num: (r.pdf_ord, r.method, r.status) for r in matching.match_sources(refs, pdfs).collect()}
    assert got == {1: (0, "doi", "accept"), 2: (1, "title", "accept")}


def test_sequential_assignment(spark):
    scores = spark.createDataFrame([("s", 1, 0, 0.9), ("s", 2, 0, 0.8), ("s", 1, 1, 0.95), ("s", 2, 1, 0.6), ("s", 3, 2, 0.5)], "session_id string, ref_num long, pdf_ord long, score double")
    assert {(r.ref_num, r.pdf_ord) for r in matching.match_in_order(scores).collect()} == {(1, 0), (2, 1)}


def test_stores(spark):
    table = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "session_id string, k int, v string")
    new = spark.createDataFrame([("a", 9, "n")], "session_id string, k int, v string")
    assert sorted(map(tuple, stores.replace_sessions(table, new).collect())) == [("a", 9, "n"), ("b", 1, "z")]
    changes = spark.createDataFrame([("a", 1, "old", 1), ("a", 1, "new", 2), ("c", 1, None, 1)], "session_id string, k int, v string, seq int")
    assert sorted(map(tuple, stores.upsert(table, changes, ["session_id", "k"], "seq").collect()), key=str) == [("a", 1, "new"), ("a", 2, "y"), ("b", 1, "z"), ("c", 1, None)]
    assert {n: t.count() for n, t in stores.cascade_delete({"t": table}, new).items()} == {"t": 1}
    cache = spark.createDataFrame([("k1", "v", "2030-01-01"), ("k2", "v", "2000-01-01")], "key string, value string, e string").withColumn("expires_at", F.to_timestamp("e"))
    hits = stores.cache_get(spark.createDataFrame([("k1",), ("k2",)], "key string"), cache, F.to_timestamp(F.lit("2020-01-01")))
    assert dict((r.key, r.hit) for r in hits.collect()) == {"k1": True, "k2": False}


def test_relevant_sections(spark):
    long = "\n\n".join([f"Methods\nfiller paragraph number {i} with nothing of interest in it at all" for i in range(40)] + ["Results\nthe copper enzyme binds zinc with 45% yield in the assay described"])
    sources = spark.createDataFrame([(1, long), (2, "short text")], "source_id long, text string")
    asked = spark.createDataFrame([(1, 1, "copper enzyme binds zinc 45%"), (2, 2, "anything"), (3, 1, "qqq www")], "claim_id long, source_id long, claim_text string")
    got = {r.claim_id: (r.heading, r.section[:20]) for r in evidence.relevant_sections(asked, sources).collect()}
    assert got[1] == ("Results", "Results\nthe copper e") and got[2] == ("Full Text", "short text") and got[3][0] == "Abstract"


def test_quotes_are_located(spark):
    pairs = spark.createDataFrame([("the cat sat", "see: the cat sat down"), ("the cat sat", "see: the bat sat down"), ("5% more", "about 6% more"), ("qqqq", "nothing")], "quote string, text string")
    got = [(r.start, r.end, r.match_type) for r in evidence.locate_quotes(pairs).orderBy("quote", "text").collect()]
    assert got == [(6, 13, "numeric_mismatch"), (None, None, None), (5, 16, "paraphrased"), (5, 16, "direct")]


def test_contained_quotes(spark):
    quotes = spark.createDataFrame([(1, "b c d e f g"), (2, "x y z u v w")], "quote_id long, quote string")
    texts = spark.createDataFrame([(1, "aab c d e f gg"), (2, "b c d e"), (3, None)], "source_id long, text string")
    assert [tuple(r) for r in evidence.contained_quotes(quotes, texts).collect()] == [(1, 1, 2, 13)]


def test_claims_are_placed(spark):
    asked = spark.createDataFrame([("s", 1, "cells grow"), ("s", 2, "zinc binds copper well")], "session_id string, claim_id long, claim_text string")
    text = spark.createDataFrame([("s", 0, "nothing"), ("s", 1, "here cells grow fast"), ("s", 2, "the zinc binds coper well now")], "session_id string, para_idx long, text string")
    assert {r.claim_id: r.para_idx for r in claims.place_claims(asked, text).collect()} == {1: 1, 2: 2}


def test_missing_citations(spark):
    sections = spark.createDataFrame([("s", 0, "Intro", "It has been shown that cells grow.\nWe performed 5% more work here today.\nIron is known to rust in the presence of water."), ("s", 1, "References", "It has been shown again and again.")], "session_id string, section_ord long, heading string, text string")
    cited = spark.createDataFrame([("s", 2, 0, 47)], "session_id string, para_idx long, sent_start int, sent_end int")
    assert [(r.para_idx, r.category) for r in scopes.missing_citations(sections, cited).collect()] == [(0, "attribution")]


def test_pages_and_sweep(spark):
    rows = spark.createDataFrame([(i, v, 0.5) for i, v in enumerate([S, X, N, S])], "row_id long, verdict string, confidence double")
    assert [r.row_id for r in results.page(rows, results.sort_keys("", "row_id"), 1, 3).collect()] == [1, 2, 0]
    spans = spark.createDataFrame([(0, 0, 10), (0, 5, 12), (0, 6, 8)], "para_idx long, start long, end long")
    assert [tuple(r) for r in results.sweep_highlights(spans).orderBy("start").collect()] == [(0, 0, 10), (0, 10, 12)]


def make_docx(paragraphs, extra=""):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' for s, t in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}{extra}</w:body></w:document>")
    return out.getvalue()


def test_docx_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(make_docx([("Heading1", "Intro"), ("Normal", "Text [1]."), ("Normal", "More."), ("Heading1", "Empty"), ("Heading1", "References"), ("Normal", "[1] Smith. A title of some length."), ("Normal", "[2] Jones. Another title.")], "<!-- --><w:p><w:r><w:instrText>ADDIN ZOTERO_ITEM x</w:instrText></w:r></w:p>"))
    (tmp_path / "b.docx").write_bytes(make_docx([("Bibliography", "First ref"), ("Bibliography", "Second ref")]))
    (tmp_path / "c.docx").write_bytes(b"not a zip")
    files = docx.read_files(spark, str(tmp_path))
    found = docx.paragraphs(files)
    parts = docx.sections(found)
    name = lambda p: p[-6:]
    assert [(name(r.session_id), r.section_ord, r.heading, r.text) for r in parts.orderBy("session_id", "section_ord").collect()][:2] == [("a.docx", 0, "Intro", "Text [1].\nMore."), ("a.docx", 1, "References", "[1] Smith. A title of some length.\n[2] Jones. Another title.")]
    assert sorted((name(r.session_id), r.ref_id, r.raw_text[:9]) for r in docx.raw_references(found, parts).collect()) == [("a.docx", 1, "[1] Smith"), ("a.docx", 2, "[2] Jones"), ("b.docx", 1, "First ref"), ("b.docx", 2, "Second re")]
    assert {name(r.path): r.has_field_codes for r in docx.field_marks(files).collect()} == {"a.docx": True, "b.docx": False, "c.docx": False}


def test_event_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet").select(F.col("user_id").cast("string").alias("session_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 8).cast("int").alias("stage"), F.col("event_type").alias("status"), F.col("value").alias("elapsed"), F.col("props").alias("message"))
    events.union(events.filter("event_id % 5 = 0")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    E.append_stream(E.without_doubles(stream, "400 days"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()
    query = E.stage_status(stream).writeStream.outputMode("complete").format("memory").queryName("status").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {tuple(r) for r in spark.table("status").select("session_id", "stage", "status", "elapsed").collect()} == {tuple(r) for r in E.stage_status(events).select("session_id", "stage", "status", "elapsed").collect()}


def test_event_rows_round_trip(spark):
    df = spark.createDataFrame([(1, {"a": 1})], "event_id long, progress map<string,int>")
    assert E.from_rows(E.to_rows(df, ["progress"]), {"progress": "map<string,int>"}).first()["progress"] == {"a": 1}


def test_docx_to_claims(spark, tmp_path):
    body = [
        ("Heading1", "Intro"), ("Normal", "Copper is known to bind zinc strongly in all cases [2]."), ("Normal", "However, iron does not bind it at all (Smith, 2010)."),
        ("Heading1", "References"), ("Normal", "[1] J. Smith, On iron and other metals. J Test 2010; 1:2."), ("Normal", "[2] K. Jones, Copper and zinc in depth. J Test 2012; 3:4."),
    ]
    (tmp_path / "a.docx").write_bytes(make_docx(body))
    (tmp_path / "b.docx").write_bytes(make_docx([("Normal", "No lists here.")]))
    (tmp_path / "c.docx").write_bytes(b"broken")
    files = docx.read_files(spark, str(tmp_path))
    claims = manuscripts.claims_of_files(files).orderBy("claim_id").collect()
    assert [(r.reference_ids, r.claim_type, r.location.para_idx, r.section, r.location.citation_markers) for r in claims] == [([2], "background", 0, "Intro", ["[2]"]), ([1], "contrast", 0, "Intro", ["(Smith, 2010)"])]
    found = docx.paragraphs(files)
    got = docx.warnings(files, found, docx.raw_references(found, docx.sections(found))).collect()
    assert sorted((r.session_id.rsplit("/", 1)[1], r.warning) for r in got) == [("b.docx", "no references found"), ("c.docx", "no text")]


def test_single_paragraphs_choose_their_detectors(spark):
    rows = [(0, "As (Smith, 2001) and Lee (2002) say."), (1, "As shown [3, 5-6]."), (2, "Both [1] and (Kim, 2003).")]
    text = spark.createDataFrame([("s", i, t) for i, t in rows], "session_id string, para_idx int, text string")
    found = citations.detect_in_paragraphs(text, sections.style_of_text(F.col("text"))).collect()
    got = {i: sorted(str((r.year, r.number)) for r in found if r.para_idx == i) for i in range(3)}
    assert got == {0: ["('2001', None)", "('2002', None)"], 1: ["(None, 3)", "(None, 5)", "(None, 6)"], 2: ["('2003', None)", "(None, 1)"]}


def test_groups_as_the_detector_reads_them(spark):
    """'as reviewed by' is a lead-in of a single citation only, and 'see' needs no blank after it."""
    texts = ["(as reviewed by Smith, 2001)", "(as reviewed by Smith, 2001; Lee, 2002)", "(Seeger, 2003)", "(see Kim and Lee, 2004, 2005a)", "(Ring, n.d.)"]
    table = spark.createDataFrame([("s", i, t) for i, t in enumerate(texts)], "session_id string, para_idx int, text string")
    got = {}
    for r in citations.detect_citations(table).orderBy("para_idx", "nth").collect():
        got.setdefault(r.para_idx, []).append((r.raw_marker, r.authors, r.year))
    assert got[0] == [(texts[0], ["Smith"], "2001")] and got[1] == [("(as reviewed by Smith, 2001)", [], "2001"), ("(Lee, 2002)", ["Lee"], "2002")]
    assert got[2] == [(texts[2], [], "2003")] and got[3] == [("(Kim, Lee, 2004)", ["Kim", "Lee"], "2004"), ("(Kim, Lee, 2005a)", ["Kim", "Lee"], "2005a")] and got[4][0][2] is None


def test_lookup_by_title(spark):
    refs = spark.createDataFrame([(1, "Copper binds zinc strongly"), (2, "Iron alone"), (3, None), (4, "zinc strongly binds copper")], "ref_key long, title string")
    known = spark.createDataFrame([(10, "copper binds zinc strongly"), (11, "Copper binds zinc weakly"), (12, ""), (13, "nothing alike")], "rec_key long, title string")
    got = {r.ref_key: (r.rec_key, round(r.score, 3)) for r in matching.lookup_by_title(refs, known).collect()}
    assert got == {1: (10, 1.0), 4: (10, 1.0)}


def test_library_and_migration(spark):
    library = spark.createDataFrame([("doi_1", "/a.pdf", 1048576), ("title_2", "/b.pdf", 524288)], "lib_key string, path string, bytes long")
    refs = spark.createDataFrame([("doi_1", None), ("title_2", "/own.pdf"), ("none", None)], "lib_key string, pdf_path string")
    assert {r.lib_key: r.pdf_path for r in stores.enrich_from_library(refs, library).collect()} == {"doi_1": "/a.pdf", "title_2": "/own.pdf", "none": None}
    assert tuple(stores.library_stats(library).first()) == (2, 1.5)
    assert tuple(stores.library_stats(library.limit(0)).first()) == (0, None)
    wider = stores.add_columns(library, {"added_at": "timestamp", "path": "int"})
    assert wider.dtypes[-1] == ("added_at", "timestamp") and wider.schema["path"].dataType.simpleString() == "string" and wider.filter("added_at IS NULL").count() == 2


def test_files_dates_and_priorities(spark):
    from quillspark.operators import claims, records
    from quillspark.sources.docx import is_pdf

    files = spark.createDataFrame([(bytearray(b"%PDF-1.7 x"),), (bytearray(b"PK.."),), (bytearray(b""),), (None,)], "content binary")
    assert [r[0] for r in files.select(is_pdf(F.col("content"))).collect()] == [True, False, False, None]
    dates = spark.createDataFrame([([[2020, 5, 1]],), ([[2019]],), ([],), (None,)], "p array<array<int>>")
    assert [r[0] for r in dates.select(records.update_date(F.col("p"))).collect()] == ["2020-5-1", "2019", "", ""]
    kinds = spark.createDataFrame([(k,) for k in ("factual", "contrast", "methodological", "background", "attribution", "interpretive", "other", None)], "claim_type string")
    assert [r.priority for r in claims.default_priority(kinds).collect()] == ["high", "high", "medium", "low", "low", "low", "medium", "medium"]
    given = spark.createDataFrame([("s", 1, [3, 1, 9]), ("s", 2, []), ("t", 1, [1])], "session_id string, claim_id int, reference_ids array<int>")
    refs = spark.createDataFrame([("s", 1, "one"), ("s", 3, "three")], "session_id string, ref_num int, title string")
    got = [(r.claim_id, r.ref_pos, r.title) for r in claims.explode_for_verification(given, refs).orderBy("ref_pos").collect()]
    assert got == [(1, 0, "three"), (1, 1, "one")]


def test_overrides_in_batches(spark):
    from quillspark.operators import results

    rows = spark.createDataFrame([(1, 10, "supported", 0.9, True), (1, 11, "supported", 0.8, True), (2, 20, "contradicted", 0.7, True)], "claim_id int, row_id int, verdict string, confidence double, needs_review boolean")
    batch = lambda *r: spark.createDataFrame(list(r), "claim_id int, new_verdict string")
    out = results.override(results.override(results.override(rows, batch((1, "contradicted")), "row_id"), batch((2, "supported"), (7, "supported")), "row_id"), batch((1, "cannot_verify")), "row_id")
    got = {r.row_id: (r.verdict, r.original_verdict, r.original_confidence, r.overridden, r.needs_review) for r in out.collect()}
    assert got == {10: ("cannot_verify", "supported", 0.9, True, False), 11: ("supported", None, None, False, True), 20: ("supported", "contradicted", 0.7, True, False)}
    assert {(r.claim_id, r.original_verdict, r.new_verdict) for r in results.report_diff(out).collect()} == {(1, "supported", "cannot_verify"), (2, "contradicted", "supported")}


def test_quotes_of_a_tier(spark):
    given = spark.createDataFrame([(1, ["copper binds zinc", "no such words here at all"], 0.1, False), (2, ["copper binds zinc"], 0.9, False), (3, [], 0.5, False), (4, ["anything"], 0.5, False)], "claim_id int, quotes array<string>, confidence double, needs_review boolean")
    texts = spark.createDataFrame([(i, "we saw that copper binds zinc in mice") for i in (1, 2, 3)] + [(4, "")], "claim_id int, text string")
    got = {r.claim_id: (r.confidence, r.needs_review) for r in evidence.validate_tier(given, texts).collect()}
    assert got == {1: (0.0, True), 2: (0.9, False), 3: (0.5, False), 4: (0.5, False)}


def test_suffixes_and_candidates(spark):
    from quillspark.operators import coverage

    refs = spark.createDataFrame([("s", 1, ["Smith, J."], 2001), ("s", 4, ["Smith, A."], 2001), ("s", 9, ["Smith, B."], 2002), ("s", 5, [], 2001), ("s", 6, ["Lee"], None)], "session_id string, ref_num int, authors array<string>, year int")
    cits = spark.createDataFrame([(1, "s", ["Smith"], "2001a"), (2, "s", ["Smith"], "2001b"), (3, "s", ["Smith"], "2001"), (4, "s", ["Smith"], "2001c"), (5, "s", ["Smith"], "2002"), (6, "s", ["Lee"], "2001"), (7, "s", None, "2001"), (8, "s", ["Smith"], None)], "cit_key int, session_id string, authors array<string>, year string")
    got = {}
    for r in coverage.candidates(cits, refs).orderBy("ref_num").collect():
        got.setdefault(r.cit_key, []).append((r.ref_num, r.n_candidates, r.is_ambiguous))
    both = [(1, 2, True), (4, 2, True)]
    assert got == {1: [(1, 1, False)], 2: [(4, 1, False)], 3: both, 4: both, 5: [(9, 1, False)]}


def test_intervals_meet_as_in_all_pairs(spark):
    import random

    from quillspark.operators.intervals import interval_join

    rng = random.Random(4)
    span = lambda: (s := rng.randrange(0, 3000), s + rng.choice([0, 1, 5, 60, 700, 2500]))
    left, right = [(rng.choice("ab"), i, *span()) for i in range(120)], [(rng.choice("ab"), i, *span()) for i in range(120)]
    x, y = spark.createDataFrame([*left, ("a", -1, None, 5)], "k string, i int, start int, end int"), spark.createDataFrame(right, "k string, j int, start int, end int")
    end = lambda r: max(r[3], r[2] + 1)
    for how, meets in (("overlaps", lambda a, b: a[2] < end(b) and b[2] < end(a)), ("starts_in", lambda a, b: a[2] <= b[2] < end(a))):
        got = sorted((r.i, r.j) for r in interval_join(x, y, ["k"], how, width=4).collect())
        assert got == sorted((a[1], b[1]) for a in left for b in right if a[0] == b[0] and meets(a, b)) and got
    assert interval_join(x.limit(0), y, ["k"]).count() == 0
    plan = interval_join(x, y, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
