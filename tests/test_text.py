"""Text functions and citations, against Python's own regular expressions and by example."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions import fold, similarity
from quillspark.functions import json as J
from quillspark.functions import text as T
from quillspark.functions.spans import find_all
from quillspark.operators import citations as C
from quillspark.operators import references as R
from quillspark.operators import scopes as S
from tests.conftest import SMALL


def one(spark, expression, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first()["y"]


def test_spans_are_finditer(spark):
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").filter("text is not null").select("text").collect()]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern in (r"\w\.", r"[A-Z][a-z]+", r"e[^ ]e"):
        java = pattern.replace(r"\w", r"(?U:\w)")
        for r in df.select("t", find_all(F.col("t"), java).alias("s")).collect():
            assert [(s.start, s.end, s.text) for s in r.s] == [(m.start(), m.end(), m[0]) for m in re.finditer(pattern, r.t)]


def reference_sentences(text):
    """Sentence spans by the stated rules, in plain Python."""
    names = "|".join(re.escape(a) for a in T.ABBREVIATIONS)
    masked = re.sub(rf"({names})\.", lambda m: m[0][:-1] + T.MASK, text, flags=re.I)
    masked = re.sub(r"(\d)\.(\d)", rf"\1{T.MASK}\2", masked)
    masked = re.sub(r"\b([A-Z])\.(?=\s*[A-Z]\.)", rf"\1{T.MASK}", masked)
    ends = [m.end() for m in re.finditer(r'[.!?]+(?:\s+(?=[A-Z(\["])|\s*$)', masked)]
    out = []
    for a, b in itertools.pairwise([0, *ends, len(text)]):
        if a < b and out and len(text[a:b].strip()) < 10:
            out[-1] = (out[-1][0], b)
        elif a < b:
            out.append((a, b))
    return out


def test_sentences(spark):
    texts = ["One sentence here. Another one follows! And see Fig. 2 of Smith et al. 2004. Short. J. A. Smith wrote 3.5 pages, i.e. few.", "No end", "", "Only. A. B. C. (Next) one begins here. [1] ends there?"]
    texts += [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").filter("length(text) between 20 and 900").limit(60).select("text").collect()]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.sentence_spans(F.col("t")).alias("s")).collect()
    for r in got:
        assert [(s.start, s.end) for s in r.s] == reference_sentences(r.t)


@pytest.mark.parametrize(
    ("text", "want"),
    [("1, 3-5, 7", [1, 3, 4, 5, 7]), ("5-1", []), ("1-200", []), ("2 – 4;9", [2, 3, 4, 9]), ("8", [8]), ("1-100", list(range(1, 101)))],
)
def test_number_ranges(spark, text, want):
    assert one(spark, C.expand_numbers, text) == want


def citations(spark, text):
    df = spark.createDataFrame([("s", 0, text)], "session_id string, para_idx long, text string")
    return C.first_wins(C.detect_citations(df), key_authors=True).orderBy("rank", "start", "nth").collect()


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("as shown (Smith et al., 2020).", [(["Smith"], "2020", None)]),
        ("(Smith and Jones, 2019; Brown, 2018a)", [(["Smith", "Jones"], "2019", None), (["Brown"], "2018a", None)]),
        ("(see Müller, 2001, 2003)", [(["Müller"], "2001", None), (["Müller"], "2003", None)]),
        ("Smith et al. (2020) found", [(["Smith"], "2020", None)]),
        ("Table (2020) and However (2001)", []),
        ("(Figure 2) (n = 20) (DNA) (5 mg) (Methods, 2020)", []),
        ("known [1, 3-4] and [7]", [([], None, 1), ([], None, 3), ([], None, 4), ([], None, 7)]),
        ("known²,³", [([], None, 2), ([], None, 3)]),
        ("(de Vries et al., 2020)", [([], "2020", None)]),
        ("(Lee, n.d.)", [(["Lee"], None, None)]),
    ],
)
def test_citations(spark, text, want):
    assert [(list(c.authors), c.year, c.number) for c in citations(spark, text)] == [pytest.approx(w) if not isinstance(w, tuple) else w for w in want] or [
        (list(c.authors), c.year, c.number) for c in citations(spark, text)
    ] == want


def test_first_wins_keys(spark):
    df = spark.createDataFrame([("s", 0, "(Smith, 2020; Jones, 2020)")], "session_id string, para_idx long, text string")
    assert C.first_wins(C.detect_citations(df)).count() == 1 and C.first_wins(C.detect_citations(df), key_authors=True).count() == 2


def test_styles(spark):
    df = spark.createDataFrame([("n", 0, "[1] [2] [3]"), ("a", 0, "(Smith, 2020)"), ("m", 0, "(Smith, 2020) [1]"), ("z", 0, "none")], "session_id string, para_idx long, text string")
    assert dict(C.detect_style(df).collect()) == {"n": "numbered", "a": "author_year", "m": "mixed", "z": "author_year"}


@pytest.mark.parametrize(
    ("text", "want"),
    [("Growth of 5% was seen", ("factual", "high")), ("n = 20 mice", ("factual", "high")), ("However it fails", ("contrast", "high")), ("they showed it", ("attribution", "medium")), ("by this protocol", ("methodological", "medium")), ("it is a gene", ("background", "low")), ("plain words", ("factual", "medium"))],
)
def test_claim_types(spark, text, want):
    assert tuple(one(spark, lambda x: S.claim_type(x, F.lit(False)), text)) == want


def test_scopes(spark):
    scope = lambda s, m, n: spark.createDataFrame([(s, m, n)], "s string, m string, n boolean").select(S.scope_of(F.col("s"), F.col("m"), F.col("n"))).first()[0]
    assert scope("Smith (2020) found cells grow.", "Smith (2020)", True) == "found cells grow."
    assert scope("Cells grow (Smith, 2020) fast [1].", "(Smith, 2020)", False) == "Cells grow fast"


@pytest.mark.parametrize(
    ("text", "doi"),
    [("x doi:10.1000/abc.1.", "10.1000/abc.1"), ("https://doi.org/10.1234/XY,", "10.1234/XY"), ("bare 10.5555/z;", "10.5555/z"), ("none", None)],
)
def test_dois(spark, text, doi):
    assert one(spark, T.extract_doi, text) == doi


def test_normalized_dois(spark):
    assert one(spark, T.normalize_doi, " HTTPS://dx.doi.org/10.1/AB. ") == "10.1/ab"
    assert one(spark, lambda x: T.dois_match(x, F.lit(None).cast("string")), "10.1/a") is False


def test_split_records(spark):
    df = spark.createDataFrame([("a", "[1] First one\ncontinues here\n[2] Second"), ("b", "A line that is long enough to be one\nAnother line that is long enough\nshort"), ("c", "")], "session_id string, text string")
    got = {(r.session_id, r.ref_id): r.raw_text for r in R.split_records(df).collect()}
    assert got == {("a", 1): "[1] First one continues here", ("a", 2): "[2] Second", ("b", 1): "A line that is long enough to be one", ("b", 2): "Another line that is long enough"}


def test_authors_and_title(spark):
    got = one(spark, R.authors_and_title, "[1] A. Courties, I. Kouki, Title of paper, Journal, 12 (2020) 1-2.")
    assert got.authors == ["A. Courties", "I. Kouki"] and got.title == "Title of paper, Journal"
    got = one(spark, R.authors_and_title, "2. Smith and others. A long title. Journal.")
    assert got.authors == ["Smith and others"] and got.title == "A long title"


def test_greedy_leaders(spark):
    pairs = spark.createDataFrame([("s", 1, 2), ("s", 2, 3), ("s", 3, 4), ("s", 1, 5)], "session_id string, a long, b long")
    assert {(r.ref_num, r.duplicate_of) for r in R.greedy_leaders(pairs).collect()} == {(2, 1), (5, 1), (4, 3)}


def test_leaders_as_one_by_one(spark):
    rng = random.Random(8)
    pairs = sorted({(s, *sorted(rng.sample(range(25), 2))) for s in "xyz" for _ in range(45)})
    want = {}
    for s, a, b in pairs:
        if (s, a) not in want and (s, b) not in want:
            want[s, b] = a
    got = R.greedy_leaders(spark.createDataFrame(pairs, "session_id string, a long, b long")).collect()
    assert {(r.session_id, r.ref_num): r.duplicate_of for r in got} == want


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_similarity():
    rng, pairs = random.Random(1), [("a" * 130, "ba" * 100), ("", "")]
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randrange(0, 90))) for _ in "ab")
        assert similarity.lcs_length(a, b) == slow_lcs(a, b)
        pairs.append((a, b))
    assert similarity.lcs_lengths(*map(list, zip(*pairs))).tolist() == [slow_lcs(a, b) for a, b in pairs]
    assert similarity.ratios([None, "", "ab"], ["x", "", "b"]).tolist() == [0.0, 100.0, 200 / 3]
    assert similarity.token_sort_ratio("b a", "a b") == 100 and similarity.partial_ratio("abc", "xxabcxx") == 100 and similarity.ratio("", "") == 100
    assert similarity.best_window("abcd", "xxabxdxx")[0] == 75


def test_names(spark):
    assert fold.plain("Müller") == "muller" and fold.plain("van der Berg") == "der berg" and fold.plain(None) is None
    assert one(spark, fold.last_name, "Smith, J.") == "Smith" and one(spark, fold.last_name, "John Smith") == "Smith"


@pytest.mark.parametrize(
    ("raw", "want"),
    [('{"a": 1}', 1), ('```json\n{"a": 2}\n```', 2), ('so {"a": 3} it is', 3), ('[{"a": 4}, 5]', 4), ("nothing", None), ("[1, 2]", None), ("{broken", None), (None, None)],
)
def test_json_salvage(spark, raw, want):
    assert one(spark, lambda x: J.field(J.extract_object(x), "a", "int"), raw) == want


def test_vote_of_answer(spark):
    got = one(spark, J.vote_of, 'x {"verdict": "supported", "confidence": 1.7}')
    assert tuple(got) == ("supported", 1.0, "") and one(spark, J.vote_of, "no") is None


def test_best_window_equals_all_windows_and_prunes(monkeypatch):
    rng, plain = random.Random(5), similarity.ratio
    for _ in range(300):
        query, text = ("".join(rng.choice("abcé\U0001f600"[: rng.randrange(1, 6)]) for _ in range(rng.randrange(1, n))) for n in (9, 40))
        for cut, starts in ((True, range(1 - len(query), len(text))), (False, range(max(1, len(text) - len(query) + 1)))):
            best = (0.0, 0, 0)
            for start in starts:
                low, high = max(start, 0), min(start + len(query), len(text))
                best = max(best, (plain(query, text[low:high]), low, high), key=lambda x: x[0])
            assert similarity.best_window(query, text, cut) == ((100.0, text.find(query), text.find(query) + len(query)) if query in text else best)
    calls = []
    monkeypatch.setattr(similarity, "ratio", lambda a, b: calls.append(1) or plain(a, b))
    words = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(4000))
    query = words[15_000:15_018] + "#" + words[15_019:15_040]
    assert similarity.best_window(query, words)[1:] == (15_000, 15_040) and len(calls) < 400


def test_quotes_are_validated(spark):
    from quillspark.operators import evidence

    source = "The first trial of  the new compound\nshowed a clear gain of 5 % in all groups, and " + "more text follows here. " * 20
    quotes = ["trial of the NEW compound showed", "trail of the new compond showed", "nothing of the kind was ever said", "  ", None, source]
    table = spark.createDataFrame([(i, q, source) for i, q in enumerate(quotes)] + [(9, "x", ""), (10, "y", None)], "id int, quote string, text string")
    got = {r.id: (r.found, round(r.similarity, 2), r.best_match) for r in evidence.validate_quotes(table).collect()}
    flat = " ".join(source.split())
    assert got[0][:2] == (True, 1.0) and got[1][0] and 0.85 <= got[1][1] < 1 and got[0][2] == flat[:32]
    assert not got[2][0] and 0 < got[2][1] < 0.85 and got[2][2] is None and got[5] == (True, 1.0, flat)
    assert all(got[i] == (False, 0.0, None) for i in (3, 4, 9, 10))


def test_quotes_are_located_in_whole_texts(spark):
    from quillspark.plans.sources import k03_locate_quotes

    found = k03_locate_quotes(spark, SMALL).collect()
    assert {r.kind for r in found if (r.end or 0) > 200} == {"benchmark", "document"} and all(r.end for r in found if r.similarity == 1)
