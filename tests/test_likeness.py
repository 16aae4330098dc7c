"""Similarity joins and approximate search against all pairs."""

import random

import pandas as pd
import pytest
from pyspark import TaskContext
from pyspark.accumulators import AccumulatorParam
from pyspark.sql import functions as F

from quillspark.functions import similarity
from quillspark.operators import approximate_search, claims, mapping, matching, references, similarity_join


def words(rng, n, alphabet="abcdeé "):
    return "".join(rng.choice(alphabet) for _ in range(n))


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        at = rng.randrange(len(out) + 1)
        if rng.random() < 0.5 and at < len(out):
            del out[at]
        else:
            out.insert(at, rng.choice("abcxyz "))
    return "".join(out)


def strings(rng, n, longest):
    base = [words(rng, rng.randrange(0, longest)) for _ in range(n // 3)]
    return [*base, *(edited(rng, rng.choice(base), rng.randrange(6)) for _ in range(n - len(base)))]


@pytest.mark.parametrize("least", [60.0, 75.0, 85.0, 95.0])
@pytest.mark.parametrize(("sort_tokens", "longest", "block"), [(True, 40, 1024), (False, 9, 7), (True, 12, 3)])
def test_similarity_join_as_all_pairs(spark, least, sort_tokens, longest, block):
    rng = random.Random(longest + int(least))
    left = [(rng.choice("pq"), s) for s in strings(rng, 60, longest)] + [("p", None), (None, "abc"), ("q", "")]
    right = [(rng.choice("pq"), s) for s in strings(rng, 30, longest) + rng.sample([s for _, s in left if s], 20)] + [("q", ""), (None, "abc")]
    got = similarity_join.similarity_join(spark.createDataFrame(left, "k string, a string"), spark.createDataFrame(right, "k string, b string"), ["k"], least, sort_tokens, block=block).collect()
    measure = similarity.token_sort_ratio if sort_tokens else similarity.ratio
    want = {(k, a, b): measure(a, b) for k, a in left for k2, b in right if k == k2 and None not in (k, a, b) and measure(a, b) >= least}
    assert len(got) == len(want) and {(r.k, r.a, r.b): pytest.approx(r.score) for r in got} == want


def test_grams_bound_the_ratio():
    """Strings as alike as the threshold share one of the grams that they are joined by, whatever the order of grams."""
    rng = random.Random(4)
    for _ in range(3000):
        a = words(rng, rng.randrange(1, 14), "abc")
        b = edited(rng, a, rng.randrange(6))
        least = rng.choice([70.5, 80.0, 85.0, 90.0, 99.0])
        often = {g: rng.randrange(5) for x in (a, b) for q in (1, 2) for g in similarity_join.grams(x, q)}
        if similarity.ratio(a, b) >= least:
            own, other = ({g for g, _, _ in similarity_join.keyed(x, least, often)} for x in (a, b))
            assert own & other


@pytest.mark.parametrize("least", [60.0, 85.0])
@pytest.mark.parametrize("block", [5, 1024])
def test_likest_as_all_pairs(spark, least, block):
    rng = random.Random(8)
    known = list(dict.fromkeys(s for s in strings(rng, 60, 30) if s))
    asked = list(dict.fromkeys([edited(rng, rng.choice(known), rng.randrange(9)) for _ in range(50)] + ["zzzz", known[0]]))
    got = similarity_join.best_like(spark.createDataFrame([(s,) for s in asked], "a string"), spark.createDataFrame([(s,) for s in known], "b string"), least, block=block)
    want = set()
    for a in asked:
        scores = {b: similarity.token_sort_ratio(a, b) for b in known}
        want |= {(a, b, s) for b, s in scores.items() if s == max(scores.values()) and s >= least}
    assert {(r.a, r.b, r.score) for r in got.collect()} == want


def test_lookup_finds_titles_without_a_common_word(spark):
    refs = spark.createDataFrame([(1, "Growth of cells under zinc"), (2, "nothing like it"), (3, None)], "ref_key long, title string")
    known = spark.createDataFrame([(7, "growthh off cellss undeer zincc"), (5, "growthh off cellss undeer zincc"), (6, "other")], "rec_key long, title string")
    (r,) = matching.lookup_by_title(refs, known).collect()
    assert (r.ref_key, r.rec_key) == (1, 5) and r.score == pytest.approx(similarity.token_sort_ratio("growth of cells under zinc", "growthh off cellss undeer zincc") / 100)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_likest_texts_as_all_pairs(spark, seed):
    rng = random.Random(seed)
    texts = [(rng.choice("st"), i, words(rng, rng.randrange(0, 120), "abcdefgh  é")) for i in range(40)]
    texts += [(k, 100 + i, t) for i, (k, _, t) in enumerate(texts[:10])]
    queries = []
    for k, _, t in rng.sample(texts, 30):
        at = rng.randrange(len(t) + 1)
        piece = t[at : at + rng.randrange(1, 50)]
        queries.append((k, edited(rng, piece, rng.choice([0, 0, 1, 2, 5, 12]))))
    queries += [(k, edited(rng, "xx" + t + "yy", rng.randrange(4))) for k, _, t in texts[:12]] + [("s", ""), ("s", None), (None, "abc"), ("u", "abc"), ("t", "a")]
    got = approximate_search.find_likest(spark.createDataFrame(queries, "k string, query string"), spark.createDataFrame(texts, "k string, place int, text string"), 80.0)
    want = {}
    for k, q in queries:
        if k and q:
            held = sorted((i, t) for g, i, t in texts if g == k and t)
            if exact := [i for i, t in held if q in t]:
                want[k, q] = (exact[0], 100.0)
            elif held:
                place, score = max(((i, similarity.partial_ratio(q, t)) for i, t in held), key=lambda x: (x[1], -x[0]))
                if score >= 80:
                    want[k, q] = (place, pytest.approx(score))
    assert {(r.k, r.query): (r.place, r.score) for r in got.collect()} == want
    assert len(want) > 20


def test_seeds_bound_the_partial_ratio():
    rng = random.Random(6)
    for _ in range(3000):
        text = words(rng, rng.randrange(8, 40), "abc")
        at = rng.randrange(len(text) - 5)
        query = edited(rng, text[at : at + rng.randrange(3, 20)], rng.randrange(5))
        for least, sizes in [*approximate_search.STEPS, (80.0, approximate_search.LAST)]:
            if query and len(query) <= len(text) and similarity.partial_ratio(query, text) >= least:
                share, found = approximate_search.seeds(query, least, sizes, {})
                assert not found or sum(n for g, n in found.items() if g in text) >= share


def test_claims_longer_than_their_paragraph(spark):
    """The paragraph is chosen by partial ratio, so one that is within the claim counts in full."""
    given = spark.createDataFrame([("s", 1, "zinc binds copper well in mice cells"), ("s", 2, "copper binds"), ("s", 3, "unlike anything else here")], "session_id string, claim_id int, claim_text string")
    text = spark.createDataFrame([("s", 0, "none of this"), ("s", 1, "zinc binds copper well"), ("s", 2, "coper binds and copper binds")], "session_id string, para_idx int, text string")
    got = {r.claim_id: (r.para_idx, r.start, r.similarity) for r in claims.place_claims(given, text).collect()}
    assert got == {1: (1, 0, 1.0), 2: (2, 16, 1.0)}


def test_names_of_citations_as_one_by_one(spark):
    """The fuzzy steps of the mapping against comparisons one by one."""
    rng = random.Random(3)
    names = ["smith", "smyth", "smithe", "garcia", "garcía", "li", "lee", "o'neil", "oneil", "van der berg", "vandenberg"]
    refs = [("s", i + 1, [f"{rng.choice(names)}"], 2000 + rng.randrange(4)) for i in range(25)]
    cits = [(i, "s", None, [edited(rng, rng.choice(names), rng.randrange(3))], str(1999 + rng.randrange(6))) for i in range(60)]
    got = mapping.map_citations(spark.createDataFrame(cits, "cit_key int, session_id string, number int, authors array<string>, year string"), spark.createDataFrame(refs, "session_id string, ref_num int, authors array<string>, year int"))
    plain = spark.createDataFrame([(i, x) for i, x in enumerate(names)], "i int, x string").select(F.lit(1)).count()
    assert plain == len(names)
    from quillspark.functions.fold import last_name, plain_name

    fold = lambda xs, last: [r[0] for r in spark.createDataFrame(list(enumerate(xs)), "i int, x string").orderBy("i").select(plain_name(last_name(F.col("x")) if last else F.col("x"))).collect()]
    ref_names, cit_names = fold([r[2][0] for r in refs], True), fold([c[3][0] for c in cits], False)
    for r in got.collect():
        name, year = cit_names[r.cit_key], int(cits[r.cit_key][4])
        scored = [(similarity.ratio(name, n), y, k) for (_, k, _, y), n in zip(refs, ref_names)]
        exact = [k for s, y, k in scored if s == 100 and y == year]
        fuzzy = sorted(((-s, k) for s, y, k in scored if s >= 85 and y == year))
        alone = [k for s, _, k in scored if s >= 85]
        want = ("exact_author_year", exact[0]) if exact else ("fuzzy_author_year", fuzzy[0][1]) if fuzzy else ("author_only", min(alone)) if alone else ("unresolved", None)
        assert (r.method, r.ref_num) == want, (name, year)


def test_duplicates_as_one_by_one(spark):
    rng = random.Random(9)
    titles = [words(rng, rng.randrange(5, 40)) for _ in range(15)]
    rows = [("s", i, rng.choice([None, "10.1/a", "10.1/b"]) if rng.random() < 0.2 else None, edited(rng, rng.choice(titles), rng.randrange(4)), rng.choice(["x", "y"]), 2000 + rng.randrange(2)) for i in range(60)]
    refs = spark.createDataFrame(rows, "session_id string, ref_num int, doi string, title string, surname string, year int")
    want = set()
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            s = similarity.token_sort_ratio(a[3].strip(), b[3].strip()) if a[3].strip() and b[3].strip() else 0
            if (a[2] and a[2] == b[2]) or s >= 95 or (s >= 85 and a[4:] == b[4:]):
                want.add((a[1], b[1]))
    assert {(r.a, r.b) for r in references.duplicate_pairs(refs).collect()} == want and want


def test_sessions_of_any_size_are_settled_alike(spark):
    """In a task, in rounds, and some sessions each way."""
    rng = random.Random(12)
    scores = [(f"s{rng.randrange(3)}", p, r, rng.choice([0.5, 0.6, 0.7, 0.8, 0.9])) for p in range(14) for r in range(14) if rng.random() < 0.5]
    want = set()
    for s in {x[0] for x in scores}:
        free = {x[2] for x in scores}
        for p in range(14):
            mine = sorted((-c, r) for t, q, r, c in scores if t == s and q == p and r in free and c >= 0.55)
            if mine:
                free.discard(mine[0][1])
                want.add((s, mine[0][1], p))
    pairs = sorted({(f"s{rng.randrange(3)}", *sorted(rng.sample(range(20), 2))) for _ in range(90)})
    taken = {}
    for s, a, b in sorted(pairs, key=lambda x: (x[0], x[2], x[1])):
        if (s, a) not in taken and (s, b) not in taken:
            taken[s, b] = a
    table, edges = spark.createDataFrame(scores, "session_id string, pdf_ord int, ref_num int, score double"), spark.createDataFrame(pairs, "session_id string, a int, b int")
    for small in (0, 30, 10**6):
        assert {(r.session_id, r.ref_num, r.pdf_ord) for r in matching.match_in_order(table, small).collect()} == want
        assert {(r.session_id, r.ref_num): r.duplicate_of for r in references.greedy_leaders(edges, small).collect()} == taken


class Tasks(AccumulatorParam):
    """The numbers of tasks that something ran in."""

    def zero(self, value):
        return frozenset()

    def addInPlace(self, value, more):  # noqa: N802
        return value | more


def test_few_pairs_are_compared_in_several_tasks(spark, monkeypatch):
    """Pairs are few bytes and much work, so their tasks follow from their number and not from their bytes."""
    ran = spark.sparkContext.accumulator(frozenset(), Tasks())
    least = similarity.partial_ratio

    def scored(a, b):
        ran.add(frozenset([TaskContext.get().partitionId()]))
        return pd.Series([least(x, y) for x, y in zip(a, b, strict=True)])

    monkeypatch.setattr(approximate_search, "partial", lambda a, b, least=0.0: F.pandas_udf(scored, "double")(a, b))
    rng = random.Random(5)
    texts = [("s", i, words(rng, 60)) for i in range(60)]
    queries = [("s", edited(rng, t[5:45], 4)) for _, _, t in texts]
    got = approximate_search.find_likest(spark.createDataFrame(queries, "k string, query string"), spark.createDataFrame(texts, "k string, place int, text string"), 80.0)
    assert {r.query: r.place for r in got.collect()}.items() >= {q: i for i, (_, q) in enumerate(queries) if least(q, texts[i][2]) > 90}.items()
    assert len(ran.value) == spark.sparkContext.defaultParallelism


def test_texts_of_claims_and_paragraphs_are_made_once(spark):
    made, read = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def counting(count):
        def same(texts):
            count.add(len(texts))
            return texts

        return F.pandas_udf(same, "string").asNondeterministic()("text")  # else a filter makes it twice

    rows = spark.createDataFrame([("s", i, f"paragraph {i % 7} of zinc and copper") for i in range(50)], "session_id string, para_idx int, text string")
    asked = rows.select("session_id", F.col("para_idx").alias("claim_id"), F.replace(counting(made), F.lit("copper"), F.lit("coper")).alias("claim_text"))
    got = claims.place_claims(asked, rows.withColumn("text", counting(read))).collect()
    assert {r.claim_id: r.para_idx for r in got} == {i: i % 7 for i in range(50)}
    assert (made.value, read.value) == (50, 50)


def test_windows_below_the_least_ratio_change_nothing(monkeypatch):
    rng = random.Random(7)
    monkeypatch.setattr(similarity, "PLACE_CELLS", 100)
    for _ in range(500):
        text = words(rng, rng.randrange(1, 60))
        query = edited(rng, text[rng.randrange(len(text)) :][:20], rng.randrange(6))
        every = similarity.partial_ratio(query, text)
        short, long = sorted((query, text), key=len)
        brute = max((similarity.ratio(short, long[max(0, i) : i + len(short)]) for i in range(1 - len(short), len(long))), default=0.0) if short else every
        assert every == brute
        for least in (60.0, 80.0, 95.0):
            got = similarity.partial_ratio(query, text, least)
            assert got == every if every >= least else got < least
