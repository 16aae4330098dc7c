"""Whitening, decontamination and collocations against brute-force versions, and on rows of every awkward kind."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import collocations, decontamination, whitening
from tests.llm.conftest import ROWS

# 11: whitening


def brute_whiten(vectors, k):
    x = np.array([[int(np.floor(256 * float(c))) for c in v] for v in vectors], object)
    fit = np.array(sorted({tuple(r) for r in x.tolist()}), object)
    n, sums = len(fit), fit.sum(0)
    centre = lambda rows: ((n * rows - sums) / n).astype(float)
    c = centre(fit)
    values, directions = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-values)[:k]
    return n, ((n * x - sums) ** 2).sum(1).tolist(), centre(x) @ directions[:, order] / np.sqrt(values[order]), values[order] / values.sum()


@pytest.mark.parametrize(("d", "tile", "block", "far"), [(5, 2, 7, 0), (16, 16, 4096, 0), (7, 3, 10, 3e6), (3, 4, 5, 0)])
def test_whitening_as_by_brute_force(spark, d, tile, block, far):
    rng = np.random.default_rng(d)
    v = (rng.standard_normal((120, d)) @ rng.standard_normal((d, d)) + far).astype(np.float32)
    v[40:80] = v[3]
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(3)
    n, deviation, whitened, explained = brute_whiten(v, 4)
    rows = whitening.whiten(table, tile=tile, block_rows=block).collect()
    k = min(4, d)
    assert len(rows) == 120 * k and {r.n for r in rows} == {n}
    assert all(r.deviation == deviation[r.vec_id] for r in rows)
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-8
    got = np.zeros((120, k))
    for r in rows:
        got[r.vec_id, r.component - 1] = r.whitened
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
    for c in range(k):
        assert min(np.abs(got[:, c] - sign * whitened[:, c]).max() for sign in (1, -1)) < 1e-7


def test_whitening_of_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.1, 0.9]), (1, [0.1, 0.9]), (None, [0.5, -0.2]), (2, None), (3, []), (4, [nan, 0.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 2.0, 3.0]), (8, [-0.0, 1e-9]), (9, [0.3, 0.3])]
    table = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "vec_id long, embedding array<double>, whitened double, `a.b` string")
    out = whitening.whiten(table)
    assert collections.Counter(r.vec_id for r in out.collect()) == {1: 4, None: 2, 8: 2, 9: 2}
    assert {r.n for r in out.collect()} == {4}
    for few in ([], rows[:2], rows[3:8]):
        assert whitening.whiten(spark.createDataFrame(few, "vec_id long, embedding array<double>")).count() == 0


def test_deviations_are_exact_beyond_doubles():
    x = np.array([[1 << 40, -5], [3, 1 << 41], [7, 7]])
    n, sums = 3, [int(x[:, k].sum()) for k in range(2)]
    exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    assert whitening.deviations(x, n, sums) == [v if v < 1 << 63 else None for v in exact]
    small = x % 1000
    sums = [int(small[:, k].sum()) for k in range(2)]
    assert whitening.deviations(small, n, sums) == [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in small.tolist()]


def test_entries_far_apart(spark):
    """Whole numbers beyond 53 bits are exact, and entries of any size don't crash."""
    big = [2.0**52, -(2.0**50), 1.5, 2.0**53 - 1]
    rows = [(i, [b, float(i)]) for i, b in enumerate(big)]
    n, deviation, _, _ = brute_whiten([v for _, v in rows], 2)
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {(r.vec_id, r.n, r.deviation) for r in got} == {(i, n, d if d < 1 << 63 else None) for i, d in enumerate(deviation)}
    far = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 0.5])], "vec_id long, embedding array<double>")
    assert {(r.vec_id, r.n, r.deviation) for r in whitening.whiten(far).collect()} == {(1, 3, None), (2, 3, None), (3, 3, 0)}


# 12: decontamination


def item_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute_leaks(texts, items, n):
    windows = collections.defaultdict(set)
    for item, text in items:
        w = item_words(text)
        for i in range(max(len(w) - n + 1, min(len(w), 1))):
            windows[tuple(w[i : i + n])].add("" if item is None else str(item))
    out = []
    for text in texts:
        w, hit, found = item_words(text), set(), set()
        for m in {len(k) for k in windows}:
            for i in range(len(w) - m + 1):
                if owners := windows.get(tuple(w[i : i + m])):
                    hit.update(range(i, i + m))
                    found |= owners
        out.append((len(w), len(hit), sorted(found), sorted(hit)))
    return out


def leaks(spark, texts, items, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = decontamination.find_contamination(docs, benchmark, **options).orderBy("doc_id").collect()
    return [(r.n_words, r.n_hit, r["items"], [j for s in r.spans for j in range(s["first"], s["last"] + 1)]) for r in rows]


@pytest.mark.parametrize("part_bytes", [1 << 24, 5000])
@pytest.mark.parametrize("seed", [1, 2])
def test_leaks_as_by_brute_force(spark, part_bytes, seed):
    rng = random.Random(seed)
    pool = ["a", "ab", "b", "The", "the", "cat", "Éclair", "日本", "x1", "longerword", "7"]
    items = [(rng.randrange(30), rng.choice(" -.\n").join(rng.choice(pool) for _ in range(rng.choice([0, 1, 2, 5, 9, 12, 30])))) for _ in range(25)]
    items += [(99, "zz"), (98, None), (None, "the cat a b the cat a b x1 7 7"), items[0], (97, " ".join(f"q{i}" for i in range(60)))]
    texts = [rng.choice(" ,;").join(rng.choice(pool + ["zz", "other"]) for _ in range(rng.randrange(0, 400))) for _ in range(40)]
    texts += [None, "", "...", items[1][1], " ".join(f"Q{i}" for i in range(3, 50)), "q1 q2 " * 9, " ".join(f"q{i}" for i in range(30)) + "z"]
    items = [(i, t) for i, t in items if len(item_words(t)) != 1 or "zz" in t]
    assert leaks(spark, texts, items, window=10, part_bytes=part_bytes) == brute_leaks(texts, items, 10)


def test_many_windows_and_long_texts(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=40))) for i in range(150)]
    texts = [" ".join(rng.choices(vocabulary, k=30) + items[i % 150][1].split()[i % 20 : i % 20 + i % 25] + rng.choices(vocabulary, k=30)) for i in range(120)]
    texts.append(" ".join(rng.choices(vocabulary, k=400_000)) + " " + items[7][1] + " end")
    assert leaks(spark, texts, items) == brute_leaks(texts, items, 10)


def test_leaks_on_awkward_documents(spark, edge, empty):
    items = [(5, " ".join(f"w{i}" for i in range(40, 55))), (6, "日本語 テキスト"), (None, "same"), (8, "")]
    benchmark = spark.createDataFrame([(*r, 1, 2) for r in items], "item_id long, text string, doc_id int, spans int")
    rows = decontamination.find_contamination(edge, benchmark).collect()
    want = brute_leaks([t for _, t, _, _ in ROWS], items, 10)
    key = lambda r: str(r)
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in rows], key=key) == sorted([(i, *w[:3]) for (i, *_), w in zip(ROWS, want)], key=key)
    assert decontamination.find_contamination(empty, benchmark).count() == 0
    assert {r.n_hit for r in decontamination.find_contamination(edge, benchmark.limit(0)).collect()} == {0}


# 13: collocations


def brute_phrases(rows, top, least, depth=4):
    sizes, f = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(w)
            for k in range(1, depth + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    often = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    gone = set()
    for (lang, p), a in often.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                if 100 * a >= 80 * f[lang, p[i : i + m]]:
                    gone.add((lang, p[i : i + m]))
    out = collections.defaultdict(list)
    for (lang, p), a in often.items():
        if (lang, p) not in gone:
            score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
            out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i, p.decode(), -a, l, r, sizes[lang], -s) for lang, x in out.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top], 1))


@pytest.mark.parametrize(("gather", "parts", "bits"), [(1 << 21, None, 26), (200, 3, 26), (64, 50, 8)])
def test_collocations_as_by_brute_force(spark, monkeypatch, gather, parts, bits):
    monkeypatch.setattr(collocations, "MAP_BITS", bits)
    rng = random.Random(gather)
    vocabulary = ["of", "The", "the", "new", "york", "city", "É", "日本", "a-b", "x"] + [f"w{i}" for i in range(30)]
    phrases = [["New", "york", "city"], ["of", "the", "x", "x"], ["日本", "É"], ["a-b", "w1", "w2", "w3", "w4"]]
    text = lambda: "".join(w + rng.choice([" "] * 8 + ["\t ", ". ", ",", "\n"]) for _ in range(rng.randrange(0, 60)) for w in (rng.choice(phrases) if rng.random() < 0.25 else [rng.choice(vocabulary)]))
    rows = [(rng.choice(["en", "en", "en", None, "de", "und"]), text()) for _ in range(250)] + [("en", None), ("en", ""), ("fr", "one two"), ("en", "x " * 500)] + [("de", "Same words here")] * 40
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    got = collocations.collocations(docs, top=25, least=6, parts=parts, gather=gather).collect()
    assert sorted(tuple(r) for r in got) == brute_phrases(rows, 25, 6)


def test_collocations_on_awkward_documents(spark, edge, empty):
    rows = [(s, t) for _, t, s, _ in ROWS]
    got = collocations.collocations(edge, least=2, lang_column="source").collect()
    assert sorted(tuple(r) for r in got) == brute_phrases(rows, 2000, 2)
    assert collocations.collocations(edge, lang_column="source", least=10**6).count() == 0
    assert collocations.collocations(empty.withColumn("lang", F.lit("en"))).count() == 0


def test_tries_survive_being_serialised():
    rng = np.random.default_rng(3)
    grams = rng.integers(0, 4, (300, 5)).astype(np.uint64) << np.uint64(61)
    levels = [collocations.distinct_paths(grams[:, : k + 1], np.ones(300, np.int64)) for k in (2, 3, 4)]
    for mine in (levels, [(p[::3], n[::3]) for p, n in levels], [(p[:0], n[:0]) for p, n in levels]):
        back = collocations.deserialised(collocations.serialised(mine), 4)
        for (p, n), (q, m) in zip(mine, back):
            counted = m > 0
            assert (q[counted] == p).all() and (m[counted] == n).all()


def test_scores_beyond_64_bits(spark):
    """Products of counts and the scale are exact however large."""
    n = [9 * 10**13 + 1, 4 * 10**14 + 7, 10**14 + 3]
    path = lambda *w: b"".join(x.to_bytes(8, "big") for x in (1, *w))
    nodes = spark.createDataFrame([(bytearray(path(1, 2)), 2, n[0]), (bytearray(path(1)), 1, n[1]), (bytearray(path(2)), 1, n[2])], "path binary, depth int, n long")
    (r,) = collocations.best_cuts(nodes).collect()
    assert (r.a, r.l, r.r, r.score) == (*n, 2_000_000 * n[0] // (n[1] + n[2]))


def test_items_come_sorted_as_strings(spark):
    assert leaks(spark, ["one two three"], [(10, "two"), (9, "one")])[0][2] == ["10", "9"]


def test_all_trusted_documents_make_target_and_threshold(spark, monkeypatch):
    """Twenty thousand rows of one kind and one of another: none is left out, by broadcast or by a shuffle."""
    from quillspark.llm import quality_rules

    texts = {0: "the cat sat on a mat and saw ten of its old friends", 1: "iron rods bend when heat of many fires melts them very slowly indeed"}
    docs = spark.range(20_001).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 20_000, texts[0]).otherwise(texts[1]).alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    counted, count = [], quality_rules.ngram_counts
    monkeypatch.setattr(quality_rules, "ngram_counts", lambda df, column: counted.append(count(df, column)) or counted[-1])
    for broadcast in (1 << 20, 5):
        assert quality_rules.judge_quality(docs, labels, broadcast=broadcast).filter("kept").count() == 20_001
        assert (counted[-2] == counted[-1]).all() and counted[-1].sum() > 20_001 * 20
    scores = spark.range(1001).select((F.col("id") / 1000).alias("score"))
    assert quality_rules.quantiles(scores, 0.25, 0.5) == [0.25, 0.5] and quality_rules.quantiles(scores.limit(0), 0.5) is None
