"""Each operator against a brute-force version, and on documents of every awkward kind."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import ann, minhash_dedup, mixing, packing, quality_classifier, quality_rules, sharding, substring_dedup, toxicity, url_filters
from quillspark.llm._words import Words, slices
from tests.conftest import SMALL
from tests.llm.conftest import ROWS


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# words


@pytest.mark.parametrize("texts", [[], [None], ["", None, "a"], ["a b", "b", " c\n\td "], ["é ü", "\u00a0x\x1cy z"], [t for _, t, _, _ in ROWS]])
def test_words_are_what_bytes_split_gives(texts):
    array = pa.array(texts, pa.string())
    words = Words(array)
    got = [bytes(words.buf[s:e]) for s, e in zip(words.starts, words.ends)]
    assert got == [w for t in texts for w in (t or "").encode().split()]
    assert words.counts.tolist() == [len((t or "").encode().split()) for t in texts]
    by_word = collections.defaultdict(set)
    for w, h in zip(got, words.hashes()):
        by_word[w].add(int(h))
    assert all(len(h) == 1 for h in by_word.values()) and len({min(h) for h in by_word.values()}) == len(by_word)


def test_slices_cover_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * n for n in (0, 5, 9, 1, 0, 30, 2)]})
    assert sum(part.num_rows for part, _ in slices(batch, "text", 8)) == 7


# 1: substring dedup


def brute_cut(texts, n):
    words = [(t or "").encode().split() for t in texts]
    seen = collections.Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                gone[i : i + n] = [True] * n
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


@pytest.mark.parametrize("most", [1, 3, 20_000])
def test_repeats_are_removed_as_by_brute_force(spark, most):
    rng = random.Random(3)
    pool = [" ".join(str(rng.randrange(9)) for _ in range(rng.randrange(5, 60))) for _ in range(8)]
    texts = [" ".join(rng.choice(pool) if rng.random() < 0.4 else str(rng.randrange(10**6)) for _ in range(rng.randrange(0, 25))) for _ in range(60)]
    texts += ["a " * 50, "a " * 30, None, "", texts[0]]
    got = substring_dedup.remove_repeats(docs_of(spark, texts), window=12, anchor=5, blocks=(4, 4, 4), most=most).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_removed, r.kept_text) for r in got] == brute_cut(texts, 12)


def test_repeats_on_awkward_documents(edge, empty):
    got = substring_dedup.remove_repeats(edge)
    assert set(got.columns) == {*edge.columns, "n_words", "n_removed", "kept_text"}
    rows = sorted((r.doc_id or -1, r.n_words, r.n_removed, r.kept_text) for r in got.collect())
    assert rows == sorted((i or -1, *x) for (i, *_), x in zip(ROWS, brute_cut([t for _, t, _, _ in ROWS], 35)))
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_anchors_of_texts_longer_than_a_position(monkeypatch):
    """Anchors lie within their windows and are the same in equal windows, whatever the place."""
    monkeypatch.setattr(substring_dedup, "_BITS", 7)
    monkeypatch.setattr(substring_dedup, "_POSITION", np.uint64(127))
    rng = random.Random(2)
    passage = [rng.choice("abc") for _ in range(60)]
    words = [rng.choice("abcdefgh") for _ in range(1000)]
    for at in (3, 97, 430, 900):
        words[at : at + 60] = passage
    w = Words(pa.array([" ".join(words)]))
    at, low, _ = substring_dedup.window_anchors(w.hashes(), w.left(), 20, 5)
    assert at.tolist() == list(range(981)) and ((low >= at) & (low <= at + 15)).all()
    offsets = {tuple((low - at)[s : s + 41].tolist()) for s in (3, 97, 430, 900)}
    assert len(offsets) == 1


def test_sliding_min():
    x = np.array([5, 3, 8, 1, 9, 2, 7], np.uint64)
    for n in range(1, 8):
        assert substring_dedup.sliding_min(x, n).tolist() == [min(x[i : i + n].tolist()) for i in range(8 - n)]


# 2: nearest neighbours


def test_neighbours_recall_and_scores(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((20, 16))
    x = (centres[rng.integers(0, 20, 400)] + 0.5 * rng.standard_normal((400, 16))).astype(np.float32)
    x[17] = x[3]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in ann.nearest(table, F.col("vec_id") % 20 == 0, block=40).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 400, 20):
        cosines = u @ u[q]
        best = sorted((i for i in range(400) if i != q), key=lambda i: (-round(cosines[i], 12), i))[:5]
        assert len(got[q]) == 5
        assert all(abs(cosines[i] - s) < 1e-12 for i, s in got[q])
        hits += len(set(best) & {i for i, _ in got[q]})
    assert hits >= 0.9 * 100


@pytest.mark.parametrize("block", [10, 8192])
def test_ties_go_to_smaller_ids(spark, block):
    rng = np.random.default_rng(5)
    direction = rng.standard_normal(12)
    rows = [(0, direction.tolist())] + [(i, (direction * rng.uniform(0.01, 90)).tolist()) for i in range(1, 60)] + [(i, rng.standard_normal(12).tolist()) for i in range(60, 99)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in ann.nearest(table, F.col("vec_id") % 50 == 0, block=block).collect()}
    assert [got[0, r] for r in range(1, 6)] == [(i, pytest.approx(1.0)) for i in range(1, 6)]
    assert [got[50, r] for r in range(1, 6)] == [(i, pytest.approx(1.0)) for i in range(5)]


def test_best_of_is_a_stable_sort():
    rng = np.random.default_rng(7)
    x = rng.integers(0, 4, (50, 20)).astype(float)
    for most in (1, 3, 20):
        got = ann.best_of(x, most)
        want = np.argsort(-x, axis=1, kind="stable")[:, :most]
        assert (np.sort(got, 1) == np.sort(want, 1)).all()


def test_recall_of_the_cells():
    """Neighbours as far as those of 20,000 vectors (those of larger tables are nearer)."""
    rng = np.random.default_rng(4)
    x = ann.unit(rng.standard_normal((40, 64))[rng.integers(0, 40, 20_000)] * 0.038 + rng.standard_normal((20_000, 64)) * 0.118)
    cosines = x[:100] @ x.T
    cosines[np.arange(100), np.arange(100)] = -1
    near = np.argpartition(-cosines, 5, axis=1)[:, :5]
    cells, found = ann.Cells(64, ann.FUNCTIONS), np.zeros((100, 5), bool)
    for t in range(cells.tables):
        keys = cells.keys(cells.of(x, t)[0])[near]
        found |= (cells.visits(x[:100], t, ann.PROBES)[:, None, :] == keys[:, :, None]).any(2)
    assert found.mean() >= 0.93


def test_neighbours_on_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 9), (1, [2.0, 0.0], 9), (2, [2.0, 0.0], 9), (2, [2.0, 0.0], 9), (3, [0.0, 0.0], 9), (4, None, 9), (5, [nan, 1.0], 9), (6, [inf, 1.0], 9), (7, [None, 1.0], 9), (8, [1.0], 9), (None, [1.0, 1.0], 9), (50, [0.0, 1.0], 9), (9, [], 9)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = [(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in ann.nearest(table, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 50, 0.0), (50, 1, 0, 0.0), (50, 2, 1, 0.0), (50, 3, 2, 0.0)]
    assert ann.nearest(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


# 3: sharding


@pytest.mark.parametrize("bucket_bytes", [50, 1 << 20])
def test_shards_are_even_and_gapless(edge, bucket_bytes):
    got = sharding.shard_documents(edge, shards=4, bucket_bytes=bucket_bytes)
    rows = got.collect()
    assert collections.Counter((r.doc_id, r.text) for r in rows) == collections.Counter((i, t) for i, t, _, _ in ROWS)
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r["size"] == len((r.text or "").encode()) + 1
    assert sorted(len(s) for s in slots.values()) == [2, 3, 3, 3] and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted((r.shard, r.slot, r.doc_id or 0) for r in rows) == sorted((r.shard, r.slot, r.doc_id or 0) for r in got.collect())


def test_positions_follow_from_scatter_and_counts(spark):
    """Buckets, offsets and cuts reckoned a second time in Python; within a bucket rows are in another order than that of the hash."""
    docs = docs_of(spark, [f"text {i} " * (i % 9) for i in range(900)])
    size, seed, shards = 4000, 20, 7
    h = F.xxhash64(F.lit(seed), "doc_id", "text")
    hashed = {r.doc_id: (r.h, r.o) for r in docs.select("doc_id", h.alias("h"), F.xxhash64(F.lit(seed + 1), h).alias("o")).collect()}
    buckets = -(-sum(len(r.text) + 1 for r in docs.collect()) // size)
    count = collections.Counter(x % buckets for x, _ in hashed.values())
    base = {b: sum(count[c] for c in range(b)) for b in range(buckets)}
    low, extra = divmod(900, shards)
    starts = [s * low + min(s, extra) for s in range(shards)]
    places = collections.defaultdict(list)
    for r in sharding.shard_documents(docs, shards=shards, bucket_bytes=size).collect():
        places[hashed[r.doc_id][0] % buckets].append((starts[r.shard] + r.slot, hashed[r.doc_id][1]))
    assert buckets > 8
    for b, found in places.items():
        assert sorted(at for at, _ in found) == list(range(base[b], base[b] + count[b]))
    assert any([o for _, o in sorted(found)] != sorted(o for _, o in found) for found in places.values())


def test_equal_rows_leave_their_bucket(spark, monkeypatch):
    monkeypatch.setattr(sharding, "EQUAL_BUCKETS", 2)
    rows = [(7, "the same", "x")] * 300 + [(7, "the same", "y")] * 2 + [(None, None, "z")] * 150 + [(i, f"t{i}", "w") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string")
    out = sharding.shard_documents(docs, shards=5, bucket_bytes=64)
    got = out.collect()
    assert sorted(((r.doc_id or -1, r.text or "", r["a.b"]) for r in got)) == sorted((i or -1, t or "", x) for i, t, x in rows)
    assert sorted((r.shard, r.slot) for r in got) == [(s, k) for s, n in enumerate([111, 111, 110, 110, 110]) for k in range(n)]
    assert len({r.shard for r in got if r["a.b"] == "x"}) > 1


CLASHES = ["rest", "mix_source", "cut_key", "epochs", "mix_key", "quality_weight", "_plan_node", "plan_node", "_places", "_strikes", "a.b", "copy", "node", "times", "kept_id", "kept_node", "rank", "query_id"]


@pytest.mark.parametrize("operator", ["sharding", "mixing", "substring", "toxicity", "stages"])
def test_columns_of_any_name_are_carried_along(spark, edge_labels, operator):
    names = [*CLASHES, *(["shard", "slot"] if operator != "sharding" else [])]
    rows = [(i, t, s, *(f"{n}{i}" for n in names)) for i, t, s, _ in ROWS]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    if operator == "stages":
        import corpus_pipeline

        corpus_pipeline.table = lambda *_: edge_labels
        try:
            for _, stage in corpus_pipeline.STAGES[:-1]:
                out = stage(spark, docs, "")
                assert out.columns == docs.columns and out.count() <= docs.count()
        finally:
            from quillspark.llm._tables import table

            corpus_pipeline.table = table
        return
    calls = {
        "sharding": lambda: sharding.shard_documents(docs),
        "mixing": lambda: mixing.mix_documents(docs),
        "substring": lambda: substring_dedup.remove_repeats(docs),
        "toxicity": lambda: toxicity.add_toxicity(docs, edge_labels),
    }
    out = calls[operator]()
    assert set(docs.columns) <= set(out.columns)
    key = lambda r: tuple(str(x) for x in r)
    picked = ["doc_id", *names]
    assert sorted((tuple(r[n] for n in picked) for r in out.collect()), key=key) == sorted((tuple(r[n] for n in picked) for r in docs.collect()), key=key)


def test_shards_of_few_and_no_rows(spark, empty):
    assert sharding.shard_documents(empty).count() == 0
    assert [(r.shard, r.slot) for r in sharding.shard_documents(docs_of(spark, ["a", None])).orderBy("shard").collect()] == [(0, 0), (1, 0)]


def test_shards_are_shuffled_and_written(spark, tmp_path):
    docs = docs_of(spark, [f"text {i}" for i in range(500)])
    sharded = sharding.shard_documents(docs, shards=3)
    order = [r.doc_id for r in sharded.orderBy("shard", "slot").collect()]
    assert sorted(order) == list(range(500)) and sum(b == a + 1 for a, b in zip(order, order[1:])) < 20
    sharding.write_shards(sharded, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().count() == 3


def test_offsets_in_two_levels(spark):
    counts = spark.createDataFrame([(b, b % 3 + 1) for b in range(0, 20_000, 7)], "b long, n long")
    total, want = 0, {}
    for b in range(0, 20_000, 7):
        want[b] = total
        total += b % 3 + 1
    assert dict(sharding.running_offsets(counts, "b", "n").collect()) == want


# 4: quality rules


def test_base_counts_against_brute_force(edge, edge_labels):
    for r in quality_rules.judge_quality(edge, edge_labels).join(edge.select("doc_id", "text").distinct(), "doc_id").collect():
        words, text = (r.text or "").encode().split(), r.text or ""
        grams = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        inside = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in text.split("\n") if x.encode().split()]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside))
        assert r.base_failed == (len(words) < 10 or 100 * len(inside) > 20 * len(words)) and not (r.base_failed and r.kept)


def test_quality_keeps_what_is_like_the_trusted(spark):
    rng = random.Random(1)
    good = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) for _ in range(60)) for _ in range(60)]
    bad = [" ".join(rng.choice("x1 $$$ ### !!! zz@@ qq%%".split()) + str(rng.randrange(99)) for _ in range(60)) for _ in range(15)]
    docs = docs_of(spark, good + bad)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in quality_rules.judge_quality(docs, labels).collect()}
    assert all(kept[i] for i in range(60)) and not any(kept[i] for i in range(60, 75))


def test_scores_and_verdicts_against_brute_force(spark):
    """Tokens by regular expressions, multinomials in dictionaries, one text at a time."""
    rng = random.Random(3)
    words = "alpha beta gamma4 delta, (epsilon) don't 3.14 $$$ é日".split()
    texts = [" ".join(rng.choice(words if i % 4 else words[6:]) for _ in range(rng.randrange(0, 50))) for i in range(80)] + [None, "", "one\ntwo  three"]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(40)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_rules.judge_quality(docs_of(spark, texts), labels, quantile=0.25).collect()}

    def grams(text):
        # neighbours may stand on both sides of white space
        tokens = re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+|[^0-9A-Za-z\u0080-\U0010ffff \t\n\x0b\x0c\r]+", text or "")
        return tokens + list(zip(tokens, tokens[1:]))

    names = {}
    for t in texts:
        doc, bucket = quality_rules.ngram_buckets(Words(pa.array([t], pa.string())))
        assert len(bucket) == len(grams(t))
        for g, b in zip(grams(t), bucket):
            assert names.setdefault(g, b) == b
    raw = collections.Counter(names[g] for t in texts for g in grams(t))
    target = collections.Counter(names[g] for i in range(40) if i % 4 for g in grams(texts[i]))
    size = quality_rules.BUCKETS
    log_p = lambda c, b: math.log((c[b] + 1) / (sum(c.values()) + size))
    score = [sum(log_p(target, names[g]) - log_p(raw, names[g]) for g in grams(t)) / max(len(grams(t)), 1) for t in texts]
    trusted = [score[i] for i in range(40) if i % 4 and len((texts[i] or "").split()) >= 10]
    least = 2 * np.quantile(trusted, 0.25) - np.median(trusted)
    for i in range(len(texts)):
        assert abs(got[i].score - score[i]) < 1e-9 and got[i].kept == (not got[i].base_failed and score[i] >= least)
    assert 0 < sum(r.kept for r in got.values()) < sum(not r.base_failed for r in got.values())


def test_quality_without_trusted_or_rows(edge, empty, edge_labels, no_labels):
    assert quality_rules.judge_quality(edge, no_labels).count() == len(ROWS)
    assert quality_rules.judge_quality(empty, edge_labels).count() == 0


# 5: quality classifier


def test_classifier_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    got = quality_classifier.classify(docs, labels, where=F.col("doc_id") % 3 > 0).join(labels, "doc_id").filter("doc_id % 3 = 0").collect()
    right = sum((r.score >= 0.7) == bool(r.quality) for r in got)
    assert len(got) > 20 and right >= 0.9 * len(got)


def test_votes_are_exact_cosines():
    rng = np.random.default_rng(0)
    v, q, y = quality_classifier.unit_rows(rng.standard_normal((50, 8))), quality_classifier.unit_rows(rng.standard_normal((9, 8))), rng.integers(0, 2, 50)
    for row, got in zip(q, quality_classifier.vote(q, v, y, 5)):
        near = sorted(range(50), key=lambda i: -(v[i] @ row))[:5]
        w = [max(v[i] @ row, 0) ** 4 for i in near]
        assert abs(got - sum(a * y[i] for a, i in zip(w, near)) / sum(w)) < 1e-9


def test_classifier_against_brute_force(spark):
    """Terms counted by dictionaries, the space by the full decomposition, votes by sorting."""
    Q = quality_classifier
    rng = random.Random(5)
    good, bad = ["alpha", "beta", "Gamma", "delta"], ["#buy", "now!!", "777", "WIN"]
    texts = [" ".join(rng.choice(good if i % 2 else bad) for _ in range(rng.randrange(3, 40))) for i in range(60)] + ["alpha 777", "", "beta beta"]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(50)] + [(7, 0, 0)], "doc_id long, quality int, toxic int")
    got = [r.score for r in Q.classify(docs_of(spark, texts), labels, dimensions=6, neighbours=7).orderBy("doc_id").collect()]

    counts = Q.term_counts(Words(pa.array(texts)))
    for text, row in zip(texts, counts):
        by_word = collections.Counter(text.lower().encode().split())
        assert abs(np.expm1(row[Q.SHAPES + Q.REPEATS :]).sum() - sum(by_word.values())) < 1e-6 and abs(np.expm1(row[: Q.SHAPES]).sum() - max(len(text) - 2, 0)) < 1e-6
    counts = counts.astype(np.float32).astype(float)
    labelled = counts[:50]
    rarity = np.log(51 / (1 + (labelled > 0).sum(0))) + 0.1
    x = labelled * rarity
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    basis = np.linalg.svd(x, full_matrices=False)[2][:6]
    place = Q.unit_rows((counts * rarity) @ basis.T)
    for p, score in zip(place, got):
        near = sorted(range(50), key=lambda i: (-round(float(place[i] @ p), 10), i))[:7]
        weight = [max(float(place[i] @ p), 0) ** 4 for i in near]
        want = sum(w * (i % 2) for w, i in zip(weight, near)) / sum(weight) if sum(weight) > 0 else 0.5
        assert abs(score - want) < 1e-6


def test_classifier_on_awkward_documents(edge, empty, edge_labels, no_labels):
    rows = quality_classifier.classify(edge, edge_labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality_classifier.classify(edge, no_labels).collect()} == {0.5}
    assert quality_classifier.classify(empty, edge_labels).count() == 0


# 6: mixing


def water_fill(sizes, weights, most):
    total, caps = sum(sizes), [most * s for s in sizes]
    open_, out = set(range(len(sizes))), [0.0] * len(sizes)
    while True:
        left = total - sum(caps[i] for i in range(len(sizes)) if i not in open_)
        share = {i: left * weights[i] / sum(weights[j] for j in open_) for i in open_}
        over = {i for i in open_ if share[i] > caps[i] + 1e-9}
        if not over:
            return [share[i] if i in open_ else caps[i] for i in range(len(sizes))]
        open_ -= over


def test_targets_by_water_filling(spark):
    rng = random.Random(5)
    for n in (1, 2, 3, 9):
        sizes = [rng.randrange(1, 1000) for _ in range(n)]
        table = spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(sizes)], "source string, source_size long")
        got = [r.target for r in mixing.source_targets(table, (5, 2, 1), 3).orderBy("source").collect()]
        assert np.allclose(got, water_fill(sizes, [(5, 2, 1)[i % 3] for i in range(n)], 3))


def test_mix_meets_targets_and_repeats_rows(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 40)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix_documents(docs)
    got = mixed.collect()
    for source in ("a", "b", "c", None):
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1 and all(r.taken <= 3 * r["size"] for r in own)
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in mixing.mix_documents(docs).collect())
    words = mixing.repeat_rows(mixed).select("doc_id", F.regexp_count("text", F.lit("w")).alias("n")).groupBy("doc_id").agg(F.sum("n")).collect()
    assert dict(words) == {r.doc_id: r.taken for r in got if r.taken}


def test_mix_prefers_quality(spark):
    rows = [(i, " ".join(["w"] * 10), "a" if i < 400 else "b", [0.1, 1.0, None][i % 3]) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, q double")
    taken = [r for r in mixing.mix_documents(docs, weights=(1, 1), quality_column="q").collect() if r.source == "a"]
    share = [sum(r.taken for r in taken if r.doc_id % 3 == k) for k in range(3)]
    assert abs(sum(share) - taken[0].target) < 1 and share[1] > 1.4 * share[0] and share[1] > 1.4 * share[2]


def test_mix_of_awkward_documents(edge, empty):
    rows = mixing.mix_documents(edge).collect()
    assert len(rows) == len(ROWS)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    for own in by.values():
        assert abs(sum(r.taken for r in own) - own[0].target) <= len(own)
    assert mixing.mix_documents(empty).count() == 0


# 7: near-duplicates


def bag(text):
    words = (text or "").encode().split()
    return collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute_similarity(a, b):
    a, b = bag(a), bag(b)
    return sum((a & b).values()) / max(sum((a | b).values()), 1)


def brute_classes(texts):
    bags = [bag(t) for t in texts]
    name = list(range(len(texts)))

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            near = texts[i] is not None and texts[i] == texts[j]
            if not near and bags[i] and bags[j]:
                near = sum((bags[i] & bags[j]).values()) >= 0.8 * sum((bags[i] | bags[j]).values())
            if near:
                a, b = sorted((root(i), root(j)))
                name[b] = a
    return [root(i) for i in range(len(texts))]


def test_near_duplicates_as_by_brute_force(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(12):
        base = [str(rng.randrange(500)) for _ in range(rng.randrange(30, 200))]
        for _ in range(rng.randrange(1, 6)):
            copy = list(base)
            for i in rng.sample(range(len(copy)), rng.randrange(0, 4)):
                copy[i] = "new" + str(rng.randrange(99))
            texts.append(" ".join(copy))
    texts += [None, None, "", "", "a b c", "a b c", "a b c d e", "a b c d e", "z " * 300, "z " * 280]
    got = minhash_dedup.near_duplicates(docs_of(spark, texts)).orderBy("doc_id").collect()
    assert [r.class_id for r in got] == brute_classes(texts)
    kept = minhash_dedup.drop_near_duplicates(docs_of(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute_classes(texts)))


def test_members_that_miss_the_lead_are_compared_with_the_rest(spark):
    # a chain in which ends are unlike: one row a band puts all of them together
    base = [str(i) for i in range(200)]
    texts = [" ".join([f"n{k}_{i}" if i < 3 * k else w for i, w in enumerate(base)]) for k in range(12)]
    got = minhash_dedup.near_duplicates(docs_of(spark, texts), rows=1, bands=24, block=(3, 100_000)).orderBy("doc_id").collect()
    assert [r.class_id for r in got] == brute_classes(texts)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    base = [f"w{rng.integers(0, 10**6)}" for _ in range(400)]
    texts = [" ".join(base), " ".join(base[:-40] + [f"x{i}" for i in range(40)]), "one two three four five", "few words"]
    words = Words(pa.array(texts))
    s = minhash_dedup.dart_signatures(*minhash_dedup.shingle_weights(words), 4, 256)
    exact = brute_similarity(texts[0], texts[1])
    assert abs((s[0] == s[1]).mean() - exact) < 0.12 and (s[:3] != 0).all() and not s[3].any()


def test_weights_are_strips_of_doubling_width():
    element, number, low = minhash_dedup.strips(np.array([1, 2, 3, 9, 0.5]))
    assert list(zip(element, number, low)) == [(0, 0, 0), (1, 0, 0), (1, 1, 1), (2, 0, 0), (2, 1, 1), (2, 2, 2), (3, 0, 0), (3, 1, 1), (3, 2, 2), (3, 3, 4), (3, 4, 8), (4, 0, 0)]
    rng = np.random.default_rng(2)
    a, b = rng.integers(1, 12, 40), rng.integers(1, 12, 40)
    names = rng.integers(1, 1 << 60, 40).astype(np.uint64)
    s = minhash_dedup.dart_signatures(np.repeat([0, 1], 40), np.concatenate([names, names]), np.concatenate([a, b]), 2, 2048)
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.05


def test_overlaps_against_counters(monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 60))) for _ in range(25)]
    parts = minhash_dedup.shingle_weights(Words(pa.array(texts)))
    for frequent in (0, 3, 100):
        monkeypatch.setattr(minhash_dedup, "FREQUENT", frequent)
        got = minhash_dedup.overlaps(*parts, len(texts), np.array([3, 0, 9]))
        assert all(got[r, j] == sum((bag(texts[i]) & bag(texts[j])).values()) for r, i in enumerate((3, 0, 9)) for j in range(25) if i != j)


def test_components(spark):
    rng = random.Random(9)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, 5000 + i) for i in range(1, 50)]
    got = dict(minhash_dedup.components(spark.createDataFrame(links, "a long, b long")).collect())
    root = {}
    for a, b in links:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(400):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert {n: got.get(n, n) for n in root} == root


def test_near_duplicates_on_awkward_documents(edge, empty):
    rows = minhash_dedup.near_duplicates(edge).collect()
    assert len(rows) == len(ROWS)
    kept = minhash_dedup.drop_near_duplicates(edge)
    texts = [r.text for r in kept.collect()]
    assert kept.columns == edge.columns and texts.count(None) == 2 and len([t for t in texts if t and t.startswith("w0 w1 ")]) == 1
    assert minhash_dedup.near_duplicates(empty).count() == 0


# 8: toxicity


def toxic_corpus(spark):
    rng = random.Random(8)
    syllables = "tha on er in re ti es or he an st en".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    texts = [" ".join(["idiot" if i % 5 == 0 and k in (3, 17) else "moron" if i % 5 == 0 and k == 9 else word() for k in range(40)]) for i in range(200)]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    return texts, labels


def test_toxic_words_are_found_in_disguise(spark):
    texts, labels = toxic_corpus(spark)
    hidden = ["you 1d10t there", "what an i d i o t he is", "such a M0R0N!!", "an idiooooot", "m.o.r.o.n", "you ( idi0t )"]
    clean = ["tha on er in", "room 101 at 10:30", "$$$ ### !!!", "a b c d e", None, ""]
    got = toxicity.add_toxicity(docs_of(spark, texts + hidden + clean), labels).orderBy("doc_id").collect()
    scores = [r.score for r in got]
    assert all((s >= 0.5) == (i % 5 == 0) for i, s in enumerate(scores[:200]))
    assert all(s >= 0.5 for s in scores[200:206]) and all(s < 0.5 for s in scores[206:])


def test_spread_terms_are_found_next_to_other_words(spark):
    texts, labels = toxic_corpus(spark)
    hidden = ["you are a i d i o t", "a m o r o n", "y o u a r e a m o r o n", "i  d  i  o  t", "i d i o t m o r o n he", "what a m 0 r o n.", "(i \t d 1 0\nt)", "y m o o r o n o", "x " * 3000 + "i d i o t " + "t h a " * 3000]
    clean = ["a b c d e f g", "i d i o", "m o r e o n", "- - - - - -", "1 2 3 4 5 6 7", "x " * 5000]
    got = toxicity.add_toxicity(docs_of(spark, texts + hidden + clean), labels).orderBy("doc_id").collect()
    scores = [r.score for r in got][200:]
    assert all(s >= 0.5 for s in scores[: len(hidden)]) and all(s < 0.5 for s in scores[len(hidden) :])


def test_runs_of_any_length_are_decoded_as_one():
    """Blocks of any size give the same terms, and long stretches without a separator are decoded too."""
    rng = random.Random(5)
    counts = np.zeros((28, 28, 28))
    for word in ["idiot", "moron", "hello", "there", "house", "you", "are", "lid", "idle"] * 20:
        codes = [0, 0, *(ord(c) - 96 for c in word), 0]
        for x in zip(codes, codes[1:], codes[2:]):
            counts[x] += 1
    model, trie = toxicity.CharacterModel(counts), toxicity.trie_of(["idiot", "moron", "lid", "are"])
    for spread in (True, False):
        for _ in range(12):
            run = "".join(rng.choice(["1d10t", "m0r0n", "hello", "y0u", "4re", "l1d", "-", "..", "iiddl"]) for _ in range(rng.randrange(1, 9)))
            want = model.terms_in(run, trie, spread)
            assert all(model.terms_in(run, trie, spread, block) == want for block in (1, 3, 7, 20))
    long = "h0use-" * 900 + "1d10t" + "-h0use" * 900
    assert "idiot" in model.terms_in(long, trie, False) and "idiot" in model.segment(long, False)
    assert model.segment("1d" * 3000, False) and model.segment("m0r0n" * 1200, True)


def test_long_and_doubled_tokens_are_restored(spark):
    texts, labels = toxic_corpus(spark)
    hidden = ["an idi" + "o" * 60 + "t", "what.a.m0r0n,you.are.such.an.1d10t..he.said", "m.o.r.o.n" + "." * 50, "tha," * 400 + "m0r0n," + "er," * 400, "moron" + "." * 50, "x" * 9000 + ".m0r0n." + "x" * 9000, "an idiiot", "a mooron", "mmoron,", "I d i i o t"]
    clean = ["ab" * 5000, "tha,on,er,in," * 2000, "https://example.com/tha/on/er?x=0123456789abcdef0123456789abcdef", "thaa onn", "0" * 3000 + "a", "xab" * 1365 + "moron" + "xab" * 9000]
    # a doubled spelling that clean rows have is a word of its own
    known = [(i, f"moronn {texts[i]}" if i % 5 else texts[i]) for i in range(200)]
    got = toxicity.add_toxicity(docs_of(spark, texts + hidden + clean), labels).orderBy("doc_id").collect()
    scores = [r.score for r in got][200:]
    assert all(s >= 0.5 for s in scores[: len(hidden)]) and all(s < 0.5 for s in scores[len(hidden) :])
    got = toxicity.add_toxicity(docs_of(spark, [t for _, t in known] + ["a moronn tha", "a moroon tha"]), labels).orderBy("doc_id").collect()
    assert got[200].score < 0.5 <= got[201].score


def brute_terms(model, run, spread, terms):
    """Terms that are a word of a path within MARGIN of the best, by listing all paths."""
    paths = []

    def walk(at, a, b, score, word, words):
        if at == len(run):
            paths.append((score + (model.log[a][b][0] if b else 0.0), [*words, word]))
            return
        for c, cost in model.ways(run[at], run[at - 1] if at else ""):
            x, y = (b, model.code(c)) if c else (a, b)
            s = score + cost + (model.log[a][b][y] if c else 0.0)
            walk(at + 1, x, y, s, word + c, words)
            if y and at + 1 < len(run) and model.may_end(run, at + 1, spread):
                walk(at + 1, y, 0, s + model.log[x][y][0], "", [*words, word + c])

    walk(0, 0, 0, 0.0, "", [])
    best = max(s for s, _ in paths)
    return {w for s, words in paths if s >= best - toxicity.MARGIN for w in words} & terms


def test_terms_are_found_as_by_listing_all_paths():
    rng = random.Random(3)
    counts = np.random.default_rng(3).integers(0, 50, (toxicity.LETTERS,) * 3).astype(float) ** 3
    model = toxicity.CharacterModel(counts)
    terms = {"".join(rng.choice("abeisot") for _ in range(rng.randrange(1, 4))) for _ in range(60)}
    trie = toxicity.trie_of(terms)
    hits = 0
    for _ in range(150):
        run = "".join(rng.choice("abst0134$.-") for _ in range(rng.randrange(1, 7)))
        for spread in (True, False):
            want = brute_terms(model, run, spread, terms)
            assert model.terms_in(run, trie, spread) == want, run
            hits += len(want)
    assert hits > 100


def test_scores_are_the_regression_of_found_terms(spark):
    texts, labels = toxic_corpus(spark)
    weights, constant, counts, known = toxicity.fit(docs_of(spark, texts), labels, "toxic", F.lit(True), 10_000)
    finder = toxicity.TermFinder(weights, toxicity.CharacterModel(counts), known)
    for r in toxicity.add_toxicity(docs_of(spark, texts), labels).collect():
        total = toxicity.log_odds(finder.find(r.text), weights, constant)
        assert finder.find(r.text) == set(r.text.split()) & set(weights) and abs(r.score - 1 / (1 + math.exp(-total))) < 1e-12


def test_regression_is_at_its_optimum():
    rng = random.Random(4)
    rows = [sorted(rng.sample(range(30), rng.randrange(0, 5))) for _ in range(80)]
    y, n = np.array([float(rng.random() < (0.8 if 3 in r else 0.2)) for r in rows]), np.array([float(rng.randrange(1, 9)) for _ in rows])
    w = toxicity.logistic(rows, 30, y, n)
    x = np.zeros((80, 31))
    for i, r in enumerate(rows):
        x[i, [*r, 30]] = 1
    slope = x.T @ (n * (y - 1 / (1 + np.exp(-x @ w)))) - np.array([0.3] * 30 + [1e-6]) * w
    assert np.abs(slope).max() < 1e-3 and w[3] > 0.5


def test_no_letter_is_too_many(spark):
    texts, labels = toxic_corpus(spark)
    hidden = ["1" + "d10" * 14 + "1d1000" + "0" * 40 + "t", "q w e r t y u i o p a s d f g h j k l z x c v b n m q w i d i o t e r t y u i o p", "i.d.i.o.t." * 5, "1d10000000000000000000000000000000000000000000t"]
    got = toxicity.add_toxicity(docs_of(spark, texts + hidden), labels).orderBy("doc_id").collect()
    assert [r.score >= 0.5 for r in got[201:]] == [True] * 3


def test_toxicity_on_awkward_documents(edge, empty, edge_labels, no_labels):
    assert toxicity.add_toxicity(edge, edge_labels).count() == len(ROWS)
    scored = toxicity.add_toxicity(edge, no_labels)
    assert {r.score for r in scored.collect()} == {0.0} and set(scored.columns) == set(edge.columns)
    assert toxicity.add_toxicity(empty, edge_labels).count() == 0


# 9: url filters


def test_url_verdicts(spark):
    urls = ["http://a.example.com/en/7x", "http://a.example.com/en/8", "https://casino.org/x", "http://x.org/es/1", "http://casinos.org/", "http://CHEAP.net/free", "http://cheap.net/a", "nourl cheap free", None, "", "http://net/de/5?q=1#f", "http://b.example.net/de/81", "a://b://c/d"]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(1))).collect()}
    assert got[0] == ("a.example.com", "/en/7x", "example.com/en/7", "allow") and got[1][2:] == ("com/en/", "block")
    assert got[2][2:] == (None, "block") and got[3][2:] == ("org/es/", "block") and got[4][3] == "allow"
    assert got[5][:2] == ("cheap.net", "/free") and got[5][3] == "block" and got[6][3] == "allow" and got[7] == ("", "", None, "block")
    assert got[8] == got[9] == ("", "", None, "allow") and got[10][2:] == ("net/de/", "block") and got[11][2:] == ("example.net/de/8", "block") and got[12][:2] == ("b:", "//c/d")


def test_url_vocabulary_of_thousands_of_terms(spark):
    rng = random.Random(9)
    terms = {"".join(rng.choice("abcdefghij") for _ in range(rng.randrange(4, 9))): rng.random() < 0.2 for _ in range(5000)}
    table = spark.createDataFrame([(t.upper() if i % 2 else t, s) for i, (t, s) in enumerate(terms.items())] + [("", True)], "term string, is_strict boolean")
    some = sorted(terms)
    urls = [f"https://{rng.choice(some)}.{rng.choice(['net', 'x' + rng.choice(some)])}/{rng.choice(some)}{rng.choice(['', 'q', '-' + rng.choice(some)])}" for _ in range(300)]
    urls += [None, "", "https://" + "x" * 100_000 + "." + some[0], urls[0], urls[0]]
    pages = spark.createDataFrame([(i, u, "v") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = url_filters.filter_urls(pages, rules=(), vocabulary=table).orderBy("page_id").collect()
    for u, r in zip(urls, got):
        found = set(re.findall(r"[a-z0-9]+", (u or "").lower())) & set(terms)
        strict = sum(terms[t] for t in found)
        assert (r.n_strict, r.n_soft) == (strict, len(found) - strict) and r.verdict == ("block" if strict or len(found) >= 2 else "allow"), u
    assert url_filters.filter_urls(pages.limit(0), vocabulary=table).count() == 0


# 10: packing


def test_best_fit_decreasing_is_tight_and_whole():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 65, 700)
    sequence, offset = packing.best_fit_decreasing(lengths, 64)
    open_rooms, want = [], []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in open_rooms if r >= n]
        if fit:
            open_rooms.remove(min(fit))
        room = min(fit, default=64)
        open_rooms.append(room - n)
        want.append(room)
    assert sequence.max() + 1 == len(open_rooms)
    for s in range(sequence.max() + 1):
        own = np.argsort(offset[sequence == s])
        size = lengths[sequence == s][own]
        assert (offset[sequence == s][own] == np.cumsum(size) - size).all() and size.sum() <= 64


def test_packed_pieces_round_trip(edge, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path(packing.TOKENIZER)))
    pieces = collections.defaultdict(list)
    sequences = collections.defaultdict(list)
    for r in packing.pack_documents(edge, window=256).collect():
        pieces[r.doc_id].append((r.start, r.length, bytes(r.ids), r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc_id, text, _, _ in ROWS:
        if doc_id in (None, 1):
            continue  # several rows: below
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        own = sorted(pieces[doc_id])
        assert b"".join(p[2] for p in own) == ids.tobytes() and {p[3] for p in own} == {len(ids)} and [p[0] for p in own] == list(np.cumsum([0] + [p[1] for p in own])[:-1])
    # rows that share an id: as many pieces of each as there are rows
    for doc_id in (None, 1):
        encoded = [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for d, t, _, _ in ROWS if d == doc_id]
        want = collections.Counter((s, np.array(x[s : s + 256], "<u4").tobytes(), len(x)) for x in encoded for s in range(0, len(x), 256))
        assert collections.Counter((s, ids, n) for s, _, ids, n in pieces[doc_id]) == want
    for parts in sequences.values():
        assert [o for o, _ in sorted(parts)] == list(np.cumsum([0] + [n for _, n in sorted(parts)])[:-1]) and sum(n for _, n in parts) <= 256
    assert packing.pack_documents(empty).count() == 0


def test_pieces_encode_as_whole_texts(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path(packing.TOKENIZER))
    texts = ["It's a test's  İstanbul ΣΑΣ été don't! a\x1cb <|endoftext|> x<|endoftext|>y 日本語 café, naïve.", "", " a b\x85c", "ſ ß ẞ ǅ", "hello!!'s we're'", "a.b.c,,,", "x\u0301 \u0301y"]
    texts += [None, "a" * 16 + " " + "a" * 17 + " " + "a" * 15 + "\x00 " + "b" * 40, "x1y22z--3.14 <|EndOfText|> <b>A'S 'll 'LL", "\x00 \x7f \x1f\x1e", "I\u0307 \u0130 \u2019s A\u030a"]
    texts += ["".join(random.Random(i).choice("abAB01 '.,<|é\n\x1c日\u0301") for _ in range(200)) for i in range(200)]
    want = [Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids for t in texts]
    encoder = packing.PieceEncoder(path)
    assert encoder.cuts
    for _ in range(2):
        ids, n = encoder.encode(pa.array(texts))
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]
    monkeypatch.setattr(packing, "PIECES_KEPT", 10)  # the table begins anew at every call
    monkeypatch.setattr(packing, "SLOT_BITS", 3)  # from few slots
    encoder = packing.PieceEncoder(path)
    got = [encoder.encode(pa.array([t], pa.string()))[0].tolist() for t in texts]
    assert got == want


def test_other_tokenizers_get_whole_texts(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    other = Tokenizer(models.WordLevel({"a b": 5, "c": 6, "?": 7}, unk_token="?"))
    other.pre_tokenizer = pre_tokenizers.Split(",", "removed")
    other.save(str(tmp_path / "other.json"))
    ids, n = packing.PieceEncoder(str(tmp_path / "other.json")).encode(pa.array(["a b,c", None, "x"]))
    assert ids.tolist() == [5, 6, 7] and n.tolist() == [2, 0, 1]


# queries and pipeline


def test_contract_columns(spark):
    from quillspark.llm.queries import QUERIES

    want = {
        "op1": "doc_id n_words n_removed kept_sha256", "op2": "query_id rank vec_id score", "op3": "doc_id size text_crc32 law shard slot grown_shard",
        "op4": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op5": "doc_id held_out score predicted", "op6": "doc_id size source_size target taken",
        "op7": "doc_id class_id kept", "op8": "doc_id held_out score predicted", "op9": "page_id host path rule verdict", "op10": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    }
    rows = {}
    for name, query in QUERIES.items():
        found = query(spark, SMALL)
        assert found.columns == want[name.split("_")[0]].split(), name
        rows[name.split("_")[0]] = found.collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert all(r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in rows["op3"])
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows["op5"]) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows["op8"])


def test_pipeline_on_awkward_and_empty_tables(spark, edge, empty):
    import corpus_pipeline as P

    for docs in (edge, empty):
        for name, stage in P.STAGES:
            found = stage(spark, docs, SMALL)
            rows = found.collect()
            if name == "packing":
                assert len(rows) >= docs.count()
            else:
                assert found.columns == docs.columns, name
                kept = collections.Counter(r.doc_id for r in rows)
                if name == "toxicity":
                    assert sum(kept.values()) == docs.count()
                elif name == "substring_dedup":
                    assert sum(kept.values()) == docs.count()
                elif name == "near_dedup" and docs is edge:
                    assert kept[1] == 1 and kept[None] == 2 and kept[7] + kept[1] <= 2


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = docs.collect()
    calm = P.toxicity(spark, docs, SMALL)
    assert calm.columns == docs.columns and 0 < docs.count() - calm.count() < 0.3 * docs.count()
    unique = P.near_dedup(spark, docs, SMALL)
    classes = brute_classes([r.text for r in before])
    assert sorted(r.doc_id for r in unique.collect()) == sorted(before[i].doc_id for i in set(classes))
    cut = {r.doc_id: r for r in P.substring_dedup(spark, docs, SMALL).collect()}
    for r, (n, gone, kept) in zip(before, brute_cut([r.text for r in before], 35)):
        assert cut[r.doc_id].text == (kept if gone else r.text)
    assert P.mixing(spark, docs, SMALL).columns == docs.columns
    assert P.run(spark, SMALL).count() > 0


def test_urls_long_and_repeated(spark):
    long = "https://example.com/" + "a/" * 20_000 + "porn"
    rows = [(1, long), (1, long), (2, None), (2, None), (None, "x"), (3, "https://example.com/" + "b" * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    strict = url_filters.STRICT[0]
    more = spark.createDataFrame([(9, f"https://h.org/{'c/' * 9000}{strict}?q")] * 2, "page_id long, url string")
    got = url_filters.filter_urls(pages.union(more)).collect()
    assert collections.Counter(r.page_id for r in got) == {1: 2, 2: 2, None: 1, 3: 1, 9: 2}
    assert {r.verdict for r in got if r.page_id == 9} == {"block"} and {r.verdict for r in got if r.page_id == 3} == {"allow"}
    assert all(r.host == "" and r.path == "" for r in got if r.page_id in (2, None))


def test_vectors_with_clashing_columns(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(6).tolist(), 7, "x", 0.5) for i in range(60)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, query_id string, `a.score` double")
    plain = ann.nearest(table.select("vec_id", "embedding"), F.col("vec_id") % 50 == 0).collect()
    assert sorted(map(tuple, ann.nearest(table, F.col("vec_id") % 50 == 0).collect())) == sorted(map(tuple, plain)) and len(plain) == 10
