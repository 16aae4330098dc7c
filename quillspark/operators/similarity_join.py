"""Joins of strings by indel similarity that don't make all pairs.

Two strings of n and m characters whose ratio is t or more have a common
subsequence of at least c * (n + m) characters, c = t / 200. A character that
is left out breaks up to q of the q-grams around it, one that is put in up to
q - 1. So they share at least c * (n + m) characters and, where that is more
than nothing, (3c - 1) * (n + m) - 1 pairs of neighbouring characters (q = 2).

Prefix filter: the grams of all strings are put in one order, rare ones first.
Two strings that must share o of their grams share one of the first
(number of grams) - o + 1 of each. Those first grams are the join's keys; a gram
that occurs again in a string is another gram. Strings so short that pairs of
characters bound nothing are keyed by single characters.

Within a key, candidates are dropped by length, by the places of the shared gram
in both orders, and by their characters regardless of order;
only then is the subsequence computed. Hot keys are dealt to blocks on both sides.

At two thirds or less no q-gram bound exists (3c <= 1). There the strings of a
group meet in blocks, where the bound by characters goes before the
subsequence. ``best_like`` asks for the likest string only: it takes the
thresholds from the top, so that what has a near match is settled by rare keys
and only the rest meets whole blocks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.similarity import lcs_of_pairs, sorted_tokens
from quillspark.operators.lineage import settle

#: Strings of a block on each side, and grams whose frequency orders them; rarer ones count as equally rare.
BLOCK, COMMON = 1024, 4096
#: Rows of a bucket on average, and pairs that are looked at together.
BUCKET_ROWS, PAIRS = 20_000, 1 << 20
#: Ratios up to which grams bound nothing that is worth a key.
BLOCKS_ONLY = 70.0
#: Ratios at which ``best_like`` looks by keys before it looks everywhere.
STEPS = (90.0, 80.0)
_EPS = 1e-9


def grams(text: str, q: int) -> list[str]:
    """The q-grams of a text, each with its number among equal ones."""
    seen: Counter[str] = Counter()
    out = []
    for i in range(len(text) - q + 1):
        g = text[i : i + q]
        seen[g] += 1
        out.append(f"{q}{g}{seen[g]}")
    return out


def keyed(text: str, least: float, often: dict[str, int]) -> list[tuple[str, int, int]]:
    """(gram, its place in the common order, number of grams) of the grams that a text is joined by."""
    n, c = len(text), least / 200
    if not n:
        return [("", 0, 1)]
    low, high, a = math.ceil(n * c / (1 - c) - _EPS), math.floor(n * (1 - c) / c + _EPS), 3 * c - 1
    from_total = 2 / a if a > 0 else math.inf  # pairs of so many characters together share a pair of neighbours
    out = []
    for q, need in ((1, c * (n + low) if n + low < from_total else 0), (2, a * max(n + low, from_total) - 1 if n + high >= from_total - _EPS else 0)):
        size = n - q + 1
        need = math.ceil(need - _EPS)
        if 0 < need <= size:
            order = sorted(grams(text, q), key=lambda g: (often.get(g, 0), g))
            out += [(g, i, size) for i, g in enumerate(order[: size - need + 1])]
    return out


def bags(a: Sequence[str], b: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of each string as bits, a character's k-th occurrence apart; bits in common bound the common subsequence."""
    place: dict[str, int] = {}
    for x in a:
        for g in grams(x, 1):
            place.setdefault(g, len(place))
    out = []
    for strings in (a, b):
        flags = np.zeros((len(strings), -(-max(len(place), 1) // 64) * 64), bool)
        for i, x in enumerate(strings):
            flags[i, [place[g] for g in grams(x, 1) if g in place]] = True
        out.append(np.packbits(flags, axis=1).view(np.uint64))
    return out[0], out[1]


def _in_common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return sum(np.bitwise_count(x[..., w] & y[..., w]).astype(np.int32) for w in range(x.shape[-1]))


def _ratio_of(shared: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.where(total > 0, 200.0 * shared / np.maximum(total, 1), 100.0)


def judged(a: list[str], b: list[str], least: float, best: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, ratio) of the pairs that are as alike as ``least``; with ``best``, each a's likest alone."""
    n, m = np.array([len(x) for x in a])[:, None], np.array([len(x) for x in b])[None, :]
    total = n + m
    x, y = bags(a, b)
    bound = np.where(200.0 * np.minimum(n, m) >= least * total - _EPS, _ratio_of(_in_common(x[:, None, :], y[None, :, :]), total), -1.0)
    scores = lambda i, j: _ratio_of(lcs_of_pairs(a, b, i, j), total[i, j])
    floor = np.full(len(a), least)
    if best:  # what the likeliest of each reaches, the others must be able to
        some = np.flatnonzero(bound.max(1) >= least - _EPS)
        floor[some] = np.maximum(least, scores(some, bound[some].argmax(1)))
    i, j = np.nonzero(bound >= floor[:, None] - _EPS)
    score = scores(i, j)
    if best:
        np.maximum.at(floor, i, score)
    good = score >= floor[i]
    return i[good], j[good], score[good]


def _met(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of equal values in both, all pairs of them, so many at a time."""
    by_x, by_y = np.argsort(x, kind="stable"), np.argsort(y, kind="stable")
    (ux, at_x, n), (uy, at_y, m) = np.unique(x[by_x], return_index=True, return_counts=True), np.unique(y[by_y], return_index=True, return_counts=True)
    _, i, j = np.intersect1d(ux, uy, return_indices=True)
    at_x, n, at_y, m = at_x[i], n[i], at_y[j], m[j]
    part = np.cumsum(n * m) // PAIRS
    for p in np.unique(part):
        own = np.flatnonzero(part == p)
        of = np.repeat(own, (n * m)[own])
        nth = np.arange(len(of)) - np.repeat(np.cumsum((n * m)[own]) - (n * m)[own], (n * m)[own])
        yield by_x[at_x[of] + nth // m[of]], by_y[at_y[of] + nth % m[of]]


def _by_shared_grams(x: pa.Table, y: pa.Table, names: list[str], least: float, sort_tokens: bool, best: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, ratio) of the pairs of a bucket that share a gram of a key and are as alike as ``least``."""
    c = least / 200
    strings, place = [], []
    for side in (x, y):
        code, names_of = pd.factorize(side["text"].to_pandas())
        strings.append([sorted_tokens(t) if sort_tokens else t for t in names_of])
        place.append(code)
    length = [np.array([len(t) for t in side], np.int64)[code] for side, code in zip(strings, place, strict=True)]
    after = [side["size"].to_numpy().astype(np.int64) - side["place"].to_numpy() for side in (x, y)]
    is_pair = np.array([g[:1] == "2" for g in x["gram"].to_pylist()])
    keys = [pd.factorize(pd.concat([x[k].to_pandas(), y[k].to_pandas()], ignore_index=True))[0] for k in [*names, "gram"]]
    bits = bags(*strings)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i, j in _met(x["g"].to_numpy(), y["g"].to_numpy()):
        total = length[0][i] + length[1][j]
        # if this is the first gram that two strings share, they share no more than what comes after it
        need = np.where(is_pair[i], (3 * c - 1) * total - 1, c * total)
        ok = (np.minimum(length[0][i], length[1][j]) >= c * total - _EPS) & (np.minimum(after[0][i], after[1][j]) >= need - _EPS)
        for k in keys:  # equal hashes are no proof
            ok &= k[i] == k[x.num_rows + j]
        i, j = i[ok], j[ok]
        ok = _ratio_of(_in_common(bits[0][place[0][i]], bits[1][place[1][j]]), length[0][i] + length[1][j]) >= least - _EPS
        i, j = i[ok], j[ok]
        score = _ratio_of(lcs_of_pairs(*strings, place[0][i], place[1][j]), length[0][i] + length[1][j])
        out.append((i[score >= least], j[score >= least], score[score >= least]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    i, j, score = (np.concatenate(v) for v in zip(*out, strict=True))
    if best:
        group = np.zeros(x.num_rows, np.int64)
        for k in [place[0], *(k[: x.num_rows] for k in keys[:-1])]:
            group = pd.factorize(group * (k.max(initial=0) + 1) + k)[0]
        top = np.zeros(group.max(initial=-1) + 1)
        np.maximum.at(top, group[i], score)
        i, j, score = (v[score >= top[group[i]]] for v in (i, j, score))
    return i, j, score


def _comparison(names: list[str], least: float, sort_tokens: bool, best: bool):
    """A function that judges the strings of a bucket: those that share a gram of a key, or a block of a key."""

    def compare(x: pa.Table, y: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if x.num_rows and y.num_rows:
            if "gram" in x.column_names:
                found.append(_by_shared_grams(x, y, names, least, sort_tokens, best))
            else:
                a, b = (np.array([sorted_tokens(t) if sort_tokens else t for t in side["text"].to_pylist()], object) for side in (x, y))
                hashes = [side["g"].to_numpy() for side in (x, y)]
                for g in np.intersect1d(*hashes):
                    own, other = np.flatnonzero(hashes[0] == g), np.flatnonzero(hashes[1] == g)
                    i, j, score = judged(a[own].tolist(), b[other].tolist(), least, best)
                    found.append((own[i], other[j], score))
        i, j, score = (np.concatenate(v) for v in zip(*found, strict=True))
        for k in names:  # equal hashes are no proof of equal keys
            code = pd.factorize(pd.concat([x[k].to_pandas(), y[k].to_pandas()], ignore_index=True))[0]
            same = code[i] == code[x.num_rows + j]
            i, j, score = i[same], j[same], score[same]
        return pa.table({**{k: x[k].take(pa.array(i)) for k in names}, "a": x["text"].take(pa.array(i)), "b": y["text"].take(pa.array(j)), "score": pa.array(score, pa.float64())})

    return compare


def pairs_of_blocks(left: DataFrame, right: DataFrame, by: list[str], block: int) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt to blocks, each block of one side with each of the other; ``g`` names a pair of blocks, and ``bucket`` a task's share of them."""
    count = lambda df, n: df.groupBy(*by).agg(F.count(F.lit(1)).alias(n))
    sizes = count(left, "left_rows").join(count(right, "right_rows"), by)
    sizes = settle(sizes.withColumns({"n_i": F.ceil(F.col("left_rows") / block).cast("int"), "n_j": F.ceil(F.col("right_rows") / block).cast("int")}))
    rows = sizes.agg(F.sum(F.col("left_rows") * F.col("n_j") + F.col("right_rows") * F.col("n_i"))).first()[0] or 0
    buckets = max(1, -(-rows // BUCKET_ROWS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda df, n, name: df.join(sizes, by).withColumn(name, F.pmod(F.xxhash64("text"), n).cast("int"))
    named = lambda df: df.drop("n_i", "n_j", "left_rows", "right_rows").withColumn("g", F.xxhash64(*by, "i", "j")).withColumn("bucket", F.pmod("g", F.lit(buckets)))
    return named(own(left, "n_i", "i").withColumn("j", every("n_j"))), named(own(right, "n_j", "j").withColumn("i", every("n_i")))


def _distinct(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    named = df.filter(F.col(column).isNotNull()).select(*(F.col(k).alias(f"k{n}") for n, k in enumerate(keys)), F.col(column).alias("text"))
    return named.distinct()


def similarity_join(left: DataFrame, right: DataFrame, keys: Sequence[str], least: float, sort_tokens: bool = True, best: bool = False, block: int = BLOCK) -> DataFrame:
    """(keys, a, b, score): the different pairs of a string ``a`` of ``left`` and a string ``b`` of ``right`` with equal keys whose ratio is ``least`` or more.

    The ratio is that of the sorted tokens, or of the strings as they are. With ``best``, pairs that a task knows to be
    less alike than another of the same ``a`` may be left out. Keys may be none; null keys and strings join nothing.
    """
    keys = list(keys)
    names = [f"k{n}" for n in range(len(keys))]
    x, y = settle(_distinct(left, keys, "a")), settle(_distinct(right, keys, "b"))
    by = names
    if least > BLOCKS_ONLY:
        often = _gram_counts(x.select("text").unionByName(y.select("text")), sort_tokens)
        x, y = (_by_grams(df, least, sort_tokens, often) for df in (x, y))
        by = [*names, "gram"]
    elif not names:
        x, y = x.withColumn("one", F.lit(0)), y.withColumn("one", F.lit(0))
        by = ["one"]
    x, y = pairs_of_blocks(x, y, by, block)
    schema = ", ".join([*(f"{k} {left.schema[c].dataType.simpleString()}" for k, c in zip(names, keys, strict=True)), "a string", "b string", "score double"])
    found = x.groupBy("bucket").cogroup(y.groupBy("bucket")).applyInArrow(_comparison(names, least, sort_tokens, best), schema)
    found = found.distinct() if least > BLOCKS_ONLY else found
    return found.select(*(F.col(n).alias(k) for n, k in zip(names, keys, strict=True)), "a", "b", "score")


def _gram_counts(texts: DataFrame, sort_tokens: bool) -> dict[str, int]:
    """How often the COMMON most frequent grams occur."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                t = sorted_tokens(t) if sort_tokens else t
                seen.update(grams(t, 1))
                seen.update(grams(t, 2))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["g", "n"])

    total = texts.mapInArrow(count, "g string, n long").groupBy("g").agg(F.sum("n").alias("n"))
    return {r.g: r.n for r in total.orderBy(F.desc("n"), "g").limit(COMMON).collect()}


def _by_grams(strings: DataFrame, least: float, sort_tokens: bool, often: dict[str, int]) -> DataFrame:
    """``strings`` once for each gram that they are joined by, with gram, place and size."""
    width = len(strings.columns)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(width - 1).to_pylist()
            rows = [(r, *k) for r, t in enumerate(texts) for k in keyed(sorted_tokens(t) if sort_tokens else t, least, often)]
            at, gram, place, size = zip(*rows, strict=True) if rows else ((), (), (), ())
            columns = [c.take(pa.array(at, pa.int64())) for c in batch.columns]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(gram, pa.string()), pa.array(place, pa.int32()), pa.array(size, pa.int32())], names=[*batch.schema.names, "gram", "place", "size"])

    schema = strings.limit(0).withColumns({"gram": F.lit(""), "place": F.lit(0), "size": F.lit(0)}).schema
    return strings.mapInArrow(spread, schema)


def best_like(asked: DataFrame, known: DataFrame, least: float, sort_tokens: bool = True, block: int = BLOCK) -> DataFrame:
    """(a, b, score): for each different string ``a`` of ``asked`` all the likest strings ``b`` of ``known``, if as alike as ``least``."""
    open_ones, found = settle(asked.select("a").filter(F.col("a").isNotNull()).distinct()), None
    for step in [s for s in STEPS if s > max(least, BLOCKS_ONLY)] + [least]:
        some = settle(similarity_join(open_ones, known, [], step, sort_tokens, True, block))
        found = some if found is None else found.unionByName(some)
        open_ones = settle(open_ones.join(some.select("a").distinct(), "a", "left_anti"))
        if open_ones.isEmpty():
            break
    top = found.groupBy("a").agg(F.max("score").alias("top"))
    return found.join(top, "a").filter("score = top").select("a", "b", "score")
