"""Phrase collocations from depth-limited count tries.

Texts are lower-cased (A-Z), split into pieces and those into words; phrases of
up to four words are counted within pieces, per language. Every shard (a task's
rows, in blocks of bounded size) builds a count trie of that depth, which is
serialised in order, in ranges of the phrases' first two words; the ranges are
shuffled, and the sorted tries of a range are merged. A phrase that is frequent
by itself has its range cut further by the whole phrase.

A phrase of ``least`` occurrences has only pairs of neighbouring words of as many.
So a first pass counts words, the tries' first level, by a 64-bit key, and pairs
in hashed cells whose sums are never below a pair's own count. A bit map of fixed
size tells the second pass which pairs may be frequent; others end a trie's path.
This leaves out no candidate.

In the merged trie, a phrase's path less its last words gives the left parts of
its cuts, and the path less its first words (its suffix link) the right parts.

A null language is ``und``; null and empty texts have no words. Repeated rows
count each time. Texts are read whole, and of any length. A language without
candidates, or an empty table, gives no rows. Words are told apart by 64-bit
hashes: of 10^8 different words, 3 in 10,000 runs would confuse two. Columns
other than language and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm._tables import cut
from quillspark.llm._words import Words, mix64, row_slices

DEPTH, LEAST, CONTAINED = 4, 30, 80
SCALE = 2_000_000
#: Bits of a cell in the count of pairs, of the map of cells, and entries that a task gathers before it sends them.
CELL_BITS, MAP_BITS, GATHER = 32, 26, 1 << 21
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BLANK, _CUT = np.zeros(256, bool), np.zeros(256, bool)
_BLANK[[0x20, 0x09]] = True
_CUT[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True


class Pieces(Words):
    """Words of a slice; ``near`` flags those whose next word stands in the same piece."""

    def __init__(self, texts: pa.Array):
        super().__init__(texts, _BLANK | _CUT, _FOLD)
        cuts = np.concatenate((np.zeros(1, np.int32), np.cumsum(_CUT[self.buf], dtype=np.int32)))
        self.near = np.zeros(len(self.starts), bool)
        if len(self.starts):
            self.near[:-1] = (self.doc[1:] == self.doc[:-1]) & (cuts[self.ends[:-1]] == cuts[self.starts[1:]])


def pieces(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, Pieces, np.ndarray, np.ndarray]]:
    """Slices of (language, its hash, text) with their words, the words' hashes and their languages'."""
    for part in row_slices(batch, 2):
        words = Pieces(part.column(2))
        yield part, words, words.hashes(), part.column(1).to_numpy(zero_copy_only=False).view(np.uint64)[words.doc]


def cells_of(lang: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(mix64(one + lang) * np.uint64(3) + two) >> np.uint64(64 - CELL_BITS)


def word_keys(lang: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(mix64(word) + lang)


def flagged(bits: np.ndarray, cells: np.ndarray) -> np.ndarray:
    low = cells & np.uint64(8 * len(bits) - 1)
    return (bits[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(counts, new) if len(new) else counts


def planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, which the shuffle then compresses."""
    return x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).reshape(-1).view(np.uint64)


def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[dict]]]:
    """Rows of each part in turn; rows come sorted by the first column, the part."""
    rows = (r for batch in batches for r in batch.to_pylist())
    held = next(rows, None)
    while held is not None:
        part = held["part"]

        def mine(part: int = part) -> Iterator[dict]:
            nonlocal held
            while held is not None and held["part"] == part:
                yield held
                held = next(rows, None)

        yield part, mine()


def frequent_cells(docs: DataFrame, least: int, parts: int, gather: int) -> DataFrame:
    """is_word, cell, n: words (by key) that occur ``least`` times, and cells that as many pairs of neighbouring words fall into."""
    bits = {True: np.uint64(64), False: np.uint64(CELL_BITS)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list] = {True: [], False: []}
        size = 0

        def sent() -> Iterator[pa.RecordBatch]:
            for is_word, some in held.items():
                if some:
                    cells, counts = summed(*map(np.concatenate, zip(*some, strict=True)))
                    part = ((cells >> (bits[is_word] - np.uint64(32))) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
                    cuts = np.flatnonzero(np.diff(part)) + 1
                    rows = [(int(p[0]), is_word, planes(np.diff(c, prepend=np.uint64(0))), planes(n)) for p, c, n in zip(np.split(part, cuts), np.split(cells, cuts), np.split(counts, cuts), strict=True)]
                    types = (pa.int32(), pa.bool_(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=["part", "is_word", "cells", "counts"])
                    some.clear()

        for batch in batches:
            for _, words, h, lang in pieces(batch):
                at = np.flatnonzero(words.near)
                for is_word, cells in ((True, word_keys(lang, h)), (False, cells_of(lang[at], h[at], h[at + 1]))):
                    if len(cells):
                        held[is_word].append(summed(cells, np.ones(len(cells), np.int64)))
                        size += len(held[is_word][-1][0])
                if size > gather:
                    for some in held.values():
                        some[:] = [summed(*map(np.concatenate, zip(*some, strict=True)))] if some else []
                    size = sum(len(x[0][0]) for x in held.values() if x)
                    if size > gather // 2:
                        yield from sent()
                        size = 0
        yield from sent()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_part(batches):
            held: dict[bool, list] = {True: [], False: []}
            size = {True: 0, False: 0}
            for r in rows:
                some = held[r["is_word"]]
                some.append((np.cumsum(from_planes(r["cells"])), from_planes(r["counts"]).astype(np.int64)))
                size[r["is_word"]] += len(some[-1][0])
                if size[r["is_word"]] > 2 * gather:
                    some[:] = [summed(*map(np.concatenate, zip(*some, strict=True)))]
                    size[r["is_word"]] = len(some[0][0]) // 2  # the next fold comes once as much again is there
            for is_word, some in held.items():
                if some:
                    cells, n = summed(*map(np.concatenate, zip(*some, strict=True)))
                    cells, n = cells[n >= least], n[n >= least]
                    yield pa.RecordBatch.from_arrays([pa.array([is_word] * len(n), pa.bool_()), pa.array(cells.view(np.int64)), pa.array(n)], names=["is_word", "cell", "n"])

    shards = docs.mapInArrow(count, "part int, is_word boolean, cells binary, counts binary")
    return shards.repartition("part").sortWithinPartitions("part").mapInArrow(merge, "is_word boolean, cell long, n long")


def bit_map(cells: DataFrame) -> np.ndarray:
    """Flags of the cells' low bits: a map of fixed size."""
    low = F.col("cell").bitwiseAND((1 << MAP_BITS) - 1)
    words = cells.groupBy(F.shiftright(low, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(cell & 63 as int))")).alias("bits")).toArrow()
    flags = np.zeros(1 << (MAP_BITS - 6), np.int64)
    flags[words["at"].to_numpy()] = words["bits"].to_numpy()
    return flags.view(np.uint8)


Levels = list[tuple[np.ndarray, np.ndarray]]


def distinct_paths(paths: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, with the sums of their counts."""
    if not len(paths):
        return paths, counts
    order = np.lexsort(paths.T[::-1])
    paths, counts = paths[order], counts[order]
    new = np.flatnonzero(np.concatenate(([True], (paths[1:] != paths[:-1]).any(1))))
    return paths[new], np.add.reduceat(counts, new)


def merged(tries: list[Levels]) -> Levels:
    """The trie that counts what the given ones count together."""
    return [distinct_paths(*map(np.concatenate, zip(*level, strict=True))) for level in zip(*tries, strict=True)]


def serialised(levels: Levels) -> bytes:
    """A trie in order of its paths: per level the last words, counts and numbers of children; paths of the first level are whole."""
    full = list(levels)
    for k in range(len(full) - 1, 0, -1):  # parents that are counted elsewhere come with a count of 0
        above = full[k][0][:, :-1]
        full[k - 1] = distinct_paths(np.concatenate((full[k - 1][0], above)), np.concatenate((full[k - 1][1], np.zeros(len(above), np.int64))))
    out = [np.array([len(paths) for paths, _ in full], np.int64).tobytes(), full[0][0].tobytes(), planes(full[0][1])]
    for (above, _), (paths, counts) in zip(full[:-1], full[1:], strict=True):
        new = np.flatnonzero(np.concatenate(([True], (paths[1:, :-1] != paths[:-1, :-1]).any(1)))) if len(paths) else np.zeros(0, np.int64)
        children = np.zeros(len(above), np.int64)
        children[places(above, paths[new, :-1])] = np.diff(np.append(new, len(paths)))
        out += [planes(children), np.ascontiguousarray(paths[:, -1]).tobytes(), planes(counts)]
    return b"".join(out)


def places(paths: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Where each row of ``some`` stands in ``paths``, distinct sorted rows that hold them all."""
    both = np.concatenate((paths, some))
    order = np.lexsort(both.T[::-1])
    place = np.empty(len(both), np.int64)
    place[order] = np.cumsum(np.concatenate(([True], (both[order[1:]] != both[order[:-1]]).any(1)))) - 1 if len(both) else []
    return place[len(paths) :]


def deserialised(raw: bytes, depth: int) -> Levels:
    sizes, at, levels = np.frombuffer(raw, np.int64, depth - 1), 8 * (depth - 1), []

    def take(n: int) -> bytes:
        nonlocal at
        at += n
        return raw[at - n : at]

    for k, n in enumerate(map(int, sizes)):
        if k:
            children = from_planes(take(8 * int(sizes[k - 1]))).astype(np.int64)
            last = np.frombuffer(take(8 * n), np.uint64)
            paths = np.column_stack((np.repeat(levels[-1][0], children, axis=0), last))
        else:
            paths = np.frombuffer(take(24 * n), np.uint64).reshape(-1, 3)
        levels.append((paths, from_planes(take(8 * n)).astype(np.int64)))
    return levels


def phrase_tries(docs: DataFrame, flags, hot, parts: int, depth: int, least: int, gather: int) -> DataFrame:
    """path, depth, n, lang, word, key: the frequent nodes of the merged tries from depth 2 on.

    A path is the language's hash and the words' hashes, 8 bytes each. At depth 1 stand the words that such phrases may
    have, with their strings and keys and without counts, and at depth 0 sums over all words of a language, one row or more.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, often = flags.value, hot.value
        words_of: dict[tuple[int, int], tuple[str, str]] = {}
        totals: dict[tuple[str, int], int] = {}
        held: list[Levels] = []
        size = 0

        def sent() -> Iterator[pa.RecordBatch]:
            rows = [(at % parts, lang, at, None, n, None) for (lang, at), n in totals.items()]
            listed: dict[tuple[int, str, int], list[str]] = {}
            for (at, hash_), (lang, word) in words_of.items():
                listed.setdefault((hash_ % parts, lang, at), []).append(word)
            rows += [(*key, words, None, None) for key, words in listed.items()]
            levels = merged(held) if held else []
            homes = []
            for paths, _ in levels:
                home = mix64(cells_of(paths[:, 0], paths[:, 1], paths[:, 2]))
                whole = home.copy()
                for k in range(3, paths.shape[1]):
                    whole = mix64(whole ^ paths[:, k])
                split = np.isin(cells_of(paths[:, 0], paths[:, 1], paths[:, 2]), often)
                homes.append(np.where(split, whole, home) % np.uint64(parts))
            for part in np.unique(np.concatenate(homes)) if homes else []:
                mine = [(paths[home == part], n[home == part]) for (paths, n), home in zip(levels, homes, strict=True)]
                rows.append((int(part), None, None, None, None, serialised(mine)))
            columns = zip(*rows, strict=True) if rows else [()] * 6
            types = (pa.int32(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=["part", "lang", "lang_hash", "words", "n", "trie"])

        for batch in batches:
            for rows, words, h, lang in pieces(batch):
                if not len(h):
                    continue
                names = rows.column(0)
                for d, m in enumerate(words.counts.tolist()):
                    key = names[d].as_py(), rows.column(1)[d].as_py()
                    totals[key] = totals.get(key, 0) + m
                at = np.flatnonzero(words.near)
                ok = np.zeros(len(h), bool)
                ok[at] = flagged(bits, cells_of(lang[at], h[at], h[at + 1]))
                part = np.flatnonzero(ok | np.append(False, ok[:-1]))
                for i in part[np.unique(word_keys(lang[part], h[part]), return_index=True)[1]].tolist():
                    key = int(lang[i].astype(np.int64)), int(h[i])
                    if key not in words_of:
                        words_of[key] = names[int(words.doc[i])].as_py(), bytes(words.buf[words.starts[i] : words.ends[i]]).decode()
                levels, run = [], ok
                for k in range(2, depth + 1):
                    run = goes_on(run, ok, k - 2)
                    begin = np.flatnonzero(run)
                    paths = np.column_stack([lang[begin], *(h[begin + j] for j in range(k))])
                    levels.append(distinct_paths(paths, np.ones(len(begin), np.int64)))
                held.append(levels)
                size += sum(len(n) for _, n in levels)
                full = len(words_of) > gather // 4
                if size > gather // 4:
                    held = [merged(held)]
                    size = sum(len(n) for _, n in held[0])
                    full |= size > gather // 8
                if full:
                    yield from sent()
                    held, size = [], 0
                    words_of.clear()
                    totals.clear()
        yield from sent()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_part(batches):
            held: list[Levels] = []
            size, totals, words = 0, {}, set()
            for r in rows:
                key = r["lang"], r["lang_hash"]
                if r["words"] is not None:
                    words.update((*key, w) for w in r["words"])
                elif r["trie"] is None:
                    totals[key] = totals.get(key, 0) + r["n"]
                else:
                    held.append(deserialised(r["trie"], depth))
                    size += sum(len(n) for _, n in held[-1])
                    if size > gather:
                        held = [merged(held)]
                        size = sum(len(n) for _, n in held[0]) // 2
            found = [(_path(at), 0, n, lang, None, None) for (lang, at), n in totals.items()]
            listed = sorted(words)
            hashes = Pieces(pa.array([w for _, _, w in listed], pa.string())).hashes()
            keys = word_keys(np.array([at for _, at, _ in listed], np.int64).view(np.uint64), hashes).view(np.int64).tolist()
            found += [(_path(at) + h.byteswap().tobytes(), 1, None, lang, word, key) for (lang, at, word), h, key in zip(listed, hashes, keys, strict=True)]
            for k, (paths, n) in enumerate(merged(held) if held else [], 2):
                raw = paths[n >= least].byteswap()
                found += [(x.tobytes(), k, m, None, None, None) for x, m in zip(raw, n[n >= least].tolist(), strict=True)]
            types = (pa.binary(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True) if found else [()] * 6, types, strict=True)], names=["path", "depth", "n", "lang", "word", "key"])

    shards = docs.mapInArrow(count, "part int, lang string, lang_hash long, words array<string>, n long, trie binary")
    return shards.repartition("part").sortWithinPartitions("part").mapInArrow(merge, "path binary, depth int, n long, lang string, word string, key long")


def _path(lang_hash: int) -> bytes:
    return int(lang_hash).to_bytes(8, "big", signed=True)


def goes_on(run: np.ndarray, ok: np.ndarray, by: int) -> np.ndarray:
    """The runs of pairs that another pair follows, ``by`` places on."""
    out = np.zeros(len(run), bool)
    out[: max(len(run) - by, 0)] = run[: max(len(run) - by, 0)] & ok[by:]
    return out


def best_cuts(nodes: DataFrame) -> DataFrame:
    """path, a, l, r, score: of the phrases of two words and more, by their lowest-scoring cut."""
    count = nodes.filter("depth >= 1").select("path", "n")
    cuts = nodes.filter("depth >= 2").select("path", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("depth") - 1)).alias("k"))
    left = F.expr("substring(path, 1, 8 + 8 * k)")
    right = F.expr("concat(substring(path, 1, 8), substring(path, 9 + 8 * k))")
    cuts = cuts.select("path", "a", "k", left.alias("left"), right.alias("right"))
    cuts = cuts.join(count.select(F.col("path").alias("left"), F.col("n").alias("l")), "left").join(count.select(F.col("path").alias("right"), F.col("n").alias("r")), "right")
    score = F.expr(f"(cast(a as decimal(19, 0)) * {SCALE}) div (cast(l as decimal(19, 0)) + r)")
    best = cuts.groupBy("path", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return best.select("path", "a", "cut.l", "cut.r", "cut.score")


def longest_within(nodes: DataFrame, depth: int) -> DataFrame:
    """path, within: the largest count of a longer phrase that holds the phrase's words in a row."""
    longer = nodes.filter("depth >= 3")
    spans = F.expr("flatten(transform(sequence(2, depth - 1), m -> transform(sequence(0, depth - m), s -> concat(substring(path, 1, 8), substring(path, 9 + 8 * s, 8 * m)))))")
    return longer.select("n", F.explode(spans).alias("path")).groupBy("path").agg(F.max("n").alias("within"))


def collocations(docs: DataFrame, top: int = 2000, least: int = LEAST, depth: int = DEPTH, contained: int = CONTAINED, parts: int | None = None, gather: int = GATHER, lang_column: str = "lang", text_column: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language.

    ``parts``: prefix ranges, four times the shuffle partitions unless given. ``gather``: entries that a task holds before
    it sends them on.
    """
    spark = docs.sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    lang = F.coalesce(F.col(lang_column).cast("string"), F.lit("und"))
    rows = docs.select(lang.alias("lang"), F.xxhash64(lang).alias("lang_hash"), F.col(text_column).alias("text"))
    cells = cut(frequent_cells(rows, least, parts, gather))
    pairs = cells.filter("NOT is_word")
    total = pairs.agg(F.sum("n")).first()[0] or 0
    hot = [r.cell for r in pairs.filter(F.col("n") > total // parts).select("cell").collect()]  # at most ``parts``
    send = spark.sparkContext.broadcast
    nodes = cut(phrase_tries(rows, send(bit_map(pairs)), send(np.array(hot, np.uint64)), parts, depth, least, gather))
    sizes = nodes.filter("depth = 0").groupBy("lang", F.col("path").alias("root")).agg(F.sum("n").alias("n"))
    words = nodes.filter("depth = 1").select(F.col("path").alias("at"), "word")
    counted = nodes.filter("depth = 1").drop("n").join(cells.filter("is_word").select(F.col("cell").alias("key"), "n"), "key")
    kept = best_cuts(nodes.filter("depth > 1").unionByName(counted)).join(longest_within(nodes, depth), "path", "left")
    kept = kept.filter(F.expr(f"within is null or cast(within as decimal(19, 0)) * 100 < cast(a as decimal(19, 0)) * {contained}"))
    kept = kept.withColumn("root", F.expr("substring(path, 1, 8)"))
    # ties at the border stay until the phrases' words are there to break them
    near = kept.withColumn("place", F.rank().over(Window.partitionBy("root").orderBy(F.desc("score"), F.desc("a")))).filter(F.col("place") <= top)
    spelt = near.select("*", F.explode(F.expr("sequence(0, cast(length(path) / 8 as int) - 2)")).alias("k")).withColumn("at", F.expr("concat(root, substring(path, 9 + 8 * k, 8))"))
    spelt = spelt.join(words, "at").groupBy("path", "root", "a", "l", "r", "score").agg(F.sort_array(F.collect_list(F.struct("k", "word"))).alias("ws"))
    phrases = spelt.withColumn("phrase", F.array_join("ws.word", " "))
    ranked = phrases.withColumn("rank", F.row_number().over(Window.partitionBy("root").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(sizes, "root").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
