"""Substring dedup: partitioned suffix trees over words, cut at the window's depth.

A window of ``window`` words is a repeat if its word sequence also starts at
another place of any text. It is the first ``window`` words of a suffix, so
repeats are the inner nodes of the suffix tree at that depth: a node there with
two leaves or more is a repeat, and a leaf that hangs higher is none.

The tree is partitioned by a key of each suffix's first ``window`` words, so that
suffixes with the same window are in the same part. The key is not the leading
words, as in a plain prefix partition, but the window's smallest k-word gram
by hash, its anchor (k + span - 1 = window): neighbouring suffixes mostly have
the same one and travel as one row, where leading words would deal them to as many
parts as there are suffixes, each with its own window (see the README for figures).

1. Suffixes are thinned to those that can matter. Anchors are counted; a window
   whose anchor is unique is unique itself and drops out.
2. Keys are of variable length. An anchor that occurs up to ``most`` times is
   the key of one part: its windows are dealt to one task with others of the
   same size. A more frequent anchor's windows take their whole length as key,
   which makes the part a single node: it is only counted, with sums made
   before the shuffle. No part outgrows memory, and a passage that a third of
   all texts share is never gathered.
3. A part's tree is built by sorting its windows by their blocks of words;
   neighbours' common blocks are the depths of the inner nodes. What hangs above
   the last level is sent back as unique; it is little.
4. Words in the windows that are left are removed from each text.

Texts are known by 64-bit hashes, and blocks of words by hashes of 64 and 32
bits, so equality is that of 128 bits for a window; of 3 * 10**10 different
texts about 25 pairs are taken for one another.

Null and empty texts have no words; texts shorter than the window lose nothing.
Equal texts and repeated rows are repeats of one another, and rows with the
same text are cut alike. Ids may be null or repeated. Very long texts are
handled whole. An empty table gives an empty result. Other columns are carried
along by ``remove_repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._tables import by_place, cut, free_name, quoted, small_batches
from quillspark.llm._words import Words, gram_hashes, released, slices, span_hashes

WINDOW = 35
#: Words of an anchor.
ANCHOR = 12
#: Occurrences of an anchor up to which its windows make one part.
MOST = 1_000
#: Anchors dealt to a task on average when trees are built.
ANCHORS_A_TASK = 40_000
#: Words of the blocks that a window is compared by.
BLOCKS = (12, 12, 11)

#: Bits of a position, and positions that anchors are found for at once.
_BITS = 24
_POSITION = np.uint64((1 << _BITS) - 1)
_LAST = np.uint64((1 << 64) - 1)


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Smallest of x[i:i + n], for every i that has n values."""
    out, width = x, 1
    while 2 * width <= n:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return np.minimum(out[: len(x) - n + 1], out[n - width : n - width + len(x) - n + 1])


def window_anchors(hashes: np.ndarray, left: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window starts, each window's anchor position, anchor hash by position)."""
    at = np.flatnonzero(left >= window)
    grams = np.full(len(hashes), _LAST)
    values, places = gram_hashes(hashes, left, anchor)
    grams[places] = values
    if not len(at):
        return at, at, grams
    # smallest by the upper bits, the leftmost of equal ones; positions count from the beginning of a stretch
    span, stretch = window - anchor + 1, 1 << (_BITS - 1)
    low = np.zeros(len(grams), np.int64)
    for begin in range(0, len(grams) - span + 1, stretch):
        own = grams[begin : begin + stretch + span - 1]
        packed = (own & ~_POSITION) | np.arange(len(own), dtype=np.uint64)
        found = (sliding_min(packed, span) & _POSITION).astype(np.int64)
        low[begin : begin + len(found)] = begin + found
    return at, low[at], grams


def anchors_of(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """(anchor, node, size, place) of the anchors of every text; a task leaves out a text's third and later copies."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in slices(batch, "text"):
                _, at, grams = window_anchors(words.hashes(), words.left(), window, anchor)
                at = np.unique(at)
                doc = words.doc[at]
                node = part.column(0).to_numpy()
                at, doc = at[(keep := twice_at_most(node)[doc])], doc[keep]
                place = at - words.first[doc]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams[at].view(np.int64)), pa.array(node[doc]), pa.array(words.counts[doc].astype(np.int32)), pa.array(place.astype(np.int32))],
                    names=["anchor", "node", "size", "place"],
                )

    return docs.select("node", "text").mapInArrow(released(make), "anchor long, node long, size int, place int")


def twice_at_most(node: np.ndarray) -> np.ndarray:
    """Flags the first two rows of each node: as good as all where it counts whether something occurs twice."""
    order = np.argsort(node, kind="stable")
    third = np.zeros(len(node), bool)
    third[order[2:]] = node[order[2:]] == node[order[:-2]]
    return ~third


def candidate_windows(words: Words, places: list[np.ndarray | None], window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(starts, anchor positions, anchor hashes, word hashes) of windows whose anchors are among each text's places."""
    hashes = words.hashes()
    at, low, grams = window_anchors(hashes, words.left(), window, anchor)
    listed = np.zeros(len(words.starts), bool)
    for first, found in zip(words.first, places, strict=False):
        if found is not None:
            listed[first + found] = True
    use = listed[low]
    return at[use], low[use], grams[low[use]], hashes


def suffixes(marked: DataFrame, window: int, anchor: int, blocks: tuple[int, ...]) -> DataFrame:
    """A row per anchor and text: anchor, node, size, place of the first window, hot, and the windows' blocks."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in slices(batch, "text"):
                places = [np.asarray(p, np.int64) if p else None for p in part.column(2).to_pylist()]
                hot = [set(p or ()) for p in part.column(3).to_pylist()]
                node = part.column(0).to_numpy()
                again = ~twice_at_most(node)
                for i in np.flatnonzero(again):
                    places[i] = None
                at, low, grams, hashes = candidate_windows(words, places, window, anchor)
                packed = window_blocks(hashes, at, blocks)
                begin = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1]))) if len(at) else np.zeros(0, np.int64)
                end = np.append(begin[1:], len(at))
                doc = words.doc[at[begin]]
                place = at[begin] - words.first[doc]
                is_hot = [int(x - words.first[d]) in hot[d] for x, d in zip(low[begin], doc, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(grams[begin].view(np.int64)),
                        pa.array(node[doc]),
                        pa.array(words.counts[doc].astype(np.int32)),
                        pa.array(place.astype(np.int32)),
                        pa.array(is_hot, pa.bool_()),
                        pa.array([packed[b:e].tobytes() for b, e in zip(begin, end, strict=True)], pa.binary()),
                    ],
                    names=["anchor", "node", "size", "place", "hot", "windows"],
                )

    return marked.mapInArrow(released(make), "anchor long, node long, size int, place int, hot boolean, windows binary")


#: First block in full, the others by half a hash each.
_BLOCK_TYPE = np.dtype([("a", "<u8"), ("b", "<u4"), ("c", "<u4")])


def window_blocks(hashes: np.ndarray, at: np.ndarray, blocks: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(len(at), _BLOCK_TYPE)
    low = at
    for name, n in zip("abc", blocks, strict=True):
        h = span_hashes(hashes, low, low + n)
        out[name] = h if name == "a" else h >> np.uint64(32)
        low = low + n
    return out


def shallow_leaves(windows: np.ndarray) -> np.ndarray:
    """Flags windows that share less than all blocks with every other: leaves that hang above the deepest level.

    Sorting puts the leaves of the tree in order; two neighbours' common blocks are the depth of the node that joins them.
    """
    order = np.lexsort((windows["c"], windows["b"], windows["a"]))
    x = windows[order]
    depth = np.zeros(len(x) + 1, np.int8)
    joined = np.ones(max(len(x) - 1, 0), bool)
    for name in "abc":
        joined = joined & (x[name][1:] == x[name][:-1])
        depth[1:-1] += joined
    deepest = np.maximum(depth[:-1], depth[1:]) == len("abc")
    out = np.ones(len(x), bool)
    out[order] = ~deepest
    return out


def build_trees(parts: DataFrame) -> DataFrame:
    """(node, size, place) of windows that are unique after all, from a task's parts (anchors are whole in a task)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        whole = pa.Table.from_batches(held).combine_chunks()
        windows = np.frombuffer(b"".join(whole["windows"].to_pylist()), _BLOCK_TYPE)
        n = np.asarray(pa.compute.binary_length(whole["windows"])) // _BLOCK_TYPE.itemsize
        row = np.repeat(np.arange(len(n)), n)
        place = whole["place"].to_numpy()[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        alone = shallow_leaves(windows)
        row, place = row[alone], place[alone]
        yield pa.RecordBatch.from_arrays([pa.array(whole["node"].to_numpy()[row]), pa.array(whole["size"].to_numpy()[row]), pa.array(place.astype(np.int32))], names=["node", "size", "place"])

    return parts.mapInArrow(released(build), "node long, size int, place int")


def spread_windows(parts: DataFrame) -> DataFrame:
    """(a, bc, node, size, place): a row per window of the hot anchors."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows = np.frombuffer(b"".join(batch.column(4).to_pylist()), _BLOCK_TYPE)
            n = np.asarray(pa.compute.binary_length(batch.column(4))) // _BLOCK_TYPE.itemsize
            row = pa.array(np.repeat(np.arange(len(n)), n))
            place = np.asarray(batch.column(3))[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            bc = windows["b"].astype(np.int64) << 32 | windows["c"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(windows["a"].astype(np.int64)), pa.array(bc), batch.column(1).take(row), batch.column(2).take(row), pa.array(place.astype(np.int32))],
                names=["a", "bc", "node", "size", "place"],
            )

    return parts.select("anchor", "node", "size", "place", "windows").mapInArrow(released(make), "a long, bc long, node long, size int, place int")


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, blocks: tuple[int, ...] = BLOCKS, most: int = MOST, text_column: str = "text"
) -> DataFrame:
    """``docs`` with n_words, n_removed and kept_text (the words that stay, joined by a space) in place of columns of these names."""
    small_batches(docs.sparkSession)
    if sum(blocks) != window or not 0 < anchor < window:
        raise ValueError("blocks must add up to the window, and the anchor be shorter")
    docs = docs.select(*quoted([c for c in docs.columns if c.lower() not in ("n_words", "n_removed", "kept_text")]))
    node, plan_node, plan_places, plan_strikes = (free_name(x, docs.columns) for x in ("node", "plan_node", "plan_places", "plan_strikes"))
    keyed = docs.withColumn(node, F.xxhash64(text_column))
    texts = keyed.select(F.col(node).alias("node"), F.col(text_column).alias("text"))
    anchors = anchors_of(texts, window, anchor)
    repeated = cut(anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    total = repeated.agg(F.sum("n")).first()[0] or 0
    spots = anchors.join(repeated.select("anchor", (F.col("n") > most).alias("hot")), "anchor")
    lists = cut(
        spots.groupBy("node").agg(F.collect_set("place").alias("places"), F.collect_set(F.when(F.col("hot"), F.col("place"))).alias("hot_places"))
    )
    marked = texts.join(lists, "node").select("node", "text", "places", "hot_places")
    found = suffixes(marked, window, anchor, blocks)
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // ANCHORS_A_TASK))
    unique = build_trees(found.filter("not hot").repartition(tasks, "anchor"))
    if not repeated.filter(F.col("n") > most).isEmpty():
        spread = spread_windows(found.filter("hot"))
        alone = spread.groupBy("a", "bc").agg(F.count(F.lit(1)).alias("n"), *(F.min(c).alias(c) for c in ("node", "size", "place"))).filter("n = 1")
        unique = unique.union(alone.select("node", "size", "place"))
    strikes = unique.groupBy("node").agg(F.collect_set("place").alias("strikes"))
    plan = cut(lists.select("node", "places").join(strikes, "node", "left")).select(F.col("node").alias(plan_node), F.col("places").alias(plan_places), F.col("strikes").alias(plan_strikes))
    joined = keyed.join(plan, F.col(node) == F.col(plan_node), "left").drop(plan_node, node)
    return cut_words(joined, docs, window, anchor, text_column)


def cut_words(joined: DataFrame, docs: DataFrame, window: int, anchor: int, text_column: str) -> DataFrame:
    """The last step: ``joined`` is ``docs`` with each text's anchor places and struck-out windows."""
    names = docs.columns
    width, text_at = len(names), names.index(text_column)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in slices(batch, f"c{text_at}"):
                places = [np.asarray(p, np.int64) if p else None for p in part.column(width).to_pylist()]
                removed = np.zeros(len(words.starts), bool)
                if any(p is not None for p in places):
                    at = candidate_windows(words, places, window, anchor)[0]
                    repeat = np.zeros(len(removed), bool)
                    repeat[at] = True
                    for first, strikes in zip(words.first, part.column(width + 1).to_pylist(), strict=False):
                        if strikes:
                            repeat[first + np.asarray(strikes, np.int64)] = False
                    at = np.flatnonzero(repeat)
                    edge = np.zeros(len(removed) + 1, np.int64)
                    edge[at] += 1
                    edge[at + window] -= 1
                    removed = np.cumsum(edge[:-1]) > 0
                n_removed = np.bincount(words.doc[removed], minlength=part.num_rows)
                kept = []
                for i, text in enumerate(part.column(text_at).to_pylist()):
                    found = (text or "").encode().split()
                    if n_removed[i]:
                        found = [w for w, gone in zip(found, removed[words.first[i] : words.first[i + 1]].tolist(), strict=True) if not gone]
                    kept.append(b" ".join(found).decode())
                columns = [*part.columns[:width], pa.array(words.counts.astype(np.int64)), pa.array(n_removed.astype(np.int64)), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "n_words", "n_removed", "kept_text"])

    schema = docs.limit(0).withColumns({"n_words": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long"), "kept_text": F.lit("")}).schema
    return by_place(joined).mapInArrow(released(make), schema)
