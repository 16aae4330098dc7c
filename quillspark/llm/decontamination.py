"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts are lower-cased (A-Z) and reduced to their words, runs of ASCII letters,
digits and any character beyond ASCII, with one space around each. The test
strings are the windows of ``window`` words of the benchmark's items; an item
of fewer words is one window. They are searched for as bytes: a shift table
over blocks of bytes says how far the search can jump at the end of a window,
and where it can't, a bucket chosen by a hash of the last bytes names the test
strings that may end their prefix there, which are then compared byte by byte.
Test strings of like length are searched for together, since the shortest sets
the length of all jumps. A slice of texts is searched in many places at once.

The benchmark may be of any size: its windows are dealt into parts of bounded
size by hash, each broadcast by itself, and every batch of documents meets all
parts within its task. Documents are never shuffled.

Null and empty texts have no words and no hits. Items without words are never
found. An item is its id: rows that share one are one item, and those of null
ids are one item, written as an empty string. Repeated documents get equal
results. Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._tables import cut
from quillspark.llm._words import mix64, row_slices

WINDOW = 10
#: Bytes of windows and ids in a part, about; a part is what the driver holds and broadcasts at a time.
PART_BYTES = 16 << 20
_SLICE, _LANE, _CELLS = 1 << 20, 512, 1 << 21
_WORDY = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
_CLEAN = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _WORDY else 0x20 for b in range(256))
_SPACE, _END = 0x20, 0x0A


def item_windows(benchmark: DataFrame, window: int, id_column: str, text_column: str) -> DataFrame:
    """item, pattern: the distinct windows of each item, with a space before and after."""
    low = F.translate(text_column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(low, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"))
    item = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    items = benchmark.select(item.alias("item"), words.alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    spans = F.transform(starts, lambda i: F.concat(F.lit(" "), F.array_join(F.slice("words", i, window), " "), F.lit(" ")))
    return items.select("item", F.explode(spans).alias("pattern")).distinct()


class Searcher:
    """Wu-Manber tables of test strings whose lengths lie between two powers of two."""

    def __init__(self, patterns: list[bytes], numbers: list[int]):
        self.patterns, self.numbers = patterns, np.array(numbers)
        self.lengths = np.array([len(p) for p in patterns])
        self.m = m = int(self.lengths.min())
        flat = np.frombuffer(b"".join(patterns), np.uint8)
        # many test strings have most short blocks among them, which would stop every jump
        self.block = 2 if m < 12 else 4 if m < 24 or len(flat) < 1 << 16 else 8
        self.suffix = min(m, 16)
        self.flat, self.begins = flat, np.cumsum(self.lengths) - self.lengths
        self.bits = min(max(len(flat).bit_length() + 2, 12), 22)
        self.shift = np.full(1 << self.bits, m - self.block + 1, np.int16)
        for end in range(self.block, m + 1):  # later blocks allow shorter jumps and overwrite earlier ones
            self.shift[self.blocks(flat, self.begins + end - 1)] = m - end
        keys = self.suffixes(flat, self.begins + m - 1)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def blocks(self, buf: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Table entry of the block of bytes that ends at each place."""
        h = np.zeros(len(last), np.uint64)
        for k in range(self.block):
            h = (h << np.uint64(8)) | buf[last - k]
        return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def suffixes(self, buf: np.ndarray, last: np.ndarray) -> np.ndarray:
        h = np.zeros(len(last), np.uint64)
        for k in range(self.suffix):
            h = mix64(h ^ buf[last - k].astype(np.uint64)) if k % 8 == 7 else (h << np.uint64(8)) ^ buf[last - k].astype(np.uint64)
        return mix64(h)

    def stops(self, buf: np.ndarray) -> np.ndarray:
        """Places where the shift is 0; lanes of the buffer advance together, each by its own shift."""
        first = np.arange(self.m - 1, len(buf), _LANE)
        at, until = first.copy(), np.minimum(first + _LANE, len(buf))
        found = []
        while len(at):
            step = self.shift[self.blocks(buf, at)]
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            on = at < until
            at, until = at[on], until[on]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def find(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte, length and number of each occurrence, compared byte by byte."""
        last = self.stops(buf)
        keys = self.suffixes(buf, last)
        low, high = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, side="right")
        last, low, n = last[high > low], low[high > low], (high - low)[high > low]
        out = []
        group = np.cumsum(n) // _CELLS
        for g in np.unique(group):
            w = group == g
            begin = np.repeat(last[w] - self.m + 1, n[w])
            rank = np.arange(n[w].sum()) - np.repeat(np.cumsum(n[w]) - n[w], n[w])
            pattern = self.order[np.repeat(low[w], n[w]) + rank]
            fits = begin + self.lengths[pattern] <= len(buf)
            begin, pattern = begin[fits], pattern[fits]
            for length in np.unique(self.lengths[pattern]):
                mine = np.flatnonzero(self.lengths[pattern] == length)
                for some in np.array_split(mine, 1 + len(mine) * int(length) // _CELLS):
                    across = np.arange(length)
                    same = (buf[begin[some, None] + across] == self.flat[self.begins[pattern[some], None] + across]).all(1)
                    out.append((begin[some][same], np.full(same.sum(), length), self.numbers[pattern[some][same]]))
        return tuple(np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out, strict=True) if out else ((), (), ())))


def searchers(patterns: list[str]) -> list[Searcher]:
    raw = [p.encode() for p in patterns]
    by: dict[int, list[int]] = {}
    for i, p in enumerate(raw):
        by.setdefault(len(p).bit_length(), []).append(i)
    return [Searcher([raw[i] for i in mine], mine) for _, mine in sorted(by.items())]


class Clean:
    """The words of a slice of texts as one buffer: a space around each word, texts apart by an end byte."""

    def __init__(self, texts: list[str | None]):
        joined = np.frombuffer(b" " + b" \n ".join((t or "").encode().translate(_CLEAN) for t in texts) + b" \n", np.uint8)
        space = joined == _SPACE
        keep = np.ones(len(joined), bool)
        keep[1:] = ~(space[1:] & space[:-1])
        self.buf = joined[keep]
        self.spaces = np.flatnonzero(self.buf == _SPACE)
        self.ends = np.flatnonzero(self.buf == _END)[: len(texts)]
        self.first = np.concatenate(([0], np.searchsorted(self.spaces, self.ends)[:-1])).astype(np.int64)
        self.counts = np.diff(np.append(self.first, np.searchsorted(self.spaces, self.ends[-1] if len(self.ends) else 0))) - 1 if len(texts) else np.zeros(0, np.int64)


def merged(first: np.ndarray, last: np.ndarray) -> list[dict[str, int]]:
    """Spans (both ends included) that cover the same words as the given ones."""
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    new = np.concatenate(([True], first[1:] > last[:-1] + 1))
    ends = np.append(np.flatnonzero(new)[1:], len(first)) - 1
    return [{"first": int(a), "last": int(b)} for a, b in zip(first[new], last[ends], strict=True)]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    part_bytes: int = PART_BYTES,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_id_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """id, n_words, n_hit (words within found windows), spans (of such words, from 0), items (ids found, as sorted strings)."""
    spark = docs.sparkSession
    pairs = cut(item_windows(benchmark, window, item_id_column, item_text_column))
    # a string takes about 80 bytes besides its own
    size = pairs.agg(F.sum(F.octet_length("pattern") + F.octet_length("item") + 160)).first()[0] or 0
    parts = -(-size // part_bytes)
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("pattern", "item"), F.lit(max(parts, 1))))
    sent = []
    for k in range(parts):
        by: dict[str, list[str]] = {}
        for r in dealt.filter(F.col("part") == k).select("pattern", "item").toLocalIterator():
            by.setdefault(r.pattern, []).append(r.item)
        sent.append(spark.sparkContext.broadcast((list(by), list(by.values()))))
        del by
    kind = docs.schema[id_column].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = {}
        for batch in batches:
            n = batch.num_rows
            spans: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(n)]
            items: list[set[str]] = [set() for _ in range(n)]
            counts = np.zeros(n, np.int64)
            for k, part in enumerate(sent or [None]):
                if part is not None and k not in built:
                    built.clear()  # one part's tables at a time
                    patterns, owners = part.value
                    built[k] = searchers(patterns), owners
                    if len(sent) > 1:
                        vars(part).pop("_value", None)  # the loaded copy goes; the next use reads it from disk again
                tables, owners = built.get(k, ([], []))
                row = 0
                for some in row_slices(batch, 1, most=_SLICE):
                    clean = Clean(some.column(1).to_pylist())
                    counts[row : row + some.num_rows] = clean.counts
                    for table in tables:
                        begin, length, number = table.find(clean.buf)
                        doc = np.searchsorted(clean.ends, begin)
                        first = np.searchsorted(clean.spaces, begin)
                        last = np.searchsorted(clean.spaces, begin + length - 1) - 1
                        order = np.argsort(doc, kind="stable")
                        for mine in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1) if len(order) else []:
                            d = int(doc[mine[0]])
                            spans[row + d].append((first[mine] - clean.first[d], last[mine] - clean.first[d]))
                            for p in np.unique(number[mine]):
                                items[row + d].update(owners[p])
                    row += some.num_rows
            covered = [merged(*map(np.concatenate, zip(*s, strict=True))) if s else [] for s in spans]
            hit = [sum(s["last"] - s["first"] + 1 for s in x) for x in covered]
            span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts), pa.array(hit, pa.int64()), pa.array(covered, span), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                names=[id_column, "n_words", "n_hit", "spans", "items"],
            )

    schema = f"`{id_column}` {kind}, n_words long, n_hit long, spans array<struct<first:long,last:long>>, items array<string>"
    return docs.select(id_column, text_column).mapInArrow(search, schema)
