"""Words of many texts at once, as numpy arrays over Arrow buffers.

A word is a run of bytes other than space and U+0009..U+000D, which is the
regular expression ``[^\\x20\\x09-\\x0D]+`` on UTF-8. Texts never share words:
a boundary between two texts always ends a word.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are handled in slices of about this many bytes, so that the arrays
#: of one slice stay small whatever the Arrow batch holds.
SLICE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_rng = np.random.Generator(np.random.PCG64(7))
_BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE_VALUE_NO_SPACE = np.where(_SPACE, np.uint64(0), _BYTE_VALUE)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, element by element."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + SLICE_BYTES // 4)
        with np.errstate(over="ignore"):
            for i, b in enumerate((_BASE, _INVERSE)):
                steps = np.full(size, b, np.uint64)
                steps[0] = 1
                _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def released(make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``make``, after which the worker gives free memory back: workers wait idle beside those of the next stage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from make(batches)
        give_back()

    return run


def give_back() -> None:
    _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim is not None:
        trim(0)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of ``values[s:e]`` for each span; equal spans hash alike."""
    up, down = _power_tables(len(values) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=total[1:])
        return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Words:
    """The words of a slice of texts.

    ``buf`` the bytes, ``offsets`` where each text begins (one more than
    texts), ``starts``/``ends`` byte spans of words, ``doc`` the text of each
    word, ``first`` the index of each text's first word (one more than texts).
    ``space`` flags the bytes that are in no word; ``fold`` maps bytes beforehand.
    """

    def __init__(self, texts: pa.Array, space: np.ndarray = _SPACE, fold: np.ndarray | None = None):
        texts = pc.fill_null(texts, "").cast(pa.large_binary())
        buffers = texts.buffers()
        self.offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1].copy()
        low, high = (int(self.offsets[0]), int(self.offsets[-1])) if len(texts) else (0, 0)
        self.buf = np.frombuffer(buffers[2], np.uint8)[low:high] if high > low else np.zeros(0, np.uint8)
        self.offsets -= low
        if fold is not None:
            self.buf = fold[self.buf]
        space = space[self.buf]
        edge = np.zeros(len(self.buf) + 1, bool)
        edge[self.offsets] = True
        before = np.concatenate(([True], space[:-1])) if len(space) else space
        after = np.concatenate((space[1:], [True])) if len(space) else space
        self.starts = np.flatnonzero(~space & (before | edge[:-1]))
        self.ends = np.flatnonzero(~space & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)

    def hashes(self) -> np.ndarray:
        return span_hashes(_BYTE_VALUE_NO_SPACE[self.buf], self.starts, self.ends)

    def left(self) -> np.ndarray:
        """Words from each word to the end of its text, itself included."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.starts))


def row_slices(batch: pa.RecordBatch, column: int, most_rows: int = 1 << 20, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch, of about ``most`` text bytes and ``most_rows`` rows at most."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
    group = np.cumsum(sizes) // most
    cuts = np.flatnonzero(np.diff(group)) + 1
    for low, high in zip([0, *cuts], [*cuts, len(sizes)], strict=True):
        for at in range(low, high, most_rows):
            yield batch.slice(at, min(most_rows, high - at))


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES, most_rows: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Consecutive rows of a batch, of about ``most`` text bytes and ``most_rows`` rows at most, with their words."""
    at = batch.schema.get_field_index(column)
    for part in row_slices(batch, at, most_rows, most):
        yield part, Words(part.column(at))


def gram_hashes(hashes: np.ndarray, left: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words and the word that each begins at."""
    at = np.flatnonzero(left >= n)
    return span_hashes(hashes, at, at + n), at
