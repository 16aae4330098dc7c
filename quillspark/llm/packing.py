"""Packing documents into sequences by best-fit decreasing.

Documents are tokenised where they are read and packed in groups of up to
``group_docs`` documents or ``group_tokens`` tokens, so nothing is shuffled and
a task holds one group. Documents longer than a window are first cut into full
windows. The pieces that are left are placed longest first, each into the open
sequence with the least room that still holds it; a segment tree over room
finds it. A task that is run again makes the same sequences.

A document is its tokens and an end token, so null and empty texts are one
token. Repeated rows are packed each on its own. Columns other than id and text
are not read. An empty table gives no pieces.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillspark.llm._tables import small_batches
from quillspark.llm._words import Words, released, row_slices

WINDOW = 4096
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
#: How the tokenizer cuts texts, after lower-casing: a fixed value of its file. Other tokenizers get whole texts.
SPLITS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Pieces that a worker remembers, before it begins anew; slots of its table, a power of two.
PIECES_KEPT, SLOT_BITS = 1_500_000, 18

_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[32, 9, 10, 11, 12, 13]] = _SPACE
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[48:58] = _DIGIT
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words with these bytes aren't cut here: contractions, special tokens, and what isn't ASCII.
_ODD = np.arange(256) >= 128
_ODD[[ord("'"), ord("<")]] = True
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)


class CapacityTree:
    """Which rooms from 0 to ``size`` have an open sequence; finds the least that is large enough."""

    def __init__(self, size: int):
        self.base = 1 << size.bit_length()
        self.any = bytearray(2 * self.base)
        self.open: dict[int, list[int]] = {}

    def add(self, room: int, sequence: int) -> None:
        self.open.setdefault(room, []).append(sequence)
        at = self.base + room
        while at and not self.any[at]:
            self.any[at] = 1
            at >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """Remove and return (room, sequence) with the least room of at least ``length``."""
        at = self.base + length
        if not self.any[at]:
            while at & 1 or not self.any[at + 1]:
                at >>= 1
                if at <= 1:
                    return None
            at += 1
            while at < self.base:
                at = 2 * at + (not self.any[2 * at])
        room = at - self.base
        sequence = self.open[room].pop()
        if not self.open[room]:
            self.any[at] = 0
            at >>= 1
            while at and not (self.any[2 * at] or self.any[2 * at + 1]):
                self.any[at] = 0
                at >>= 1
        return room, sequence


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece; no piece is longer than the window."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, made = CapacityTree(window), 0
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        room, at = tree.take(n) or (window, made)
        made += at == made
        sequence[i], offset[i] = at, window - room
        if room > n:
            tree.add(room - n, at)
    return sequence, offset


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def text_pieces(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts and ends of pieces, first piece of each text): what the tokenizer encodes each on its own.

    It drops white space, lower-cases, and tells letters, single digits and
    other characters apart. Words that need more than ASCII to be cut stay whole.
    """
    words = Words(texts)
    buf, kind = words.buf, _KIND[words.buf]
    begins = np.zeros(len(buf) + 1, bool)
    begins[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    begins[words.starts] = True
    odd = np.zeros(len(buf) + 1, np.int32)
    np.cumsum(_ODD[buf], out=odd[1:])
    whole = np.flatnonzero(odd[words.ends] > odd[words.starts])
    inside = np.zeros(len(buf) + 1, np.int8)
    inside[words.starts[whole]] += 1
    inside[words.ends[whole]] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
    low = np.where(inside, buf, _LOWER[buf])
    inside[words.starts[whole]] = False
    begins[:-1] &= ~inside & (kind != _SPACE)
    starts = np.flatnonzero(begins[:-1])
    # a piece ends where the next begins, or where its word ends
    ends = np.append(starts[1:], len(buf))
    if len(starts):
        ends = np.minimum(ends, words.ends[np.searchsorted(words.starts, starts, "right") - 1])
    return low, starts, ends, np.searchsorted(starts, words.offsets)


class PieceEncoder:
    """Token ids of pieces, remembered in a hash table that is looked up for many at once.

    Keys are a piece's length and first 16 bytes, so a hit is the same piece;
    longer pieces are kept in a dictionary. After PIECES_KEPT pieces the table
    begins anew; one that fills up within a call doubles.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.cuts = json.dumps(SPLITS) in self.tokenizer.to_str()
        self.clear()

    def clear(self) -> None:
        self.make_slots(SLOT_BITS)
        self.begin, self.count, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.long: dict[bytes, int] = {}

    def make_slots(self, bits: int) -> None:
        self.bits = bits
        self.key = np.zeros((2, 1 << bits), np.uint64)
        self.size, self.slot = np.zeros(1 << bits, np.uint8), np.full(1 << bits, -1, np.int32)

    def make_room(self, more: int) -> bool:
        """Double the table until it is at most half full with ``more`` entries; whether it has grown."""
        bits = self.bits
        while 2 * (len(self.count) + more) > 1 << bits:
            bits += 1
        if bits == self.bits:
            return False
        used = np.flatnonzero(self.slot >= 0)
        (a, b), size, entry = self.key[:, used], self.size[used], self.slot[used]
        self.make_slots(bits)
        self.place(a, b, self.slots_of(a, b, size), size, entry)
        return True

    def slots_of(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F) + size.astype(np.uint64)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def keys(self, low: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and next 8 bytes of pieces of 16 bytes at most."""
        padded = np.concatenate([low, np.zeros(24, np.uint8)])
        eight = np.ndarray((len(low) + 16,), "<u8", padded, strides=(1,))
        a = eight[starts] & _FIRST_BYTES[np.minimum(size, 8)]
        b = eight[starts + 8] & _FIRST_BYTES[np.clip(size - 8, 0, 8)]
        return a, b

    def find(self, a: np.ndarray, b: np.ndarray, slot: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The entry of each key; -1 for unknown ones."""
        slot = slot.copy()
        entry = self.slot[slot]
        same = (entry >= 0) & (self.key[0, slot] == a) & (self.key[1, slot] == b) & (self.size[slot] == size)
        out = np.where(same, entry, -1)
        left = np.flatnonzero(~same & (entry >= 0))
        while len(left):
            at = (slot[left] + 1) & ((1 << self.bits) - 1)
            slot[left] = at
            entry = self.slot[at]
            same = (entry >= 0) & (self.key[0, at] == a[left]) & (self.key[1, at] == b[left]) & (self.size[at] == size[left])
            out[left[same]] = entry[same]
            left = left[~same & (entry >= 0)]
        return out

    def place(self, a: np.ndarray, b: np.ndarray, slot: np.ndarray, size: np.ndarray, entry: np.ndarray) -> None:
        """Enter different new keys."""
        left = np.arange(len(a))
        while len(left):
            at = slot[left]
            free = self.slot[at] < 0
            self.slot[at[free]] = entry[left[free]]
            won = free & (self.slot[at] == entry[left])
            self.key[0, at[won]], self.key[1, at[won]], self.size[at[won]] = a[left[won]], b[left[won]], size[left[won]]
            left, at = left[~won], at[~won]
            slot[left] = (at + 1) & ((1 << self.bits) - 1)

    def remember(self, pieces: list[bytes]) -> np.ndarray:
        """Encode new pieces; their entries."""
        first = len(self.count)
        made = [e.ids for low in range(0, len(pieces), 20_000) for e in self.tokenizer.encode_batch_fast([p.decode() for p in pieces[low : low + 20_000]], add_special_tokens=False)]
        self.count = np.concatenate([self.count, np.fromiter(map(len, made), np.int64, len(made))])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(made), np.uint32)])
        self.begin = np.cumsum(self.count) - self.count
        return np.arange(first, len(self.count))

    def entries(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = ends - starts
        out = np.full(len(starts), -1, np.int64)
        short = np.flatnonzero(size <= 16)
        a, b = self.keys(low, starts[short], size[short])
        n = size[short].astype(np.uint8)
        slot = self.slots_of(a, b, n)
        out[short] = self.find(a, b, slot, n)
        while len(missing := np.flatnonzero(out[short] < 0)):
            # of pieces with the same hash one is entered at a time, so that none is taken for another
            new = missing[np.unique(a[missing] * np.uint64(31) + b[missing] + n[missing], return_index=True)[1]]
            if self.make_room(len(new)):
                slot = self.slots_of(a, b, n)
            entry = self.remember([low[s:e].tobytes() for s, e in zip(starts[short[new]], ends[short[new]], strict=True)])
            self.place(a[new], b[new], slot[new], n[new], entry)
            out[short[missing]] = self.find(a[missing], b[missing], slot[missing], n[missing])
        far = np.flatnonzero(size > 16)
        if len(far):
            pieces = [low[s:e].tobytes() for s, e in zip(starts[far], ends[far], strict=True)]
            new = [p for p in dict.fromkeys(pieces) if p not in self.long]
            self.long.update(zip(new, self.remember(new).tolist(), strict=True))
            out[far] = [self.long[p] for p in pieces]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(token ids of all texts, one after the other; how many each text has)."""
        if not self.cuts:
            made = [self.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts.to_pylist()]
            return np.fromiter(chain.from_iterable(made), np.uint32), np.array([len(m) for m in made], np.int64)
        if len(self.count) > PIECES_KEPT:
            self.clear()
        low, starts, ends, first = text_pieces(texts)
        entry = self.entries(low, starts, ends)
        n = self.count[entry]
        upto = np.concatenate(([0], np.cumsum(n)))
        at = np.repeat(self.begin[entry] - upto[:-1], n) + np.arange(upto[-1])
        return self.ids[at], np.diff(upto[first])


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str | None = None,
    window: int = WINDOW,
    end_id: int = END_ID,
    group_docs: int = 8192,
    group_tokens: int = 6_000_000,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """A row per piece: id, start, length, ids (binary: little-endian 32-bit), doc_tokens, sequence_id, offset.

    ``tokenizer_path`` defaults to the public word BPE of the tokenizers folder.
    """
    small_batches(docs.sparkSession)
    schema = f"`{id_column}` {docs.schema[id_column].dataType.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

    def group_out(ids: list[pa.Array], tokens: list[np.ndarray], totals: list[np.ndarray], first: int) -> tuple[pa.RecordBatch, int]:
        total, stream = np.concatenate(totals), np.concatenate(tokens)
        pieces = np.maximum(-(-total // window), 1)
        doc = np.repeat(np.arange(len(total)), pieces)
        start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
        length = np.minimum(total[doc] - start, window)
        sequence, offset = best_fit_decreasing(length, window)
        # pieces follow one another in the stream
        at = np.concatenate(([0], 4 * np.cumsum(length))).astype(np.int32)
        chunks = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(at), pa.py_buffer(stream.astype("<u4"))])
        columns = [pa.chunked_array(ids).combine_chunks().take(pa.array(doc)), start, length, chunks, total[doc], first + sequence, offset]
        names = [id_column, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=names), first + int(sequence.max(initial=-1)) + 1

    def with_end(ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = np.full(len(ids) + len(n), end_id, np.uint32)
        own = np.ones(len(out), bool)
        own[np.cumsum(n + 1) - 1] = False
        out[own] = ids
        return out

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        path = tokenizer_path
        if path is None:
            import public_tokenizers

            path = str(public_tokenizers.path(TOKENIZER))
        encoder = PieceEncoder(path)  # a task's own: an idle worker holds no table
        first = TaskContext.get().partitionId() << 36
        ids, tokens, totals, held, size = [], [], [], 0, 0
        for batch in batches:
            for part in row_slices(batch, 1, group_docs):
                found, n = encoder.encode(part.column(1))
                ids.append(part.column(0))
                tokens.append(with_end(found, n))
                totals.append(n + 1)
                held, size = held + len(n), size + len(tokens[-1])
                if held >= group_docs or size >= group_tokens:
                    out, first = group_out(ids, tokens, totals, first)
                    yield out
                    ids, tokens, totals, held, size = [], [], [], 0, 0
        if held:
            yield group_out(ids, tokens, totals, first)[0]

    return docs.select(id_column, text_column).mapInArrow(released(pack), schema)
