"""Indel similarity of strings, as Arrow functions, and exact bounds that prune pairs before them.

ratio = 200 * LCS / (len a + len b); token-sort ratio compares the sorted
tokens; partial ratio is the best ratio of the shorter string with a window of
the longer. The longest common subsequence is bit-parallel: a pair on Python
integers, a batch of pairs on arrays of 64-bit words, a step of all pairs at a time.
"""

from __future__ import annotations

import os.path
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    if not a or not b:
        return 0
    if len(a) > len(b):
        a, b = b, a
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    rows = full
    for c in b:
        hit = rows & masks.get(c, 0)
        rows = (rows + hit) | (rows - hit)
    return len(a) - (rows & full).bit_count()


#: Cells of the table of character masks that are held at once, and pairs that are compared at once.
MASK_CELLS, PAIRS = 1 << 21, 1 << 15


def lcs_of_pairs(a: list[str], b: list[str], ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
    """``lcs_length`` of a[i] and b[j] for each pair (i, j) of ``ia`` and ``ib``."""
    out = np.zeros(len(ia), np.int64)
    if not len(ia):
        return out
    alphabet = {c: i for i, c in enumerate(sorted(set().union(*a)))}
    words = max(1, -(-max(map(len, a)) // 64))
    size = np.array([len(x) for x in b])
    # the last code stands for characters that no string of ``a`` has
    codes = np.full((max(1, size.max()), len(b)), len(alphabet), np.int64)
    for j, x in enumerate(b):
        codes[: len(x), j] = [alphabet.get(c, len(alphabet)) for c in x]
    step = max(1, MASK_CELLS // (words * (len(alphabet) + 1)))
    for first in range(0, len(a), step):
        masks = np.zeros((words, min(step, len(a) - first), len(alphabet) + 1), np.uint64)
        for i, x in enumerate(a[first : first + step]):
            for at, c in enumerate(x):
                masks[at // 64, i, alphabet[c]] |= np.uint64(1 << at % 64)
        own = np.flatnonzero((ia >= first) & (ia < first + step))
        own = own[np.argsort(size[ib[own]], kind="stable")]
        for low in range(0, len(own), PAIRS):
            some = own[low : low + PAIRS]
            out[some] = _lcs(masks, ia[some] - first, codes[: size[ib[some]].max(initial=0)], ib[some])
    return out


def _lcs(masks: np.ndarray, ia: np.ndarray, codes: np.ndarray, ib: np.ndarray) -> np.ndarray:
    words = len(masks)
    rows = np.full((words, len(ia)), np.uint64((1 << 64) - 1))
    for step in codes:
        c = step[ib]
        carry = None
        for w in range(words):
            r = rows[w]
            hit = r & masks[w, ia, c]
            with np.errstate(over="ignore"):
                total = r + hit
                over = total < r if w + 1 < words else None
                if carry is not None:
                    total += carry
                    over = over | (total < carry) if w + 1 < words else None
            rows[w] = total | (r ^ hit)
            carry = over.astype(np.uint64) if over is not None else None
    return np.bitwise_count(~rows).sum(0).astype(np.int64)


#: Strings that a step serves at once, and cells of a table of ratios.
ABREAST, TABLE_CELLS = 1 << 14, 1 << 18


class Compared:
    """Strings made ready to be compared with all of many others: their bits lie side by side, so that a step serves them all."""

    def __init__(self, strings: list[str]):
        self.sizes = np.array([len(x) for x in strings], np.int64)
        words = np.maximum(1, -(-self.sizes // 64))
        if self.sizes.max(initial=0) <= 32:
            words[:] = 0  # half a word
        self.parts: list[tuple[np.ndarray, dict[str, np.ndarray]]] = []
        for w in np.unique(words).tolist():
            of_width, kind = np.flatnonzero(words == w), np.uint64 if w else np.uint32
            for own in np.array_split(of_width, -(-len(of_width) // max(1, ABREAST // max(1, w)))):
                masks: dict[str, np.ndarray] = {}
                for k, i in enumerate(own.tolist()):
                    for at, c in enumerate(strings[i]):
                        if c not in masks:
                            masks[c] = np.zeros((max(1, w), len(own)), kind)
                        masks[c][at // 64, k] |= kind(1 << at % 64)
                self.parts.append((own, masks))

    def ratios(self, others: list[str]) -> np.ndarray:
        """``ratio`` of each of ``others`` (rows) with each string (columns)."""
        out = np.empty((len(others), len(self.sizes)))
        order, first = sorted(range(len(others)), key=others.__getitem__), 0
        for own, masks in self.parts:
            some = next(iter(masks.values()), np.zeros((1, len(own)), np.uint32))
            none, sizes = np.zeros_like(some), self.sizes[own].astype(float)
            hit, states, last, columns = np.empty_like(some[0]), [~none], "", slice(first, first + len(own))
            for i in order:
                text = others[i]
                # what begins as the one before goes on from there
                for at in range(len(os.path.commonprefix([last, text])), len(text)):
                    if at + 1 == len(states):
                        states.append(np.empty_like(some))
                    _lcs_step(states[at], masks.get(text[at], none), hit, states[at + 1])
                last, row = text, out[i, columns]
                shared = [np.bitwise_count(np.invert(w, out=hit)) for w in states[len(text)]]
                np.multiply(shared[0] if len(shared) == 1 else sum(x.astype(np.int64) for x in shared), 200.0, out=row)
                np.divide(row, sizes + len(text) if text else np.maximum(sizes, 1), out=row)
                if not text:
                    row[sizes == 0] = 100.0
            first = columns.stop
        return out[:, np.argsort(np.concatenate([own for own, _ in self.parts]))] if len(self.parts) > 1 else out

    def tables(self, others: list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
        """(places in ``others``, their ``ratios``), so many at a time, those that begin alike together."""
        order, rows = sorted(range(len(others)), key=others.__getitem__), max(1, TABLE_CELLS // max(1, len(self.sizes)))
        for first in range(0, len(order), rows):
            some = order[first : first + rows]
            yield some, self.ratios([others[i] for i in some])


def _lcs_step(rows: np.ndarray, mask: np.ndarray, hit: np.ndarray, out: np.ndarray) -> None:
    carry = None
    for w, r in enumerate(rows):
        np.bitwise_and(r, mask[w], out=hit)
        total = np.add(r, hit, out=out[w])
        if len(rows) > 1:
            over = total < r
            if carry is not None:
                np.add(total, carry, out=total)
                over |= total < carry
            carry = over.astype(rows.dtype)
        np.bitwise_xor(r, hit, out=hit)
        np.bitwise_or(total, hit, out=total)


def lcs_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """``lcs_length`` of each pair."""
    (ia, one), (ib, other) = pd.factorize(pd.Series(a, dtype=object)), pd.factorize(pd.Series(b, dtype=object))
    return lcs_of_pairs(one.tolist(), other.tolist(), ia, ib)


def ratios(a: list[str | None], b: list[str | None]) -> np.ndarray:
    """``ratio`` of each pair."""
    known = np.array([x is not None and y is not None for x, y in zip(a, b, strict=True)], bool)
    x, y = [s or "" for s in a], [s or "" for s in b]
    total = np.array([len(p) + len(q) for p, q in zip(x, y, strict=True)])
    out = np.where(total > 0, 200.0 * lcs_lengths(x, y) / np.maximum(total, 1), 100.0)
    return np.where(known, out, 0.0)


def ratio(a: str | None, b: str | None) -> float:
    if a is None or b is None:
        return 0.0
    if not a and not b:
        return 100.0
    return 200.0 * lcs_length(a, b) / (len(a) + len(b))


def sorted_tokens(text: str | None) -> str | None:
    return None if text is None else " ".join(sorted(text.split()))


def token_sort_ratio(a: str | None, b: str | None) -> float:
    return ratio(sorted_tokens(a), sorted_tokens(b))


#: Cells of the table of a query's characters in a text that are held at once.
PLACE_CELLS = 1 << 20


def best_window(query: str, text: str, cut: bool = False, least: float = 0.0) -> tuple[float, int, int]:
    """(ratio, start, end) of the window of the query's length in the text that is most like it, the first of equals; with ``cut``, windows that hang over the ends count too.

    Windows that can't be as alike as ``least`` are not compared.
    """
    n = len(query)
    if not n or not text:
        return 0.0, 0, 0
    at = text.find(query)
    if at >= 0:
        return 100.0, at, at + n
    # the characters that a window shares with the query, order aside, bound the common subsequence: likeliest windows first
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.arange(1 - n, len(text)) if cut else np.arange(max(1, len(text) - n + 1))
    lows, highs = np.maximum(starts, 0), np.minimum(starts + n, len(text))
    shared = np.zeros(len(starts), np.int64)
    chars, counts = np.unique(np.frombuffer(query.encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)
    step = max(1, PLACE_CELLS // (len(text) + 1))
    for first in range(0, len(chars), step):
        some = chars[first : first + step, None]
        upto = np.zeros((len(some), len(text) + 1), np.int64)
        np.cumsum(codes == some, axis=1, out=upto[:, 1:])
        shared += np.minimum(upto[:, highs] - upto[:, lows], counts[first : first + step, None]).sum(0)
    bounds = 200.0 * shared / (n + highs - lows)
    best, at = (0.0, 0, 0), len(starts)
    for i in np.argsort(-bounds, kind="stable").tolist():
        if bounds[i] < max(best[0], least) or not bounds[i]:
            break
        if bounds[i] > best[0] or i < at:
            low, high = int(lows[i]), int(highs[i])
            r = ratio(query, text[low:high])
            if r > best[0] or r == best[0] and i < at:
                best, at = (r, low, high), i
    return best


def partial_ratio(a: str | None, b: str | None, least: float = 0.0) -> float:
    """The best ratio of the shorter string with a window of the longer; below ``least`` it may come out lower."""
    if a is None or b is None:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    return (100.0 if not a and not b else 0.0) if not a else best_window(a, b, cut=True, least=least)[0]


def _by_pair(function, a: pd.Series, b: pd.Series) -> list:
    """The function's result for each pair; equal pairs are compared once."""
    known: dict = {}
    return [known[p] if p in known else known.setdefault(p, function(*p)) for p in zip(a, b, strict=True)]


def partial(a: Column, b: Column, least: float = 0.0) -> Column:
    """``partial_ratio``; below ``least`` it may come out lower."""
    return F.pandas_udf(lambda x, y: pd.Series(_by_pair(lambda p, q: partial_ratio(p, q, least), x, y), dtype="float64"), "double")(a, b)


def window_match(query: Column, text: Column) -> Column:
    """struct<similarity (0 to 1), start, end> of the best window."""

    def match(queries: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = _by_pair(lambda q, t: best_window(q or "", t or ""), queries, texts)
        return pd.DataFrame([(r / 100, s, e) for r, s, e in rows], columns=["similarity", "start", "end"])

    return F.pandas_udf(match, "similarity double, start int, end int")(query, text)


#: Steps of the coarse window search, and how much longer than the quote its windows are.
STEP, LONGER = 50, 20


def validate_quote(quote: str, source: str, least: float) -> tuple[bool, float, str | None]:
    """(found, similarity, best match) of a quote in a text, white space squeezed in both.

    A quote is found by its partial ratio; the match is then the likest window of its length at every STEP-th place.
    Else windows LONGER than the quote decide, at the same places.
    """
    q, s = " ".join(quote.split()), " ".join(source.split())
    part = partial_ratio(q.lower(), s.lower()) / 100
    found, more = part >= least, 0 if part >= least else LONGER
    if len(q) >= len(s):
        windows = [s]
    else:
        windows = [s[i : i + len(q) + more] for i in range(0, len(s) - len(q) + 1, STEP)]
    scores = ratios([q.lower()] * len(windows), [w.lower() for w in windows])
    best = int(scores.argmax())
    if found:
        return True, part, windows[best] if scores[best] > 0 else windows[0]
    likeness = float(scores[best]) / 100
    return likeness >= least, likeness, windows[best] if likeness >= least else None


def quote_validation(quote: Column, text: Column, least: float) -> Column:
    """struct<found, similarity, best_match>; blank quotes and empty texts find nothing."""

    def check(quotes: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = [validate_quote(q, t, least) if q and q.strip() and t else (False, 0.0, None) for q, t in zip(quotes, texts, strict=True)]
        return pd.DataFrame(rows, columns=["found", "similarity", "best_match"])

    return F.pandas_udf(check, "found boolean, similarity double, best_match string")(quote, text)
