"""Toxicity: words are restored through a noisy channel, then scored.

Writers hide words by digits and symbols for letters, by letters spread out
and by letters repeated. Each suspicious token is a lattice of what its
characters may stand for; a Viterbi search under a trigram language model of
characters, counted over the whole corpus, restores it: the state is the pair
of last letters, so the best path is exact at any length. A term counts if the
best path with it as a word, found by walking the terms' trie between forward
and backward scores, comes near the best of all. In a run of single characters
words may end anywhere, in other tokens at separators only. Words that are
terms but for doubled letters are restored unless clean labelled rows have
them. Other plain words pass unchanged. Terms that tell toxic documents from others are learnt from a
bounded sample of labelled rows by logistic regression on restored words; a
document's score is the probability from the terms among its restored words.

Null and empty texts have no terms and get the base probability, as do texts
of other scripts without a learnt term. Equal texts get equal scores. Without
toxic labels every score is 0. An empty table gives an empty result. Very long
texts are read whole; each is handled on its own. Only id and text are read,
and columns of other names are carried along by ``add_toxicity``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm._tables import by_place, cut, labelled_sample, quoted, small_batches
from quillspark.llm._words import released, row_slices, slices

#: What a character may stand for besides itself.
STANDS_FOR = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
              "@": "a", "$": "s", "!": "i", "+": "t", "|": "il", "(": "c", "#": "h"}
SEPARATORS = frozenset(".-_*'~,:;/\\\"?)]}[{<>%&=^`")
EDGES = ".,;:!?\"'()[]{}<>*#$%&|-_~/\\=^`"
#: Log costs in the channel: another letter is meant, a separator is dropped, a symbol that may be a letter is dropped, a repeat is dropped.
SUBSTITUTE, DROP, DROP_SYMBOL, DROP_REPEAT = -1.0, -0.5, -3.0, -0.7
LETTERS = 28
#: Labelled rows at most, and the tokens a worker remembers.
LABELLED_ROWS, CACHE_TOKENS = 12_000, 100_000
#: Characters of a run or long token whose scores are held at once.
BLOCK = 4096
#: Share of the toxic rows that a term must be in, to be a term and to be a strong one; log odds of a strong one alone.
TERM_SHARE, STRONG_SHARE, STRONG_ODDS = 0.01, 0.03, 3.0

_CODE = np.zeros(256, np.int64)
_CODE[97:123] = _CODE[65:91] = np.arange(1, 27)
_CODE[0xC0:] = 27
_HEAD = np.ones(256, bool)
_HEAD[0x80:0xC0] = False
_SPREAD = re.compile(r"(?<!\S)\S\s+\S(?!\S)")
#: Characters of a spread run at least; a term counts if the best path with it as a word is no worse than the best path by this.
RUN, MARGIN = 3, 8.0
_FOUR = re.compile(r"(.)\1{3,}")
_RUN = re.compile(r"(.)\1+")
_REPEATED = re.compile(r"([^\W\d_])\1+")
_TRIPLE = re.compile(r"([^\W\d_])\1\1")


def character_counts(docs: DataFrame, text_column: str = "text") -> np.ndarray:
    """Trigram counts of letters (others are word ends) over all rows; LETTERS ** 3 numbers at most come from a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS**3, np.int64)
        for batch in batches:
            for _, words in slices(batch, text_column):
                heads = _HEAD[words.buf]
                code = _CODE[words.buf[heads]]
                code = np.concatenate(([0, 0], code, [0]))
                total += np.bincount((code[:-2] * LETTERS + code[1:-1]) * LETTERS + code[2:], minlength=LETTERS**3)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["gram", "n"])

    out = np.zeros(LETTERS**3)
    for gram, n in docs.select(text_column).mapInArrow(released(count), "gram long, n long").groupBy("gram").agg(F.sum("n")).collect():
        out[gram] = n
    return out.reshape(LETTERS, LETTERS, LETTERS)


class CharacterModel:
    """Interpolated trigram log probabilities."""

    def __init__(self, counts: np.ndarray):
        share = lambda x: (x + 0.01) / (x + 0.01).sum(-1, keepdims=True)
        p = 0.7 * share(counts) + 0.2 * share(counts.sum(0))[None] + 0.1 * share(counts.sum((0, 1)))[None, None]
        self.log = np.log(p).tolist()

    @staticmethod
    def code(c: str) -> int:
        return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0

    def ways(self, char: str, before: str) -> list[tuple[str, float]]:
        """What one character of a run may stand for."""
        if char.isalpha():
            return [(char, 0.0)] + [("", DROP_REPEAT)] * (char == before)
        drop = DROP_REPEAT if char == before else DROP_SYMBOL if char in STANDS_FOR or char.isdigit() else DROP
        return [(c, SUBSTITUTE) for c in STANDS_FOR.get(char, "")] + [("", drop)]

    def closings(self, states: dict, may_end: bool) -> Iterator[tuple[tuple[int, int], tuple[int, int], float]]:
        """(state, state after a word end, log cost) of states that are within a word."""
        return (((a, b), (b, 0), self.log[a][b][0]) for a, b in states if b and may_end)

    @staticmethod
    def may_end(run: str, at: int, spread: bool) -> bool:
        """Whether a word may end before place ``at``: everywhere if spread out, else beside what is no letter or digit."""
        return spread or at == len(run) or not (run[at].isalnum() and (at == 0 or run[at - 1].isalnum()))

    def after(self, run: str, at: int, states: dict, spread: bool) -> dict[tuple[int, int], tuple[float, tuple]]:
        """The best score and path to each pair of last codes after the character at a place, from those before it."""
        out: dict[tuple[int, int], tuple[float, tuple]] = {}
        ways = self.ways(run[at], run[at - 1] if at else "")
        for (a, b), (score, path) in states.items():
            for c, cost in ways:
                x, y = (b, self.code(c)) if c else (a, b)
                s = score + cost + (self.log[a][b][y] if c else 0.0)
                if (x, y) not in out or s > out[x, y][0]:
                    out[x, y] = s, (path, c) if c else path
        for state, ended, cost in list(self.closings(out, self.may_end(run, at + 1, spread))):
            s, path = out[state]
            if ended not in out or s + cost > out[ended][0]:
                out[ended] = s + cost, (path, " ")
        return out

    def forward(self, run: str, spread: bool, low: int, high: int, states: dict[tuple[int, int], float]) -> list[dict[tuple[int, int], float]]:
        """Of each place from ``low`` to ``high``, the best score to each pair of last codes, from those at ``low``."""
        places = [states]
        for at in range(low, high):
            before = {k: (s, ()) for k, s in places[-1].items()}
            places.append({k: s for k, (s, _) in self.after(run, at, before, spread).items()})
        return places

    def backward(self, run: str, spread: bool, low: int, places: list[dict], end: dict[tuple[int, int], float]) -> list[dict[tuple[int, int], float]]:
        """Of each place and state of ``places`` (those from ``low``), the best score of what follows, from those at the last place."""
        left: list[dict[tuple[int, int], float]] = [{} for _ in places]
        left[-1] = end
        for i in range(len(places) - 2, -1, -1):
            at = low + i
            ways = self.ways(run[at], run[at - 1] if at else "")
            here, then = left[i], left[i + 1]
            for a, b in places[i]:
                here[a, b] = max(cost + (self.log[a][b][self.code(c)] + then[b, self.code(c)] if c else then[a, b]) for c, cost in ways)
            for state, ended, cost in self.closings(here, at > 0 and self.may_end(run, at, spread)):
                here[state] = max(here[state], cost + here[ended])
        return left

    def segment(self, run: str, spread: bool = True) -> list[str]:
        """The words of the best path through a run; only the last states are held, and the letters of their paths."""
        states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for at in range(len(run)):
            states = self.after(run, at, states, spread)
        path = max(((s + (self.log[a][b][0] if b else 0.0), (a, b)) for (a, b), (s, _) in states.items()))[1]
        path, out = states[path][1], []
        while path:
            path, c = path
            out.append(c)
        return "".join(reversed(out)).split()

    def scored_blocks(self, run: str, spread: bool, block: int) -> Iterator[tuple[int, list[dict], list[dict]]]:
        """(first place, forward scores, backward scores) of a run's blocks in turn.

        A run of several blocks is gone through three times, with the scores at the blocks' borders kept, so that one
        block's scores are held at a time.
        """
        lows = list(range(0, max(len(run), 1), block))
        begins: list[dict[tuple[int, int], float]] = [{(0, 0): 0.0}]
        places: list[dict] = []
        for low in lows:
            places = self.forward(run, spread, low, min(low + block, len(run)), begins[-1])
            begins.append(places[-1])
        ends = [{(a, b): self.log[a][b][0] if b else 0.0 for a, b in begins[-1]}]
        if len(lows) == 1:
            yield 0, places, self.backward(run, spread, 0, places, ends[0])
            return
        for low, begin in zip(reversed(lows), reversed(begins[:-1]), strict=True):
            ends.append(self.backward(run, spread, low, self.forward(run, spread, low, min(low + block, len(run)), begin), ends[-1])[0])
        for low, begin, end in zip(lows, begins[:-1], reversed(ends[:-1]), strict=True):
            places = self.forward(run, spread, low, min(low + block, len(run)), begin)
            yield low, places, self.backward(run, spread, low, places, end)

    def terms_in(self, run: str, trie: dict, spread: bool = True, block: int = BLOCK) -> set[str]:
        """Terms that are words of some path within MARGIN of the best one, at any length of the run."""
        found: set[str] = set()
        least = None
        active: dict[tuple[int, int, int], tuple[float, dict]] = {}
        for low, places, left in self.scored_blocks(run, spread, block):
            if least is None:
                least = left[0][0, 0] - MARGIN
            for at in range(low, low + len(places) - 1):
                for (a, b), s in places[at - low].items():
                    if not b:  # a word may begin here
                        key = a, b, id(trie)
                        if key not in active or s > active[key][0]:
                            active[key] = s, trie
                after: dict[tuple[int, int, int], tuple[float, dict]] = {}
                for (a, b, _), (s, node) in active.items():
                    for c, cost in self.ways(run[at], run[at - 1] if at else ""):
                        to = node.get(c) if c else node
                        if to is not None and (c or node is not trie):
                            x, y = (b, self.code(c)) if c else (a, b)
                            total = s + cost + (self.log[a][b][y] if c else 0.0)
                            if (x, y, id(to)) not in after or total > after[x, y, id(to)][0]:
                                after[x, y, id(to)] = total, to
                then = left[at + 1 - low]
                active = {k: v for k, v in after.items() if v[0] + then[k[0], k[1]] >= least}
                if self.may_end(run, at + 1, spread):
                    for (a, b, _), (s, node) in active.items():
                        if "" in node and s + self.log[a][b][0] + then[b, 0] >= least:
                            found.add(node[""])
        return found


def trie_of(terms: Iterable[str]) -> dict:
    """Nested dicts by letter; "" holds the term that ends there."""
    trie: dict = {}
    for term in terms:
        node = trie
        for c in term:
            node = node.setdefault(c, {})
        node[""] = term
    return trie


def suspicious(token: str) -> bool:
    """Whether a (lower-cased) token needs restoring beyond taking punctuation off its ends."""
    core = token.strip(EDGES)
    if not core:
        return False
    if not core.isalpha():
        once = _RUN.sub(r"\1", core)
        return any(c.isalpha() for c in once) and sum(c.isdigit() for c in once) <= len(once) // 2 + 1
    if _TRIPLE.search(core):
        return True
    head, tail = token[: token.find(core)], token[token.find(core) + len(core) :]
    return any(x in STANDS_FOR for x in head) or (len(tail) == 1 and tail in STANDS_FOR and tail != "!")


def squeezed(run: str) -> str:
    """Without the fourth and later equal characters in a row, which tell no more than the third."""
    return _FOUR.sub(r"\1\1\1", run)


def spread_runs(text: str) -> list[str]:
    """Runs of RUN or more single characters between blanks of any length, punctuation at their sides taken off, joined."""
    if not _SPREAD.search(text):
        return []
    singles = (t if len(t) == 1 else core if len(core := t.strip(EDGES)) == 1 else "" for t in text.split())
    runs = ("".join(run) for single, run in groupby(singles, bool) if single)
    return [squeezed(r) for r in runs if len(r) >= RUN and sum(c.isalnum() or c in STANDS_FOR for c in r) >= RUN and any(c.isalpha() for c in r)]


def restored_words(text: str, model: CharacterModel, cache: dict[str, tuple[str, ...]]) -> set[str]:
    """The distinct words of a text after restoring, by the best path."""
    low = text.lower()
    out = set()
    for run in set(spread_runs(low)):
        out.update(w for w in model.segment(run) if w.isalpha())
    for token in set(low.split()):
        found = cache.get(token)
        if found is None:
            if suspicious(token):
                found = tuple(w for w in model.segment(squeezed(token), spread=False) if w.isalpha())
            else:
                core = token.strip(EDGES)
                found = (core,) if core.isalpha() else ()
            if len(cache) < CACHE_TOKENS:
                cache[token] = found
        out.update(found)
    return out


class TermFinder:
    """Which of a set of terms the restored words of a text hold: a path within MARGIN of the best counts.

    A word that is a term but for doubled letters is restored too, unless it is one of the ``known`` words.
    """

    def __init__(self, terms: Iterable[str], model: CharacterModel, known: Iterable[str] = ()):
        self.terms, self.model, self.cache, self.known = frozenset(terms), model, {}, frozenset(known)
        self.single = frozenset(_REPEATED.sub(r"\1", t) for t in self.terms)
        self.plain: set[str] = set()
        self.trie = trie_of(self.terms)

    def doubled(self, token: str) -> bool:
        core = token.strip(EDGES)
        return core not in self.terms and core not in self.known and _REPEATED.sub(r"\1", core) in self.single

    def fresh(self, tokens: set[str]) -> set[str]:
        """Words of letters that are terms but for doubled letters; others are remembered and not looked at again."""
        new = tokens - self.plain
        out = {t for t in new if t.isalpha() and self.doubled(t)}
        if len(self.plain) >= CACHE_TOKENS:
            self.plain.clear()
        self.plain |= new - out
        return out

    def of_token(self, token: str) -> frozenset[str]:
        found = self.cache.get(token)
        if found is None:
            if suspicious(token) or self.doubled(token):
                found = frozenset(self.model.terms_in(squeezed(token), self.trie, spread=False))
            else:
                found = self.terms & {token.strip(EDGES)}
            if len(self.cache) >= CACHE_TOKENS:
                self.cache.clear()
            self.cache[token] = found
        return found

    def find(self, text: str | None) -> set[str]:
        if not text:
            return set()
        low = text.lower()
        tokens = set(low.split())
        out = set(self.terms & tokens)
        odd = [t for t in tokens if not t.isalpha()]
        if _TRIPLE.search(low):
            odd += [t for t in tokens if t.isalpha() and _TRIPLE.search(t)]
        for run in set(spread_runs(low)):
            out.update(self.model.terms_in(run, self.trie))
        odd += self.fresh(tokens)
        return out.union(*map(self.of_token, odd))


def logistic(rows: list[list[int]], terms: int, y: np.ndarray, n: np.ndarray, ridge: float = 0.3, rounds: int = 25) -> np.ndarray:
    """Weights (the last is the constant) of a regression on which ``terms`` a row holds; rows count ``n`` times.

    Newton steps by conjugate gradients, so that memory is in proportion to
    the terms that rows hold, not to rows times terms.
    """
    row = np.repeat(np.arange(len(rows)), [len(r) + 1 for r in rows])
    term = np.fromiter((t for r in rows for t in (*r, terms)), np.int64, len(row))
    times = lambda v: np.bincount(row, v[term], len(rows))
    turned = lambda r: np.bincount(term, r[row], terms + 1)
    w, penalty = np.zeros(terms + 1), np.full(terms + 1, ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(times(w), -30, 30)))
        curve = n * (p * (1 - p) + 1e-6)
        left = turned(n * (y - p)) - penalty * w
        step, way, size = np.zeros(terms + 1), left.copy(), left @ left
        least = 1e-20 * max(size, 1e-300)
        for _ in range(4 * terms + 20):
            if size <= least:
                break
            bent = turned(curve * times(way)) + penalty * way
            far = size / (way @ bent)
            step += far * way
            left -= far * bent
            size, before = left @ left, size
            way = left + size / before * way
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-4:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, target: str, where: Column, rows: int) -> tuple[dict[str, tuple[float, float]], float, np.ndarray, list[str]] | None:
    """(weight and own log odds of each term, constant, character counts, clean rows' words that are terms but for doubled letters); None without labels of both kinds."""
    ids = labelled_sample(labels, target, where, rows)
    sample = cut(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "y"))
    counts = character_counts(docs)
    totals = dict(sample.groupBy("y").count().collect())
    if not totals.get(1) or not totals.get(0):
        return None

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = CharacterModel(counts), {}
        for batch in batches:
            for text, y in ((t.as_py(), n.as_py()) for t, n in zip(*batch.columns, strict=True)):
                found = sorted(restored_words(text or "", model, cache))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([y] * len(found), pa.int32())], names=["word", "y"])

    per_word = cut(sample.mapInArrow(released(words), "word string, y int").groupBy("word").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c")))
    weight = F.log((F.col("t") + 0.5) / (totals[1] + 1.0)) - F.log((F.col("c") + 0.5) / (totals[0] + 1.0))
    top = per_word.filter(F.col("t") >= max(3, TERM_SHARE * totals[1])).withColumn("w", weight).filter("w > 1.5").select("word").collect()
    terms = sorted(r["word"] for r in top)
    single = sorted({_REPEATED.sub(r"\1", t) for t in terms})
    known = sorted(r["word"] for r in per_word.filter("c > 0").filter(F.regexp_replace("word", r"(\p{L})\1+", "$1").isin(single)).select("word").collect())

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = TermFinder(terms, CharacterModel(counts), known)
        place = {t: i for i, t in enumerate(terms)}
        for batch in batches:
            found = [sorted(place[t] for t in finder.find(text)) for text in (t.as_py() for t in batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["y", "terms"])

    seen = sample.mapInArrow(released(hits), "y int, terms array<int>").groupBy("y", "terms").count().collect()
    seen.sort(key=lambda r: (r["y"], r["terms"]))
    rows = [r["terms"] for r in seen]
    y, n = np.array([float(r["y"]) for r in seen]), np.array([float(r["count"]) for r in seen])
    w = logistic(rows, len(terms), y, n)
    held, of = np.array([t for r in rows for t in r], np.int64), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    with_term, toxic_with_term = np.bincount(held, n[of], len(terms)), np.bincount(held, (n * y)[of], len(terms))
    alone = np.log(toxic_with_term + 0.5) - np.log(with_term - toxic_with_term + 0.5)
    strong = (w[:-1] >= 1.0) & (alone >= STRONG_ODDS) & (toxic_with_term >= STRONG_SHARE * totals[1])
    return {t: (float(v), float(a) if s else -np.inf) for t, v, a, s in zip(terms, w, alone, strong, strict=False)}, float(w[-1]), counts, known


def log_odds(found: set[str], weights: dict[str, tuple[float, float]], constant: float) -> float:
    """Of the regression; but a strong term counts for no less than its own log odds among the labelled rows,
    since terms that always come together share their weight."""
    return max([constant + sum(weights[t][0] for t in sorted(found)), *(weights[t][1] for t in found)])


def add_toxicity(
    docs: DataFrame, labels: DataFrame, target: str = "toxic", where: Column | None = None, labelled_rows: int = LABELLED_ROWS, score_column: str = "score"
) -> DataFrame:
    """``docs`` with the probability of label 1 of every row; ``where`` says which labels may be learnt from."""
    small_batches(docs.sparkSession)
    fitted = fit(docs, labels, target, F.lit(True) if where is None else where, labelled_rows)
    model = docs.sparkSession.sparkContext.broadcast(fitted)
    docs = docs.select(*quoted([c for c in docs.columns if c.lower() != score_column.lower()]))
    text_at, names = docs.columns.index("text"), [*docs.columns, score_column]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = None
        for batch in batches:
            for part in row_slices(batch, text_at):
                if model.value is None:
                    scores = np.zeros(part.num_rows)
                else:
                    weights, constant, counts, known = model.value
                    finder = finder or TermFinder(weights, CharacterModel(counts), known)
                    total = [log_odds(finder.find(text), weights, constant) for text in part.column(text_at).to_pylist()]
                    scores = 1 / (1 + np.exp(-np.clip(np.array(total, float), -30, 30)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], names=names)

    schema = docs.limit(0).withColumn(score_column, F.lit(0.0)).schema
    return by_place(docs).mapInArrow(released(score), schema)
