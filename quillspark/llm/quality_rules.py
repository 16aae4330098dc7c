"""Quality rules: base counts and an n-gram log-likelihood ratio.

Texts are split into tokens (runs of letters and digits, or of other
characters, between white space); tokens and pairs of neighbours are hashed
into a fixed number of buckets. Two multinomials over the buckets, one of
trusted target documents and one of the whole raw corpus, give every document
the mean over its n-grams of log(p_target / p_raw). A document is kept if
that mean is at or above a threshold fixed by the trusted documents' own scores:
as far below a stated low quantile as that is below their median. So documents
like them fail more rarely than the quantile says, even if the trusted ones are
few. The same text always gets the same verdict.

The base rules come first: too few words, or too many words in repeated
five-word windows, fail whatever the ratio says. A word is a run of bytes
other than ASCII white space.

Null and empty texts have no words and fail the base rules. Repeated rows get
equal results. Without any trusted document, or with an empty table, every
score is 0 and the base rules decide alone. Very long texts are handled whole,
a slice of rows at a time. Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._words import _BYTE_VALUE_NO_SPACE, Words, gram_hashes, mix64, slices, span_hashes

BUCKETS = 1 << 14
#: Ids of trusted documents, at most, that are broadcast; more are left to a join of Spark's.
MOST_BROADCAST = 1_000_000
#: Scores are counted in steps of a ten-thousandth for their quantiles, so that what is gathered doesn't grow with the rows.
DECIMALS = 4
#: The low quantile of trusted scores.
QUANTILE = 0.0005

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_WORDY = np.zeros(256, np.uint8)
_WORDY[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS = np.where(_SPACE, 0, 2 - _WORDY).astype(np.uint8)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_STARTS_POINT = np.ones(256, bool)
_STARTS_POINT[0x80:0xC0] = False


def ngram_buckets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every token and every pair of neighbouring tokens of a slice."""
    if not len(words.buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _CLASS[words.buf]
    new = np.concatenate(([True], kind[1:] != kind[:-1]))
    edges = words.offsets[:-1]
    new[edges[edges < len(kind)]] = True
    begins = np.flatnonzero(new)
    ends = np.append(begins[1:], len(kind))
    solid = kind[begins] > 0
    begins, ends = begins[solid], ends[solid]
    doc = np.searchsorted(words.offsets, begins, side="right") - 1
    one = span_hashes(_BYTE_VALUE_NO_SPACE[words.buf], begins, ends)
    near = doc[1:] == doc[:-1]
    with np.errstate(over="ignore"):
        two = mix64(one[:-1] * np.uint64(3) + one[1:])[near]
    return np.concatenate((doc, doc[1:][near])), (np.concatenate((one, two)) % np.uint64(BUCKETS)).astype(np.int64)


def repeated_words(words: Words, n: int = 5) -> np.ndarray:
    """Per text, words inside n-word windows that its text has twice or more."""
    out = np.zeros(len(words.counts), np.int64)
    grams, at = gram_hashes(words.hashes(), words.left(), n)
    if not len(at):
        return out
    doc = words.doc[at]
    with np.errstate(over="ignore"):
        keys = mix64(grams + mix64(doc.astype(np.uint64)))
    order = np.argsort(keys)
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.concatenate((same, [False])) | np.concatenate(([False], same))
    covered = np.zeros(len(words.starts) + 1, np.int64)
    hit = at[order[twice]]
    np.add.at(covered, hit, 1)
    np.add.at(covered, hit + n, -1)
    inside = np.cumsum(covered[:-1]) > 0
    return np.bincount(words.doc[inside], minlength=len(out))


def duplicate_lines(text: str | None) -> int:
    """Lines with a word that equal an earlier line of the text."""
    if not text or "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def base_counts(words: Words, texts: list[str | None]) -> dict[str, np.ndarray]:
    of_bytes = lambda flag: np.diff(np.concatenate(([0], np.cumsum(flag)))[words.offsets])
    return {
        "n_words": words.counts.astype(np.int64),
        "word_chars": of_bytes(_STARTS_POINT[words.buf] & ~_SPACE[words.buf]).astype(np.int64),
        "n_symbols": of_bytes(_SYMBOL[words.buf]).astype(np.int64),
        "n_dup_lines": np.array([duplicate_lines(t) for t in texts], np.int64),
        "n_repeat_words": repeated_words(words),
    }


def ngram_counts(docs: DataFrame, text_column: str = "text") -> np.ndarray:
    """Counts of the hashed n-grams of all rows; a task sends one number per bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, words in slices(batch, text_column):
                total += np.bincount(ngram_buckets(words)[1], minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    out = np.zeros(BUCKETS)
    for bucket, n in docs.select(text_column).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    p, q = target + smooth, raw + smooth
    return np.log(p / p.sum()) - np.log(q / q.sum())


def score_documents(docs: DataFrame, ratio: np.ndarray, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, the base counts and score (mean log ratio of the text's n-grams, 0 without any)."""
    kind = docs.schema[id_column].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in slices(batch, text_column):
                counts = base_counts(words, part.column(1).to_pylist())
                doc, bucket = ngram_buckets(words)
                n = np.bincount(doc, minlength=part.num_rows)
                total = np.bincount(doc, ratio[bucket], part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *map(pa.array, counts.values()), pa.array(total / np.maximum(n, 1))], names=[id_column, *counts, "score"]
                )

    return docs.select(id_column, text_column).mapInArrow(
        score, f"`{id_column}` {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"
    )


def quantiles(scores: DataFrame, *shares: float) -> list[float] | None:
    """Quantiles of the column ``score`` of all rows, from the numbers of rows of each step; None without rows."""
    steps = scores.groupBy(F.round("score", DECIMALS).alias("score")).agg(F.count(F.lit(1)).alias("n"))
    return steps.agg(F.percentile("score", F.array(*map(F.lit, shares)), F.col("n"))).first()[0]


def judge_quality(
    docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, id_column: str = "doc_id", text_column: str = "text", broadcast: int = MOST_BROADCAST
) -> DataFrame:
    """id, n_words, the base counts, score, base_failed and kept, a row per document.

    ``labels`` (doc_id, quality): all rows with quality 1 make the target and the threshold; up to ``broadcast`` ids are broadcast.
    """
    ids = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias(id_column)).distinct()
    few = ids.limit(broadcast + 1).count() <= broadcast
    trusted = docs.select(id_column, text_column).join(F.broadcast(ids) if few else ids, id_column, "left_semi")
    target, raw = ngram_counts(trusted, text_column), ngram_counts(docs, text_column)
    if target.any():
        ratio = log_ratio(target, raw)
        if few:
            scored = score_documents(trusted, ratio, id_column, text_column)
        else:  # scores meet the ids, not texts once more
            scored = score_documents(docs, ratio, id_column, text_column).join(ids, id_column, "left_semi")
        low = quantiles(scored.filter("n_words >= 10"), quantile, 0.5)
        threshold = 2 * low[0] - low[1] if low is not None else 0.0
    else:
        ratio, threshold = np.zeros(BUCKETS), 0.0
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (
        score_documents(docs, ratio, id_column, text_column)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(threshold)))
    )
