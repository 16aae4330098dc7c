"""Quality classifier: nearest-neighbour voting among latent-semantic vectors.

A text's terms are its words, lower-cased and hashed, the three-character
shapes it is made of (hashed) and the share of its words that repeat, weighted
by log frequency and rarity. A
truncated singular value decomposition of a bounded sample of labelled rows
gives the latent space. The labelled vectors are broadcast (their number is a
parameter, so their size has a fixed bound), and every document is multiplied
with all of them, a block of documents at a time: exact cosines, no index. The
score is the share of good labels among the nearest, weighted by similarity.

Null and empty texts have no shape; their vector is that of the repeat term
alone, and where a cosine is undefined the score is the labelled share of good
rows. Equal texts get equal scores. Ties between neighbours go to the earlier
labelled row (by id). Of rows with the same labelled id the one whose text
hashes lowest is learnt from. Without any labelled row every score is 0.5. Very long texts are
read whole. Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm._tables import labelled_sample
from quillspark.llm.ann import DECIMALS, best_of
from quillspark.llm._words import Words, mix64, slices, span_hashes
from quillspark.llm.quality_rules import repeated_words

WORDS, SHAPES = 1024, 1024
REPEATS = 6
DIMENSIONS = 24
#: Labelled rows at most, of which the space and the voters are made.
LABELLED_ROWS = 4000
NEIGHBOURS = 25
#: Texts whose terms are counted at once.
ROWS_AT_ONCE = 2048

_SHAPE = np.zeros(256, np.uint64)
_SHAPE[:] = 1
_SHAPE[[*range(97, 123), *range(128, 256)]] = 2
_SHAPE[[*range(65, 91)]] = 3
_SHAPE[[*range(48, 58)]] = 4
for _i, _c in enumerate(" \n.,!?#*$%&|<>@:/-\"'"):
    _SHAPE[ord(_c)] = 5 + _i


#: Values of bytes for hashing words, capitals as small letters.
_LOWER_VALUE = mix64(np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64))


def term_counts(words: Words) -> np.ndarray:
    """Log frequencies of the hashed shapes and words, and the repeat term, a row for each text."""
    rows = len(words.counts)
    out = np.zeros((rows, SHAPES + REPEATS + WORDS))
    word = (span_hashes(_LOWER_VALUE[words.buf], words.starts, words.ends) % np.uint64(WORDS)).astype(np.int64)
    out[:, SHAPES + REPEATS :] = np.bincount(words.doc * WORDS + word, minlength=rows * WORDS).reshape(rows, WORDS)
    doc = np.repeat(np.arange(rows), np.diff(words.offsets))
    if len(doc) >= 3:
        s = _SHAPE[words.buf]
        inside = doc[2:] == doc[:-2]
        code = (s[:-2] * np.uint64(1024) + s[1:-1] * np.uint64(32) + s[2:])[inside]
        shape = (mix64(np.arange(32 * 1024, dtype=np.uint64)) % np.uint64(SHAPES)).astype(np.int64)[code]
        out[:, :SHAPES] = np.bincount(doc[2:][inside] * SHAPES + shape, minlength=rows * SHAPES).reshape(rows, SHAPES)
    np.log1p(out, out)
    share = repeated_words(words) / np.maximum(words.counts, 1)
    level = np.minimum((share * REPEATS).astype(np.int64), REPEATS - 1)
    out[np.arange(rows), SHAPES + level] = np.where(level > 0, 4.0, 0.0)
    return out


def unit_rows(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def latent_space(counts: np.ndarray, dimensions: int) -> np.ndarray:
    """Matrix from log frequencies to the latent space: rarity weights, then the leading right singular vectors."""
    rarity = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 0.1
    x = counts * rarity
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    values, vectors = np.linalg.eigh(x.T @ x)
    return rarity[:, None] * vectors[:, np.argsort(-values)[:dimensions]]


def vote(vectors: np.ndarray, voters: np.ndarray, labels: np.ndarray, neighbours: int) -> np.ndarray:
    """Share of label 1 among each row's nearest voters, weighted by the fourth power of the cosine."""
    cosines = vectors @ voters.T
    k = min(neighbours, len(voters))
    near = best_of(np.round(cosines, DECIMALS), k)
    weight = np.maximum(np.take_along_axis(cosines, near, 1), 0) ** 4
    total = weight.sum(1)
    return np.where(total > 0, (weight * labels[near]).sum(1) / np.maximum(total, 1e-12), labels.mean())


def fit(docs: DataFrame, labels: DataFrame, target: str, where: Column, rows: int, dimensions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(space, voters, labels) from at most ``rows`` labelled documents; None without any."""
    ids = labelled_sample(labels, target, where, rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "text", "y", F.xxhash64("text").alias("h"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in slices(batch, "text", most_rows=ROWS_AT_ONCE):
                rows = [r.tobytes() for r in term_counts(words).astype(np.float32)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(rows, pa.binary())], names=["doc_id", "y", "h", "terms"])

    # one row per id, should the documents repeat one
    found = sample.mapInArrow(terms, f"doc_id {kind}, y int, h long, terms binary").groupBy("doc_id").agg(F.first("y").alias("y"), F.min_by("terms", "h").alias("terms")).collect()
    if not found:
        return None
    found.sort(key=lambda r: r["doc_id"])
    counts = np.stack([np.frombuffer(r["terms"], np.float32) for r in found]).astype(float)
    space = latent_space(counts, dimensions)
    return space, unit_rows(counts @ space), np.array([r["y"] for r in found], float)


def classify(
    docs: DataFrame,
    labels: DataFrame,
    target: str = "quality",
    where: Column | None = None,
    labelled_rows: int = LABELLED_ROWS,
    dimensions: int = DIMENSIONS,
    neighbours: int = NEIGHBOURS,
) -> DataFrame:
    """(doc_id, score): the likelihood of label 1 for every document; ``where`` says which labels may be learnt from."""
    fitted = fit(docs, labels, target, F.lit(True) if where is None else where, labelled_rows, dimensions)
    model = docs.sparkSession.sparkContext.broadcast(fitted)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in slices(batch, "text", most_rows=ROWS_AT_ONCE):
                if model.value is None:
                    scores = np.full(part.num_rows, 0.5)
                else:
                    space, voters, y = model.value
                    scores = np.zeros(part.num_rows)
                    vectors = unit_rows(term_counts(words) @ space)
                    for low in range(0, part.num_rows, 512):
                        scores[low : low + 512] = vote(vectors[low : low + 512], voters, y, neighbours)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores)], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double")
