"""Whitening of embeddings by a tiled covariance.

A component c of a vector becomes the whole number floor(256 * c). The fit list
holds each distinct vector of these numbers once. Its sums give the means; the
centred rows are cut into column blocks, which are shuffled by row block. Where
the column blocks of a row block meet, those of each tile (a pair of blocks of
dimensions) are multiplied, and the products are summed per tile. The driver
assembles the tiles into the covariance and takes its eigenvectors: dimensions
squared is all that it holds. Projections of the rows on the leading
components, divided by the roots of their eigenvalues, are the result.

Vectors that are null, empty or hold null or non-finite entries are left out,
and so are those of another length than the commonest one (of the longest, if
several are). Whole numbers beyond 2^62 are counted as about that bound, so that
sums stay exact. Repeated rows count once in the fit and come out as often
as they are there; null ids are kept. Components without variance (one distinct
vector, or fewer dimensions than components) give no rows; an empty table gives
none. A deviation beyond a long is null. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._tables import cut

#: Dimensions of a column block, and rows of a row block.
TILE, BLOCK_ROWS = 16, 4096
_MOST = float((1 << 62) - (1 << 10))


def scaled(batch: pa.RecordBatch, column: int, d: int) -> np.ndarray:
    """Whole numbers of the vectors of a batch, all of ``d`` entries."""
    x = batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    return np.floor(np.clip(256.0 * x, -_MOST, _MOST)).astype(np.int64)


def usable(vectors: DataFrame, vector_column: str) -> tuple[DataFrame, int]:
    """The rows that take part, and their number of dimensions (0 if there are none)."""
    v = F.col(vector_column)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.withColumn(vector_column, v.cast("array<double>")).filter(v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(F.exists(v, bad), F.lit(True)))
    commonest = rows.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size(v) == (commonest.d if commonest else 0)), commonest.d if commonest else 0


def fit_list(rows: DataFrame, d: int, vector_column: str) -> DataFrame:
    """x: the bytes of each distinct vector of whole numbers."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.unique(scaled(batch, 0, d), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in flat], pa.binary())], names=["x"])

    return rows.select(vector_column).mapInArrow(pack, "x binary").distinct()


def unpacked(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64).reshape(-1, d)


def column_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Rows of the fit list, and the exact sum of each dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            x = unpacked(batch, d)
            n += len(x)
            high += (x >> 26).sum(0)
            low += (x & ((1 << 26) - 1)).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([n] * d, pa.int64()), pa.array(range(d), pa.int32()), pa.array(high), pa.array(low)], names=["n", "k", "high", "low"])

    total = fit.mapInArrow(add, "n long, k int, high long, low long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"))
    sums = {r.k: r for r in total.collect()}
    return (sums[0].n if sums else 0), [(sums[k].high << 26) + sums[k].low for k in range(d)] if sums else []


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n; whole parts are subtracted as whole numbers."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - whole).astype(np.float64) - rest


def column_blocks(fit: DataFrame, d: int, n: int, sums: list[int], tile: int, block_rows: int) -> DataFrame:
    """row_block, column_block, cells: the centred entries of up to ``block_rows`` rows in ``tile`` dimensions."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for batch in batches:
            x = centred(unpacked(batch, d), n, sums)
            for low in range(0, len(x), block_rows):
                blocks = [np.ascontiguousarray(x[low : low + block_rows, c : c + tile]).tobytes() for c in range(0, d, tile)]
                yield pa.RecordBatch.from_arrays([pa.array([at] * len(blocks), pa.int64()), pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.binary())], names=["row_block", "column_block", "cells"])
                at += 1

    return fit.mapInArrow(deal, "row_block long, column_block int, cells binary")


def tile_sums(blocks: DataFrame, d: int, tile: int) -> DataFrame:
    """a, b, at, v: entry ``at`` of the sum of products of column blocks a <= b."""
    width = [min(tile, d - c) for c in range(0, d, tile)]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        held: list[np.ndarray] = []
        for batch in batches:
            for column, cells in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                held.append(np.frombuffer(cells).reshape(-1, width[column]))
                if column == len(width) - 1:
                    for a, left in enumerate(held):
                        for b in range(a, len(held)):
                            product = left.T @ held[b]
                            sums[a, b] = sums[a, b] + product if (a, b) in sums else product
                    held = []
        for (a, b), v in sums.items():
            yield pa.RecordBatch.from_arrays([*(pa.array(k, pa.int32()) for k in ([a] * v.size, [b] * v.size, range(v.size))), pa.array(v.ravel())], names=["a", "b", "at", "v"])

    met = blocks.repartition("row_block").sortWithinPartitions("row_block", "column_block")
    return met.mapInArrow(multiply, "a int, b int, at int, v double").groupBy("a", "b", "at").agg(F.sum("v").alias("v"))


def covariance(tiles: DataFrame, d: int, n: int, tile: int) -> np.ndarray:
    out = np.zeros((d, d))
    for r in tiles.toLocalIterator():
        i, j = r.at // min(tile, d - r.b * tile), r.at % min(tile, d - r.b * tile)
        out[r.a * tile + i, r.b * tile + j] = out[r.b * tile + j, r.a * tile + i] = r.v / n
    return out


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - S)^2, exact; None beyond a long."""
    if not len(x):
        return []
    d = x.shape[1]
    reach = max(abs(n * int(edge) - s) for k, s in enumerate(sums) for edge in (x[:, k].min(), x[:, k].max()))
    if d * reach * reach < 1 << 63:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(1).tolist()
    exact = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(1)
    return [v if v < 1 << 63 else None for v in exact]


def identity_error(fit: DataFrame, d: int, n: int, sums: list[int], projection: np.ndarray) -> float:
    """Largest absolute entry of the covariance of the whitened fit list, less the identity; measured, not derived."""
    k = projection.shape[1]

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = centred(unpacked(batch, d), n, sums) @ projection
            total += np.vstack((w.T @ w, w.sum(0)))
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["at", "v"])

    total = np.zeros((k + 1) * k)
    for at, v in fit.mapInArrow(moments, "at int, v double").groupBy("at").agg(F.sum("v")).collect():
        total[at] = v
    total = total.reshape(k + 1, k) / n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = 4, id_column: str = "vec_id", vector_column: str = "embedding", tile: int = TILE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """id, component (from 1), n, deviation, whitened, explained, identity_error: up to ``components`` rows a vector."""
    kind = vectors.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows, d = usable(vectors.select(id_column, vector_column), vector_column)
    if not d:
        return vectors.sparkSession.createDataFrame([], schema)
    fit = cut(fit_list(rows, d, vector_column))
    n, sums = column_sums(fit, d)
    v = covariance(tile_sums(column_blocks(fit, d, n, sums, tile, block_rows), d, tile), d, n, tile)
    values, directions = np.linalg.eigh(v)
    values, directions = values[::-1], directions[:, ::-1]
    trace = float(np.trace(v))
    k = int(np.sum(values[:components] > trace * d * np.finfo(float).eps))
    if not k:
        return vectors.sparkSession.createDataFrame([], schema)
    projection = directions[:, :k] / np.sqrt(values[:k])
    error, explained = identity_error(fit, d, n, sums, projection), values[:k] / trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = scaled(batch, 1, d)
            m, each = len(x), np.repeat(np.arange(len(x)), k)
            w = centred(x, n, sums) @ projection
            yield pa.RecordBatch.from_arrays(
                [
                    pc.take(batch.column(0), pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n, np.int64)),
                    pc.take(pa.array(deviations(x, n, sums), pa.int64()), pa.array(each)),
                    pa.array(w.ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ],
                names=[id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(project, schema)
