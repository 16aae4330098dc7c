"""Approximate nearest neighbours: multiprobe p-stable hashing.

Each of several tables cuts Gaussian projections of the unit vectors into
cells of one width. A query visits its own cell and the cells around it in the
order of estimated success: the sum over functions of the squared distance
from the query to the borders that are crossed. What the tables find is ranked
by exact cosines in double precision, a block of queries against a block of a
cell's vectors, and merged. A query that finds fewer than ``k`` is compared
with all vectors, in blocks. Ranks go by cosines rounded at the twelfth decimal,
so that rounding errors of products don't decide between equals; scores are not rounded.

Every vector is in every table. Equal vectors are one entry with their ``k + 1``
smallest ids, which is all that a ranking can show; so a group of copies is
small. Cells are counted first: those of more than a block's vectors are split
by a hash of the id, the others are dealt to groups of about a block; queries
go to cells that hold something, and to each of a cell's blocks. Functions and
probes are the same for every size of table: more functions would lose
neighbours unless probes grew 2.5-fold with each, which halves the vectors
compared at best. So comparisons grow with queries times vectors.

Rows with a null id, and vectors that are null, empty, zero or hold null or
non-finite numbers, take no part; neither do vectors of another length than
most. Repeated rows count once. Ties go to the smaller id. An empty table or
one without queries gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm._tables import cut

TABLES, WIDTH, SEED = 8, 1.5, 5
#: Functions in a table, and cells that a query visits in it.
FUNCTIONS, PROBES = 4, 10
#: Vectors of a block, on average; queries compared with it at once.
BLOCK, QUERIES = 8192, 256
#: Decimals of a cosine that count.
DECIMALS = 12


class Cells:
    """The cells of all tables: where vectors are, and where queries look."""

    def __init__(self, dimension: int, functions: int, tables: int = TABLES, width: float = WIDTH, seed: int = SEED):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.a = rng.standard_normal((tables, dimension, functions))
        self.b = rng.uniform(0, width, (tables, functions))
        self.key = rng.integers(1, 1 << 62, functions) | 1
        self.width, self.tables = width, tables
        steps = [s for n in range(min(functions, 4) + 1) for at in itertools.combinations(range(functions), n) for s in self._signs(at, functions)]
        self.steps = np.array(steps, np.int64)
        self.crossed = np.hstack([self.steps == -1, self.steps == 1]).astype(float)

    @staticmethod
    def _signs(at: tuple[int, ...], functions: int) -> Iterator[list[int]]:
        for signs in itertools.product((-1, 1), repeat=len(at)):
            step = [0] * functions
            for i, s in zip(at, signs, strict=True):
                step[i] = s
            yield step

    def of(self, unit: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """Cell coordinates and the distance to each cell's lower borders."""
        x = unit @ self.a[table] + self.b[table]
        cell = np.floor(x / self.width)
        return cell.astype(np.int64), x - cell * self.width

    def keys(self, cell: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (cell * self.key).sum(-1)

    def visits(self, unit: np.ndarray, table: int, probes: int) -> np.ndarray:
        """Keys of the cells that each query visits, likeliest first."""
        cell, low = self.of(unit, table)
        risk = np.hstack([low**2, (self.width - low) ** 2]) @ self.crossed.T
        first = np.argsort(risk, axis=1, kind="stable")[:, :probes]
        return self.keys(cell[:, None, :] + self.steps[first])


def matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dimension)


def unit(x: np.ndarray) -> np.ndarray:
    # scaled by the largest component first, so that squares neither overflow nor vanish
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def best_of(cosines: np.ndarray, most: int) -> np.ndarray:
    """Columns of each row's ``most`` largest values; of equal ones at the border those that come first."""
    border = -np.partition(-cosines, most - 1, axis=1)[:, most - 1 : most]
    above, equal = cosines > border, cosines == border
    take = above | (equal & (np.cumsum(equal, axis=1) <= most - above.sum(1, keepdims=True)))
    return np.nonzero(take)[1].reshape(len(cosines), most)


def nearest_in_block(queries: pa.Table, members: pa.Table, k: int, dimension: int) -> pa.Table:
    """(query_id, vec_id, ids, score): each query's best entries in each of its cells, k + 1 since it may find itself."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])
    if not queries.num_rows or not members.num_rows:
        return schema.empty_table()
    members, queries = members.sort_by([("cell", "ascending"), ("vec_id", "ascending")]).combine_chunks(), queries.sort_by("cell").combine_chunks()
    m, cell_m = unit(matrix(members["embedding"].chunk(0), dimension)), members["cell"].to_numpy()
    q, cell_q = unit(matrix(queries["embedding"].chunk(0), dimension)), queries["cell"].to_numpy()
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for cell in np.unique(cell_q):
        q_low, q_high = np.searchsorted(cell_q, cell), np.searchsorted(cell_q, cell, "right")
        low, high = np.searchsorted(cell_m, cell), np.searchsorted(cell_m, cell, "right")
        for at in range(q_low, q_high if high > low else q_low, QUERIES):
            block = q[at : min(at + QUERIES, q_high)]
            cosines = block @ m[low:high].T
            near = best_of(np.round(cosines, DECIMALS), min(k + 1, high - low))
            out.append((np.repeat(np.arange(at, at + len(block)), near.shape[1]), (low + near).ravel(), np.take_along_axis(cosines, near, 1).ravel()))
    if not out:
        return schema.empty_table()
    row, at, score = (np.concatenate(x) for x in zip(*out, strict=True))
    columns = [queries["query_id"].take(pa.array(row)), members["vec_id"].take(pa.array(at)), members["ids"].take(pa.array(at)), pa.array(score)]
    return pa.Table.from_arrays(columns, schema=schema)


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding", tables: int = TABLES, width: float = WIDTH, block: int = BLOCK
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row that ``is_query`` (a condition on vec_id) holds for."""
    x = F.col(vector_column)
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    valid = vectors.select(F.col(id_column).cast("long").alias("vec_id"), x.cast("array<double>").alias("embedding")).filter(
        F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False))
    )
    lengths = valid.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dimension, rows = lengths or (1, 0)
    valid = valid.filter(F.size("embedding") == dimension).dropDuplicates(["vec_id", "embedding"])
    queries = valid.filter(is_query).select(F.col("vec_id").alias("query_id"), "embedding")
    # equal vectors: only the smallest ids can be ranked (the limit is applied before the shuffle)
    first = Window.partitionBy("embedding").orderBy("vec_id")
    entries = valid.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1).groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    entries = cut(entries.select(F.col("ids")[0].alias("vec_id"), "ids", "embedding"))
    queries = cut(queries)
    cells = Cells(dimension, FUNCTIONS, tables, width)
    whole_blocks = max(1, math.ceil(rows / block))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = unit(matrix(batch.column(2), dimension)) if batch.num_rows else np.zeros((0, dimension))
            for t in range(tables):
                key = cells.keys(cells.of(u, t)[0])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), t, np.int32)), pa.array(key), *batch.columns], names=["t", "cell", "vec_id", "ids", "embedding"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = unit(matrix(batch.column(1), dimension)) if batch.num_rows else np.zeros((0, dimension))
            for t in range(tables):
                keys = cells.visits(u, t, PROBES)
                row = pa.array(np.repeat(np.arange(len(u)), keys.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), t, np.int32)), pa.array(keys.ravel()), batch.column(0).take(row), batch.column(1).take(row)], names=["t", "cell", "query_id", "embedding"])

    schema = "query_id long, vec_id long, ids array<long>, score double"
    by = ["t", "is_large", "group", "block"]

    def rank_blocks(placed: DataFrame, visiting: DataFrame) -> DataFrame:
        found = visiting.groupBy(*by).cogroup(placed.groupBy(*by)).applyInArrow(lambda q, m: nearest_in_block(q, m, k, dimension), schema)
        return merge(found)

    def merge(found: DataFrame) -> DataFrame:
        one = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.first("ids").alias("ids"))
        ranked = one.select("query_id", F.explode("ids").alias("vec_id"), "score").filter("vec_id <> query_id")
        ranked = ranked.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        best = Window.partitionBy("query_id").orderBy(F.round("score", DECIMALS).desc(), "vec_id")
        return ranked.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    placed = entries.mapInArrow(place, "t int, cell long, vec_id long, ids array<long>, embedding array<double>")
    visiting = queries.mapInArrow(visit, "t int, cell long, query_id long, embedding array<double>")
    # a large cell is a group of its own in several blocks; small ones share groups
    sizes = placed.groupBy("t", "cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    is_large = F.col("blocks") > 1
    sizes = cut(sizes.withColumns({"is_large": is_large, "group": F.when(is_large, F.col("cell")).otherwise(F.pmod(F.xxhash64("cell"), F.lit(whole_blocks)))}))
    dealt = placed.join(sizes, ["t", "cell"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int"))
    asking = visiting.join(sizes, ["t", "cell"]).withColumn("block", every(F.col("blocks")))
    found = cut(rank_blocks(dealt.select(*by, "cell", "vec_id", "ids", "embedding"), asking.select(*by, "cell", "query_id", "embedding")))
    enough = found.groupBy("query_id").count().filter(F.col("count") >= k)
    short = cut(queries.join(enough, "query_id", "left_anti"))
    if short.isEmpty():
        return found.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
    # queries that found too few see every block
    one = [F.lit(-1).alias("t"), F.lit(True).alias("is_large"), F.lit(0).cast("long").alias("group"), F.lit(0).cast("long").alias("cell")]
    whole = entries.select(*one, F.pmod(F.xxhash64("vec_id"), F.lit(whole_blocks)).cast("int").alias("block"), "vec_id", "ids", "embedding")
    rest = short.select(*one, every(F.lit(whole_blocks)).alias("block"), "query_id", "embedding")
    ranked = found.join(short.select("query_id"), "query_id", "left_anti").unionByName(rank_blocks(whole, rest))
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
