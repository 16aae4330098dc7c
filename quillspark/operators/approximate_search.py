"""Which text of a group holds a string, or something like it, without comparing them all.

A string of n characters is in a text to a partial ratio of t if a window of w
characters, n at most, shares a common subsequence of c * (n + w), c = t / 200.
Then the window has at least a * (n + w) - (q - 1) of the string's q-grams,
a = (2q - 1) * c - (q - 1): a character left out breaks up to q grams, one put in
up to q - 1. So however the string's grams are chosen, all but that many and one
more hold a gram of the window: the rarest are chosen as seeds, and meet an
inverted index of the texts' grams.

The thresholds go down: an exact place (t = 100) needs one seed of eight
characters, near ones need long seeds, and only strings that are found nowhere
go on to short ones. What a step finds is final, since all that is as alike has
been a candidate. Where the text is shorter than the string, the text is what
is looked for.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.similarity import partial
from quillspark.operators.lineage import settle

#: (least ratio, characters of seeds) of each step before the last, and the characters of the last one's seeds; a string
#: takes the first size that bounds anything, and single characters always do.
STEPS, LAST = ((100.0, (8, 4, 2, 1)), (95.0, (6, 2, 1)), (88.0, (3, 2, 1))), (2, 1)
#: Strings whose grams are taken, and pairs that are compared, in a task: so few bytes that Spark alone would make one task of them all.
DEALT = 1 << 12
#: Frequent grams that are known by their frequency, and seeds that a pair shares at least, where it must have as many.
COMMON, SHARED = 4096, 3
_EPS = 1e-9


def needed(n: int, least: float, q: int) -> int:
    """Grams of a string of ``n`` characters that any window as alike as ``least`` has; 0 if that is no bound."""
    c = least / 200
    a = (2 * q - 1) * c - (q - 1)
    if a <= 0 or n < q:
        return 0
    shortest = math.ceil(n * c / (1 - c) - _EPS)
    return max(0, math.ceil(a * (n + shortest) - (q - 1) - _EPS))


def seeds(text: str, least: float, sizes: tuple[int, ...], often: dict[str, int]) -> tuple[int, dict[str, int]]:
    """(seeds that must be shared, seeds with their numbers) for the first size that bounds anything; none if no size does."""
    for q in sizes:
        if need := needed(len(text), least, q):
            share = min(need, SHARED if least < 100 else 1)
            order = sorted((text[i : i + q] for i in range(len(text) - q + 1)), key=lambda g: (often.get(g, 0), g))
            return share, Counter(order[: len(order) - need + share])
    return 0, {}


def dealt(rows: DataFrame, count: int, *by: str) -> DataFrame:
    """``rows``, which are ``count`` at most, dealt over all cores, in parts of about DEALT."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-count // DEALT)), *by)


def _sizes_used(strings: DataFrame, least: float, sizes: tuple[int, ...]) -> tuple[int, ...]:
    """Of ``sizes``, those that some string's seeds have."""
    column, use = F.length("s"), F.lit(0)
    for q in reversed(sizes):
        shortest = next((n for n in range(q, 1000) if needed(n, least, q)), None)
        use = use if shortest is None else F.when(column >= shortest, q).otherwise(use)
    return tuple(q for q in sizes if strings.filter(use == q).limit(1).count())


def _grams(strings: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """The columns of ``strings`` (the last one a string ``s``) once for each different gram, without the string."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r, g) for r, s in enumerate(batch.column(batch.num_columns - 1).to_pylist()) for g in {s[i : i + q] for q in sizes for i in range(len(s) - q + 1)}]
            at, gram = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int64())) for c in batch.columns[:-1]), pa.array(gram, pa.string())], names=[*batch.schema.names[:-1], "gram"])

    return strings.mapInArrow(spread, strings.limit(0).withColumnRenamed("s", "gram").schema)


def _seeded(strings: DataFrame, least: float, sizes: tuple[int, ...], often: dict[str, int]) -> DataFrame:
    """The columns of ``strings`` but ``s`` with share, gram and n, once for each seed."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r, s in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                share, found = seeds(s, least, sizes, often)
                rows += [(r, share, g, n) for g, n in found.items()]
            at, share, gram, n = zip(*rows, strict=True) if rows else ((),) * 4
            some = [c.take(pa.array(at, pa.int64())) for c in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*some, pa.array(share, pa.int32()), pa.array(gram, pa.string()), pa.array(n, pa.int32())], names=[*batch.schema.names[:-1], "share", "gram", "n"])

    schema = strings.limit(0).drop("s").withColumns({"share": F.lit(0), "gram": F.lit(""), "n": F.lit(0)}).schema
    return strings.mapInArrow(spread, schema)


def _candidates(looked_for: DataFrame, held: DataFrame, least: float, sizes: tuple[int, ...], count: int) -> DataFrame:
    """(k, query, place) of the pairs that share as many seeds as they must; the last column of both sides is the string ``s``.

    ``count`` is how many strings there are at most.
    """
    sizes = _sizes_used(looked_for, least, sizes)
    index = settle(_grams(dealt(held.join(looked_for.select("k").distinct(), "k", "left_semi"), count, *held.columns), sizes))
    often = {r.gram: r["count"] for r in index.groupBy("gram").count().orderBy(F.desc("count"), "gram").limit(COMMON).collect()}
    met = _seeded(dealt(looked_for, count, *looked_for.columns), least, sizes, often).join(index, ["k", "gram"])
    return met.groupBy("k", "query", "place").agg(F.sum("n").alias("n"), F.first("share").alias("share")).filter("n >= share").select("k", "query", "place")


def find_likest(queries: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(k, query, place, score, text): for each string ``query`` of a group ``k`` the likest text of the group, and its partial ratio.

    ``queries``: k, query. ``texts``: k, place, text. A text that holds the string comes before others; of texts as alike,
    that of the smallest place. Texts below ``least``, empty strings and null groups are never found.
    """
    open_ones = settle(queries.select("k", "query").filter("query <> ''").distinct())
    held = settle(texts.filter("text <> ''").groupBy("k", "text").agg(F.min("place").alias("place")).select("k", "place", "text"))
    found, count = None, open_ones.count() + held.count()
    for step, sizes in [*(x for x in STEPS if x[0] > least), (least, LAST)]:
        asked, known = open_ones.select("k", "query", F.col("query").alias("s")), held.select("k", "place", F.col("text").alias("s"))
        near = _candidates(asked, known, step, sizes, count)
        if step == 100:
            good = near.join(held, ["k", "place"]).filter(F.length("text") >= F.length("query"))
            good = good.filter(F.instr("text", F.col("query")) > 0).withColumn("score", F.lit(100.0))
        else:
            near = settle(near)
            pairs, met = near.join(held, ["k", "place"]).filter(F.length("text") >= F.length("query")), near.count()
            longest = asked.groupBy("k").agg(F.max(F.length("query")).alias("longest"))
            short = known.join(longest, "k").filter(F.length("s") < F.col("longest")).select("k", "place", "s")
            if not short.isEmpty():
                turned = settle(_candidates(short, asked, step, sizes, count))
                pairs, met = pairs.unionByName(turned.join(held, ["k", "place"]).filter(F.length("text") < F.length("query"))), met + turned.count()
            good = dealt(pairs, met, "k", "query", "place").withColumn("score", partial(F.col("query"), F.col("text"), step)).filter(F.col("score") >= step)
        best = settle(good.groupBy("k", "query").agg(F.min_by(F.struct("place", "score", "text"), F.struct(-F.col("score"), "place", "text")).alias("b")).select("k", "query", "b.place", "b.score", "b.text"))
        found = best if found is None else found.unionByName(best)
        open_ones = settle(open_ones.join(best, ["k", "query"], "left_anti"))
        if open_ones.isEmpty():
            break
    return found
