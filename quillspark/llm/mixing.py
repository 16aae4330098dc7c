"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a target share of all words by its weight, at most ``most``
times its own words; what is cut off there goes to the others by weight until
none is above (the level at which capped shares add up to the total). A source
first gives as many complete epochs as fit in its target. The rest is a
sample without replacement: documents in the order of their keys, exponential
variates divided by the document's quality weight, up to the word budget.
The document at the border gives only the words that are left to take.

The sample is a cut-off key for each source, so texts are never sorted or
shuffled; keys are recomputed where the copies are made. The keys are sorted
by range, which splits a source that holds most of the rows.

Null and empty texts have size 0; a source's documents of size 0 follow the
same rule. A null source is a source of its own, the last. Rows equal in id and
text have equal keys; at the border they share what is left. An empty table, or one without
words, gives targets of 0. Other columns are carried along; those named like a
result column are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm._tables import WORD, cut, free_name, quoted

#: A table of at most this many sources is broadcast; one with more is joined by shuffle.
BROADCAST_SOURCES = 10_000
#: The least quality weight.
LEAST_WEIGHT = 0.05
ADDED = ("size", "source_size", "target", "copies", "border_words", "taken")


def quality_weight(text: Column) -> Column:
    """1 for plain text, falling to 0.05 as symbols make up a twentieth of it or more."""
    text = F.coalesce(text, F.lit(""))
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>!", ""))
    return F.greatest(F.lit(LEAST_WEIGHT), F.lit(1.0) - F.lit(20.0) * symbols / F.greatest(F.length(text), F.lit(1)))


def mix_key(doc_id: Column, text: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight with u in (0, 1] from a hash of seed, id and text."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit(""))).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 1) / F.lit(float(1 << 52))
    return -F.log(u) / weight


def source_targets(sizes: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """(source, source_size) with target: one row per source, so the ordering windows are small."""
    placed = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    table = F.array(*(F.lit(float(w)) for w in weights))
    placed = placed.withColumn("w", F.get(table, (F.col("place") - 1) % len(weights))).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("cap") / F.col("w"), "place").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    # in the order of cap / w, sources below the level are full; the first that isn't sets the level of all after it
    levelled = placed.withColumn("level", level)
    final = F.min(F.when(F.col("cap") / F.col("w") >= F.col("level"), F.struct(F.col("cap") / F.col("w"), "place", "level"))).over(everything)["level"]
    return levelled.withColumn("final", final).select(
        "source", "source_size", F.least("cap", F.coalesce(F.col("w") * F.col("final"), F.col("cap"))).alias("target")
    )


def mix_documents(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    most: float = 3,
    seed: int = 11,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    quality_column: str | None = None,
) -> DataFrame:
    """``docs`` with size, source_size, target, copies (times the mix takes the whole row), border_words (words of
    one more copy that is cut) and taken (words it takes in all).

    ``quality_column`` holds quality weights, such as the classifier's score: a
    document of twice the weight is twice as likely to come next. Null weights
    and those below LEAST_WEIGHT count as that. Without it plain text counts more
    than text full of symbols.
    """
    docs = docs.select(*quoted([c for c in docs.columns if c.lower() not in ADDED]))
    weight, key, at, epochs, cut_key, rest = (free_name(x, docs.columns) for x in ("quality_weight", "mix_key", "mix_source", "epochs", "cut_key", "rest"))
    keyed = docs.withColumns(
        {"size": F.coalesce(F.regexp_count(F.col(text_column), F.lit(WORD)), F.lit(0)).cast("long"), weight: quality_weight(F.col(text_column)) if quality_column is None else F.greatest(F.lit(LEAST_WEIGHT), F.coalesce(F.col(quality_column).cast("double"), F.lit(0.0)))}
    ).withColumn(key, mix_key(F.col(id_column), F.col(text_column), F.col(weight), seed))
    # written once: ranges are found by a first pass over the keys
    light = cut(keyed.select(F.col(source_column).alias("source"), "size", F.col(key).alias("mix_key")))
    # ordered by key within source, in ranges of like size however large one source is
    ranged = cut(light.repartitionByRange("source", "mix_key").withColumn("part", F.spark_partition_id()))
    parts = ranged.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    targets = source_targets(parts.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, most).withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    )
    targets = cut(targets)
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    budget = targets.select("source", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("budget"))
    offsets = parts.withColumn("offset", F.sum("part_size").over(Window.partitionBy("source").orderBy("part")) - F.col("part_size"))
    # only the part of each source in which the budget ends is gone through key by key
    holds = lambda n: (F.col("offset") < F.col("budget")) & (F.col("budget") <= F.col("offset") + F.col(n))
    border = small(offsets.join(budget, same(offsets, budget)).drop(budget["source"]).filter(holds("part_size")).select(F.col("source").alias("s"), F.col("part").alias("p"), "offset", "budget"))
    keys = (
        ranged.join(border, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
        .groupBy("s", "p", "offset", "budget", "mix_key")
        .agg(F.sum("size").alias("key_size"), F.count(F.lit(1)).alias("n"))
        .withColumn("offset", F.col("offset") + F.sum("key_size").over(Window.partitionBy("s", "p").orderBy("mix_key")) - F.col("key_size"))
        .filter(holds("key_size"))
        .select("s", F.col("mix_key").alias("cut_key"), F.floor((F.col("budget") - F.col("offset")) / F.col("n")).alias("rest"))
    )
    plan = targets.join(keys, targets["source"].eqNullSafe(keys["s"]), "left").select(
        F.col("source").alias(at), "source_size", "target", F.col("epochs").alias(epochs), F.col("cut_key").alias(cut_key), F.col("rest").alias(rest)
    )
    plan = small(cut(plan))
    border_words = F.when(F.col(key) == F.col(cut_key), F.least(rest, "size")).otherwise(0)
    copies = F.col(epochs) + F.when(F.col(key) < F.col(cut_key), 1).otherwise(0)
    return (
        keyed.join(plan, keyed[source_column].eqNullSafe(plan[at]))
        .withColumns({"copies": copies.cast("int"), "border_words": border_words})
        .withColumn("taken", F.col("copies") * F.col("size") + F.col("border_words"))
        .drop(at, weight, key, epochs, cut_key, rest)
    )


def small(df: DataFrame) -> DataFrame:
    """Broadcast ``df`` if it has few rows; else leave the join to Spark."""
    return F.broadcast(df) if df.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else df


def repeat_rows(mixed: DataFrame, text_column: str = "text") -> DataFrame:
    """Each row as many times as the mix takes it; a border document's last copy has its first words, joined by spaces."""
    n = F.col("copies") + F.when(F.col("border_words") > 0, 1).otherwise(0)
    cut_text = F.array_join(F.slice(F.regexp_extract_all(F.col(text_column), F.lit(WORD), F.lit(0)), 1, F.col("border_words").cast("int")), " ")
    copy = free_name("copy", mixed.columns)
    return (
        mixed.filter(n > 0)
        .withColumn(copy, F.explode(F.sequence(F.lit(1), n.cast("int"))))
        .withColumn(text_column, F.when(F.col(copy) > F.col("copies"), cut_text).otherwise(F.col(text_column)))
        .drop(copy)
    )
