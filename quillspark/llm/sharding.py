"""Sharding by a two-pass external shuffle, with SQL functions only.

Pass one scatters the records evenly over buckets small enough for memory, by
a seeded hash of id and text: to tasks first, each of which splits its share
into buckets. Pass two puts each bucket, taken as an array in
hash order, into a random order with ``shuffle`` (a seeded Fisher-Yates
shuffle; its numbers come from seed and partition, so another number of
partitions gives another order). The buckets in turn make one long random order, which is cut into
shards of equal length: numbers of rows differ by one at most (law ``rows``).

Null texts and empty texts have size 1, and null ids are hashed like any
value. Equal texts scatter by their ids, so a group of copies never meets in
one bucket. Rows equal in id and text share one, unless they are very many: then
rows that are equal altogether are summed up, and each copy is dealt by its
number. Very long texts take more of their bucket. Other columns are carried along
unchanged; those named like a result column are replaced. Fewer rows than
shards fill the first shards with a row each; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm._tables import free_name, quoted

#: Text bytes that a bucket holds on average, and buckets that a task splits its share into at most.
BUCKET_BYTES, BUCKETS_A_TASK = 4 << 20, 32
#: Equal rows of more bytes than so many buckets hold are dealt one by one.
EQUAL_BUCKETS = 8
#: Buckets whose counts are summed together before the sums themselves are.
STRIDE = 4096


def text_size(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long") + 1


def running_offsets(counts: DataFrame, bucket: str, n: str) -> DataFrame:
    """(bucket, offset): rows in the buckets before, in two levels so that no task sees all buckets."""
    group = counts.withColumn("g", F.floor(F.col(bucket) / STRIDE))
    outer = group.groupBy("g").agg(F.sum(n).alias("all")).withColumn("base", F.sum("all").over(Window.orderBy("g")) - F.col("all"))
    inner = F.sum(n).over(Window.partitionBy("g").orderBy(bucket)) - F.col(n)
    return group.withColumn("inner", inner).join(outer.select("g", "base"), "g").select(bucket, (F.col("base") + F.col("inner")).alias("offset"))


def shard_documents(
    docs: DataFrame, shards: int = 16, seed: int = 20, bucket_bytes: int = BUCKET_BYTES, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """All columns of ``docs`` with size, shard and slot (gapless from 0 in each shard)."""
    kept = [c for c in docs.columns if c.lower() not in ("size", "shard", "slot")]
    docs = docs.select(*quoted(kept))
    record, bucket, order = (free_name(x, kept) for x in ("record", "bucket", "order"))
    rows, total = docs.agg(F.count(F.lit(1)), F.sum(text_size(F.col(text_column)))).first()
    buckets = max(1, -(-(total or 0) // bucket_bytes))
    h = F.xxhash64(F.lit(seed), F.col(id_column), F.col(text_column))

    def scatter(rows: DataFrame, key: Column) -> DataFrame:
        x = F.struct(F.xxhash64(F.lit(seed + 1), key).alias(order), F.struct(*quoted(kept)).alias(record), text_size(F.col(text_column)).alias("size"))
        return rows.select(F.pmod(key, F.lit(buckets)).alias(bucket), x.alias("x"))

    # at most an eighth as many as buckets
    equal = docs.groupBy(h.alias("h")).agg(F.sum(text_size(F.col(text_column))).alias("bytes")).filter(F.col("bytes") > EQUAL_BUCKETS * bucket_bytes)
    hot = [r.h for r in equal.select("h").collect()]
    if hot:
        times, copy = free_name("times", kept), free_name("copy", kept)
        equal = docs.filter(h.isin(hot)).groupBy(*quoted(kept)).agg(F.count(F.lit(1)).alias(times))
        equal = equal.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))))
        scattered = scatter(docs.filter(~h.isin(hot)), h).unionByName(scatter(equal, F.xxhash64(h, F.col(copy))))
    else:
        scattered = scatter(docs, h)
    offsets = running_offsets(scattered.groupBy(bucket).agg(F.count(F.lit(1)).alias("n")), bucket, "n")
    by_hash = lambda a, b: F.when(a[order] < b[order], -1).when(a[order] > b[order], 1).otherwise(0)
    # the arrays of one task stay near BUCKETS_A_TASK buckets' size
    tasks = min(buckets, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-buckets // BUCKETS_A_TASK)))
    filled = scattered.repartition(tasks, bucket).groupBy(bucket).agg(F.array_sort(F.collect_list("x"), by_hash).alias("xs"))
    shuffled = filled.join(offsets, bucket).sortWithinPartitions(bucket).select("offset", F.posexplode(F.shuffle("xs", seed)).alias("pos", "x"))
    at, low, extra = F.col("at"), rows // shards, rows % shards
    head = extra * (low + 1)
    return shuffled.select("x", (F.col("offset") + F.col("pos")).alias("at")).select(
        f"x.{record}.*",
        "x.size",
        F.when(at < head, F.floor(at / (low + 1))).otherwise(extra + F.floor((at - head) / max(low, 1))).cast("int").alias("shard"),
        F.when(at < head, at % (low + 1)).otherwise((at - head) % max(low, 1)).cast("long").alias("slot"),
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """Parquet, a folder for each shard, files in slot order; ranges of slots, so that a shard is written by many tasks."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
