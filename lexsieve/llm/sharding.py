"""Sharding by a two-pass external shuffle.

Pass one scatters the records uniformly into buckets by a seeded hash; a bucket is a
partition and fits in memory. Pass two shuffles each bucket (Spark's ``shuffle`` of an
array is a Fisher-Yates shuffle) and writes it to the shared folder. The written
buckets, one after the other, are a random order of all records; shards are equal
stretches of that order.

Law ``rows``: the sizes of two shards differ by one record at most.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexsieve.llm.common import code_points, named, packed, parallelism, unpacked
from lexsieve.sources.shared import settle

OUTPUTS = ["size", "shard", "slot"]
# Bytes of a record besides its text.
RECORD_BYTES = 16


def shuffle_shards(
    df: DataFrame,
    shards: int,
    key: str = "doc_id",
    text: str = "text",
    seed: int = 20_241,
    bucket_bytes: int = 64 * 1024 * 1024,
) -> DataFrame:
    """All records with ``size`` (bytes), ``shard`` and ``slot``, written in random order.

    There are as many buckets as keep each near ``bucket_bytes``, and at least one for each
    shuffle partition. The hash takes in the place of the row in the input, so repeated
    rows, or one key that holds a third of them, spread like all others; give a table read
    from files (or ``settle`` it first), whose rows keep their places when a task is
    repeated. Only the buckets' counts (one number for each ``bucket_bytes`` of input) pass
    through the driver.

    Null texts count as empty, null keys are hashed like any other value, an empty table
    gives an empty result, and columns named like the outputs give way to them.
    """
    spark = df.sparkSession
    size = F.octet_length(code_points(named(text))).cast("long") + RECORD_BYTES
    records = packed(df, OUTPUTS, key=named(key), size=size)
    total = records.agg(F.sum("size").alias("bytes")).first()["bytes"] or 0
    buckets = max(-(-total // bucket_bytes), parallelism(spark))

    place = F.xxhash64(F.lit(seed), "key", F.monotonically_increasing_id())
    scattered = records.withColumn("bucket", F.pmod(place, F.lit(buckets)).cast("int"))
    in_memory = (
        scattered.repartitionById(buckets, "bucket")
        .groupBy("bucket")
        .agg(F.collect_list(F.struct("row", "size")).alias("records"))
    )
    written = settle(
        in_memory.select("bucket", F.posexplode(F.shuffle("records", F.lit(seed))).alias("place", "record"))
        .select("bucket", "place", "record.row", "record.size")
    )

    counts = dict(written.groupBy("bucket").count().collect())
    starts = [0, *accumulate(counts.get(b, 0) for b in range(buckets))]
    n = starts.pop()
    if not n:
        return unpacked(
            written, "size", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")
        )
    offsets = spark.createDataFrame(list(enumerate(starts)), "bucket int, start long")
    ordered = written.join(F.broadcast(offsets), "bucket").withColumn("at", F.col("start") + F.col("place"))
    sharded = ordered.withColumn("shard", F.expr(f"at * {shards} div {n}"))
    first = F.expr(f"(shard * {n} + {shards - 1}) div {shards}")
    return unpacked(
        sharded, "size", F.col("shard").cast("int").alias("shard"), (F.col("at") - first).alias("slot")
    )
