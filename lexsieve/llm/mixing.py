"""Mixing sources to target weights.

Sizes are added up per source, repetition rates derived from the targets, and each
document is taken floor(rate) times plus once more with a probability equal to the rest,
decided by a hash of its id, its text and, of equal rows, its number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexsieve.llm.common import WORD, code_points, named, packed, unpacked
from lexsieve.operators.terms import BROADCAST_BYTES
from lexsieve.sources.shared import settle

OUTPUTS = ["size", "source_size", "target", "copies"]
SALTS = 64
SOURCE_KEY = ["no_source", "source_key"]


def word_count(text: Column) -> Column:
    return F.regexp_count(code_points(text), F.lit(WORD)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """Add ``rank``: the place of each source by code point, null last, from 0.

    Sources are dealt out in ranges, so that a rank is a place in a range plus the sizes of
    the ranges before it; no task sees all sources. One range per partition is counted in
    the driver.
    """
    dealt = settle(
        sources.repartitionByRange(*SOURCE_KEY).withColumn("range", F.spark_partition_id())
    )
    before, start = [], 0
    for part, n in sorted(dealt.groupBy("range").count().collect()):
        before.append((part, start))
        start += n
    starts = sources.sparkSession.createDataFrame(before, "range int, start long")
    place = F.row_number().over(Window.partitionBy("range").orderBy(*SOURCE_KEY)) - 1
    return dealt.withColumn("place", place).join(F.broadcast(starts), "range").select(
        *SOURCE_KEY, "source_size", (F.col("start") + F.col("place")).alias("rank")
    )


def source_targets(
    sizes: DataFrame, weights: Sequence[int], share: float, most: int
) -> DataFrame:
    """(no_source, source_key, source_size, target) from rows of (no_source, source_key, size).

    The targets share ``share`` times all sizes by weight. One above ``most`` times its
    source's size stops there, and what it leaves is shared by weight among the others,
    until none is above. Each round is one small aggregation and at least one source stops in
    each but the last; only sums pass through the driver.
    """
    sources = sizes.groupBy(*SOURCE_KEY).agg(F.sum("size").alias("source_size"))
    weight = F.element_at(
        F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")
    )
    ranked = settle(_ranked(sources).withColumn("weight", weight.cast("long")))
    cap = F.col("source_size") * most
    total = ranked.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    level, stopped = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) > cap
        sums = ranked.agg(
            F.count_if(above).alias("n"),
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0)).alias("held"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)).alias("free"),
        ).first()
        if sums["n"] == stopped or not sums["free"]:
            break
        stopped, level = sums["n"], (total * share - sums["held"]) / sums["free"]
    target = F.least(cap.cast("double"), F.col("weight") * F.lit(level))
    return ranked.select(*SOURCE_KEY, "source_size", target.alias("target"))


def draw(seed: int, *parts: Column) -> Column:
    """A number from 0 to 1 that seed and parts alone decide: 52 bits of a digest."""
    told = [F.coalesce(part.cast("string"), F.lit("null")) for part in parts]
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *told))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def _numbered(documents: DataFrame) -> DataFrame:
    """Add ``nth``: a row's number, from 0, among the rows of its ``alike`` (id, text and source).

    Only rows that have an equal are counted, in each partition of the input by itself, so rows
    repeated ever so often are no task's burden; a partition's numbers start where those of the
    partitions before it end. Which of equal rows has which number makes no difference.
    """
    documents = documents.withColumn("hash", F.xxhash64("alike"))
    repeated = settle(documents.groupBy("hash").count().filter("count > 1").select("hash"))
    if repeated.isEmpty():
        return documents.drop("hash").withColumn("nth", F.lit(0).cast("long"))
    single = documents.join(repeated, "hash", "left_anti").withColumn("nth", F.lit(0).cast("long"))
    group = ["part", "alike"]
    several = documents.withColumn("part", F.spark_partition_id()).join(repeated, "hash", "left_semi")
    before = Window.partitionBy("alike").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = several.groupBy(*group).agg(F.count("*").alias("n")).select(
        *group, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
    )
    own = F.row_number().over(Window.partitionBy(*group).orderBy("hash")) - 1
    counted = several.withColumn("own", own).join(starts, group).withColumn("nth", F.col("start") + F.col("own"))
    return single.drop("hash").unionByName(counted.drop("hash", "part", "own", "start"))


def mix(
    df: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    most: int = 2,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    seed: int = 11,
) -> DataFrame:
    """All documents with ``size`` (words), ``source_size``, ``target`` and ``copies``.

    ``copies`` is how often the mix takes the document: floor(rate) times, and once more with
    the probability of the rest, where rate = target / source_size. ``take`` repeats the rows.

    Texts are not shuffled: sizes are added up before the shuffle by source, and the sources
    are broadcast after a check of their size (beyond it, the join is salted, so a source
    that holds a third of the documents is spread). A null text has size 0, a null source is a
    source, a null id is a value. Rows with the same id, text and source are told apart by number,
    so that of equal rows, too, the right part is taken once more. A source without
    words has the target 0. An empty table gives an empty result.
    """
    documents = packed(
        df, OUTPUTS, key=named(key), size=word_count(named(text)),
        no_source=named(source).isNull(), source_key=code_points(named(source).cast("string")),
        digest=F.md5(code_points(named(text))),
    )
    alike = F.concat_ws("\n", F.coalesce(F.col("key").cast("string"), F.lit("null")), "digest", "no_source", "source_key")
    documents = _numbered(documents.withColumn("alike", F.md5(alike)))
    targets = settle(source_targets(documents.select(*SOURCE_KEY, "size"), weights, share, most))
    bytes_ = F.sum(F.octet_length("source_key") + 40)
    if (targets.agg(bytes_.alias("n")).first()["n"] or 0) <= BROADCAST_BYTES:
        joined = documents.join(F.broadcast(targets), SOURCE_KEY)
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        salt = F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")
        joined = documents.withColumn("salt", salt).join(
            targets.withColumn("salt", salts), [*SOURCE_KEY, "salt"]
        )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor("rate")
    once_more = (draw(seed, F.col("key"), F.col("digest"), F.col("nth")) < F.col("rate") - whole).cast("long")
    mixed = joined.withColumn("rate", rate).withColumn("copies", whole + once_more)
    return unpacked(mixed, *OUTPUTS)


def take(mixed: DataFrame) -> DataFrame:
    """Each document of :func:`mix` as often as it is taken, without the mix's columns."""
    times = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return mixed.filter("copies > 0").withColumn("copies", times).drop(*OUTPUTS)
