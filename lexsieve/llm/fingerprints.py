"""Document fingerprints of closed syncmers.

A text is a row of units: its words, and the code points of words too long to be words (scripts
without spaces, encoded runs). A run of K units is an anchor if the smallest hash among its inner
runs of S units is at one of its edges. That is decided by the K units alone, so the same passage gives
the same anchors wherever it stands, and the anchors of two texts can be matched by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexsieve.llm.common import code_points, let, named, packed, parallelism, unpacked

K = 5
S = 2
LONGEST_WORD = 24
# A whole word of up to LONGEST_WORD characters, else one character of a longer one.
UNIT = rf"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]{{1,{LONGEST_WORD}}}+(?![^\x20\x09-\x0D])|[^\x20\x09-\x0D]"


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """Array of (pos, hash): the closed syncmers of a text, in order of their first unit.

    A text with units but without a closed syncmer (always below ``k`` units, never from
    2k - s - 1 on) has one anchor for all its units; an empty or null text has none.
    """
    units = F.regexp_extract_all(code_points(text), F.lit(UNIT), F.lit(0))
    hashes = F.transform(units, lambda w: F.xxhash64(w))
    inner = k - s + 1

    def of(x: Column) -> Column:
        small = F.transform(x, lambda h, i: F.xxhash64(h, *[F.get(x, i + j) for j in range(1, s)]))
        n = F.size(x)

        def chosen(y: Column) -> Column:
            def closed(i: Column) -> Column:
                middle = [F.get(y, i + j) for j in range(1, inner - 1)]
                return F.least(F.get(y, i), F.get(y, i + inner - 1)) <= F.least(*middle)

            at = F.filter(F.sequence(F.lit(0), n - k), closed)
            return F.transform(at, lambda i: F.struct(
                i.alias("pos"), F.xxhash64(*[F.get(x, i + j) for j in range(k)]).alias("hash")
            ))

        whole = F.struct(F.lit(0).alias("pos"), F.aggregate(
            x, F.lit(0).cast("long"), lambda a, h: F.xxhash64(a, h)
        ).alias("hash"))
        none = F.array().cast("array<struct<pos:int,hash:bigint>>")
        return let(
            F.when(n >= k, let(small, chosen)).otherwise(none),
            lambda found: F.when((F.size(found) == 0) & (n > 0), F.array(whole)).otherwise(found),
        )

    return let(hashes, of)


def fingerprint(found: Column) -> Column:
    """The anchors' hashes as text, 8 hexadecimal digits each, in order of position."""
    digits = F.transform(found, lambda a: F.lpad(F.hex(a["hash"].bitwiseAND(0xFFFFFFFF)), 8, "0"))
    return F.lower(F.array_join(digits, ""))


def likeness(a: Column, b: Column) -> Column:
    """Share of the different anchors of either text that both have (1 for two without)."""

    def of(x: Column) -> Column:
        both = F.size(F.array_intersect(x["a"], x["b"]))
        either = F.size(x["a"]) + F.size(x["b"]) - both
        return F.when(either == 0, F.lit(1.0)).otherwise(both / either)

    hashes = [F.array_distinct(F.transform(x, lambda y: y["hash"])) for x in (a, b)]
    return let(F.struct(hashes[0].alias("a"), hashes[1].alias("b")), of)


def in_place(a: Column, b: Column) -> Column:
    """How many anchors of two texts match by position: equal ones that are equally far apart in both.

    Anchors with the same hash are paired in order of position where they are next to one another in
    the sorted anchors of both texts; of the distances between the two of a pair the most common
    one counts. A passage that moved as a whole is found where it went.
    """

    def side(found: Column, sign: int) -> Column:
        return F.transform(found, lambda x: F.struct(
            x["hash"].alias("hash"), F.lit(sign).alias("side"), x["pos"].alias("pos")
        ))

    def distances(x: Column) -> Column:
        def one(own: Column, i: Column) -> Column:
            other = F.get(x, i + 1)
            pair = (other["hash"] == own["hash"]) & (other["side"] > own["side"])
            return F.when(pair, other["pos"] - own["pos"])

        return F.array_sort(F.filter(F.transform(x, one), lambda d: d.isNotNull()))

    def longest_run(d: Column) -> Column:
        def step(state: Column, value: Column) -> Column:
            n = F.when(value == state["value"], state["n"] + 1).otherwise(F.lit(1))
            return F.struct(value.alias("value"), n.alias("n"), F.greatest(state["most"], n).alias("most"))

        start = F.struct(F.lit(0).alias("value"), F.lit(0).alias("n"), F.lit(0).alias("most"))
        return F.aggregate(d, start, step, lambda s: s["most"])

    both = F.array_sort(F.concat(side(a, 0), side(b, 1)))
    return let(let(both, distances), longest_run)


def _bucket(key: Column, splits: list[int]) -> Column:
    """How many of the sorted splits are below the key: found in two short steps."""
    if not splits:
        return F.lit(0)
    width = max(1, round(len(splits) ** 0.5))
    groups = [splits[i : i + width] for i in range(0, len(splits), width)]
    tops = F.array(*[F.lit(g[-1]).cast("long") for g in groups])
    nested = F.array(*[F.array(*[F.lit(v).cast("long") for v in g]) for g in groups])
    group = F.size(F.filter(tops, lambda v: v < key))
    inside = F.coalesce(F.size(F.filter(F.get(nested, group), lambda v: v < key)), F.lit(0))
    return F.when(group == len(groups), F.lit(len(splits))).otherwise(
        group * width + inside
    ).cast("int")


def with_next(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows with ``next_text``: the text of the next row by descending key, and after the
    last row that of the first. One shuffle of the texts.

    Keys are whole numbers; null keys come last, rows of one key are ordered by their texts.
    Keys are cut into ranges of about equal numbers of rows, one per partition. The first rows
    of a range are also sent to the range before it, as guests, so every row finds its
    successor in its own range. One split and one first key per range pass through the driver.
    """
    lowest = -(2**63)
    rows = packed(
        df, ["next_text"], text=code_points(named(text)),
        key=F.coalesce(named(key).cast("long"), F.lit(lowest)), null_key=named(key).isNull(),
    )
    ranges = parallelism(df.sparkSession)
    shares = [i / ranges for i in range(1, ranges)]
    found = rows.select(F.percentile_approx("key", shares, 10_000).alias("s")).first()["s"] if shares else []
    splits = sorted(set(found or []))
    bucketed = rows.withColumn("bucket", _bucket(F.col("key"), splits))
    heads = dict(bucketed.groupBy("bucket").agg(F.max("key")).collect())
    present = sorted(heads, reverse=True)
    # The first key of each range -> the range that has its rows as guests.
    host = {heads[b]: present[i - 1] for i, b in enumerate(present)}
    guests = df.sparkSession.createDataFrame(list(host.items()), "key long, host int")
    to = F.when(F.col("host").isNull(), F.array(F.struct(F.col("bucket"), F.lit(0).alias("guest")))).otherwise(
        F.array(
            F.struct(F.col("bucket"), F.lit(0).alias("guest")),
            F.struct(F.col("host").alias("bucket"), F.lit(1).alias("guest")),
        )
    )
    sent = bucketed.join(F.broadcast(guests), "key", "left").select(
        "row", "text", "key", "null_key", F.explode(to).alias("to")
    ).select("row", "text", "key", "null_key", "to.*")
    order = Window.partitionBy("bucket").orderBy("guest", F.desc("key"), "null_key", "text")
    placed = sent.repartitionById(len(splits) + 1, "bucket").withColumn("next_text", F.lead("text").over(order))
    return unpacked(placed.filter("guest = 0"), "next_text")


def edited(text: Column, other: Column) -> Column:
    """The text with its last floor(n/3) code points put as the first as many of another."""
    n = F.length(text)
    cut = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(other, F.lit(1), cut))
