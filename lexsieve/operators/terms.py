"""Shared steps of the operators that look up tokens in a table of terms.

The shape is always the same. Token occurrences are looked up in the table; only
those that change come back, as (key, pos, word); they are gathered per document
and patched into its token array. Texts move at most once, unchanged tokens never.

Two things could overload one task, and both are met here. A frequent term, when
occurrences are shuffled by term: terms that make up a noticeable share of all
occurrences are few by arithmetic, so they are broadcast and kept out of the
shuffle. A caller's table that is too big to broadcast: its size is measured, and
beyond the bound a Bloom filter of its terms, whose size is fixed, keeps all other
tokens out of the shuffle, and of those left the frequent ones are counted and broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType

from lexsieve.functions.tokens import apply_changes, tokenize
from lexsieve.sources.shared import settle

# A term is frequent if it has at least 1/HOT_SHARE of all occurrences, so there
# are at most HOT_SHARE such terms, and together they hold at most HOT_SHARE
# average terms' worth of bytes, however large the corpus.
HOT_SHARE = 10_000
BROADCAST_BYTES = 64 * 1024 * 1024
# 64-bit words of a Bloom filter at most: 16 MB with their numbers.
BLOOM_WORDS = 1 << 20
# Bytes of the most frequent terms that are broadcast, beyond those that HOT_SHARE asks for.
HOT_BYTES = 32 * 1024 * 1024
# Bytes of a table, by Spark's estimate, in a partition dealt out by key, and how many of these there may be.
PART_BYTES = 4 * 1024 * 1024
MOST_PARTS = 1 << 15
ROW = "_row"


def tokens_of(df: DataFrame, col: str) -> Column:
    """The tokens of a text column, or of an array column its items but for nulls."""
    if isinstance(df.schema[col].dataType, ArrayType):
        return F.filter(col, lambda w: w.isNotNull())
    return tokenize(col)


def tells_apart(df: DataFrame, key: str) -> bool:
    """Whether a key is never null and never repeated; only its column is read."""
    keys = df.select(F.col(key).alias("k"))
    return keys.groupBy("k").count().filter("count > 1 OR k IS NULL").isEmpty()


def row_key(df: DataFrame, key: str | None) -> tuple[DataFrame, str]:
    """The table and the column that tells its rows apart.

    A key that does so is taken. Without one, or with one that is repeated or null, the rows are
    numbered and the key is a column like others. The numbered table is written once, as numbers
    given anew in a second pass could differ; :func:`patch_tokens` takes them off again.
    """
    if key is not None and tells_apart(df, key):
        return df, key
    return settle(df.withColumn(ROW, F.monotonically_increasing_id())), ROW


def dealt(df: DataFrame, key: str) -> DataFrame:
    """The table dealt out by its key, in partitions whose tokens can be sorted without spilling.

    Tokens looked up in a broadcast table stay where their row is. So they are gathered, and put into
    the row again, without a shuffle: the text's own is the only one.
    """
    spark = df.sparkSession
    # Joins ask for this on one side: asked for here, both sides can read the same shuffle.
    df = df.filter(F.col(key).isNotNull())
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if estimate >= 1 << 47:  # Spark does not know
        return df.repartition(least, key)
    return df.repartition(max(least, min(-(-estimate // PART_BYTES), MOST_PARTS)), key)


def made_once(tokens: Column) -> Column:
    """Tokens to explode. Of a plain column Spark also filters the sizes, below any shuffle, for which the
    tokens would be made a second time; an expression has no such filter."""
    return F.coalesce(tokens, F.array().cast("array<string>"))


def token_rows(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """One row per token: (key, pos, term)."""
    return df.select(key, F.posexplode(made_once(tokens)).alias("pos", "term"))


def term_counts(df: DataFrame, tokens: Column) -> DataFrame:
    """Occurrences of each term in the corpus: (term, n)."""
    return df.select(F.explode(made_once(tokens)).alias("term")).groupBy("term").agg(
        F.count("*").alias("n")
    )


def numbered(df: DataFrame, *order: Column | str, name: str = "id") -> DataFrame:
    """Add the place of each row in the order, from 0; the order leaves no ties.

    Rows are dealt out in ranges of the order and written so; a place is that in the range plus the sizes
    of the ranges before it. No task sees more than a range; one number for each reaches the driver.
    """
    dealt = settle(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    starts, start = [], 0
    for part, n in sorted(tuple(r) for r in dealt.groupBy("_range").count().collect()):
        starts.append((part, start))
        start += n
    places = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    before = df.sparkSession.createDataFrame(starts, "_range int, _start long")
    return dealt.withColumn("_place", places).join(F.broadcast(before), "_range").select(
        *df.columns, (F.col("_start") + F.col("_place")).alias(name)
    )


def sorted_runs(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(key, words, starts): sorted tokens, and where each run of equal ones starts."""
    words = F.col("words")
    starts = F.transform(
        words, lambda w, i: F.when((i == 0) | (w != F.get(words, i - 1)), i)
    )
    return df.select(key, F.sort_array(tokens).alias("words")).withColumn(
        "starts", F.filter(starts, lambda i: i.isNotNull())
    )


def distinct_terms() -> Column:
    """Each term of a row of :func:`sorted_runs` once."""
    return F.transform("starts", lambda start: F.get("words", start))


def term_frequencies(runs: DataFrame, key: str) -> DataFrame:
    """(key, term, tf) from :func:`sorted_runs`: counted in place, without a shuffle.

    The array is exploded as an expression, not as a column: for a column Spark adds
    a filter on its size, which would work out the array a second time.
    """
    words, starts = F.col("words"), F.col("starts")

    def run(start: Column, j: Column) -> Column:
        end = F.coalesce(F.get(starts, j + 1), F.size(words))
        return F.struct(F.get(words, start).alias("term"), (end - start).cast("bigint").alias("tf"))

    return runs.select(key, F.explode(F.transform(starts, run)).alias("t")).select(key, "t.*")


def join_counted_terms(
    rows: DataFrame, table: DataFrame, wanted: Column | None = None
) -> DataFrame:
    """Inner join of ``rows`` with a per-term table that grows with the corpus.

    ``table`` is a settled table with a row for each term of the rows and its number
    ``n`` of rows; ``wanted`` tells which of its rows matter. Frequent terms are joined
    in place, if any is wanted; the others are shuffled, and none of them has more
    than 1/HOT_SHARE of the rows.
    """
    total = table.agg(F.sum("n").alias("total")).first()["total"] or 0
    wanted = F.lit(True) if wanted is None else wanted
    hot = table.filter(F.col("n") * HOT_SHARE >= total)
    cold = table.filter((F.col("n") * HOT_SHARE < total) & wanted)
    others = rows.join(F.broadcast(hot.select("term")), "term", "left_anti")
    joined = others.join(cold, "term")
    hot_wanted = hot.filter(wanted)
    if hot_wanted.isEmpty():
        return joined
    return rows.join(F.broadcast(hot_wanted), "term").unionByName(joined)


def _least_frequent(table: DataFrame, total: int) -> int:
    """The number ``n`` from which a term is broadcast: all terms with 1/HOT_SHARE of the rows are, and
    of the others the most frequent, as long as these take at most HOT_BYTES.

    Sizes are added up by powers of two of ``n``, of which there are at most 64.
    """
    size = F.octet_length("term") + 16 * (len(table.columns) + 1)
    for field in table.schema.fields:
        if field.name != "term" and isinstance(field.dataType, StringType):
            size = size + F.coalesce(F.octet_length(field.name), F.lit(0))
        elif isinstance(field.dataType, ArrayType):
            size = size + F.coalesce(F.octet_length(F.to_json(field.name)), F.lit(0))
    power = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    levels = table.groupBy(power.alias("power")).agg(F.sum(size).alias("bytes")).collect()
    least, taken = -(-total // HOT_SHARE), 0
    for power, held in sorted(((r["power"], r["bytes"]) for r in levels), reverse=True):
        taken += held
        if taken > HOT_BYTES:
            break
        least = min(least, 1 << power)
    return max(least, 1)


def counted_hits(
    df: DataFrame, key: str, rows_of: Callable[[DataFrame], DataFrame], table: DataFrame, wanted: Column | None = None,
    in_place: bool = True,
) -> list[DataFrame]:
    """As :func:`join_counted_terms` of ``rows_of(df)``, in one or two tables: of the frequent terms, joined in
    place in the rows :func:`dealt` out (unless ``in_place`` is False), and of the others, which are shuffled.

    As many terms are frequent as may be broadcast, so that few rows are shuffled; none is if all terms fit.
    """
    total = table.agg(F.sum("n").alias("total")).first()["total"] or 0
    least = _least_frequent(table, total)
    wanted = F.lit(True) if wanted is None else wanted
    hot, cold = table.filter(F.col("n") >= least), table.filter((F.col("n") < least) & wanted)
    found = [rows_of(dealt(df, key) if in_place else df).join(F.broadcast(hot.filter(wanted)), "term")]
    if cold.isEmpty():
        return found
    others = rows_of(df).join(F.broadcast(hot.select("term")), "term", "left_anti")
    return [*found, others.join(cold, "term")]


def gathered(df: DataFrame, key: str, hits: Sequence[DataFrame], *fields: str) -> DataFrame:
    """``df``, dealt out by ``key``, with ``_changes``: the (pos, ...) of its hits in all the tables, sorted
    by pos; null if there are none."""
    joined = dealt(df, key)
    listed = []
    for i, found in enumerate(hits):
        changes = found.groupBy(F.col(key).alias(f"_key_{i}")).agg(
            F.sort_array(F.collect_list(F.struct("pos", *fields))).alias(f"_changes_{i}")
        )
        joined = joined.join(changes, F.col(key) == F.col(f"_key_{i}"), "left")
        listed.append(F.col(f"_changes_{i}"))
    if len(listed) == 1:
        value = listed[0]
    else:
        one, two = listed
        both = F.sort_array(F.concat(one, two))
        value = F.when(one.isNull(), two).when(two.isNull(), one).otherwise(both)
    names = [f"_{x}_{i}" for x in ("key", "changes") for i in range(len(hits))]
    return joined.withColumn("_changes", value).drop(*names)


def fits_broadcast(table: DataFrame) -> bool:
    """Whether the rows of a table take at most BROADCAST_BYTES."""
    size = F.lit(16 * (len(table.columns) + 1))
    for field in table.schema.fields:
        if isinstance(field.dataType, (StringType, BinaryType)):
            size = size + F.coalesce(F.octet_length(field.name), F.lit(0))
    measured = table.agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()["bytes"]
    return measured <= BROADCAST_BYTES


def _bloom_place(on: str, words: int) -> tuple[Column, Column]:
    """The word of a Bloom filter that a term sets bits in, and these three bits."""
    h = F.xxhash64(on)

    def bit(shift: int) -> Column:
        at = F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(63)).cast("int")
        return F.call_function("shiftleft", F.lit(1).cast("long"), at)

    return h.bitwiseAND(F.lit(words - 1)), bit(24).bitwiseOR(bit(36)).bitwiseOR(bit(48))


def bloom_filter(table: DataFrame, on: str = "term") -> tuple[DataFrame, int]:
    """(word, bits) of a Bloom filter of a table's terms, and how many words it may have.

    All bits of a term are in one 64-bit word, so the filter is a table that one look-up tests. It
    has 16 bits for a term, up to BLOOM_WORDS words: beyond, it lets more through, never less.
    """
    n = table.count()
    words = 64
    while words * 4 < n and words < BLOOM_WORDS:
        words *= 2
    word, bits = _bloom_place(on, words)
    return table.select(word.alias("word"), bits.alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits")), words


def maybe_listed(rows: DataFrame, table: DataFrame, on: str = "term") -> DataFrame:
    """The rows whose term a Bloom filter of the table lets through: all that are in it, and few others."""
    bloom, words = bloom_filter(table, on)
    word, bits = _bloom_place(on, words)
    bloom = F.broadcast(bloom.select(F.col("word").alias("_word"), F.col("bits").alias("_bits")))
    tested = rows.join(bloom, word == F.col("_word"))
    return tested.filter(F.col("_bits").bitwiseAND(bits) == bits).drop("_word", "_bits")


def join_given_terms(
    rows: DataFrame, table: DataFrame, on: str = "term", small: bool | None = None
) -> DataFrame:
    """Inner join of ``rows`` with a caller's table of terms.

    A table of checked size is broadcast. Of a bigger one a Bloom filter is, so that only rows
    with a term of the table (and few others) are kept and written once. Among these, frequent
    terms are counted; their few rows of the table are broadcast, the others are shuffled, and none of
    them has more than 1/HOT_SHARE of the rows. The table is never copied.
    """
    small = fits_broadcast(table) if small is None else small
    if small:
        return rows.join(F.broadcast(table), on)
    table = settle(table)
    likely = settle(maybe_listed(rows, table, on))
    counts = settle(likely.groupBy(on).agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n").alias("total")).first()["total"] or 0
    hot = counts.filter(F.col("n") * HOT_SHARE >= total).select(on)
    cold = likely.join(F.broadcast(hot), on, "left_anti").join(table, on)
    if hot.isEmpty():
        return cold
    return likely.join(F.broadcast(table.join(F.broadcast(hot), on, "left_semi")), on).unionByName(cold)


def patch_tokens(
    df: DataFrame, key: str, tokens: Column, hits: DataFrame | Sequence[DataFrame], out: str
) -> DataFrame:
    """Add ``out``: the tokens with ``hits`` (key, pos, word) put in.

    ``key`` tells the rows of ``df`` apart and is never null. A document's hits are never more than its
    tokens; tokens are made after the join, so only the text itself is shuffled.
    """
    hits = [hits] if isinstance(hits, DataFrame) else hits
    joined = gathered(df, key, hits, "word").withColumn("_tokens", tokens)
    patched = apply_changes(F.col("_tokens"), F.col("_changes"))
    return joined.withColumn(out, patched).drop("_changes", "_tokens", ROW)
