"""A dictionary of a corpus's tokens: each different token is numbered, and worked on, once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexsieve.functions.stem import stem_tokens
from lexsieve.operators.terms import (
    HOT_SHARE,
    counted_hits,
    dealt,
    gathered,
    numbered,
    patch_tokens,
    row_key,
    term_counts,
    token_rows,
    tokens_of,
)
from lexsieve.sources.shared import settle


def token_dictionary(df: DataFrame, col: str) -> DataFrame:
    """(term, n, id): the tokens of a text or array column, how often each occurs, and its number.

    The most frequent token is 0, equal counts in order of the token, so that small numbers stand
    for most of a corpus. The table is written once.
    """
    counts = term_counts(df, tokens_of(df, col))
    return settle(numbered(counts, F.desc("n"), F.col("term")))


def encode_tokens(df: DataFrame, key: str | None, col: str, dictionary: DataFrame, out: str = "ids") -> DataFrame:
    """Add the tokens' numbers, an array of bigint, in their order.

    ``dictionary`` is a :func:`token_dictionary` of this or another corpus; tokens that it does not have
    are left out. A null text stays null.
    """
    df, key = row_key(df, key)
    tokens = tokens_of(df, col)
    table = dictionary.select("term", "n", F.col("id").alias("word"))
    hits = counted_hits(df, key, lambda rows: token_rows(rows, key, tokens), table)
    return _listed(df, key, F.col(col).isNotNull(), hits, "bigint", out)


def decode_tokens(df: DataFrame, key: str | None, col: str, dictionary: DataFrame, out: str = "tokens") -> DataFrame:
    """Add the tokens that an array of numbers stands for; numbers not in the dictionary are left out.

    Frequent tokens have the smallest numbers, so those below HOT_SHARE are joined by broadcast and no
    other is frequent enough to fill a task.
    """
    df, key = row_key(df, key)
    rows = dealt(df, key).select(key, F.posexplode(col).alias("pos", "number"))
    table = dictionary.select(F.col("id").alias("number"), F.col("term").alias("word"))
    few, many = F.col("number") < HOT_SHARE, F.col("number") >= HOT_SHARE
    hot = rows.filter(few).join(F.broadcast(table.filter(few)), "number")
    hits = [hot, rows.filter(many).join(table, "number")]
    return _listed(df, key, F.col(col).isNotNull(), hits, "string", out)


def _listed(df: DataFrame, key: str, present, hits: list[DataFrame], kind: str, out: str) -> DataFrame:
    joined = gathered(df.withColumn("_present", present), key, hits, "word")
    value = F.when(F.col("_present"), F.coalesce("_changes.word", F.array().cast(f"array<{kind}>")))
    return joined.withColumn(out, value).drop("_changes", "_present", "_row")


def stems_of(counts: DataFrame, extended: bool = True) -> DataFrame:
    """Add ``stem`` to a table of terms."""
    return counts.withColumn("stem", F.get(stem_tokens(F.array("term"), 0, extended), F.lit(0)))


def stem_terms(
    df: DataFrame, key: str | None, col: str, min_len: int = 3, extended: bool = True, out: str = "stems"
) -> DataFrame:
    """Add the stems of the tokens, those of at least ``min_len`` characters.

    As :func:`lexsieve.functions.stem_tokens`, but each different token of the corpus is stemmed once,
    and only tokens whose stem differs are shuffled. Use the function on streams.
    """
    df, key = row_key(df, key)
    tokens = tokens_of(df, col)
    counts = settle(term_counts(df, tokens))
    kept = F.when(F.length("stem") >= min_len, F.col("stem"))
    table = settle(stems_of(counts, extended).select("term", "n", kept.alias("word")))
    changed = ~F.col("word").eqNullSafe(F.col("term"))
    hits = counted_hits(df, key, lambda rows: token_rows(rows, key, tokens), table, changed)
    return patch_tokens(df, key, tokens, hits, out)
