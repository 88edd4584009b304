"""Word-by-word translation from a glossary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexsieve.operators.terms import dealt, join_given_terms, patch_tokens, row_key, token_rows, tokens_of


def translate_terms(
    df: DataFrame, key: str | None, col: str, glossary: DataFrame, lang: str, out: str = "translated"
) -> DataFrame:
    """Add the tokens with each glossary term replaced by its target in ``lang``.

    ``glossary`` has columns ``lang``, ``term`` and ``target``; of several targets
    the first in order is taken. Terms not listed stay. ``key`` tells the rows apart; with
    None they are numbered.
    """
    df, key = row_key(df, key)
    tokens = tokens_of(df, col)
    table = (
        glossary.filter(F.col("lang") == lang)
        .groupBy("term")
        .agg(F.min("target").alias("word"))
        .filter("word is not null")
    )
    hits = join_given_terms(token_rows(dealt(df, key), key, tokens), table).select(key, "pos", "word")
    return patch_tokens(df, key, tokens, hits, out)
