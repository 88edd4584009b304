"""Noun lemmas by detachment rules checked against a dictionary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexsieve.functions.tokens import keep_longer
from lexsieve.operators.terms import dealt, join_given_terms, patch_tokens, row_key, token_rows, tokens_of

# Noun endings and what they stand for in the base form.
NOUN_ENDINGS = [
    ("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"),
    ("shes", "sh"), ("men", "man"), ("ies", "y"),
]


def inflected_forms(lemmas: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """The changes a dictionary implies: (term, word), one row per inflected form.

    Rules are run backwards, from dictionary word to form, so the table depends on
    the dictionary alone and has at most nine rows per word: the corpus is never
    searched for candidates. Of several base forms the shortest wins, and a form that
    is itself in the dictionary stays unless a base form is shorter.
    ``exceptions`` (form, word) lists irregular forms, for which no rule is tried.
    """
    base = lemmas.select(F.col("word")).distinct()
    endings = F.array(
        *[
            F.struct(F.lit(form).alias("form"), F.lit(word).alias("word"), F.lit(i).alias("rank"))
            for i, (form, word) in enumerate(NOUN_ENDINGS, start=1)
        ]
    )
    by_rule = base.select(
        "word",
        F.explode(F.filter(endings, lambda e: F.col("word").endswith(e["word"]))).alias("rule"),
    ).select(
        F.concat(
            F.substring("word", F.lit(1), F.length("word") - F.length("rule.word")), F.col("rule.form")
        ).alias("term"),
        "word",
        F.col("rule.rank").alias("rank"),
    )
    itself = base.select(F.col("word").alias("term"), "word", F.lit(0).alias("rank"))
    if exceptions is not None:
        listed = exceptions.select(F.col("form").alias("term"), "word").distinct()
        by_rule = by_rule.join(listed, "term", "left_anti")
        known = listed.join(base, "word", "left_semi")
        itself = itself.unionByName(known.select("term", "word", F.lit(1).alias("rank")))
    best = (
        by_rule.unionByName(itself)
        .groupBy("term")
        .agg(F.min(F.struct(F.length("word").alias("size"), "rank", "word")).alias("best"))
    )
    return best.select("term", F.col("best.word").alias("word")).filter("term <> word")


def lemma_hits(
    df: DataFrame, key: str, tokens: Column, lemmas: DataFrame, exceptions: DataFrame | None = None
) -> DataFrame:
    """The tokens that change: (key, pos, word)."""
    forms = inflected_forms(lemmas, exceptions)
    return join_given_terms(token_rows(dealt(df, key), key, tokens), forms).select(key, "pos", "word")


def lemmatize_tokens(
    df: DataFrame,
    key: str | None,
    col: str,
    lemmas: DataFrame,
    min_len: int = 3,
    out: str = "lemmas",
    exceptions: DataFrame | None = None,
) -> DataFrame:
    """Add the noun lemmas of the tokens, those of at least ``min_len`` characters.

    ``lemmas`` has a column ``word``. Tokens the dictionary cannot explain stay.
    ``key`` tells the rows apart; with None they are numbered.
    """
    df, key = row_key(df, key)
    tokens = tokens_of(df, col)
    hits = lemma_hits(df, key, tokens, lemmas, exceptions)
    return patch_tokens(df, key, tokens, hits, out).withColumn(out, keep_longer(out, min_len))
