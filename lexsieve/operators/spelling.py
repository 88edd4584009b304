"""Spelling correction against a vocabulary with frequencies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexsieve.operators.terms import (
    counted_hits,
    fits_broadcast,
    join_given_terms,
    made_once,
    patch_tokens,
    row_key,
    term_counts,
    token_rows,
    tokens_of,
)
from lexsieve.sources.shared import settle


def shortened(word: Column, distance: int) -> Column:
    """The word and all it becomes when up to ``distance`` characters are deleted.

    Two words within an edit distance always share one of these (in whole text,
    whatever the edits), so an equality join on them misses no pair.
    """

    def one_less(w: Column) -> Column:
        cuts = F.when(
            F.length(w) > 0,
            F.transform(
                F.sequence(F.lit(1), F.length(w)),
                lambda i: F.concat(
                    F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))
                ),
            ),
        ).otherwise(F.array().cast("array<string>"))
        return F.concat(F.array(w), cuts)

    forms = F.array(word)
    for _ in range(distance):
        forms = F.array_distinct(F.flatten(F.transform(forms, one_less)))
    return forms


def near_pairs(counts: DataFrame, vocab: DataFrame, max_distance: int) -> DataFrame:
    """(term, word, freq, distance): unknown terms with all vocabulary words within ``max_distance``.

    Terms without a letter are left alone, and so are those too long or too short for
    any vocabulary word to be near. A pair may be told more than once.
    """
    vocab = vocab.select("word", "freq")
    longest = vocab.agg(F.max(F.length("word")).alias("longest")).scalar()
    shortest = vocab.agg(F.min(F.length("word")).alias("shortest")).scalar()
    size = F.length("term")
    checked = counts.select("term").filter(
        (size <= longest + max_distance)
        & (size >= shortest - max_distance)
        & F.col("term").rlike("\\p{L}")
    )
    near_words = vocab.select(
        F.explode(shortened(F.col("word"), max_distance)).alias("form"), "word", "freq"
    )
    small = fits_broadcast(near_words)
    known = vocab.select(F.col("word").alias("term"))
    unknown = checked.join(F.broadcast(known) if small else known, "term", "left_anti")
    near_terms = unknown.select(
        F.explode(shortened(F.col("term"), max_distance)).alias("form"), "term"
    )
    # The distance is tested inside the join, and the best word is a minimum, taken
    # before any shuffle: the candidates of a term are never gathered.
    pairs = join_given_terms(near_terms, near_words, on="form", small=small).withColumn(
        "distance", F.levenshtein("term", "word", max_distance)
    )
    return pairs.filter("distance >= 0").select("term", "word", "freq", "distance")


def corrections(counts: DataFrame, vocab: DataFrame, max_distance: int = 1) -> DataFrame:
    """Unknown terms of the corpus with their best vocabulary word: (term, word).

    The best word is the nearest, then the most frequent, then the first in order; see
    :func:`near_pairs` for the terms that have one.
    """
    return (
        near_pairs(counts, vocab, max_distance)
        .groupBy("term")
        .agg(F.min(F.struct("distance", (-F.col("freq")).alias("rank"), "word")).alias("best"))
        .select("term", F.col("best.word").alias("word"))
    )


def spell_correct(
    df: DataFrame, key: str | None, col: str, vocab: DataFrame, max_distance: int = 1, out: str = "corrected"
) -> DataFrame:
    """Add the tokens with each unknown one replaced by its best vocabulary word.

    ``vocab`` has columns ``word`` and ``freq``. A token without a word within
    ``max_distance`` edits stays. Counts and corrections are settled on the way. ``key``
    tells the rows apart; with None they are numbered.
    """
    df, key = row_key(df, key)
    tokens = tokens_of(df, col)
    counts = settle(term_counts(df, tokens))
    table = settle(counts.join(corrections(counts, vocab, max_distance), "term", "left"))
    hits = counted_hits(df, key, lambda rows: token_rows(rows, key, tokens), table, F.col("word").isNotNull())
    return patch_tokens(df, key, tokens, hits, out)


def nearest_words(counts: DataFrame, vocab: DataFrame, max_distance: int = 1) -> DataFrame:
    """(term, words): unknown terms with all the words of ``vocab`` (word, freq) that are nearest to each."""
    pairs = settle(near_pairs(counts, vocab, max_distance).distinct())
    least = pairs.groupBy("term").agg(F.min("distance").alias("distance"))
    words = F.sort_array(F.collect_list(F.struct("word", "freq"))).alias("words")
    return pairs.join(least, ["term", "distance"]).groupBy("term").agg(words)


def _bigram_counts(df: DataFrame, tokens: Column, wanted: DataFrame) -> DataFrame:
    """(term, n): how often each pair of neighbouring tokens in ``wanted`` occurs, as "first second"."""
    pairs = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("_tokens") - 1, F.lit(1))),
        lambda i: F.concat(F.get("_tokens", i - 1), F.lit(" "), F.get("_tokens", i)),
    )
    rows = df.select(tokens.alias("_tokens")).filter("size(_tokens) > 1").select(F.explode(pairs).alias("term"))
    return join_given_terms(rows, wanted).groupBy("term").agg(F.count("*").alias("n"))


def correct_in_context(
    df: DataFrame, key: str | None, col: str, vocab: DataFrame, max_distance: int = 1, out: str = "corrected"
) -> DataFrame:
    """As :func:`spell_correct`, but of words equally near the one is taken that fits its neighbours.

    A noisy channel: equally near words are equally likely misspelt so, and how well a word
    fits is told by how often the corpus has it after the token before and before the token after, each count
    plus one, multiplied. Of equal ones the most frequent, then the first in order is taken. Only pairs
    with a candidate in them are counted.
    """
    df, key = row_key(df, key)
    tokens = tokens_of(df, col)
    counts = settle(term_counts(df, tokens))
    table = settle(counts.join(nearest_words(counts, vocab, max_distance), "term", "left"))

    def around(rows: DataFrame) -> DataFrame:
        each = F.posexplode(made_once(F.col("_tokens"))).alias("pos", "term")
        return rows.select(key, tokens.alias("_tokens")).select(key, "_tokens", each).select(
            key, "pos", "term", F.get("_tokens", F.col("pos") - 1).alias("before"), F.get("_tokens", F.col("pos") + 1).alias("after")
        )

    # What is found is written, not put back in place, so the texts need not be dealt out for it.
    found = reduce(DataFrame.unionByName, counted_hits(df, key, around, table, F.col("words").isNotNull(), in_place=False))
    options = settle(found.select(key, "pos", F.explode("words").alias("w"), "before", "after").select(
        key, "pos", "w.*", F.concat("before", F.lit(" "), "w.word").alias("left"), F.concat("w.word", F.lit(" "), "after").alias("right")
    ))
    pairs = options.select(F.explode(F.array("left", "right")).alias("term")).filter("term is not null").distinct()
    told = settle(_bigram_counts(df, tokens, settle(pairs)))
    for side in ("left", "right"):
        counted = told.select(F.col("term").alias(side), F.col("n").alias(f"n_{side}"))
        options = options.join(counted, side, "left")
    fits = [(F.coalesce(f"n_{side}", F.lit(0)) + 1).cast("decimal(19,0)") for side in ("left", "right")]
    best = F.min(F.struct((-(fits[0] * fits[1])).alias("fit"), (-F.col("freq")).alias("rank"), "word")).alias("best")
    hits = options.groupBy(key, "pos").agg(best).select(key, "pos", F.col("best.word").alias("word"))
    return patch_tokens(df, key, tokens, hits, out)
