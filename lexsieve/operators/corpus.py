"""Operators that need counts over the whole corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import IDF, HashingTF
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexsieve.functions.stopwords import ENGLISH_STOP_WORDS
from lexsieve.functions.tokens import remove_stop_words
from lexsieve.operators.terms import (
    counted_hits,
    distinct_terms,
    join_counted_terms,
    numbered,
    patch_tokens,
    row_key,
    sorted_runs,
    term_counts,
    term_frequencies,
    token_rows,
    tokens_of,
)
from lexsieve.sources.shared import settle

# Up to this many terms, testing each token against a list is cheaper than a join.
LIST_LIMIT = 200


def hashed_tfidf(df: DataFrame, col: str, num_features: int = 3) -> DataFrame:
    """Add ``tokens``, hashed term counts ``tf`` and ``tfidf`` vectors (Spark ML).

    Fitting sends one vector of ``num_features`` numbers to the driver. Rows with a null text
    are kept, with null vectors.
    """
    tokens = df.withColumn("tokens", tokens_of(df, col))
    present = tokens.filter(F.col("tokens").isNotNull())
    tf = HashingTF(inputCol="tokens", outputCol="tf", numFeatures=num_features)
    counted = tf.transform(present)
    weighted = IDF(inputCol="tf", outputCol="tfidf").fit(counted).transform(counted)
    absent = tokens.filter(F.col("tokens").isNull())
    return weighted.unionByName(absent, allowMissingColumns=True)


def doc_terms(df: DataFrame, key: str, col: str) -> DataFrame:
    """Exact document-term table: (key, term, tf, df, tfidf).

    ``tf`` counts the term in the document, ``df`` the documents with the term, and
    ``tfidf = tf * ln((m + 1) / (df + 1))`` over the ``m`` documents with a text.
    ``key`` tells the documents apart. Document counts are settled first.
    """
    runs = sorted_runs(df.filter(F.col(col).isNotNull()), key, tokens_of(df, col))
    # The null term stands for the document itself: one pass counts terms and documents.
    itself = F.array(F.lit(None).cast("string"))
    counts = settle(term_counts(runs, F.concat(itself, distinct_terms())))
    documents = counts.filter("term is null").first()
    idf = F.log(F.lit((documents["n"] if documents else 0) + 1.0) / (F.col("n") + F.lit(1.0)))
    tf = term_frequencies(runs, key)
    return join_counted_terms(tf, counts.filter("term is not null")).select(
        key, "term", "tf", F.col("n").alias("df"), (F.col("tf") * idf).alias("tfidf")
    )


def frequent_terms(df: DataFrame, col: str, k: int) -> DataFrame:
    """The ``k`` most frequent terms, equal counts in order of the term: (term, n)."""
    counts = term_counts(df, tokens_of(df, col))
    if k <= LIST_LIMIT:
        return counts.orderBy(F.desc("n"), "term").limit(k)
    return top_counts(settle(counts), k)


def top_counts(counts: DataFrame, k: int) -> DataFrame:
    """The ``k`` first rows of a settled table (term, n), greatest counts first, for any ``k``.

    Terms are counted by the power of two below their number, which shows where the ``k``-th
    lies; only terms from that power on are sorted, in ranges, so no task sees all of them.
    """
    power = F.floor(F.log2("n")).cast("int")
    steps = counts.groupBy(power.alias("power")).count().orderBy(F.desc("power")).collect()
    least, seen = 0, 0
    for step in steps:
        least, seen = step["power"], seen + step["count"]
        if seen >= k:
            break
    return numbered(counts.filter(power >= least), F.desc("n"), F.col("term")).filter(F.col("id") < k).drop("id")


def remove_frequent(
    df: DataFrame,
    col: str,
    k: int = 20,
    out: str = "kept",
    mode: str = "corpus",
    key: str | None = None,
) -> DataFrame:
    """Add the tokens without the ``k`` most frequent terms of the corpus.

    A short list is tested in place, so documents are not shuffled. Beyond
    LIST_LIMIT terms the list is joined instead, by ``key``; without one the rows are numbered.
    ``mode='compat'`` drops English stop words and counts nothing.
    """
    tokens = tokens_of(df, col)
    if mode == "compat":
        return df.withColumn(out, remove_stop_words(tokens))
    if k <= LIST_LIMIT:
        listed = frequent_terms(df, col, k).agg(F.collect_list("term").alias("terms")).scalar()
        return (
            df.withColumn("_drop", listed)
            .withColumn(
                out, F.filter(tokens, lambda w: ~F.array_contains(F.col("_drop"), w))
            )
            .drop("_drop")
        )
    df, key = row_key(df, key)
    counts = settle(term_counts(df, tokens))
    top = top_counts(counts, k).select("term", F.lit(True).alias("drop"))
    table = settle(counts.join(top, "term", "left"))
    hits = counted_hits(df, key, lambda rows: token_rows(rows, key, tokens), table, F.col("drop").isNotNull())
    hits = [h.withColumn("word", F.lit(None).cast("string")) for h in hits]
    return patch_tokens(df, key, tokens, hits, out)


def remove_rare(
    df: DataFrame,
    key: str | None,
    col: str,
    min_count: int = 2,
    out: str = "kept",
    mode: str = "corpus",
    words: Sequence[str] | None = None,
) -> DataFrame:
    """Add the tokens without the terms seen fewer than ``min_count`` times.

    The counts are settled first; only rare tokens are shuffled. ``key`` tells the rows
    apart; with None they are numbered.
    ``mode='compat'`` counts nothing: see :func:`thin_unlisted`.
    """
    tokens = tokens_of(df, col)
    if mode == "compat":
        return thin_unlisted(df.withColumn("_tokens", tokens), "_tokens", out, words).drop("_tokens")
    df, key = row_key(df, key)
    counts = settle(term_counts(df, tokens))
    hits = counted_hits(df, key, lambda rows: token_rows(rows, key, tokens), counts, F.col("n") < min_count)
    hits = [h.withColumn("word", F.lit(None).cast("string")) for h in hits]
    return patch_tokens(df, key, tokens, hits, out)


def thin_unlisted(
    df: DataFrame, tokens: str, out: str, words: Sequence[str] | None = None
) -> DataFrame:
    """Delete-while-iterating removal of the tokens that are not on a word list.

    Removing an item from a list being iterated over skips the item after it. So in
    each run of unlisted tokens every second one, from the first, is a removal; and
    a removal takes out the first copy of its word still there. Hence a word removed
    r times loses its first r copies. Linear but for a sort of the document's tokens.
    """
    listed = list(ENGLISH_STOP_WORDS if words is None else words)
    t = F.col(tokens)
    last = F.size(t) - 1

    def positions(test) -> Column:
        return F.filter(
            F.transform(t, lambda w, i: F.when(test(w), i)), lambda i: i.isNotNull()
        )

    # sort_array compares rows itself; array_sort would evaluate an expression for each comparison.
    # Positions of listed words, with one bound before and one after all tokens.
    stops = df.withColumn("_listed", positions(lambda w: w.isin(listed))).withColumn(
        "_bounds", F.concat(F.array(F.lit(-1)), F.col("_listed"), F.array(last + 1))
    )
    bounds = F.col("_bounds")

    def run(b: Column, j: Column) -> Column:
        """Tokens between two bounds: (word, pos, whether it is a removal)."""
        end = F.get(bounds, j + 1)
        inside = F.when(end - b > 1, F.sequence(b + 1, end - 1)).otherwise(
            F.array().cast("array<int>")
        )
        return F.transform(
            inside,
            lambda p: F.struct(
                F.get(t, p).alias("word"), p.alias("pos"), ((p - b) % 2 == 1).alias("removal")
            ),
        )

    runs = F.transform(F.slice(bounds, F.lit(1), F.size(bounds) - 1), run)
    sorted_runs = stops.withColumn("_unlisted", F.sort_array(F.flatten(runs)))
    unlisted = F.col("_unlisted")
    starts = F.filter(
        F.transform(
            unlisted,
            lambda u, i: F.when((i == 0) | (u["word"] != F.get(unlisted, i - 1)["word"]), i),
        ),
        lambda i: i.isNotNull(),
    )
    grouped = sorted_runs.withColumn("_starts", starts)

    def survivors(start: Column, j: Column) -> Column:
        end = F.coalesce(F.get(F.col("_starts"), j + 1), F.size(unlisted))
        copies = F.slice(unlisted, start + 1, end - start)
        removed = F.size(F.filter(copies, lambda u: u["removal"]))
        return F.transform(
            F.slice(unlisted, start + removed + 1, end - start - removed), lambda u: u["pos"]
        )

    kept = F.sort_array(
        F.concat(F.col("_listed"), F.flatten(F.transform(F.col("_starts"), survivors)))
    )
    return (
        grouped.withColumn(out, F.transform(kept, lambda p: F.get(t, p)))
        .drop("_listed", "_bounds", "_unlisted", "_starts")
    )
