"""Words written together, taken apart by dynamic programming over word frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexsieve.operators.terms import (
    counted_hits,
    fits_broadcast,
    join_given_terms,
    patch_tokens,
    row_key,
    term_counts,
    token_rows,
    tokens_of,
)
from lexsieve.sources.shared import settle

# How costs are rounded: whole thousandths of the natural logarithm, so that sums are exact.
COST_UNIT = 1_000
BEST = "struct<cost:bigint,words:int,start:int>"


def word_costs(vocab: DataFrame) -> DataFrame:
    """(word, cost): the negative logarithm of each word's share of all, in whole COST_UNITs."""
    table = vocab.filter((F.col("freq") > 0) & (F.col("word") != "")).groupBy("word").agg(F.sum("freq").alias("freq"))
    total = table.agg(F.coalesce(F.sum("freq"), F.lit(1)).alias("total")).first()["total"]
    cost = F.round(F.lit(COST_UNIT) * (F.log(F.lit(float(total))) - F.log(F.col("freq").cast("double"))))
    return table.select("word", cost.cast("bigint").alias("cost"))


def _edges(terms: DataFrame, costs: DataFrame, max_length: int) -> DataFrame:
    """(term, end, ways): the words that end at each place of a term, as (start, cost)."""
    longest = min(costs.agg(F.max(F.length("word"))).first()[0] or 0, max_length)
    size = F.length("term")
    pieces = F.flatten(F.transform(F.sequence(F.lit(1), size), lambda end: F.transform(
        F.sequence(F.greatest(end - longest, F.lit(0)), end - 1),
        lambda start: F.struct(
            start.alias("start"), end.alias("end"), F.substring(F.col("term"), start + 1, end - start).alias("word")
        ),
    )))
    # The whole term is no part of itself.
    parts = terms.filter(size.between(2, max_length)).select("term", F.explode(pieces).alias("p")).select("term", "p.*")
    parts = parts.filter(F.col("end") - F.col("start") < F.length("term"))
    found = join_given_terms(parts, costs, on="word")
    return found.groupBy("term", "end").agg(F.sort_array(F.collect_list(F.struct("start", "cost"))).alias("ways"))


def segmentations(terms: DataFrame, vocab: DataFrame, max_length: int = 64) -> DataFrame:
    """(term, word): the terms that are several words of ``vocab`` in a row, as these, joined by spaces.

    Of all ways to cut a term the one of least total cost is taken, of equal ones that of fewer words, then
    that whose last word is longest, and so on towards the front. ``terms`` has one row per term. Every
    piece of a term is looked up at once; a term's places are then gone through in order, each keeping
    its best way from the start. Terms longer than ``max_length`` are no words and are not looked at.
    """
    ways = _edges(terms, word_costs(vocab), max_length)
    ends = ways.groupBy("term").agg(F.map_from_entries(F.collect_list(F.struct("end", "ways"))).alias("ends"))

    def step(best: Column, end: Column) -> Column:
        """The best way to each place up to ``end``; of -1 words where there is none."""
        reached = F.filter(F.coalesce(F.col("ends")[end], F.array().cast("array<struct<start:int,cost:bigint>>")),
                           lambda w: F.get(best, w["start"])["words"] >= 0)
        options = F.transform(reached, lambda w: F.struct(
            (F.get(best, w["start"])["cost"] + w["cost"]).alias("cost"),
            (F.get(best, w["start"])["words"] + 1).alias("words"), w["start"].alias("start"),
        ))
        return F.array_append(best, F.coalesce(F.array_min(options).cast(BEST), place(-1)))

    def place(words: int) -> Column:
        return F.struct(F.lit(0).alias("cost"), F.lit(words).alias("words"), F.lit(0).alias("start")).cast(BEST)

    origin = F.array(place(0))
    places = F.aggregate(F.sequence(F.lit(1), F.length("term")), origin, step)
    reached = ends.withColumn("best", places).filter(F.get("best", F.length("term"))["words"] > 0)

    def back(state: Column, _: Column) -> Column:
        start = F.get(F.col("best"), state["at"])["start"]
        word = F.substring(F.col("term"), start + 1, state["at"] - start)
        longer = F.when(state["text"] == "", word).otherwise(F.concat(word, F.lit(" "), state["text"]))
        return F.struct(start.alias("at"), longer.alias("text"))

    end = F.struct(F.length("term").alias("at"), F.lit("").alias("text"))
    count = F.get("best", F.length("term"))["words"]
    text = F.aggregate(F.sequence(F.lit(1), count), end, back, lambda s: s["text"])
    return reached.select("term", text.alias("word"))


def split_joined(
    df: DataFrame, key: str | None, col: str, vocab: DataFrame, max_length: int = 64, out: str = "split"
) -> DataFrame:
    """Add the tokens with each unknown one that is several words of ``vocab`` in a row put as these.

    ``vocab`` has columns ``word`` and ``freq``; see :func:`segmentations`. Words of the vocabulary
    and tokens without a letter stay, and so do those that no cut explains. Each
    different token is cut once; only tokens that change are shuffled.
    """
    df, key = row_key(df, key)
    tokens = tokens_of(df, col)
    counts = settle(term_counts(df, tokens))
    known = vocab.select(F.col("word").alias("term"))
    small = fits_broadcast(known)
    unknown = counts.filter(F.col("term").rlike("\\p{L}")).select("term")
    unknown = unknown.join(F.broadcast(known) if small else known, "term", "left_anti")
    table = settle(counts.join(segmentations(unknown, vocab, max_length), "term", "left"))
    hits = counted_hits(df, key, lambda rows: token_rows(rows, key, tokens), table, F.col("word").isNotNull())
    # Tokens hold no spaces, so those in a result are between words put in.
    split = F.flatten(F.transform(out, lambda w: F.split(w, " ")))
    return patch_tokens(df, key, tokens, hits, out).withColumn(out, split)
