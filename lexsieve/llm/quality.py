"""A quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on each document. Expectation-maximisation
estimates from the votes alone how accurate each labeller is, which gives each document a
posterior label; these train a linear scorer over hashed words.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexsieve.llm.common import WORD, code_points, let, named, packed, unpacked

OUTPUTS = ["quality", "keep"]
GOOD, BAD, NONE = 1, -1, 0


def split_words(text: Column) -> Column:
    return F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+")


def _told_once(text: Column) -> Column:
    """The words, joined by spaces, with the repetitions right after a word put as one "="."""

    def one(w: Column, i: Column, words: Column) -> Column:
        before = F.get(words, F.greatest(i - 1, F.lit(0)))
        earlier = F.get(words, F.greatest(i - 2, F.lit(0)))
        return F.when((i == 0) | (w != before), w).when((i == 1) | (before != earlier), "=")

    return let(split_words(text), lambda words: F.array_join(F.transform(words, lambda w, i: one(w, i, words)), " "))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, BAD).when(good, GOOD).otherwise(NONE).cast("int")


def votes(text: Column) -> dict[str, Column]:
    """One vote of each labeller on a text, from counts of characters and words."""
    chars = F.greatest(F.length(text), F.lit(1))

    def share(kept: str) -> Column:
        return F.length(F.regexp_replace(text, kept, "")) / chars

    letters = share(r"\P{L}+")
    capitals = share(r"\P{Lu}+") / F.greatest(letters, F.lit(1e-9))
    odd = share(r"[\p{L}\p{N}\s.,;:'\"!?()-]+")
    stops = F.regexp_count(text, F.lit(r"[.!?](?=\s|$)")) / F.greatest(F.lit(1.0), chars / 100)
    again = let(split_words(text), lambda w: F.exists(F.sequence(F.lit(2), F.greatest(F.size(w), F.lit(2))), lambda i: (
        F.coalesce((F.get(w, i) == F.get(w, i - 1)) & (F.get(w, i) == F.get(w, i - 2)), F.lit(False))
    )))
    marks = share(r"[^!|*#$%&]+")
    words = F.regexp_count(text, F.lit(WORD))
    return {
        "letters": _vote(letters < 0.6, letters > 0.75),
        "capitals": _vote(capitals > 0.3, capitals < 0.1),
        "odd": _vote(odd > 0.03, odd < 0.01),
        "sentences": _vote((stops < 0.3) & (words > 10), stops > 0.8),
        "repeats": _vote(again, ~again),
        "marks": _vote(marks > 0.03, marks < 0.005),
        "length": _vote(words < 3, words > 20),
    }


def estimate(
    patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, smooth: float = 1.0
) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of good per pattern, chances, share of good) by expectation-maximisation.

    ``chances[l, c, v]`` is how likely labeller l votes v (bad, nothing, good) on a bad (c = 0)
    or good (c = 1) document; labellers are taken as independent given the label. Each starts
    with bad votes rare on good documents, which says which of the two classes is the good one.
    """
    voted = np.stack([patterns == v for v in (BAD, NONE, GOOD)], 2).astype(float)
    start = np.array([[0.3, 0.2, 0.5], [0.03, 0.17, 0.8]])
    chances, prior = np.repeat(start[None], patterns.shape[1], 0), 0.8
    for _ in range(rounds):
        likely = np.einsum("plv,lcv->pc", voted, np.log(chances)) + np.log([1 - prior, prior])
        good = 1 / (1 + np.exp(np.clip(likely[:, 0] - likely[:, 1], -40, 40)))
        shares = np.stack([counts * (1 - good), counts * good], 1)
        seen = np.einsum("pc,plv->lcv", shares, voted) + smooth * start
        chances = seen / seen.sum(2, keepdims=True)
        prior = float(np.clip((counts @ good + smooth) / (counts.sum() + 2 * smooth), 0.01, 0.99))
    return good, chances, prior


def accuracies(chances: np.ndarray, prior: float) -> np.ndarray:
    """How often each labeller is right when it votes."""
    right = (1 - prior) * chances[:, 0, 0] + prior * chances[:, 1, 2]
    return right / ((1 - prior) * (1 - chances[:, 0, 1]) + prior * (1 - chances[:, 1, 1]))


def _vectors(df: DataFrame, features: int) -> DataFrame:
    """Add ``features``: shares of a text's word shapes, hashed. A shape has runs of small letters,
    capitals and digits put as one; a word that repeats the one before it is marked."""
    shape = _told_once(F.col("text"))
    for pattern, sign in ((r"\p{Lu}+", "A"), (r"\p{Ll}+", "a"), (r"\p{N}+", "0")):
        shape = F.regexp_replace(shape, pattern, sign)
    tokens = F.regexp_extract_all(shape, F.lit(WORD), F.lit(0))
    hashed = HashingTF(numFeatures=features, inputCol="tokens", outputCol="counts")
    shares = Normalizer(p=1.0, inputCol="counts", outputCol="features")
    return shares.transform(hashed.transform(df.withColumn("tokens", tokens))).drop("tokens", "counts")


def weak_labels(df: DataFrame, text: str = "text") -> tuple[DataFrame, int, dict[str, float]]:
    """(rows packed with ``text`` and ``weak_label``, their number, accuracies of the labellers).

    Votes are counted per pattern over all documents; there are at most 3 ** 7 patterns, so
    that table is small however large the corpus.
    """
    rows = packed(df, ["weak_label"], text=code_points(named(text)))
    judged = votes(F.col("text"))
    names = list(judged)
    rows = rows.withColumn("votes", F.array(*judged.values()))
    counted = rows.groupBy("votes").count().collect()
    if not counted:
        return rows.withColumn("weak_label", F.lit(None).cast("double")), 0, {}
    patterns = np.array([r["votes"] for r in counted])
    good, chances, prior = estimate(patterns, np.array([r["count"] for r in counted], float))
    table = df.sparkSession.createDataFrame(
        [(list(map(int, p)), float(g)) for p, g in zip(patterns, good, strict=True)],
        "votes array<int>, weak_label double",
    )
    labelled = rows.join(F.broadcast(table), "votes", "left").drop("votes")
    return labelled, sum(r["count"] for r in counted), dict(zip(names, map(float, accuracies(chances, prior)), strict=True))


def train(
    labelled: DataFrame, total: int, features: int = 4096, most_rows: int = 10_000, seed: int = 9
) -> LogisticRegressionModel | None:
    """The scorer, from at most ``most_rows`` documents of :func:`weak_labels`, a bound that does
    not grow with the corpus; the documents are chosen by a hash of their texts, and
    of equal ones there is one. Each counts for both labels, by its posterior. None if there is nothing to learn from."""
    chosen = labelled.select("text", "weak_label").withColumn("chance", F.xxhash64(F.lit(seed), "text"))
    chosen = chosen.withColumn("part", F.pmod(F.shiftright("chance", 20), F.lit(1 << 20)))
    if not total:
        return None
    least = F.lit(int(min(1.0, most_rows / total) * (1 << 20)))
    sample = _vectors(chosen.filter(F.col("part") <= least).dropDuplicates(["chance"]), features)
    both = F.explode(F.array(
        F.struct(F.lit(1.0).alias("label"), F.col("weak_label").alias("weight")),
        F.struct(F.lit(0.0).alias("label"), (1 - F.col("weak_label")).alias("weight")),
    ))
    weighted = sample.select("features", both.alias("y")).select("features", "y.*").filter("weight > 1e-6")
    weighted = weighted.persist()
    try:
        if weighted.agg(F.count_distinct("label").alias("n")).first()["n"] < 2:
            return None
        return LogisticRegression(maxIter=25, regParam=1e-3, weightCol="weight").fit(weighted)
    finally:
        weighted.unpersist()


def classify(df: DataFrame, text: str = "text", threshold: float = 0.5, **options) -> DataFrame:
    """All rows with ``quality`` (the scorer's, 0 to 1) and ``keep`` (quality at the threshold or
    above).

    Null texts count as empty and have the same quality as texts without words. Rows with the
    same text have the same result; an empty table gives an empty result. Where all documents
    have the same weak label there is nothing to learn, and that label is the quality.
    """
    labelled, total, _ = weak_labels(df, text)
    model = train(labelled, total, **options)
    if model is None:
        scored = labelled.withColumn("quality", F.col("weak_label"))
    else:
        rows = packed(df, OUTPUTS, text=code_points(named(text)))
        scored = model.transform(_vectors(rows, model.numFeatures)).withColumn(
            "quality", vector_to_array("probability")[1]
        )
    return unpacked(scored, "quality", (F.col("quality") >= threshold).alias("keep"))
