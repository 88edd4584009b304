"""The whole text normalization as one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexsieve.functions.stem import stem_tokens
from lexsieve.functions.text import strip_digits, strip_non_ascii, strip_punct
from lexsieve.functions.tokens import apply_changes, remove_stop_words, tokenize
from lexsieve.operators.dictionary import stems_of
from lexsieve.operators.lemmas import inflected_forms
from lexsieve.operators.terms import counted_hits, gathered, row_key, term_counts, token_rows
from lexsieve.sources.shared import settle

STAGES = ("no_punct", "ascii", "no_digits", "tokens", "no_stop", "stems", "lemmas")


def normalize(
    df: DataFrame,
    key: str,
    col: str,
    stages: Sequence[str] | None = None,
    lemmas: DataFrame | None = None,
    min_len: int = 3,
    stop_words: Sequence[str] | None = None,
) -> DataFrame:
    """(key, one column per stage), each stage made from the one before:

    ``no_punct`` without punctuation, ``ascii`` without other scripts, ``no_digits``
    without digits, ``tokens``, ``no_stop`` without stop words, ``stems`` and ``lemmas``
    (if a dictionary is given), the last two with ``min_len`` characters or more.

    Without a dictionary all stages are one pass without a shuffle. With one, stems and lemmas are
    found once for each different token of the corpus; tokens that change are joined with these, and
    one shuffle brings them and the texts together, after which all stages are made. ``key``
    may repeat or be null; rows are then numbered.
    """
    if stages is None:
        stages = STAGES if lemmas is not None else STAGES[:-1]
    unknown = set(stages) - set(STAGES)
    if unknown:
        raise ValueError(f"unknown stages: {sorted(unknown)}")
    if "lemmas" in stages and lemmas is None:
        raise ValueError("the lemmas stage needs a dictionary")

    def words_of(rows: DataFrame) -> DataFrame:
        return (
            rows.withColumn("no_punct", strip_punct("_text"))
            .withColumn("ascii", strip_non_ascii("no_punct"))
            .withColumn("no_digits", strip_digits("ascii"))
            .withColumn("tokens", tokenize("no_digits"))
            .withColumn("no_stop", remove_stop_words("tokens", stop_words))
        )

    rows = df.select(key, F.col(col).alias("_text"))
    wanted = [s for s in STAGES if s in stages]
    if "lemmas" not in stages:
        return words_of(rows).withColumn("stems", stem_tokens("no_stop", min_len)).select(key, *wanted)

    rows, number = row_key(rows, key)
    made = words_of(rows)
    tokens = F.col("no_stop")
    table = _bases(settle(term_counts(made, tokens)), lemmas, min_len)
    hits = counted_hits(rows, number, lambda r: token_rows(words_of(r), number, tokens), table, F.col("changed"))
    patched = words_of(gathered(rows, number, hits, "stem", "lemma"))
    for out, base in (("stems", "stem"), ("lemmas", "lemma")):
        # Fields of an array of structs are arrays of the fields.
        own = F.arrays_zip(F.col("_changes.pos").alias("pos"), F.col(f"_changes.{base}").alias("word"))
        patched = patched.withColumn(f"_{base}", own).withColumn(out, apply_changes(F.col("no_stop"), F.col(f"_{base}")))
    return patched.select(key, *wanted)


def _bases(counts: DataFrame, lemmas: DataFrame, min_len: int) -> DataFrame:
    """(term, n, stem, lemma, changed) of each term; null where its base is shorter than ``min_len``."""
    kept = F.col("stem").isNotNull() & (F.length("stem") >= min_len)
    forms = inflected_forms(lemmas).select(F.col("term").alias("stem"), F.col("word").alias("base"))
    found = stems_of(counts).join(forms, "stem", "left")
    lemma = F.coalesce("base", "stem")
    table = found.select(
        "term", "n", F.when(kept, F.col("stem")).alias("stem"),
        F.when(kept & (F.length(lemma) >= min_len), lemma).alias("lemma"),
    )
    same = F.col("stem").eqNullSafe(F.col("term")) & F.col("lemma").eqNullSafe(F.col("term"))
    return settle(table.withColumn("changed", ~same))
