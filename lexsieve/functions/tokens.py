"""Functions over token arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexsieve.functions.stopwords import ENGLISH_STOP_WORDS
from lexsieve.functions.text import ASCII_SPACE, to_column


def tokenize(c: Column | str) -> Column:
    """Lower-case and split at each ASCII white-space character.

    Leading and inner empty tokens stay, trailing ones are dropped; ``''`` gives
    one empty token and blank text gives none.
    """
    c = to_column(c)
    body = F.rtrim(F.lower(c), F.lit(ASCII_SPACE))
    return F.when((body == "") & (c != ""), F.array().cast("array<string>")).otherwise(
        F.split(body, "\\s")
    )


def remove_stop_words(
    tokens: Column | str, words: Sequence[str] | None = None, case_sensitive: bool = False
) -> Column:
    """Drop the tokens on the list (English by default); null tokens go as well."""
    words = ENGLISH_STOP_WORDS if words is None else words
    if case_sensitive:
        return F.filter(to_column(tokens), lambda w: ~w.isin(list(words)))
    low = sorted({w.lower() for w in words})
    return F.filter(to_column(tokens), lambda w: ~F.lower(w).isin(low))


def join_tokens(tokens: Column | str, delim: str = " ") -> Column:
    """Tokens as one delimited text; null tokens are skipped, a null array stays null."""
    return F.array_join(to_column(tokens), delim)


def bracketed_text(tokens: Column | str) -> Column:
    """A list as ``[a, b]`` text, the form it has in a plain text column."""
    return F.concat(F.lit("["), F.array_join(to_column(tokens), ", "), F.lit("]"))


def keep_longer(tokens: Column | str, min_len: int) -> Column:
    """Keep tokens of at least ``min_len`` characters."""
    return F.filter(to_column(tokens), lambda w: F.length(w) >= min_len)


def apply_changes(tokens: Column, changes: Column) -> Column:
    """Put ``changes`` (an array of (pos, word) sorted by pos) into ``tokens``.

    A null word deletes the token. Untouched stretches between changes are
    sliced out whole, so the work is linear in the tokens. Pass plain columns:
    both arguments are used several times.
    """

    def stretch(change: Column, j: Column) -> Column:
        start = F.when(j == 0, F.lit(0)).otherwise(changes[j - 1]["pos"] + 1)
        before = F.slice(tokens, start + 1, change["pos"] - start)
        new = F.when(change["word"].isNotNull(), F.array(change["word"])).otherwise(
            F.array().cast("array<string>")
        )
        return F.concat(before, new)

    last = changes[F.size(changes) - 1]["pos"]
    tail = F.slice(tokens, last + 2, F.size(tokens) - last - 1)
    patched = F.concat(F.flatten(F.transform(changes, stretch)), tail)
    return F.when(F.size(changes) > 0, patched).otherwise(tokens)
