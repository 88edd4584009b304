"""Porter's suffix-stripping stemmer (Porter 1980) as native column expressions.

The published algorithm plus the extensions that general-purpose Porter stemmers
switch on by default: short -ies and -ied words, ``y`` to ``i`` only after a
consonant, a few irregular words, -bli, -fulli and -logi. ``extended=False``
gives the published rules alone.

Each step is one ``CASE`` over a word. A step mentions its input many times, so
steps are never nested in one another: over arrays every step is its own
``transform``, over a column its own projection.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexsieve.functions.text import to_column

# The word shapes of the paper. A word is [C](VC)^m[V]: C a run of consonants, V a
# run of vowels; y is a consonant at the start and after a vowel, else a vowel.
FIRST_VOWELS = "^(?:[^aeiou][^aeiouy]*[aeiouy]|[aeiou])[aeiou]*"
POSITIVE = FIRST_VOWELS + "[^aeiou]"  # m > 0
ABOVE_ONE = POSITIVE + "[^aeiouy]*[aeiouy][aeiou]*[^aeiou]"  # m > 1
JUST_ONE = POSITIVE + "[^aeiouy]*(?:[aeiouy][aeiou]*)?$"  # m = 1
HAS_VOWEL = "^(?:[^aeiou][^aeiouy]*[aeiouy]|[aeiou])"  # *v*
LAST_CONSONANT = "(?:(?:^|[aeiou])y(?:yy)*|[^aeiouy]yy(?:yy)*|[^aeiouy])"
ENDS_CONSONANT = LAST_CONSONANT + "$"
SHORT_END = LAST_CONSONANT + "[aeiouy][^aeiouwxy]$"  # *o
SHORT_END_EXTENDED = SHORT_END + "|^[aeiou][^aeiou]$"

# Fixed values of the paper: suffix and what replaces it, by step. In a step the
# first suffix that fits is taken, whether or not its condition then holds.
STEP_2_PAPER = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"),
    ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
    ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
    ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
    ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
STEP_3 = [
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
    ("ful", ""), ("ness", ""),
]
STEP_4 = (
    "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize"
).split()
# Fixed values of the extensions.
STEP_2_EXTENDED = [
    *(("bli", "ble") if s == "abli" else (s, r) for s, r in STEP_2_PAPER), ("fulli", "ful"),
]
DONE = "\uffff"
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "news": "news", "innings": "inning", "inning": "inning", "outings": "outing",
    "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}


def _cut(w: Column, n: int) -> Column:
    """The word without its last ``n`` characters."""
    return F.substring(w, F.lit(1), F.length(w) - n)


def _by_suffix(w: Column, rules: list[tuple[str, Column]], shortest: int) -> Column:
    """The value for the first suffix that fits, else the word.

    Most words fit none: length and last two letters tell that without trying all.
    """
    value = F.when(w.endswith(rules[0][0]), rules[0][1])
    for suffix, outcome in rules[1:]:
        value = value.when(w.endswith(suffix), outcome)
    ends = sorted({suffix[-2:] for suffix, _ in rules})
    may_fit = (F.length(w) >= shortest) & F.substring(w, -2, 2).isin(ends)
    return F.when(may_fit, value.otherwise(w)).otherwise(w)


def _swap(w: Column, suffix: str, new: str, shape: str) -> Column:
    """Replace the suffix if what is left has the shape, else keep the word."""
    stem = _cut(w, len(suffix))
    return F.when(stem.rlike(shape), F.concat(stem, F.lit(new)) if new else stem).otherwise(w)


def _plural(w: Column, extended: bool) -> Column:
    """Step 1a."""
    ies = F.when(F.length(w) == 4, _cut(w, 1)).otherwise(_cut(w, 2)) if extended else _cut(w, 2)
    return (
        F.when(~w.endswith("s") | w.endswith("ss") & ~w.endswith("sses"), w)
        .when(w.endswith("sses"), _cut(w, 2))
        .when(w.endswith("ies"), ies)
        .otherwise(_cut(w, 1))
    )


def _past(w: Column, extended: bool) -> Column:
    """Step 1b: the word, and whether it lost -ed or -ing and so needs mending."""

    def outcome(word: Column, mend: bool) -> Column:
        return F.struct(word.alias("word"), F.lit(mend).alias("mend"))

    def cut(suffix: str) -> Column:
        stem = _cut(w, len(suffix))
        return F.when(stem.rlike(HAS_VOWEL), outcome(stem, True)).otherwise(outcome(w, False))

    eed = outcome(_swap(w, "eed", "ee", POSITIVE), False)
    value = F.when(w.endswith("eed"), eed)
    if extended:
        ied = F.when(F.length(w) == 4, _cut(w, 1)).otherwise(_cut(w, 2))
        value = value.when(w.endswith("ied"), outcome(ied, False))
    return (
        value.when(w.endswith("ed"), cut("ed"))
        .when(w.endswith("ing"), cut("ing"))
        .otherwise(outcome(w, False))
    )


def _mend(past: Column, extended: bool) -> Column:
    """Step 1b, second half."""
    stem, short_end = past["word"], SHORT_END_EXTENDED if extended else SHORT_END
    last = F.substring(stem, -1, 1)
    doubled = (last == F.substring(_cut(stem, 1), -1, 1)) & stem.rlike(ENDS_CONSONANT)
    mended = (
        F.when(F.substring(stem, -2, 2).isin("at", "bl", "iz"), F.concat(stem, F.lit("e")))
        .when(doubled, F.when(last.isin("l", "s", "z"), stem).otherwise(_cut(stem, 1)))
        .when(stem.rlike(JUST_ONE) & stem.rlike(short_end), F.concat(stem, F.lit("e")))
        .otherwise(stem)
    )
    return F.when(past["mend"], mended).otherwise(stem)


def _final_y(w: Column, extended: bool) -> Column:
    """Step 1c."""
    stem = _cut(w, 1)
    turns = (F.length(w) > 2) & stem.rlike(ENDS_CONSONANT) if extended else stem.rlike(HAS_VOWEL)
    return F.when(w.endswith("y") & turns, F.concat(stem, F.lit("i"))).otherwise(w)


def _alli(w: Column, extended: bool) -> Column:
    """Extended rules take -alli before step 2, which then sees the result."""
    return F.when(w.endswith("alli"), _swap(w, "alli", "al", POSITIVE)).otherwise(w)


def _double_suffix(w: Column, extended: bool) -> Column:
    """Step 2."""
    table = STEP_2_EXTENDED if extended else STEP_2_PAPER
    rules = [(s, _swap(w, s, r, POSITIVE)) for s, r in table]
    if extended:
        rules.append(("logi", F.when(_cut(w, 3).rlike(POSITIVE), _cut(w, 1)).otherwise(w)))
    return _by_suffix(w, rules, 5)


def _adjective_suffix(w: Column, extended: bool) -> Column:
    """Step 3."""
    return _by_suffix(w, [(s, _swap(w, s, r, POSITIVE)) for s, r in STEP_3], 5)


def _residual_suffix(w: Column, extended: bool) -> Column:
    """Step 4."""
    rules = [(s, _swap(w, s, "", ABOVE_ONE)) for s in STEP_4]
    stem = _cut(w, 3)
    rules.append(("ion", F.when(stem.rlike("[st]$") & stem.rlike(ABOVE_ONE), stem).otherwise(w)))
    return _by_suffix(w, rules, 6)


def _final_e(w: Column, extended: bool) -> Column:
    """Step 5a."""
    stem, short_end = _cut(w, 1), SHORT_END_EXTENDED if extended else SHORT_END
    drop = stem.rlike(ABOVE_ONE) | (stem.rlike(JUST_ONE) & ~stem.rlike(short_end))
    return F.when(w.endswith("e") & drop, stem).otherwise(w)


def _final_ll(w: Column, extended: bool) -> Column:
    """Step 5b."""
    stem = _cut(w, 1)
    return F.when(w.endswith("ll") & stem.rlike(ABOVE_ONE), stem).otherwise(w)


STEPS: list[Callable[[Column, bool], Column]] = [
    _plural, _past, _mend, _final_y, _alli, _double_suffix, _adjective_suffix,
    _residual_suffix, _final_e, _final_ll,
]


def _each(words: Column, step: Callable[[Column, bool], Column], extended: bool) -> Column:
    return F.transform(words, lambda w: step(w, extended))


def _set_aside(w: Column, extended: bool) -> Column:
    """End short and irregular words in a mark, so that no suffix rule sees them."""
    done = F.when((F.length(w) <= 2) | w.endswith(DONE), F.concat(w, F.lit(DONE)))
    forms = None
    for word, form in IRREGULAR.items():
        test, form = w == word, F.lit(form + DONE)
        forms = F.when(test, form) if forms is None else forms.when(test, form)
    return done.when(w.isin(list(IRREGULAR)), forms).otherwise(w)


def _take_back(w: Column, extended: bool) -> Column:
    return F.when(w.endswith(DONE), _cut(w, 1)).otherwise(w)


def stem_tokens(tokens: Column | str, min_len: int = 3, extended: bool = True) -> Column:
    """Stem each (lower-case) token and keep the stems of at least ``min_len`` characters.

    A map over the array: no explode, no shuffle, no Python.
    """
    steps = [_set_aside, *STEPS, _take_back] if extended else [s for s in STEPS if s is not _alli]
    stems = to_column(tokens)
    for step in steps:
        stems = _each(stems, step, extended)
    return F.filter(stems, lambda s: F.length(s) >= min_len)
