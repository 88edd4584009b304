"""Rule-based sentiment over a valence lexicon (Hutto and Gilbert 2014)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexsieve.functions.text import PUNCTUATION, strip_punct, words
from lexsieve.operators.terms import fits_broadcast, join_given_terms, row_key

# Fixed values of the method.
BOOST, CAPS, NEGATION, ALPHA = 0.293, 0.733, -0.74, 15.0
NEGATIONS = (
    "aint arent cannot cant couldnt darent didnt doesnt ain't aren't can't couldn't daren't "
    "didn't doesn't dont hadnt hasnt havent isnt mightnt mustnt neither don't hadn't hasn't "
    "haven't isn't mightn't mustn't neednt needn't never none nope nor not nothing nowhere "
    "oughtnt shant shouldnt uhuh wasnt werent oughtn't shan't shouldn't uh-uh wasn't weren't "
    "without wont wouldnt won't wouldn't rarely seldom despite"
).split()
STRONGER = (
    "absolutely amazingly awfully completely considerably decidedly deeply effing enormously "
    "entirely especially exceptionally extremely fabulously flipping flippin fricking frickin "
    "frigging friggin fully fucking greatly hella highly hugely incredibly intensely majorly "
    "more most particularly purely quite really remarkably so substantially thoroughly totally "
    "tremendously uber unbelievably unusually utterly very"
).split()
WEAKER = (
    "almost barely hardly kinda kindof kind-of less little marginally occasionally partly "
    "scarcely slightly somewhat sorta sortof sort-of"
).split()
WEAKER_PHRASES = ["just enough", "kind of", "sort of"]
IDIOMS = {
    "the shit": 3.0, "the bomb": 3.0, "bad ass": 1.5, "yeah right": -2.0,
    "cut the mustard": 2.0, "kiss of death": -1.5, "hand to mouth": -2.0,
}
PHRASE_WORDS = sorted(
    {w for phrase in [*IDIOMS, *WEAKER_PHRASES] for w in phrase.split()} - {"the", "to", "of"}
)
MARKS = [
    ".", "!", "?", ",", ";", ":", "-", "'", '"', "!!", "!!!", "??", "???", "?!?", "!?!",
    "?!?!", "!?!?",
]


@dataclass(frozen=True)
class WordLists:
    """Words that turn or grade the valence of what follows; give others for other languages."""

    negations: Sequence[str] = tuple(NEGATIONS)
    stronger: Sequence[str] = tuple(STRONGER)
    weaker: Sequence[str] = tuple(WEAKER)


_NO_PUNCT = "[^" + "".join("\\" + p for p in PUNCTUATION) + "]{2,}"
_ANY_MARK = "(?:" + "|".join("".join("\\" + ch for ch in m) for m in MARKS) + ")"
MARKED_WORD = f"^(?:{_ANY_MARK}{_NO_PUNCT}|{_NO_PUNCT}{_ANY_MARK})$"


def sentiment_words(c: Column | str) -> Column:
    """Words of two characters or more; a word with one mark before or after loses it."""
    return F.transform(
        F.filter(words(c), lambda w: F.length(w) > 1),
        lambda w: F.when(w.rlike(MARKED_WORD), strip_punct(w)).otherwise(w),
    )


def _shouts(w: Column) -> Column:
    return (w == F.upper(w)) & (w != F.lower(w))


def _negates(low: Column, lists: WordLists) -> Column:
    return F.coalesce(low.isin(list(lists.negations)) | low.contains("n't"), F.lit(False))


def _idiom_value(*names: str) -> Column:
    table = F.create_map(*[F.lit(x) for pair in IDIOMS.items() for x in pair])
    return F.element_at(table, F.concat_ws(" ", *names))


def _exclaim(c: Column) -> Column:
    def count(mark: str) -> Column:
        return F.length(c) - F.length(F.translate(c, mark, ""))

    questions = count("?")
    return F.least(count("!"), F.lit(4)) * 0.292 + F.when(questions <= 1, 0.0).when(
        questions <= 3, questions * 0.18
    ).otherwise(0.96)


def _positions(df: DataFrame, key: str, col: str) -> DataFrame:
    """One row per word, with what the rules need to know of its document."""
    w = F.col("_words")
    shouted = F.size(F.filter(w, _shouts))
    but = F.array_position(F.transform(w, F.lower), "but")
    # What holds for the whole document is worked out before its words are exploded.
    # Exploding a plain column keeps all that follows in one compiled stage, where
    # the array of words is only pointed at.
    documents = df.select(
        key, sentiment_words(col).alias("_words"), _exclaim(F.col(col)).alias("emphasis")
    ).select(
        key,
        "emphasis",
        F.size(w).alias("n"),
        ((shouted > 0) & (shouted < F.size(w))).alias("mixed"),
        F.when(but > 0, but - 1).alias("but"),
        "_words",
    )
    return documents.select("*", F.posexplode_outer("_words").alias("i", "w0"))


def _neighbours(df: DataFrame) -> DataFrame:
    """Add the three words before, also in lower case, and the two after."""
    offsets = {"w3": -3, "w2": -2, "w1": -1, "n1": 1, "n2": 2}
    near = [F.get("_words", F.col("i") + d).alias(name) for name, d in offsets.items()]
    lowered = [F.lower(f"w{back}").alias(f"l{back}") for back in (1, 2, 3)]
    return df.select("*", *near).drop("_words").select("*", *lowered)


def _boosted(df: DataFrame, back: int, lists: WordLists) -> DataFrame:
    """Effect of the word ``back`` places before: booster, then negation."""
    w, low, v = F.col(f"w{back}"), F.col(f"l{back}"), F.col("v")
    sign = F.when(v < 0, -1.0).otherwise(1.0)
    scalar = F.when(low.isin(list(lists.stronger)), sign * BOOST).when(
        low.isin(list(lists.weaker)), sign * -BOOST
    )
    caps = F.when(
        _shouts(w) & F.col("mixed"), F.when(v > 0, F.lit(CAPS)).otherwise(F.lit(-CAPS))
    ).otherwise(0.0)
    fade = {1: 1.0, 2: 0.95, 3: 0.9}[back]
    applies = (F.col("i") >= back) & F.col(f"in{back}").isNull()
    raised = v + F.coalesce((scalar + caps) * fade, F.lit(0.0))
    negated = F.when(_negates(low, lists), F.lit(NEGATION)).otherwise(1.0)
    emphatic = ["so", "this"]
    if back == 2:
        never_so = (F.col("w2") == "never") & F.col("w1").isin(emphatic)
        negated = F.when(never_so, 1.5).otherwise(negated)
    elif back == 3:
        never_so = ((F.col("w3") == "never") & F.col("w2").isin(emphatic)) | F.col("w1").isin(emphatic)
        negated = F.when(never_so, 1.25).otherwise(negated)
    return df.withColumn("v", F.when(applies, raised * negated).otherwise(v))


def _idiom(df: DataFrame) -> DataFrame:
    """Set phrases around the word, and two-word boosters before it."""

    value = F.coalesce(
        F.when(F.col("n2").isNotNull(), _idiom_value("w0", "n1", "n2")),
        F.when(F.col("n1").isNotNull(), _idiom_value("w0", "n1")),
        _idiom_value("w1", "w0"),
        _idiom_value("w2", "w1", "w0"),
        _idiom_value("w2", "w1"),
        _idiom_value("w3", "w2", "w1"),
        _idiom_value("w3", "w2"),
        F.col("v"),
    )
    weak = F.concat_ws(" ", "w3", "w2").isin(WEAKER_PHRASES) | F.concat_ws(" ", "w2", "w1").isin(
        WEAKER_PHRASES
    )
    value = value - F.when(weak, BOOST).otherwise(0.0)
    # No phrase is put together unless a word that only phrases have is near.
    marked = F.lit(False)
    for name in ("w3", "w2", "w1", "w0", "n1", "n2"):
        marked = marked | F.coalesce(F.col(name).isin(PHRASE_WORDS), F.lit(False))
    applies = (F.col("i") >= 3) & F.col("in3").isNull() & marked
    return df.withColumn("v", F.when(applies, value).otherwise(F.col("v")))


def _least(df: DataFrame) -> DataFrame:
    least = (F.col("l1") == "least") & F.col("in1").isNull()
    spared = (F.col("i") > 1) & F.col("l2").isin("at", "very")
    turned = F.when(least & ~F.coalesce(spared, F.lit(False)), F.col("v") * NEGATION)
    return df.withColumn("v", F.coalesce(turned, F.col("v")))


def _joined_once(at: DataFrame, key: str, table: DataFrame, unscored: Column) -> DataFrame:
    """Lexicon words with their own valence and those of the words just before, and one row without a
    valence for each document, from one join: the words before are found among a document's hits."""
    hits = join_given_terms(at.withColumn("term", F.col("l0")), table, small=False).drop("term")
    order = Window.partitionBy(key).orderBy("i")
    for back in (1, 2, 3):
        earlier = [
            F.when(F.lag("i", n).over(order) == F.col("i") - back, F.lag("valence", n).over(order))
            for n in range(1, back + 1)
        ]
        hits = hits.withColumn(f"in{back}", F.coalesce(*earlier))
    hits = hits.withColumn("v0", F.when(~unscored, F.col("valence"))).filter("v0 is not null").drop("valence")
    nothing = F.lit(None).cast("double")
    first = at.filter("i is null or i = 0").select("*", *[nothing.alias(c) for c in ("in1", "in2", "in3", "v0")])
    return hits.unionByName(first)


def sentiment(
    df: DataFrame,
    key: str | None,
    col: str,
    lexicon: DataFrame,
    out: str = "sentiment",
    lists: WordLists = WordLists(),
) -> DataFrame:
    """(key, out): a struct of ``neg``, ``neu``, ``pos`` and ``compound`` per document.

    ``lexicon`` has columns ``term`` (lower case) and ``valence``. Words are scored in
    place with their neighbours beside them and summed before the only shuffle, which
    carries one small row per document and map task.

    With None for ``key``, or where it is repeated or null, rows are numbered: each has its own scores.
    With None all columns are given back with ``out``.
    """
    rows, number = row_key(df, key)
    if number != key:
        scores = sentiment(rows, number, col, lexicon, out, lists)
        columns = df.columns if key is None else [key]
        return rows.join(scores, number, "left").select(*[F.col(c) for c in columns if c != out], out)
    table = lexicon.groupBy("term").agg(F.max(F.col("valence").cast("double")).alias("valence"))
    small = fits_broadcast(table)
    low = F.col("l0")

    def unscored(next_word: Column) -> Column:
        return low.isin([*lists.stronger, *lists.weaker]) | (
            (low == "kind") & (F.coalesce(F.lower(next_word), F.lit("")) == "of")
        )

    # From here on only lexicon words count, and one row of every document.
    at = _positions(df, key, col).withColumn("l0", F.lower("w0"))
    if small:
        def listed(rows: DataFrame, word: Column, name: str) -> DataFrame:
            found = rows.withColumn("term", word).join(F.broadcast(table), "term", "left")
            return found.withColumnRenamed("valence", name).drop("term")

        at = listed(at, low, "v0")
        at = at.withColumn("v0", F.when(~unscored(F.get("_words", F.col("i") + 1)), F.col("v0")))
        at = _neighbours(at.filter("v0 is not null or i is null or i = 0"))
        for back in (1, 2, 3):
            neighbour = F.when(F.col("v0").isNotNull(), F.col(f"l{back}"))
            at = listed(at, neighbour, f"in{back}")
    else:
        at = _joined_once(_neighbours(at), key, table, unscored(F.col("n1")))
    shout = F.when(_shouts(F.col("w0")) & F.col("mixed"), F.lit(CAPS)).otherwise(0.0)
    at = at.withColumn("v", F.col("v0") + F.when(F.col("v0") > 0, shout).otherwise(-shout))
    for back in (1, 2, 3):
        at = _boosted(at, back, lists)
    at = _least(_idiom(at))
    around_but = F.when(F.col("i") < F.col("but"), 0.5).when(F.col("i") > F.col("but"), 1.5)
    v = F.col("v") * F.coalesce(around_but, F.lit(1.0))
    sums = (
        at.select(key, "n", "emphasis", v.alias("v"))
        .groupBy(key)
        .agg(
            F.max("n").alias("n"),
            F.max("emphasis").alias("emphasis"),
            F.coalesce(F.sum("v"), F.lit(0.0)).alias("total"),
            F.coalesce(F.sum(F.when(F.col("v") > 0, F.col("v") + 1)), F.lit(0.0)).alias("up"),
            F.coalesce(F.sum(F.when(F.col("v") < 0, 1 - F.col("v"))), F.lit(0.0)).alias("down"),
            F.count(F.when(F.col("v") != 0, 1)).alias("scored"),
        )
    )
    emphasis = F.col("emphasis")
    shifted = sums.select(
        key,
        "n",
        (F.col("total") + F.signum("total") * emphasis).alias("total"),
        (F.col("up") + F.when(F.col("up") > F.col("down"), emphasis).otherwise(0.0)).alias("up"),
        (F.col("down") + F.when(F.col("up") < F.col("down"), emphasis).otherwise(0.0)).alias("down"),
        (F.col("n") - F.col("scored")).alias("flat"),
    )
    whole = F.col("up") + F.col("down") + F.col("flat")

    def share(part: str) -> Column:
        return F.round(F.coalesce(F.try_divide(F.col(part), whole), F.lit(0.0)), 3)

    compound = F.col("total") / F.sqrt(F.col("total") * F.col("total") + ALPHA)
    scores = F.struct(
        share("down").alias("neg"),
        share("flat").alias("neu"),
        share("up").alias("pos"),
        F.round(compound, 4).alias("compound"),
    )
    return shifted.select(key, F.when(F.col("n").isNotNull(), scores).alias(out))
