"""Translation of phrases: glossary terms of one word or several, the leftmost longest first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexsieve.functions.tokens import tokenize
from lexsieve.operators.terms import dealt, fits_broadcast, join_given_terms, made_once, patch_tokens, row_key, tokens_of
from lexsieve.sources.shared import settle

CHOSEN = "array<struct<pos:int,size:int,word:string>>"


def trie(glossary: DataFrame, lang: str) -> DataFrame:
    """(term, size, word, open): the nodes of a trie of the glossary's terms.

    A node is the words on its path joined by spaces, which no word holds. ``word`` is its target
    if a term ends there, of several the first in order; ``open`` tells whether longer terms go on.
    """
    words = F.filter(tokenize("term"), lambda w: w != "")
    terms = glossary.filter((F.col("lang") == lang) & F.col("target").isNotNull()).select(words.alias("w"), "target")
    paths = F.transform(F.sequence(F.lit(1), F.size("w")), lambda n: F.struct(
        F.array_join(F.slice("w", 1, n), " ").alias("term"), n.alias("size"),
        F.when(n == F.size("w"), F.col("target")).alias("word"), (n < F.size("w")).alias("open"),
    ))
    nodes = terms.filter("size(w) > 0").select(F.explode(paths).alias("n")).select("n.*")
    return nodes.groupBy("term", "size").agg(F.min("word").alias("word"), F.max("open").alias("open"))


def phrase_hits(df: DataFrame, key: str, tokens: Column, nodes: DataFrame) -> DataFrame:
    """(key, pos, size, word): the longest term that begins at each place, if one does.

    The tokens walk down the trie, one word a level. Only tokens that begin a term set out, and
    each stops where no node goes on, keeping the last term that ended on its way.
    """
    nodes = settle(nodes)
    depth = nodes.agg(F.max("size")).first()[0] or 0
    small = fits_broadcast(nodes.select("term", "word", "open"))
    starts = df.select(key, tokens.alias("_tokens")).select(
        key, "_tokens", F.posexplode(made_once(F.col("_tokens"))).alias("pos", "term")
    )
    if not small:  # rows will be written, and the whole array must not be with each
        ahead = F.slice("_tokens", F.col("pos") + 2, F.lit(max(depth - 1, 0)))
        starts = starts.withColumn("_ahead", ahead).drop("_tokens")
    level = nodes.filter("size = 1").select("term", "word", "open")
    walk = join_given_terms(starts.filter("term != ''"), level, small=small)
    walk = walk.withColumn("size", F.when(F.col("word").isNotNull(), 1))
    for n in range(2, depth + 1):
        following = F.get("_tokens", F.col("pos") + n - 1) if small else F.get("_ahead", F.lit(n - 2))
        path = F.when(F.col("open") & (following != ""), F.concat_ws(" ", "term", following))
        level = nodes.filter(F.col("size") == n).select(F.col("term").alias("_to"), F.col("word").alias("_word"), F.col("open").alias("_open"))
        # A walk that has ended goes nowhere, by a name of its own, so that such rows stay spread.
        nowhere = F.concat(F.lit(" "), F.xxhash64(key, "pos").cast("string"))
        walk = walk.withColumn("_path", F.coalesce(path, nowhere)).join(
            F.broadcast(level) if small else level, F.col("_path") == F.col("_to"), "left"
        )
        ended = F.col("_word").isNotNull()
        others = [c for c in ("_tokens", "_ahead") if c in walk.columns]
        walk = walk.select(
            key, "pos", *others, F.col("_to").alias("term"), F.coalesce("_open", F.lit(False)).alias("open"),
            F.when(ended, F.col("_word")).otherwise(F.col("word")).alias("word"),
            F.when(ended, F.lit(n)).otherwise(F.col("size")).alias("size"),
        )
    return walk.filter("size is not null").select(key, "pos", "size", "word")


def leftmost(hits: DataFrame, key: str) -> DataFrame:
    """The hits that stand when each is taken from left to right, unless one taken before covers it.

    Hits that overlap form chains, between which nothing reaches across; only a chain is
    looked at in order.
    """
    reach = F.max(F.col("pos") + F.col("size"))
    order = Window.partitionBy(key).orderBy("pos")
    before = reach.over(order.rowsBetween(Window.unboundedPreceding, -1))
    chained = hits.withColumn("chain", F.when(F.col("pos") >= F.coalesce(before, F.lit(0)), 1).otherwise(0))
    chained = chained.withColumn("chain", F.sum("chain").over(order))
    listed = F.sort_array(F.collect_list(F.struct("pos", "size", "word")))
    chains = chained.groupBy(key, "chain").agg(listed.alias("hits"))

    def step(state: Column, hit: Column) -> Column:
        taken = F.struct(
            (hit["pos"] + hit["size"]).alias("free"), F.array_append(state["taken"], hit).alias("taken")
        )
        return F.when(hit["pos"] >= state["free"], taken).otherwise(state)

    start = F.struct(F.lit(0).alias("free"), F.array().cast(CHOSEN).alias("taken"))
    alone = F.col("hits").cast(CHOSEN)
    chosen = F.when(F.size("hits") == 1, alone).otherwise(F.aggregate(alone, start, step, lambda s: s["taken"]))
    return chains.select(key, F.explode(chosen).alias("h")).select(key, "h.*")


def translate_phrases(
    df: DataFrame, key: str | None, col: str, glossary: DataFrame, lang: str, out: str = "translated"
) -> DataFrame:
    """Add the tokens with each glossary term, of one word or several, replaced by its target in ``lang``.

    ``glossary`` has columns ``lang``, ``term`` and ``target``. A term is split into words as texts are.
    At each place, from the left, the longest term that begins there is taken, and the next
    begins after it. A target is one item of the result. Where several terms have the same words, the
    first target in order is taken. Tokens in no term stay; empty tokens are in none.
    """
    df, key = row_key(df, key)
    tokens = tokens_of(df, col)
    hits = leftmost(phrase_hits(dealt(df, key), key, tokens, trie(glossary, lang)), key)
    changes = F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: F.struct(
        (F.col("pos") + i).alias("pos"), F.when(i == 0, F.col("word")).alias("word")
    ))
    changed = hits.select(key, F.explode(changes).alias("c")).select(key, "c.*")
    return patch_tokens(df, key, tokens, changed, out)
