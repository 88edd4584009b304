"""N-gram Jaccard join by MinHash banding and exact verification.

A text is the set of its runs of five words. Each band (``trees`` of them) hashes a text's first
``prefix_length`` min-hashes of its own; texts with an equal band are candidates. The length is worked
out once: the longest at which pairs at the threshold are expected to be found with the target
recall. No forest is built: prefixes are neither sorted nor deepened where they are crowded.
Candidates that hang together form a cluster, and inside clusters all pairs are verified
exactly, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexsieve.llm.common import code_points, named, objects, packed, unpacked
from lexsieve.llm.components import components
from lexsieve.sources.shared import settle

OUTPUTS = ["class_id", "n_links", "kept"]
WORDS = 5
SPACES = " \t\n\x0b\x0c\r"
CODE = {ord(c): " " for c in SPACES}


def prefix_length(threshold: float, trees: int, depth: int, target: float) -> int:
    """The longest prefix at which a pair at the threshold meets in a tree with the target
    probability, 1 at least."""
    length = depth
    while length > 1 and 1 - (1 - threshold**length) ** trees < target:
        length -= 1
    return length


def split_words(text: str) -> list[str]:
    return [w for w in text.translate(CODE).split(" ") if w]


def shingle_hashes(words: list[str], n: int = WORDS) -> np.ndarray:
    """32-bit hashes of a text's runs of ``n`` words (of all words, if fewer)."""
    ids = pd.util.hash_array(np.array(words, dtype=object), categorize=len(words) > 50)
    n = min(n, len(words))
    mixed = np.zeros(len(ids) - n + 1, np.uint64)
    for i in range(n):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + (ids[i : len(ids) - n + 1 + i] ^ np.uint64(i + 1))
        mixed ^= mixed >> np.uint64(29)
    return np.unique((mixed * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32))


def prefixes(text: str, trees: int, length: int, seed: int) -> np.ndarray | None:
    """A hash of the first ``length`` min-hashes in each tree; None for a text without words."""
    words = split_words(text)
    if not words:
        return None
    shingles = shingle_hashes(words)
    random = np.random.default_rng(seed)
    count = trees * length
    turn = random.integers(0, 2**32, count, dtype=np.uint32)
    factor = random.integers(0, 2**31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    least = np.full(count, 2**32 - 1, np.uint32)
    for i in range(0, len(shingles), 1024):
        part = shingles[None, i : i + 1024] ^ turn[:, None]
        part *= factor[:, None]
        part ^= part >> np.uint32(15)
        part *= np.uint32(0x2C1B3C6D)
        np.minimum(least, part.min(axis=1), out=least)
    tree = np.arange(trees, dtype=np.uint64) + np.uint64(1)
    mixed = tree * np.uint64(0x9E3779B97F4A7C15)
    for column in least.reshape(trees, length).T:
        mixed = (mixed ^ column) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(31)
    return mixed.view(np.int64)


def shingle_rows(texts: list[str], n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle) of all different shingles of each text, shingles numbered exactly:
    equal numbers mean equal words."""
    split = [split_words(t) for t in texts]
    sizes = np.array([len(w) for w in split])
    code = pd.factorize(np.array([w for words in split for w in words], dtype=object))[0].astype(np.int64) + 1
    text = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left = sizes[text] - at
    shingle = code
    for i in range(1, n):
        # Past the end of a short text the following word is 0.
        following = np.r_[code[i:], np.zeros(min(i, len(code)), np.int64)]
        following = np.where(left > i, following, 0)
        shingle = np.unique(shingle * (code.max(initial=0) + 1) + following, return_inverse=True)[1]
    whole = (left >= n) | ((at == 0) & (sizes[text] < n))
    pairs = np.unique(np.c_[text[whole], shingle[whole]], axis=0)
    return pairs[:, 0], pairs[:, 1]


def links(
    texts: list[str], threshold: tuple[int, int], left: np.ndarray | None = None, columns: int = 2048
) -> np.ndarray:
    """Matrix of the pairs with Jaccard similarity of at least threshold[0] / threshold[1].

    Intersections are counted by matrix products over stretches of the shingles that two texts
    or more have; others are in no intersection. ``left`` marks the texts of the first of two
    blocks: then only pairs across blocks count.
    """
    n = len(texts)
    text, shingle = shingle_rows(texts)
    size = np.bincount(text, minlength=n)
    shared = np.bincount(shingle)[shingle] > 1 if len(shingle) else np.zeros(0, bool)
    text, shingle = text[shared], np.unique(shingle[shared], return_inverse=True)[1]
    both = np.zeros((n, n), np.float32)
    order = np.argsort(shingle, kind="stable")
    text, shingle = text[order], shingle[order]
    for start in range(0, int(shingle.max(initial=-1)) + 1, columns):
        a, b = np.searchsorted(shingle, [start, start + columns])
        part = np.zeros((n, columns), np.float32)
        part[text[a:b], shingle[a:b] - start] = 1
        both += part @ part.T
    common = both.astype(np.int64)
    over, under = threshold
    near = (common > 0) & (common * (over + under) >= over * (size[:, None] + size[None, :]))
    np.fill_diagonal(near, False)
    if left is not None:
        near &= left[:, None] != left[None, :]
    return near


def _least_reachable(near: np.ndarray) -> np.ndarray:
    label = np.arange(len(near))
    while True:
        new = np.array([label[row].min(initial=own) for row, own in zip(near, label, strict=True)])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_classes(
    df: DataFrame, key: str = "doc_id", text: str = "text", threshold: tuple[int, int] = (4, 5),
    trees: int = 24, depth: int = 6, target: float = 0.9995, block: int = 800, seed: int = 3,
) -> DataFrame:
    """(tid, class_tid, copies, n_links, class_id, head_tid): one row per different text, ``tid``
    being its digest.

    ``n_links`` counts the other rows that a row of this text is linked with directly, copies
    included; ``class_tid`` is the least digest in its class, ``class_id`` the least key, and
    ``head_tid`` the text that has it.

    Copies are one text throughout. A frequent prefix is met by a partial minimum; a cluster over
    ``block`` texts is cut into blocks, and each pair of blocks is a task of its own, so no
    group is gathered whole and no pair is given out as a row. Inside a cluster every pair
    is verified, so no candidate is left out, whatever its size.
    """
    length = prefix_length(threshold[0] / threshold[1], trees, depth, target)
    documents = df.select(named(key).alias("key"), code_points(named(text)).alias("text"))

    @F.pandas_udf("array<bigint>")
    def signature(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            yield pd.Series([prefixes(t, trees, length, seed) for t in series], dtype=object)

    signed = documents.select(
        "key", F.md5("text").alias("tid"), F.xxhash64("text").alias("node"), signature("text").alias("prefixes")
    )
    forest = settle(signed.groupBy("tid", "node").agg(
        F.count("*").alias("copies"), F.min("key").alias("key"), F.first("prefixes").alias("prefixes")
    ))
    leaves = forest.select("node", F.explode("prefixes").alias("prefix"))
    hubs = leaves.groupBy("prefix").agg(F.min("node").alias("hub"), F.max("node").alias("other"))
    met = leaves.join(hubs.filter("hub != other").select("prefix", "hub"), "prefix").filter("node != hub")
    edges = settle(met.select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct())
    clusters = settle(components(edges))
    sizes = clusters.groupBy("label").agg(F.count("*").alias("members"))
    placed = clusters.join(sizes, "label").select(
        "node", "label", F.ceil(F.col("members") / block).cast("int").alias("blocks")
    )
    members = settle(forest.join(placed, "node").select("tid", "key", "copies", "label", "blocks"))

    # One row per text of a cluster, with the text.
    wanted = members
    texts = documents.withColumn("tid", F.md5("text"))
    full = texts.join(wanted, (texts["tid"] == wanted["tid"]) & texts["key"].eqNullSafe(wanted["key"])).select(
        wanted["tid"], "text", "copies", "label", "blocks"
    ).dropDuplicates(["tid"])
    own = F.pmod(F.xxhash64("tid"), F.col("blocks")).cast("int")
    others = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda j: F.struct(F.least("own", j).alias("p"), F.greatest("own", j).alias("q")),
    )
    total = members.count()
    bins = max(1, total // block)
    one = F.col("blocks") == 1
    dealt = full.withColumn("own", own).withColumn("pair", F.explode(others)).select(
        "tid", "text", "copies", "label", "own", "pair.*",
        F.when(one, F.pmod(F.xxhash64("label"), F.lit(bins))).otherwise(F.col("label")).alias("bin"),
        one.alias("whole"),
    )

    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, group in rows.groupby("label", sort=False):
            across = group["p"].iloc[0] != group["q"].iloc[0]
            left = (group["own"] == group["p"]).to_numpy() if across else None
            near = links(group["text"].tolist(), threshold, left)
            tid = group["tid"].to_numpy()
            linked = near @ group["copies"].to_numpy()
            order = np.argsort(tid)
            rank = np.empty(len(tid), int)
            rank[order] = np.arange(len(tid))
            reached = tid[order][_least_reachable(near[np.ix_(order, order)])]
            some = linked > 0
            out.append((tid[some], linked[some], reached[rank][some]))
        tid, linked, hub = (np.concatenate(x) for x in zip(*out, strict=True))
        return pd.DataFrame({"tid": objects(tid), "linked": linked, "hub": objects(hub)})

    verified = settle(
        dealt.groupBy("bin", "whole", "p", "q").applyInPandas(verify, "tid string, linked long, hub string")
    )
    linked = verified.groupBy("tid").agg(F.sum("linked").alias("linked"))
    classes = components(verified.select(F.col("tid").alias("a"), F.col("hub").alias("b")))
    labelled = (
        forest.select("tid", "copies", "key")
        .join(classes.select(F.col("node").alias("tid"), F.col("label").alias("class_tid")), "tid", "left")
        .join(linked, "tid", "left")
        .withColumn("class_tid", F.coalesce("class_tid", "tid"))
    )
    labelled = settle(labelled)
    heads = labelled.groupBy("class_tid").agg(
        F.min("key").alias("class_id"), F.min_by("tid", F.struct(F.col("key").isNull(), "key", "tid")).alias("head_tid")
    )
    return settle(labelled.join(heads, "class_tid").select(
        "tid", "class_tid", "copies",
        (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        "class_id", "head_tid",
    ))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """All rows with ``class_id``, ``n_links`` and ``kept``.

    A class is what links connect, equal texts included; ``class_id`` is the least key in it.
    ``n_links`` counts the other rows linked directly. ``kept`` marks the class's row of the
    least key (null last); repeated rows with the same key and text are marked alike, and
    :func:`keep_one` takes one of them. Options are those of :func:`near_classes`.

    Texts without words link with none but their equals; a text of fewer than five words is
    one shingle; null counts as empty. An empty table gives an empty result.
    """
    classes = near_classes(df, key, text, **options).select("tid", "class_id", "n_links", "head_tid")
    rows = packed(df, OUTPUTS, key=named(key), tid=F.md5(code_points(named(text))))
    joined = rows.join(classes, "tid")
    kept = F.col("key").eqNullSafe(F.col("class_id")) & (F.col("tid") == F.col("head_tid"))
    return unpacked(joined, "class_id", "n_links", kept.alias("kept"))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each class, with the columns of ``df``."""
    found = near_duplicates(df, key, text, **options).filter("kept").drop(*OUTPUTS)
    first = F.struct(named(key), F.md5(code_points(named(text))))
    repeated = df.groupBy(first.alias("k")).count().filter("count > 1")
    if repeated.isEmpty():
        return found
    return found.withColumn("__k", first).dropDuplicates(["__k"]).drop("__k")
