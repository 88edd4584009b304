"""Very long texts: one run without a break, or one piece again and again."""

from __future__ import annotations

import random
import re
import time

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer as Library

from lexsieve.llm import bpe, fingerprints, quality, secrets, toxicity

LONG_PIECES = ["ab/", "a-", "aA1_", "a ", "word word ", "a", "é", "x\n", "deadbeef"]


@pytest.fixture(scope="module")
def long_texts(spark):
    rows = [(i, piece * (300_000 // len(piece))) for i, piece in enumerate(LONG_PIECES)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()


def test_secrets_of_long_texts(long_texts):
    found = {r["doc_id"]: r["kinds"] for r in secrets.scan_secrets(long_texts).select(
        "doc_id", F.transform("secrets", lambda s: s["order"]).alias("kinds")
    ).collect()}
    assert len(found) == len(LONG_PIECES)
    hexadecimal = {i for i, piece in enumerate(LONG_PIECES) if set(piece) <= set("0123456789abcdef")}
    assert len(hexadecimal) == 2
    assert all(kinds == ([2] if i in hexadecimal else []) for i, kinds in found.items())


def test_fingerprints_of_long_texts(long_texts):
    """A run without a break has anchors of its characters, as has a row of equal words."""
    found = {r["doc_id"]: r["n"] for r in long_texts.select("doc_id", F.size(fingerprints.anchors(F.col("text"))).alias("n")).collect()}
    assert len(found) == len(LONG_PIECES) and all(n > 10_000 for n in found.values())


def test_fingerprints_without_white_space(spark):
    random.seed(9)
    signs = [chr(c) for c in range(0x4E00, 0x4E00 + 900)]
    text, tail, front = ("".join(random.choices(signs, k=n)) for n in (600, 200, 70))
    rows = [(text, text[:400] + tail), (text, front + text), (text, "".join(random.choices(signs, k=600)))]
    a, b = fingerprints.anchors(F.col("a")), fingerprints.anchors(F.col("b"))
    found = spark.createDataFrame(rows, "a string, b string").select(
        fingerprints.likeness(a, b).alias("near"), fingerprints.in_place(a, b).alias("placed"), F.size(a).alias("n")
    ).collect()
    assert found[0]["near"] > 0.4 and found[0]["placed"] > 0.6 * found[0]["n"]
    assert found[1]["near"] > 0.8 and found[1]["placed"] > 0.99 * found[1]["n"]
    assert found[2]["near"] == 0.0 and found[2]["placed"] == 0


def test_anchors_match_by_position(spark):
    """A passage that moved is matched at its one distance; a reordered text only in part."""
    random.seed(10)
    words = [f"w{i}" for i in range(200)]
    moved, halves = ["new"] * 9 + words, words[100:] + words[:100]
    rows = [(" ".join(words), " ".join(other)) for other in (words, moved, halves)]
    a, b = fingerprints.anchors(F.col("a")), fingerprints.anchors(F.col("b"))
    found = spark.createDataFrame(rows, "a string, b string").select(fingerprints.in_place(a, b).alias("placed"), F.size(a).alias("n")).collect()
    n = found[0]["n"]
    assert found[0]["placed"] == n and found[1]["placed"] == n and 0.3 * n < found[2]["placed"] < 0.7 * n


def test_quality_of_long_texts(long_texts):
    found = quality.classify(long_texts).select("doc_id", "quality").collect()
    assert len(found) == len(LONG_PIECES) and all(0 <= r["quality"] <= 1 for r in found)


def test_repeats_as_the_pattern_says(spark):
    texts = ["", " ", "a", "a a", "a a a", " b  b\tb c", "a a b b b a", "a\x0ba\x0ba", "ab a a", "a ab ab", "x x x x y y z z z "]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    pattern = r"(?<!\S)(\S+)(?:\s+\1(?!\S))"
    for r in df.select("text", quality.votes(F.col("text"))["repeats"].alias("vote"), quality._told_once(F.col("text")).alias("once")).collect():
        bad = re.search(pattern + "{2,}", r["text"], re.ASCII)
        assert r["vote"] == (quality.BAD if bad else quality.GOOD), r
        assert r["once"].split() == re.sub(pattern + "+", r"\1 =", r["text"], flags=re.ASCII).split(), r


def test_allowed_paths_as_a_repeated_group_says(spark):
    looping = re.compile(r"[/_-]?(?:[A-Za-z]+[0-9]{0,3}[/_=-]+)+(?:[A-Za-z]+[0-9]{0,3})?")
    random.seed(6)
    texts = ["".join(random.choices("aB1/_=-+9", [4, 3, 1, 2, 2, 1, 2, 0.2, 0.5], k=random.randint(20, 24))) for _ in range(3_000)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    found = df.select("text", F.col("text").rlike(secrets.ALLOWED[2]).alias("allowed")).collect()
    assert {r["allowed"] for r in found} == {True, False}
    assert all(r["allowed"] == bool(looping.fullmatch(r["text"])) for r in found)


@pytest.mark.parametrize("most_rows", [100, 300])
def test_toxicity_keeps_its_meaning_under_a_bound(spark, most_rows):
    """The share of rows flagged hardly depends on how many rows of a class are sampled."""
    folder = "/root/testdata/sf0.1"
    documents = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    shares = []
    for bound in (most_rows, 100_000):
        model = toxicity.train(documents, labels, most_rows=bound)
        flagged = toxicity.score(documents.join(labels, "doc_id").filter("toxic = 0"), model)
        shares.append(flagged.agg(F.avg("predicted")).first()[0])
    assert abs(shares[0] - shares[1]) < 0.05, shares


def test_toxicity_takes_one_row_of_an_id(spark):
    rows = [(1, f"same id {i}") for i in range(2_000)] + [(i, f"bad words {i}") for i in range(2, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")).distinct()
    assert toxicity.score(df, toxicity.train(df, labels)).count() == len(rows)


def test_bpe_of_long_words_as_the_library_does():
    path = public_tokenizers.path("word_bpe_49k.json")
    coder, library = bpe.Tokenizer(path), Library.from_file(path)
    random.seed(7)
    letters = "etaoinshrdlucmfwypvbgkqjxz"
    words = ["".join(random.choices(letters, range(26, 0, -1), k=n)) for n in (999, 1_000, 1_001, 5_000, 30_000)]
    words += ["a" * 4_001, "ab" * 3_000, "é" * 1_500, "日本語" * 700, "".join(random.choices("aéß日", k=3_000)), "the" * 2_000]
    texts = [*words, " ".join(words[:3]) + " the end", words[3] + "!"]
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_of_a_megabyte_without_a_break():
    coder = bpe.Tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    random.seed(8)
    text = "".join(random.choices("etaoinshrdlucmfwypvbgkqjxz", k=1_000_000))
    start = time.process_time()
    assert len(coder.encode([text])[0]) > 100_000
    assert time.process_time() - start < 20
