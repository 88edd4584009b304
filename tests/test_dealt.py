"""Look-ups of tokens shuffle the texts alone; terms too many to broadcast give the same results."""

import re

import pytest
from pyspark.sql import functions as F

from lexsieve import functions as fn
from lexsieve import operators as op
from lexsieve.operators import terms
from lexsieve.plans import normalize
from lexsieve.sources import settle

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")


def _vocabulary(documents):
    common = terms.term_counts(documents, fn.tokenize("text")).filter("n >= 20")
    return settle(common.select(F.col("term").alias("word"), F.col("n").alias("freq")))


def _results(documents):
    words = _vocabulary(documents)
    glossary = words.select(F.lit("xx").alias("lang"), F.concat("word", F.lit(" the")).alias("term"), "word").toDF(
        "lang", "term", "target"
    )
    return {
        "ids": op.encode_tokens(documents, "doc_id", "text", op.token_dictionary(documents, "text")),
        "phrases": op.translate_phrases(documents, "doc_id", "text", glossary, "xx"),
        "stems": op.stem_terms(documents, "doc_id", "text"),
        "rare": op.remove_rare(documents, "doc_id", "text", 3),
        "spelled": op.spell_correct(documents, "doc_id", "text", words),
        "split": op.split_joined(documents, "doc_id", "text", words),
        "normal": normalize(documents, "doc_id", "text", lemmas=words),
    }


def test_hits_meet_their_texts_without_a_shuffle(spark, documents):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = {k: df._jdf.queryExecution().executedPlan().toString() for k, df in _results(documents).items()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for name, text in plans.items():
        exchanges = re.findall(r"Exchange hashpartitioning\([^\n]*", text)
        assert exchanges and all("doc_id" in x and "REPARTITION_BY_NUM" in x for x in exchanges), name
        assert "Union" not in text, name


def test_frequent_and_other_terms_together_give_the_same(spark, documents, monkeypatch):
    few = settle(documents.filter("doc_id < 30"))

    def found():
        ids = op.encode_tokens(few, "doc_id", "text", op.token_dictionary(few, "text"))
        rare = op.remove_rare(few, "doc_id", "text", 3)
        return [sorted(map(str, df.collect())) for df in (ids, rare)]

    want = found()
    monkeypatch.setattr(terms, "HOT_SHARE", 300)
    monkeypatch.setattr(terms, "HOT_BYTES", 0)
    assert found() == want


def test_terms_are_broadcast_as_long_as_they_fit(spark, monkeypatch):
    table = spark.createDataFrame([(f"t{i}", 1 << (i % 5)) for i in range(100)], "term string, n long")
    assert terms._least_frequent(table, 10**9) == 1
    monkeypatch.setattr(terms, "HOT_BYTES", 3 * 20 * 60)  # three of the five counts
    assert terms._least_frequent(table, 10**9) == 4
    monkeypatch.setattr(terms, "HOT_SHARE", 10**9)
    assert terms._least_frequent(table, 10**9) == 1
