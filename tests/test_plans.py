"""The plans are the ones meant for big inputs."""

import re

import pytest
from pyspark.sql import functions as F

from lexsieve import functions as fn
from lexsieve import operators as op
from lexsieve.operators import terms
from lexsieve.plans import normalize
from lexsieve.sources import settle
from lexsieve.plans.catalog import QUERIES, flagship

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.mark.parametrize("name", QUERIES)
def test_no_python_and_no_cross_join(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert not re.search("BatchEvalPython|ArrowEvalPython|MapInPandas", text)
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", text)


def test_normalize_is_one_pass(documents):
    text = plan(normalize(documents, "doc_id", "text"))
    assert "Exchange" not in text and text.count("FileScan") == 1
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_normalize_with_lemmas_shuffles_texts_once(spark, documents):
    """Stems are made for the different tokens, before; texts cross one exchange, with no stage made yet."""
    lemmas = spark.createDataFrame([("cat",)], "word string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(normalize(documents, "doc_id", "text", lemmas=lemmas))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ational" not in text
    below = text[text.index("SortMergeJoin"):]
    assert len(re.findall(r"Exchange hashpartitioning\(doc_id", below)) <= 2
    texts = [line for line in below.split("\n") if "Project" in line and "_text" in line]
    assert texts and not any("translate" in line or "split" in line for line in texts[:1])


def test_stems_are_worked_out_once_for_each_token(spark):
    """At sf0.1 that is 14 times less often than tokens occur."""
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").withColumn("text", fn.strip_punct("text"))
    counted = op.token_dictionary(documents, "text").agg(F.sum("n").alias("all"), F.count("*").alias("different")).first()
    assert counted["all"] > 13 * counted["different"]
    found = op.stem_terms(documents.select("doc_id", "text").limit(10), "doc_id", "text")
    assert "ational" not in plan(found)


def test_text_functions_compile_and_prune(documents):
    text = plan(
        documents.filter(F.col("lang") == "en").select(
            fn.lower("text"), fn.strip_punct("text"), fn.strip_non_ascii("text"), fn.strip_digits("text"),
            fn.extract_urls("text"), fn.strip_tags("text"), fn.tokenize("text"), fn.avg_word_length("text"),
            fn.word_count("text"), fn.char_count("text"), fn.special_char_count("text"),
        )
    )
    assert re.search(r"\*\(1\) Project", text)
    assert "ReadSchema: struct<text:string,lang:string>" in text and "EqualTo(lang,en)" in text


def test_remove_frequent_does_not_shuffle_documents(spark, documents):
    df = op.remove_frequent(documents, "text", 20)
    tree = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in tree and "scalar-subquery" in tree


def test_small_tables_are_broadcast_and_big_ones_filtered(spark, documents, monkeypatch):
    glossary = spark.createDataFrame([("fr", "the", "le")], "lang string, term string, target string")
    text = plan(op.translate_terms(documents, "doc_id", "text", glossary, "fr"))
    assert re.search(r"BroadcastHashJoin \[term", text)
    monkeypatch.setattr(terms, "BROADCAST_BYTES", -1)
    filtered = plan(op.translate_terms(documents, "doc_id", "text", glossary, "fr"))
    assert "posexplode" not in filtered and "settled" in filtered


def test_sentiment_shuffles_one_row_per_document(spark, documents):
    lexicon = spark.createDataFrame([("good", 1.9)], "term string, valence double")
    text = plan(op.sentiment(documents, "doc_id", "text", lexicon))
    assert len(re.findall(r"Exchange hashpartitioning\(doc_id", text)) == 1
    assert "partial_sum(v" in text and text.count("documents.parquet") == 1


def test_summary_shuffles_digests(documents):
    text = plan(op.column_summary(documents, "text"))
    assert "sha2" in text and "partial_max" in text


def test_frequent_terms_stay_out_of_the_shuffle(spark, monkeypatch):
    """One word is a third of all tokens: no shuffle partition gets its rows."""
    docs = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.concat(F.lit("r"), "id"))
                                    .otherwise("hot").alias("text"))
    monkeypatch.setattr(terms, "HOT_SHARE", 10)
    counts = settle(terms.term_counts(docs, fn.tokenize("text")))
    rows = terms.token_rows(docs, "id", fn.tokenize("text"))
    joined = terms.join_counted_terms(rows, counts, F.col("n") < 2)
    tree = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in tree and "Union" not in tree
    assert joined.count() == 1000


def test_flagship(spark):
    df = flagship(spark, FOLDER)
    assert df.columns == ["doc_id", "no_punct", "ascii", "no_digits", "tokens", "no_stop", "stems"]
    assert df.count() == 200
