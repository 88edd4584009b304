"""The registered queries: SQL twins, whole tables and the pipeline."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
import corpus_pipeline
from lexsieve.llm.queries import ORACLE, QUERIES
from tests.compare import duck, duck_rows, spark_rows

FOLDER = "/root/testdata/sf0.001"


def test_all_operators_are_registered():
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES)
    assert numbers == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= entry_points.queries().keys()


@pytest.mark.parametrize("name", ORACLE)
def test_same_rows_as_sql(spark, name):
    names, got = spark_rows(QUERIES[name](spark, FOLDER))
    want_names, want = duck_rows(duck(FOLDER), ORACLE[name])
    assert (names, got) == (want_names, want)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE])
def test_one_row_for_each_of_the_table(spark, name):
    table, key = ("embeddings", "vec_id") if name.startswith("op3") else ("documents", "doc_id")
    found = QUERIES[name](spark, FOLDER).select(key)
    want = spark.read.parquet(f"{FOLDER}/{table}.parquet").select(key)
    assert found.exceptAll(want).isEmpty() and want.exceptAll(found).isEmpty()


def test_pipeline_stages(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs, seen = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = stage(spark, docs, FOLDER).cache()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert seen[name].schema.names == documents.schema.names
            docs = seen[name]
    assert seen["toxicity"].count() >= 0.8 * documents.count()
    assert seen["near_duplicates"].select("text").distinct().count() == seen["near_duplicates"].count()
    assert seen["secrets"].count() == seen["near_duplicates"].count()
    assert seen["secrets"].filter(F.col("text").rlike("AKIA[A-Z0-9]{16}")).isEmpty()
    assert seen["bpe"].count() == seen["mixing"].count()


def test_pipeline_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert docs.count() == 0
