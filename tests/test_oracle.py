"""Every query of the library against its SQL twin."""

import re
from collections import Counter

import pytest

from lexsieve.plans.catalog import QUERIES
from oracle import ORACLE
from tests.compare import duck, duck_rows, spark_rows

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(FOLDER)


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_same_rows(spark, connection, name):
    names, got = spark_rows(QUERIES[name](spark, FOLDER))
    want_names, want = duck_rows(connection, ORACLE[name])
    assert names == want_names
    assert got == want


def test_spelling_alters_no_common_token(spark):
    """A token of the vocabulary stays, short ones as well."""
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    corrected = {r.doc_id: r.corrected for r in QUERIES["spell_correct"](spark, FOLDER).collect()}
    before = {r.doc_id: r.text.lower().rstrip() for r in documents}
    pairs = Counter()
    for key, text in before.items():
        pairs.update(zip(re.split("[ \t-\r]", text), corrected[key].split(" ")))
    seen = Counter()
    for (token, _), n in pairs.items():
        seen[token] += n
    assert all(new == old for old, new in pairs if seen[old] >= 20)
    assert sum(new != old for old, new in pairs) > 0 and {"the", "and"} <= {w for w, n in seen.items() if n >= 20}
