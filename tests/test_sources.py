import json
import random

import pyarrow.parquet as pq
import pytest

from pyspark.sql import functions as F

from lexsieve import functions as fn
from lexsieve import sources as io
from lexsieve.operators import hashed_tfidf, kept_summaries, merged_summaries, summary_measures
from lexsieve.plans.catalog import QUERIES
from lexsieve.streaming import append_stream

ROWS = [(1, "A b", ["x", "y"]), (2, None, []), (3, "", None)]


@pytest.fixture
def df(spark):
    return spark.createDataFrame(ROWS, "id bigint, text string, tags array<string>")


@pytest.mark.parametrize("fmt", ["parquet", "json", "orc"])
def test_append_and_overwrite(spark, df, tmp_path, fmt):
    path = str(tmp_path / "out")
    io.write(df, fmt, "append", path)
    io.write(df, fmt, "append", path)
    back = io.read(spark, fmt, df.schema, path)
    assert sorted(map(tuple, back.collect())) == sorted(ROWS * 2)
    io.write(df.limit(1), fmt, "overwrite", path)
    assert io.read(spark, fmt, df.schema, path).count() == 1


def test_json_files(spark, tmp_path):
    (tmp_path / "array.json").write_text(json.dumps([{"a": 1, "b": "x"}, {"a": "two"}]))
    (tmp_path / "lines.json").write_text('{"a": 1, "b": "x"}\n{"a": 2}\n')
    array = io.read_json(spark, str(tmp_path / "array.json"), array=True)
    assert [(r.a, r.b) for r in array.collect()] == [("1", "x"), ("two", None)]
    lines = io.read_json(spark, str(tmp_path / "lines.json"), "a bigint, b string")
    assert [(r.a, r.b) for r in lines.collect()] == [(1, "x"), (2, None)]


def test_json_column(spark):
    texts = ['[{"a": 1}, {"a": 2}]', '{"a": 3}', "broken", None]
    df = spark.createDataFrame([(t,) for t in texts], "j string")
    got = [(r.a, r.bad) for r in io.parse_json(df, "j", "a bigint", corrupt="bad").collect()]
    assert got == [(1, None), (2, None), (3, None), (None, "broken"), (None, None)]
    assert io.parse_json(df, "j", "a bigint").columns == ["a"]
    more = spark.createDataFrame([("[]",), ("[null, {\"a\": 1}]",), ("",), ('{"a": 1',)], "j string")
    rows = [(r.a, r.bad) for r in io.parse_json(more, "j", "a bigint", corrupt="bad").collect()]
    assert rows == [(None, None), (1, None), (None, ""), (None, '{"a": 1')]


def test_json_lines(df):
    lines = [r.value for r in io.to_json_lines(df).collect()]
    assert lines == ['{"id":1,"text":"A b","tags":["x","y"]}', '{"id":2,"tags":[]}', '{"id":3,"text":""}']
    assert '"text":null' in io.to_json_lines(df, ignore_nulls=False).collect()[1].value


def test_flatten(df):
    assert [r.tags for r in io.flatten_arrays(df).collect()] == ["x,y", "", None]


def test_vector_text(spark):
    df = spark.createDataFrame([(1, "a a b"), (2, "c")], "id bigint, text string")
    vectors = hashed_tfidf(df, "text")
    text = vectors.select(io.vector_text("tf").alias("x")).first().x
    assert text == str(vectors.first().tf)


def test_jdbc_options():
    options = io.jdbc_options("jdbc:x", "t", "id", 0, 100, 8, user="u")
    assert options["numPartitions"] == "8" and options["partitionColumn"] == "id" and options["user"] == "u"


def test_view(df):
    assert io.query_view(df, "some_rows", "select count(*) as n from some_rows").first().n == 3


def test_shared_folder_is_the_clusters(spark):
    assert io.shared_folder(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")
    settled = io.settle(spark.range(5))
    assert settled.count() == 5 and all(io.shared_folder(spark) in f for f in settled.inputFiles())


def test_spread(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).coalesce(1).write.parquet(path)
    few = spark.read.parquet(path)
    assert io.spread(few, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1")
    try:
        large = spark.read.parquet(path)
        assert io.spread(large, "id") is large
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_functions_run_on_streams(spark, df, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    io.write(df, "parquet", "append", source)
    for total in (3, 6):
        stream = spark.readStream.schema(df.schema).parquet(source)
        clean = stream.select("id", fn.lower("text").alias("text"), fn.tokenize("text").alias("tokens"))
        append_stream(clean, "parquet", str(tmp_path / "state"), out).awaitTermination()
        assert spark.read.parquet(out).count() == total
        io.write(df, "parquet", "append", source)
    assert {r.text for r in spark.read.parquet(out).collect()} == {"a b", None, ""}


def test_append_once_after_a_broken_call(spark, df, tmp_path):
    """Nothing of an attempt that breaks is seen; a repeated call adds its batch once."""
    path = str(tmp_path / "kept")
    broken = df.withColumn("text", F.when(F.col("id") == 3, F.raise_error(F.lit("stop"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="stop"):
        io.append_once(broken, path, "day=1")
    assert io.read_batches(spark, path, df.schema).count() == 0
    assert io.append_once(df, path, "day=1") and not io.append_once(df, path, "day=1")
    assert io.append_once(df.limit(1), path, "day=2")
    back = io.read_batches(spark, path, df.schema)
    assert sorted(map(tuple, back.collect())) == sorted([*ROWS, tuple(df.limit(1).first())])
    with pytest.raises(ValueError):
        io.append_once(df, path, "../x")


def test_append_once_of_two_writers(spark, df, tmp_path, monkeypatch):
    """One that publishes second finds the batch there and takes its own rows back."""
    from lexsieve.sources import ledger

    path = str(tmp_path / "kept")
    checked = ledger._files

    class Blind:
        """A file system whose first look sees no entry, as before another writer's publishing."""

        def __init__(self, files):
            self.files, self.looks = files, 0

        def exists(self, place):
            self.looks += 1
            return self.looks > 1 and self.files.exists(place)

        def __getattr__(self, name):
            return getattr(self.files, name)

    assert io.append_once(df, path, "b")
    monkeypatch.setattr(ledger, "_files", lambda s, p: (lambda place, files: (place, Blind(files)))(*checked(s, p)))
    assert not io.append_once(df, path, "b")
    monkeypatch.undo()
    assert io.read_batches(spark, path, df.schema).count() == len(ROWS)
    assert len(list((tmp_path / "kept" / "data").iterdir())) == 1


def test_fan_out_is_one_pass(spark, df, tmp_path):
    source = str(tmp_path / "in")
    df.write.parquet(source)
    rows = spark.read.parquet(source).select("id", fn.lower("text").alias("low"), "tags", fn.word_count("text").alias("n"))
    assert io.staged(rows, "id")._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    targets = io.fan_out(rows, "id", str(tmp_path / "out"), ",")
    assert list(targets) == ["low", "tags", "n"]
    found = {name: sorted(map(tuple, spark.read.parquet(p).select("id", "value").collect())) for name, p in targets.items()}
    assert found == {
        "low": [(1, "a b"), (2, None), (3, "")], "tags": [(1, "x,y"), (2, ""), (3, None)], "n": [(1, "2"), (2, None), (3, "1")]
    }


def test_fanned_out_texts_are_compressed_well(spark, tmp_path):
    """The stages of a text are seven copies of it, so their files decide how much disk the query takes."""
    random.seed(1)
    words = ["".join(random.choices("abcdefgh", k=7)) for _ in range(500)]
    rows = [(i, " ".join(random.choices(words, k=300))) for i in range(200)]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    files = QUERIES["normalize_sinks"](spark, str(tmp_path)).inputFiles()
    metas = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in files]
    chunks = [m.row_group(i).column(1) for m in metas for i in range(m.num_row_groups)]
    assert len(chunks) >= 7 and {c.compression for c in chunks} == {"ZSTD"}


def test_observed_write_is_one_job(spark, df, tmp_path):
    group = "observed"
    spark.sparkContext.setJobGroup(group, "")
    try:
        told = io.write_observed(df, "parquet", "append", str(tmp_path / "out"), summary_measures(df, "text"))
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    finally:
        spark.sparkContext.setJobGroup("", "")
    assert told == {"count": 3, "unique": 3, "maximum": None} and len(jobs) == 1
    assert io.write_observed(df, "parquet", "append", str(tmp_path / "out")) == {"count": 3}


def test_kept_summaries_merge(spark):
    rows = spark.range(60_000).select((F.col("id") % 7).alias("day"), (F.col("id") % 20_000).alias("a"), F.lit(None).cast("int").alias("b"))
    kept = kept_summaries(rows, F.col("day"), ["a", "b"])
    assert kept.count() == 14
    merged = {r["column"]: r for r in merged_summaries(kept).collect()}
    assert merged["a"]["count"] == 60_000 and abs(merged["a"]["unique"] - 20_000) < 400
    assert merged["b"]["count"] == 0 and merged["b"]["unique"] == 0
    by_day = merged_summaries(kept.filter("column = 'a'"), "part").collect()
    assert len(by_day) == 7 and all(abs(r["unique"] - r["count"]) < 0.02 * r["count"] for r in by_day)
    halves = merged_summaries(kept.filter("part < 3"), "part").count()
    assert halves == 6


def test_variants(spark, tmp_path):
    path = str(tmp_path / "lines")
    lines = ['{"a": 1}', '{"a": "x", "b": {"c": 2.5}}', '{"b": [1, "2"]}', "[1]"]
    spark.createDataFrame([(t,) for t in lines], "value string").coalesce(1).write.text(path)
    fields = {"a": ("$.a", "string"), "n": ("$.a", "int"), "kind": ("$.b", "kind"), "c": ("$.b.c", "double")}
    found = io.variant_fields(io.read_variant(spark, path), "row", fields).drop("row").collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, [
        ("1", 1, None, None), ("x", None, "OBJECT<c: DECIMAL(2,1)>", 2.5), (None, None, "ARRAY<VARIANT>", None), (None,) * 4
    ]))
    df = spark.createDataFrame([('{"a": 7}',), ("broken {",), (None,)], "t string")
    parsed = io.variant_fields(io.parse_variant(df, "t"), "parsed", {"a": ("$.a", "bigint")})
    assert [r["a"] for r in parsed.collect()] == [7, None, None]
