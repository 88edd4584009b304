"""Every operator as a query over the tables of a folder: name -> (spark, folder) -> DataFrame.

Token arrays are shown as text joined by spaces, which tokens never hold.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexsieve import functions as fn
from lexsieve import operators as op
from lexsieve import sources as io
from lexsieve.operators.sentiment import NEGATIONS, STRONGER, WEAKER, WordLists
from lexsieve.operators.terms import term_counts
from lexsieve.plans.normalize import normalize

# Negations of the languages of the documents; frequent words stand in for boosters,
# as the invented prose has none.
SENTIMENT_LISTS = WordLists(
    negations=[*NEGATIONS, "nicht", "pas", "no"],
    stronger=[*STRONGER, "this", "der", "une"],
    weaker=[*WEAKER, "from", "sich", "por"],
)

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark: SparkSession, folder: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    return io.spread(table(spark, folder, name), key)


def _text(function: Callable[[str], Column], out: str, name="documents", key="doc_id", col="text") -> Query:
    """A query of one column function next to the key."""
    return lambda spark, folder: texts(spark, folder, name, key).select(
        key, function(col).alias(out)
    )


def _tokens(function: Callable[[str], Column], out: str, **where) -> Query:
    """As :func:`_text` for arrays: joined text and number of items."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        found = _text(function, "items", **where)(spark, folder)
        return found.select(
            found.columns[0],
            fn.join_tokens("items").alias(out),
            F.size("items").cast("bigint").alias("n"),
        )

    return query


def _common_words(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of the documents seen 20 times or more, as a table: (word, freq)."""
    common = term_counts(texts(spark, folder), fn.tokenize("text")).filter("n >= 20")
    return io.settle(common.select(F.col("term").alias("word"), F.col("n").alias("freq")))


def _benchmark_terms(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "benchmark")
    return items.select(F.explode(fn.tokenize(fn.strip_punct("text"))).alias("term")).distinct()


def _joined(df: DataFrame, out: str) -> DataFrame:
    return df.select("doc_id", fn.join_tokens(out).alias(out))


def lemmatize(spark: SparkSession, folder: str) -> DataFrame:
    words = _common_words(spark, folder)
    return _joined(op.lemmatize_tokens(texts(spark, folder), "doc_id", "text", words), "lemmas")


def spell_correct(spark: SparkSession, folder: str) -> DataFrame:
    words = _common_words(spark, folder)
    return _joined(op.spell_correct(texts(spark, folder), "doc_id", "text", words), "corrected")


def correct_in_context(spark: SparkSession, folder: str) -> DataFrame:
    words = _common_words(spark, folder)
    documents = texts(spark, folder).select("doc_id", "text")
    return _joined(op.correct_in_context(documents, "doc_id", "text", words), "corrected")


def split_joined(spark: SparkSession, folder: str) -> DataFrame:
    words = _common_words(spark, folder)
    return _joined(op.split_joined(texts(spark, folder).select("doc_id", "text"), "doc_id", "text", words), "split")


def translate(spark: SparkSession, folder: str) -> DataFrame:
    glossary = _benchmark_terms(spark, folder).select(
        F.lit("xx").alias("lang"), "term", F.reverse("term").alias("target")
    )
    documents = texts(spark, folder).select("doc_id", "text")
    return _joined(op.translate_terms(documents, "doc_id", "text", glossary, "xx"), "translated")


def translate_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Turns of conversations, which no single column tells apart."""
    glossary = _benchmark_terms(spark, folder).select(
        F.lit("xx").alias("lang"), "term", F.reverse("term").alias("target")
    )
    turns = table(spark, folder, "conversations")
    found = op.translate_terms(turns, None, "text", glossary, "xx")
    return found.select("conv_id", "turn", fn.join_tokens("translated").alias("translated"))


def translate_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """Words, pairs and triples of words of the benchmark, wherever documents have them."""
    words = fn.tokenize(fn.strip_punct("text"))
    runs = F.flatten(F.transform(F.array(*map(F.lit, (1, 2, 3))), lambda n: F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, n), " ")
    )))
    terms = table(spark, folder, "benchmark").select(words.alias("w")).select(F.explode(runs).alias("term")).distinct()
    glossary = terms.select(F.lit("xx").alias("lang"), "term", F.reverse("term").alias("target"))
    documents = texts(spark, folder).select("doc_id", "text")
    return _joined(op.translate_phrases(documents, "doc_id", "text", glossary, "xx"), "translated")


def _bare(spark: SparkSession, folder: str) -> DataFrame:
    bare = fn.strip_digits(fn.strip_non_ascii(fn.strip_punct("text")))
    return texts(spark, folder).select("doc_id", bare.alias("text"))


def stem_terms(spark: SparkSession, folder: str) -> DataFrame:
    found = op.stem_terms(_bare(spark, folder), "doc_id", "text")
    return found.select("doc_id", fn.join_tokens("stems").alias("stems"), F.size("stems").cast("bigint").alias("n"))


def token_ids(spark: SparkSession, folder: str) -> DataFrame:
    documents = texts(spark, folder).select("doc_id", "text")
    coded = op.encode_tokens(documents, "doc_id", "text", op.token_dictionary(documents, "text"))
    return coded.select("doc_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


def _lexicon(spark: SparkSession, folder: str) -> DataFrame:
    return _benchmark_terms(spark, folder).filter("length(term) > 1").select(
        "term", ((F.length("term") % 7) - 3.0).alias("valence")
    )


def sentiment(spark: SparkSession, folder: str) -> DataFrame:
    scored = op.sentiment(
        texts(spark, folder), "doc_id", "text", _lexicon(spark, folder), lists=SENTIMENT_LISTS
    )
    return scored.select("doc_id", "sentiment.*")


def sentiment_of_turns(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    scored = op.sentiment(turns, None, "text", _lexicon(spark, folder), lists=SENTIMENT_LISTS)
    return scored.select("conv_id", "turn", "sentiment.*")


def normalized(spark: SparkSession, folder: str) -> DataFrame:
    stages = normalize(
        texts(spark, folder), "doc_id", "text", lemmas=_common_words(spark, folder)
    )
    return io.flatten_arrays(stages, " ")


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Text cleaning without a shuffle: punctuation to stop words and stems."""
    return io.flatten_arrays(normalize(texts(spark, folder), "doc_id", "text"), " ")


def date_text(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    given = orders.select("o_orderkey", F.date_format("o_orderdate", "MM/dd/yyyy").alias("given"))
    return given.select("o_orderkey", fn.parse_date_text("given").alias("parsed"))


def order_words(spark: SparkSession, folder: str) -> DataFrame:
    return texts(spark, folder, "orders", "o_orderkey").select(
        "o_orderkey",
        fn.number_to_words("o_orderkey").alias("key_words"),
        fn.number_to_words("o_totalprice").alias("price_words"),
        fn.number_to_words("o_orderpriority").alias("not_a_number"),
    )


def hashed_tfidf(spark: SparkSession, folder: str) -> DataFrame:
    vectors = op.hashed_tfidf(texts(spark, folder), "text")
    tf, tfidf = vector_to_array("tf"), vector_to_array("tfidf")
    return vectors.select(
        "doc_id",
        *[tf[i].cast("bigint").alias(f"tf_{i}") for i in range(3)],
        *[F.round(tfidf[i], 6).alias(f"tfidf_{i}") for i in range(3)],
    )


def doc_terms(spark: SparkSession, folder: str) -> DataFrame:
    terms = op.doc_terms(texts(spark, folder), "doc_id", "text")
    return terms.withColumn("tfidf", F.round("tfidf", 6))


def remove_frequent(spark: SparkSession, folder: str) -> DataFrame:
    return _joined(op.remove_frequent(texts(spark, folder), "text", 20), "kept")


def remove_frequent_compat(spark: SparkSession, folder: str) -> DataFrame:
    return _joined(op.remove_frequent(texts(spark, folder), "text", mode="compat"), "kept")


def remove_rare(spark: SparkSession, folder: str) -> DataFrame:
    return _joined(op.remove_rare(texts(spark, folder), "doc_id", "text", 3), "kept")


def remove_rare_compat(spark: SparkSession, folder: str) -> DataFrame:
    documents = texts(spark, folder)
    return _joined(op.remove_rare(documents, "doc_id", "text", mode="compat"), "kept")


def frequent_terms(spark: SparkSession, folder: str) -> DataFrame:
    return op.frequent_terms(texts(spark, folder), "text", 20)


def top_terms(spark: SparkSession, folder: str) -> DataFrame:
    """A top list too long to be sorted in one task."""
    return op.frequent_terms(texts(spark, folder), "text", 5_000)


def summary(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part").withColumn("size_text", F.col("p_size").cast("string"))
    return op.column_summary(parts, "size_text")


def summary_of_text(spark: SparkSession, folder: str) -> DataFrame:
    return op.column_summary(texts(spark, folder).drop("doc_id"), "text")


def uniques(spark: SparkSession, folder: str) -> DataFrame:
    return op.column_uniques(table(spark, folder, "events"), ["user_id", "event_type", "props"])


def group_values(spark: SparkSession, folder: str) -> DataFrame:
    return op.group_values(table(spark, folder, "part"), "p_type", "p_size")


def group_info(spark: SparkSession, folder: str) -> DataFrame:
    return op.group_info(table(spark, folder, "part"), "p_type", "p_size")


def group_summary(spark: SparkSession, folder: str) -> DataFrame:
    return op.group_summary(table(spark, folder, "part"), "p_type", "p_size")


def json_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Customers written as JSON lines, then read back with a schema."""
    customers = table(spark, folder, "customer")
    path = io.new_path(spark, "json_scan")
    io.write(customers, "json", "append", path)
    return io.read_json(spark, path, customers.schema)


def json_column(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("props")
    return io.parse_json(events, "props", "k bigint").groupBy("k").agg(F.count("*").alias("n"))


def sql_view(spark: SparkSession, folder: str) -> DataFrame:
    nations = table(spark, folder, "nation")
    return io.query_view(nations, "lexsieve_nations", "select n_name from lexsieve_nations")


def append_sink(spark: SparkSession, folder: str) -> DataFrame:
    """Lower-cased customer names appended twice: each row is there twice."""
    names = table(spark, folder, "customer").select("c_custkey", fn.lower("c_name").alias("name"))
    path = io.new_path(spark, "append_sink")
    io.write(names, "parquet", "append", path)
    io.write(names, "parquet", "append", path)
    return io.read(spark, "parquet", names.schema, path)


def append_once(spark: SparkSession, folder: str) -> DataFrame:
    """Customer names in two batches, of which each is appended twice: each row is there once."""
    names = table(spark, folder, "customer").select("c_custkey", fn.lower("c_name").alias("name"))
    path = io.new_path(spark, "append_once")
    for _ in range(2):
        io.append_once(names.filter("c_custkey % 2 = 0"), path, "even")
        io.append_once(names.filter("c_custkey % 2 = 1"), path, "odd")
    return io.read_batches(spark, path, names.schema)


def normalize_sinks(spark: SparkSession, folder: str) -> DataFrame:
    """All seven stages, each written to its own folder in one pass over the documents."""
    stages = normalize(texts(spark, folder), "doc_id", "text", lemmas=_common_words(spark, folder))
    # Seven copies of the texts: zstd takes two thirds of what Spark's own codec does.
    targets = io.fan_out(stages, "doc_id", io.new_path(spark, "normalize_sinks"), compression="zstd")
    found = [
        spark.read.schema("doc_id bigint, value string").parquet(path).select(F.lit(name).alias("stage"), "doc_id", "value")
        for name, path in targets.items()
    ]
    return reduce(DataFrame.unionByName, found)


def written_summary(spark: SparkSession, folder: str) -> DataFrame:
    """What a write of the parts tells of them, without another pass."""
    parts = table(spark, folder, "part").withColumn("size_text", F.col("p_size").cast("string"))
    measures = op.summary_measures(parts, "size_text")
    told = io.write_observed(parts, "parquet", "append", io.new_path(spark, "written_summary"), measures)
    close = abs(told["unique"] - told["count"]) <= 0.05 * told["count"]
    return spark.createDataFrame([(told["count"], told["maximum"], close)], "count long, maximum int, close boolean")


def daily_uniques(spark: SparkSession, folder: str) -> DataFrame:
    """Different values of the events by month, from sketches kept for each day, held against exact ones."""
    cols = ["user_id", "event_type", "value"]
    events = table(spark, folder, "events")
    kept = io.settle(op.kept_summaries(events, F.to_date("ts"), cols))
    month = F.date_format("part", "yyyy-MM").alias("month")
    merged = op.merged_summaries(kept.select("*", month), "month")
    exact = events.groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(
        *[F.count_distinct(c).alias(c) for c in cols]
    ).unpivot("month", cols, "column", "exact")
    close = F.abs(F.col("unique") - F.col("exact")) <= 0.03 * F.col("exact")
    return merged.join(exact, ["month", "column"]).select("month", "column", "count", "exact", close.alias("close"))


def changing_json(spark: SparkSession, folder: str) -> DataFrame:
    """Events written as JSON lines whose field changes its type from row to row, then read as they are."""
    value = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(F.col("user_id").alias("v")))).when(
        F.col("event_id") % 3 == 1, F.to_json(F.struct(F.col("event_type").alias("v")))
    ).otherwise(F.to_json(F.struct(F.struct(F.col("user_id").alias("a")).alias("v"))))
    events = table(spark, folder, "events")
    lines = events.select(F.concat(F.lit('{"id": '), "event_id", F.lit(", "), F.substring(value, 2, 1 << 20)).alias("value"))
    path = io.new_path(spark, "changing_json")
    io.write(lines, "text", "append", path)
    fields = {"id": ("$.id", "bigint"), "kind": ("$.v", "kind"), "number": ("$.v", "bigint"), "text": ("$.v", "string"),
              "inner": ("$.v.a", "bigint")}
    return io.variant_fields(io.read_variant(spark, path), "row", fields).drop("row")


def vectors_as_text(spark: SparkSession, folder: str) -> DataFrame:
    """Hashed term counts as the text that a flat sink takes."""
    vectors = op.hashed_tfidf(texts(spark, folder).select("doc_id", "text"), "text")
    return vectors.select("doc_id", io.vector_text("tf").alias("tf"))


def overwrite_sink(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes in words written over an older result: only the newer rows are there."""
    parts = table(spark, folder, "part")
    path = io.new_path(spark, "overwrite_sink")
    io.write(parts.select("p_partkey", F.col("p_name").alias("words")), "parquet", "overwrite", path)
    words = parts.select("p_partkey", fn.number_to_words("p_size").alias("words"))
    io.write(words, "parquet", "overwrite", path)
    return io.read(spark, "parquet", words.schema, path)


def json_lines(spark: SparkSession, folder: str) -> DataFrame:
    return io.to_json_lines(table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment"))


def flat_arrays(spark: SparkSession, folder: str) -> DataFrame:
    talks = texts(spark, folder, "conversations", "conv_id")
    tokens = talks.select("conv_id", "turn", fn.tokenize("text").alias("tokens"))
    return io.flatten_arrays(tokens, ",")


def bracketed_lists(spark: SparkSession, folder: str) -> DataFrame:
    pages = texts(spark, folder, "pages", "page_id")
    return pages.select("page_id", fn.bracketed_text(fn.extract_urls("url")).alias("urls"))


QUERIES: dict[str, Query] = {
    "lower_text": _text(fn.lower, "lowered"),
    "replace_pattern": _text(lambda c: fn.replace(c, "the", "x"), "replaced"),
    "replace_literal": _text(
        lambda c: fn.replace(c, "Customer#", "No. ", literal=True),
        "replaced", name="customer", key="c_custkey", col="c_name",
    ),
    "strip_punctuation": _text(fn.strip_punct, "stripped"),
    "strip_non_ascii": _text(fn.strip_non_ascii, "stripped"),
    "strip_numbers": _text(fn.strip_digits, "stripped"),
    "tokenize": _tokens(fn.tokenize, "tokens"),
    "remove_stop_words": _tokens(lambda c: fn.remove_stop_words(fn.tokenize(c)), "kept"),
    "stem_tokens": stem_terms,
    "token_ids": token_ids,
    "lemmatize_tokens": lemmatize,
    "normalize": normalized,
    "extract_emails": _tokens(fn.extract_emails, "emails"),
    "extract_urls": _tokens(fn.extract_urls, "urls", name="pages", key="page_id", col="url"),
    "strip_tags": _text(fn.strip_tags, "stripped", name="pages", key="page_id", col="html"),
    "string_to_date": date_text,
    "date_to_string": _text(
        fn.format_date, "formatted", name="orders", key="o_orderkey", col="o_orderdate"
    ),
    "translate_terms": translate,
    "translate_turns": translate_turns,
    "translate_phrases": translate_phrases,
    "average_word_length": _text(lambda c: F.round(fn.avg_word_length(c), 9), "average"),
    "word_count": _text(fn.word_count, "words"),
    "character_count": _text(fn.char_count, "characters"),
    "special_character_count": _text(fn.special_char_count, "specials"),
    "remove_frequent": remove_frequent,
    "remove_frequent_compat": remove_frequent_compat,
    "frequent_terms": frequent_terms,
    "top_terms": top_terms,
    "remove_rare": remove_rare,
    "remove_rare_compat": remove_rare_compat,
    "number_to_words": order_words,
    "column_summary": summary,
    "column_summary_text": summary_of_text,
    "column_uniques": uniques,
    "spell_correct": spell_correct,
    "correct_in_context": correct_in_context,
    "split_joined": split_joined,
    "group_values": group_values,
    "group_info": group_info,
    "group_summary": group_summary,
    "hashed_tfidf": hashed_tfidf,
    "doc_terms": doc_terms,
    "sentiment": sentiment,
    "sentiment_of_turns": sentiment_of_turns,
    "json_scan": json_scan,
    "json_column": json_column,
    "sql_view": sql_view,
    "append_sink": append_sink,
    "append_once": append_once,
    "normalize_sinks": normalize_sinks,
    "written_summary": written_summary,
    "daily_uniques": daily_uniques,
    "changing_json": changing_json,
    "vectors_as_text": vectors_as_text,
    "overwrite_sink": overwrite_sink,
    "json_lines": json_lines,
    "flatten_arrays": flat_arrays,
    "bracketed_lists": bracketed_lists,
}
