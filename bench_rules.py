"""Time row-level functions against the same rule as a row-at-a-time Python UDF.

Prints one line per rule: native seconds, UDF seconds, ratio (median of 3 after a
warm-up, on the documents and pages of $BENCH_SF_DIR).
"""

from __future__ import annotations

import os
import re
import statistics
import string
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lexsieve import functions as fn
from lexsieve.sources import spread

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

RULES = {
    "lower": (fn.lower, "string", lambda x: x.lower()),
    "strip_punct": (fn.strip_punct, "string", lambda x: "".join(c for c in x if c not in string.punctuation)),
    "strip_non_ascii": (fn.strip_non_ascii, "string", lambda x: "".join(c for c in x if ord(c) < 128)),
    "strip_digits": (fn.strip_digits, "string", lambda x: re.sub(r"\d+", "", x)),
    "strip_tags": (fn.strip_tags, "string", lambda x: re.sub("<.*?>", "", x)),
    "extract_emails": (fn.extract_emails, "array<string>", lambda x: re.findall(r"\S+@\S+", x)),
    "avg_word_length": (
        fn.avg_word_length, "double", lambda x: sum(map(len, x.split())) / max(1, len(x.split()))
    ),
    "word_count": (fn.word_count, "bigint", lambda x: len(x.split(" "))),
    "char_count": (fn.char_count, "bigint", lambda x: sum(c != " " for c in x)),
    "special_char_count": (
        fn.special_char_count, "bigint", lambda x: sum(c in string.punctuation for c in x)
    ),
}


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    documents = spread(spark.read.parquet(f"{FOLDER}/documents.parquet"), "doc_id").select("text")
    pages = spread(spark.read.parquet(f"{FOLDER}/pages.parquet"), "page_id").select("html")
    tables = {"text": documents.cache(), "html": pages.cache()}
    for table in tables.values():
        table.count()

    def timed(df, column) -> float:
        def once() -> float:
            start = time.perf_counter()
            df.select(column.alias("x")).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - start

        once()
        return statistics.median(once() for _ in range(3))

    for name, (native, kind, rule) in RULES.items():
        col = "html" if name == "strip_tags" else "text"
        own = timed(tables[col], native(col))
        udf = timed(tables[col], F.udf(rule, kind)(col))
        print(f"| {name} | {own:.3f} | {udf:.3f} | {udf / own:.1f} |", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
