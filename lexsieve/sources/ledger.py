"""Appending each batch once: a repeated or broken call adds nothing twice."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

LEDGER, DATA = "_ledger", "data"


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path
    return place, place(path).getFileSystem(spark._jsc.hadoopConfiguration())


def _entries(spark: SparkSession, path: str) -> Iterator[tuple[str, str]]:
    """(batch, folder of its rows) of all published batches."""
    place, files = _files(spark, path)
    ledger = place(f"{path}/{LEDGER}")
    if files.exists(ledger):
        for status in files.listStatus(ledger):
            stream = files.open(status.getPath())
            try:
                yield status.getPath().getName(), bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()


def append_once(df: DataFrame, path: str, batch: str, fmt: str = "parquet", **options) -> bool:
    """Append the rows under the name of their batch, unless that batch is there; whether they were.

    Rows are first written to a folder of the attempt's own, which no reader looks at, and then published by
    one file of the batch's name in the ledger, which only one writer can create. So a call that
    is repeated, or one that goes on beside another or after one was killed half-way, adds the
    batch once. Of a failed attempt nothing is visible; its folder may be deleted at any time.
    """
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_=.-]*", batch):
        raise ValueError("a batch is named by letters, digits, '_', '-', '.' and '='")
    spark = df.sparkSession
    place, files = _files(spark, path)
    entry = place(f"{path}/{LEDGER}/{batch}")
    if files.exists(entry):
        return False
    attempt = f"{DATA}/{batch}-{uuid.uuid4().hex}"
    df.write.format(fmt).options(**options).save(f"{path}/{attempt}")
    try:
        stream = files.create(entry, False)
    except Py4JJavaError:
        if not files.exists(entry):
            raise
        files.delete(place(f"{path}/{attempt}"), True)
        return False
    stream.write(bytearray(attempt.encode()))
    stream.close()
    return True


def read_batches(
    spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet", **options
) -> DataFrame:
    """The rows of all published batches."""
    folders = [f"{path}/{attempt}" for _, attempt in _entries(spark, path) if attempt]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.format(fmt).schema(schema).options(**options).load(folders)
