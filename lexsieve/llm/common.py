"""What the operators share: words, names that cannot clash, and salted look-ups."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a run of anything but a space, tab or line end.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def named(name: str) -> Column:
    """A column by its plain name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, outputs: list[str], **needed: Column) -> DataFrame:
    """One struct ``row`` of the caller's columns, and the ``needed`` ones beside it.

    A caller's column with the name of an output gives way to the output; no other name
    can clash, as an operator's own columns are never beside the caller's.
    """
    taken = {name.lower() for name in outputs}
    kept = [named(c).alias(c) for c in df.columns if c.lower() not in taken]
    row = F.struct(*kept) if kept else F.struct(F.lit(None).cast("int").alias("none"))
    return df.select(row.alias("row"), *[column.alias(name) for name, column in needed.items()])


def unpacked(df: DataFrame, *outputs: str | Column) -> DataFrame:
    """The caller's columns again, then the outputs."""
    fields = df.schema["row"].dataType.names
    kept = [F.col("row").getField(c).alias(c) for c in fields if fields != ["none"]]
    return df.select(*kept, *outputs)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def code_points(text: Column) -> Column:
    """Text or, for null, the empty text."""
    return F.coalesce(text, F.lit(""))


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def objects(values) -> pd.Series:
    """A column of Python objects: pandas' own string columns come in chunks, which Spark's way
    back to Arrow does not take."""
    return pd.Series(list(values), dtype=object)
