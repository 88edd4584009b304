"""Column and group summaries, each one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

INT_TEXT = "^\\s*([+-]?[0-9]+)(?:[.][0-9]*)?\\s*$"


def as_int(df: DataFrame, col: str) -> Column:
    """A column as 32-bit integer: text like ``' 42 '`` or ``'4.7'`` (fraction cut
    off) counts, other text and numbers out of range give null."""
    if isinstance(df.schema[col].dataType, StringType):
        return F.regexp_extract(col, INT_TEXT, 1).try_cast("int")
    return F.col(col).try_cast("int")


def _short(df: DataFrame, name: str) -> Column:
    """A value to compare by: a long text gives way to its SHA-256 digest.

    A digest is marked and longer than any text kept as it is, so the two cannot be
    confused. This spares the distinct count from shuffling whole documents.
    """
    kind = df.schema[name].dataType
    if not isinstance(kind, (StringType, BinaryType)):
        return F.col(name)
    digest = F.concat(F.lit("sha256:"), F.sha2(F.col(name).cast("binary"), 256))
    if isinstance(kind, BinaryType):
        digest = digest.cast("binary")
    return F.when(F.octet_length(name) > 64, digest).otherwise(F.col(name)).alias(name)


def column_summary(df: DataFrame, col: str, approx: bool = False) -> DataFrame:
    """One row: ``count`` of all rows, ``unique`` rows over all columns (rows with
    nulls count too), and ``maximum`` of the column as an integer."""
    row = F.struct(*[_short(df, name) for name in df.columns])
    unique = F.approx_count_distinct(F.xxhash64(row)) if approx else F.count_distinct(row)
    return df.agg(
        F.count("*").alias("count"),
        unique.alias("unique"),
        F.max(as_int(df, col)).alias("maximum"),
    )


def column_uniques(df: DataFrame, cols: list[str], approx: bool = False) -> DataFrame:
    """One row with the number of distinct non-null values of each column."""
    count = F.approx_count_distinct if approx else F.count_distinct
    return df.agg(*[count(_short(df, c)).alias(c) for c in cols])


def group_info(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row: ``count`` of groups (null is one), ``maximum`` and ``minimum`` of the
    value over the whole table."""
    number = as_int(df, value)
    return df.agg(
        F.count_distinct(F.struct(key)).alias("count"),
        F.max(number).alias("maximum"),
        F.min(number).alias("minimum"),
    )


def group_summary(df: DataFrame, key: str, value: str) -> DataFrame:
    """Per group: ``count`` of rows, ``maximum`` and ``minimum`` of the value."""
    number = as_int(df, value)
    return df.groupBy(key).agg(
        F.count("*").alias("count"), F.max(number).alias("maximum"), F.min(number).alias("minimum")
    )


def group_values(df: DataFrame, key: str, value: str) -> DataFrame:
    """The values of each group as (key, value, count) rows.

    This is the whole list of a group, equal values told once with their number,
    and no group is gathered in one place. Nulls are not listed; a group of nulls
    alone still has its row, with a count of 0.
    """
    counted = df.groupBy(key, value).agg(F.count(value).alias("count"))
    only_null = counted.groupBy(key).agg(F.sum("count").alias("count")).filter("count = 0")
    nothing = F.lit(None).cast(df.schema[value].dataType).alias(value)
    return counted.filter("count > 0").unionByName(only_null.select(key, nothing, "count"))


def summary_measures(df: DataFrame, col: str) -> dict[str, Column]:
    """The measures of :func:`column_summary` for a write that is observed; ``unique`` is approximate."""
    row = F.xxhash64(F.struct(*[_short(df, name) for name in df.columns]))
    return {
        "count": F.count("*"), "unique": F.approx_count_distinct(row, 0.01), "maximum": F.max(as_int(df, col))
    }


def kept_summaries(df: DataFrame, part: Column, cols: list[str], precision: int = 14) -> DataFrame:
    """(part, column, count, sketch): for each part (a day, say) the non-null values of each column.

    ``sketch`` is a HyperLogLog sketch of the values, of the same size whatever their number; its error is
    about 1.04 / sqrt(2 ** precision), 0.8 % here. Rows may be stored and merged later, in any grouping.
    """
    values = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols
    ])
    told = df.select(part.alias("part"), F.explode(values).alias("v")).select("part", "v.*")
    return told.groupBy("part", "column").agg(
        F.count("value").alias("count"), F.hll_sketch_agg("value", precision).alias("sketch")
    )


def merged_summaries(kept: DataFrame, *keys: str) -> DataFrame:
    """(keys, column, count, unique): kept summaries put together, over all parts or by ``keys``.

    ``unique`` estimates the different values in all of the parts together; values that are in several
    parts count once.
    """
    return kept.groupBy(*keys, "column").agg(
        F.sum("count").alias("count"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("unique")
    )
