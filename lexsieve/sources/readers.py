"""Reading: thin helpers over Spark's own readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read(
    spark: SparkSession, fmt: str, schema: StructType | str | None = None, path: str | None = None, **options
) -> DataFrame:
    """Read any format Spark knows; options and credentials come from the caller."""
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path) if path is not None else reader.load()


def read_json(
    spark: SparkSession, path: str, schema: StructType | str | None = None, array: bool = False
) -> DataFrame:
    """JSON lines, which split over tasks, or with ``array`` files that each hold one
    array. Giving the schema saves a pass over the data."""
    return read(spark, "json", schema, path, multiLine=str(array).lower())


def read_variant(spark: SparkSession, path: str, out: str = "row") -> DataFrame:
    """JSON lines, each a value of a VARIANT column: no schema is needed, and fields may change their type."""
    return spark.read.option("singleVariantColumn", out).json(path)


def parse_variant(df: DataFrame, col: str, out: str = "parsed") -> DataFrame:
    """Add a column of JSON texts as VARIANT; null where a text cannot be read."""
    return df.withColumn(out, F.try_parse_json(F.col(col)))


def variant_fields(df: DataFrame, col: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """Add columns from a VARIANT: name -> (path like ``$.a.b``, type), null where a value has another type
    that does not become the one wanted. The type ``kind`` tells the value's own type."""

    def field(path: str, kind: str) -> Column:
        if kind == "kind":
            return F.schema_of_variant(F.try_variant_get(F.col(col), path, "variant"))
        return F.try_variant_get(F.col(col), path, kind)

    return df.select("*", *[field(path, kind).alias(name) for name, (path, kind) in fields.items()])


def parse_json(
    df: DataFrame, col: str, schema: StructType | str, corrupt: str | None = None
) -> DataFrame:
    """Rows of a column of JSON texts; a text that is an array gives a row for each
    element, an empty array none. A null text and one that cannot be read give a row of
    nulls; with ``corrupt`` a column of that name has the text that could not be read."""
    row = schema.simpleString() if isinstance(schema, StructType) else f"struct<{schema}>"
    parsed = F.from_json(F.col(col), f"array<{row}>")
    # One null element stands for a text without a reading.
    elements = F.coalesce(parsed, F.array(F.lit(None).cast(row)))
    rows = df.select(F.explode(elements).alias("row"), F.when(parsed.isNull(), F.col(col)).alias("text"))
    return rows.select("row.*", *([F.col("text").alias(corrupt)] if corrupt else []))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal the rows of a small table out to all cores, by key where one is given.

    A Parquet row group is read by one task, so a small file can leave a cluster idle. A table
    that fills one scan partition per core by Spark's own estimate is left as it is, so a big
    table is never shuffled for this.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    scan = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return df if estimate >= cores * scan else df.repartition(cores, *keys)


def jdbc_options(
    url: str,
    table: str,
    partition_column: str,
    lower: int,
    upper: int,
    partitions: int,
    **options: str,
) -> dict[str, str]:
    """Options of a JDBC read in ``partitions`` parallel ranges of a column."""
    return {
        "url": url,
        "dbtable": table,
        "partitionColumn": partition_column,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(partitions),
        **options,
    }


def query_view(df: DataFrame, name: str, sql: str) -> DataFrame:
    """Run SQL over a DataFrame under a temporary name."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.sql(sql)
