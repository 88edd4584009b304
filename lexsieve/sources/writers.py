"""Writing: results stay distributed, the driver holds none of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lexsieve.functions.text import to_column
from lexsieve.functions.tokens import join_tokens


def write(
    df: DataFrame, fmt: str, mode: str = "append", path: str | None = None, **options
) -> None:
    """Append to or overwrite any sink Spark knows, for JDBC with ``url``,
    ``dbtable``, ``batchsize``, ``numPartitions`` and so on as options."""
    writer = df.write.format(fmt).mode(mode).options(**options)
    if path is not None:
        writer.save(path)
    else:
        writer.save()


def write_observed(
    df: DataFrame, fmt: str, mode: str = "append", path: str | None = None, measures: dict[str, Column] | None = None,
    **options,
) -> dict:
    """As :func:`write`, giving the ``measures`` (aggregates) of the rows written, from the same pass.

    Without measures the number of rows is counted. Distinct counts must be approximate ones, as Spark
    observes no others.
    """
    watched = Observation()
    told = {"count": F.count("*")} if measures is None else measures
    columns = [measure.alias(name) for name, measure in told.items()]
    write(df.observe(watched, *columns), fmt, mode, path, **options)
    return watched.get


def staged(df: DataFrame, key: str, delim: str = " ") -> DataFrame:
    """(key, stage, value): each column beside the key as rows of text, from one evaluation of the table.

    Arrays of text are joined by ``delim``; other columns are cast to text.
    """
    flat = flatten_arrays(df, delim)
    values = [
        F.struct(F.lit(name).alias("stage"), F.col(name).cast("string").alias("value"))
        for name in flat.columns if name != key
    ]
    return flat.select(key, F.explode(F.array(*values)).alias("s")).select(key, "s.*")


def fan_out(
    df: DataFrame, key: str, path: str, delim: str = " ", fmt: str = "parquet", **options
) -> dict[str, str]:
    """Write each column beside the key to a folder of its own, all in one pass; the folder of each.

    The table is evaluated once however many targets there are. Each folder has the columns
    ``key`` and ``value`` and can be loaded into a sink of its own. ``options`` are the writer's, such
    as ``compression``.
    """
    staged(df, key, delim).write.format(fmt).options(**options).partitionBy("stage").save(path)
    return {name: f"{path}/stage={name}" for name in df.columns if name != key}


def to_json_lines(df: DataFrame, ignore_nulls: bool = True, out: str = "value") -> DataFrame:
    """One JSON object per row, null fields left out by default."""
    options = {"ignoreNullFields": str(ignore_nulls).lower()}
    return df.select(F.to_json(F.struct("*"), options).alias(out))


def flatten_arrays(df: DataFrame, delim: str = ",") -> DataFrame:
    """Arrays of text as delimited text, for sinks without an array type."""

    def flat(field):
        kind = field.dataType
        if isinstance(kind, ArrayType) and isinstance(kind.elementType, StringType):
            return join_tokens(F.col(field.name), delim).alias(field.name)
        return F.col(field.name)

    return df.select(*[flat(f) for f in df.schema.fields])


def vector_text(c: Column | str) -> Column:
    """An ML vector as text, like ``(3,[0,2],[1.0,1.0])``."""
    return to_column(c).cast("string")
