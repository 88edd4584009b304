"""The folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.

    Only where that is unset and all work is done in this process, as in tests, a folder
    of this machine's is made and set; elsewhere other machines could not see it.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lexsieve-")
        context.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder; what is written there goes when the session's JVM ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def settle(df: DataFrame, **options: str) -> DataFrame:
    """Compute a table once, as files in the shared folder, and go on from those.

    What follows neither repeats the work nor loses it with an executor, and is
    planned with the table's true size. ``options`` are those of the write.
    """
    spark = df.sparkSession
    path = new_path(spark, "settled")
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
