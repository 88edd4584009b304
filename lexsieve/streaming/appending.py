"""Row-level functions over a stream.

The functions of :mod:`lexsieve.functions` keep no state, so they take a streaming
DataFrame as they are. This is the streaming form of appending to a sink.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def append_stream(
    df: DataFrame, fmt: str, checkpoint: str, path: str | None = None, **options
) -> StreamingQuery:
    """Append what has arrived to a sink, each row once, and stop.

    ``checkpoint`` must be a folder that outlives the job and all executors share.
    """
    writer = (
        df.writeStream.format(fmt)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .options(**options)
        .trigger(availableNow=True)
    )
    return writer.start(path) if path is not None else writer.start()
