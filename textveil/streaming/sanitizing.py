"""Sanitising as a stream.

Without a review step every record is handled on its own, so the batch
expressions run unchanged on a stream and need no state or watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from textveil.plans.sanitize import sanitize


def sanitize_stream(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    action: str = "redact",
    fmt: str = "parquet",
    continuous: bool = False,
    tasks: int | None = None,
    **options,
) -> StreamingQuery:
    """Write the sanitised stream to files, each input record exactly once.

    By default the query handles all that is there and stops; ``continuous`` lets
    it go on. ``tasks`` deals the rows of a source with few files or partitions out
    to more tasks. The checkpoint must lie on storage that all nodes share.
    """
    rows = stream if tasks is None else stream.repartition(tasks)
    writer = (
        sanitize(rows, action, **options)
        .writeStream.format(fmt)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    return (writer if continuous else writer.trigger(availableNow=True)).start()
