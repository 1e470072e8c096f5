"""Tables between passes, row keys, and Arrow batches: helpers of all operators here."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textveil.sources.scratch import scratch_path

#: Bytes of text that a task works on at a time.
PIECE = 1 << 20


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: what follows neither
    computes it again nor depends on the executors that made it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    # Shuffle files of the finished job go when the driver drops its references.
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of ``stored`` tables that nothing reads any more."""
    for table in tables:
        jvm = table.sparkSession.sparkContext._jvm
        conf = table.sparkSession._jsparkSession.sessionState().newHadoopConf()
        for path in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)


def mark_of(text: Column) -> Column:
    """Tells apart texts of one id."""
    return F.xxhash64(text)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``mark`` and ``text``, and no other column. ``mark`` tells apart rows
    of one id with different texts; equal rows share all results."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("id"), mark_of(text).alias("mark"), text.alias("text"))


def numbered(docs: DataFrame, *columns: str) -> tuple[DataFrame, list[str]]:
    """``docs`` under the names ``c0, c1, …``, which clash with no result, and the new
    names of ``columns``. ``toDF`` with the old names undoes it."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), [names[c] for c in columns]


def same_row(left: DataFrame, right: DataFrame) -> Column:
    return left["id"].eqNullSafe(right["id"]) & (left["mark"] == right["mark"])


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column one after the other, and where each row begins
    and the last one ends; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, data = column.buffers()
    at = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    at = at.astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), at * 0
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def row_groups(at: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes together; a longer row is alone."""
    row, rows = 0, len(at) - 1
    while row < rows:
        last = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield row, min(last, rows)
        row = last


def slices(batches: Iterable[pa.RecordBatch], *columns: str, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each holds about ``limit`` bytes of text in all ``columns``."""
    for batch in batches:
        if batch.num_rows:
            at = sum(flat(batch.column(c))[1] for c in columns or ("text",))
            for first, last in row_groups(at, limit):
                yield batch.slice(first, last - first)


def int_lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column one after the other, and the row of each."""
    sizes = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    return np.asarray(column.flatten()), np.repeat(np.arange(len(column)), sizes)
