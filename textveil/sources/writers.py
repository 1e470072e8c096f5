"""Dataset sinks. All of them write one file per task."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _as_array(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines of one valid JSON array, one record a line, in constant memory."""
    held = None
    for batch in batches:
        lines = list(batch["value"])
        if not lines:
            continue
        if held is not None:
            yield pd.DataFrame({"value": [held + ","]})
        else:
            lines[0] = "[" + lines[0]
        held = lines.pop()
        if lines:
            yield pd.DataFrame({"value": [line + "," for line in lines]})
    if held is not None:
        yield pd.DataFrame({"value": [held + "]"]})


def write_records(df: DataFrame, path: str, fmt: str | None = None, mode: str = "error") -> None:
    """Write records as ``jsonl``, ``json`` (each part file one array) or ``parquet``.

    The format comes from the extension unless given; anything unknown is written
    as JSON arrays. Nulls are kept and other scripts stay readable.
    """
    if fmt is None:
        extension = path.rstrip("/").rsplit(".", 1)[-1].lower()
        fmt = extension if extension in ("jsonl", "parquet") else "json"
    if fmt == "parquet":
        df.write.mode(mode).parquet(path)
    elif fmt == "jsonl":
        df.write.mode(mode).option("ignoreNullFields", False).json(path)
    elif fmt == "json":
        record = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
        lines = df.select(record.alias("value")).mapInPandas(_as_array, "value string")
        lines.write.mode(mode).text(path)
    else:
        raise ValueError(f"Unsupported format: {fmt!r}")


def write_tokenized(df: DataFrame, path: str, fmt: str = "json", mode: str = "error") -> None:
    """Token rows, one folder per split where there is a ``split`` column."""
    writer = df.write.mode(mode)
    if "split" in df.columns:
        writer = writer.partitionBy("split")
    writer.format(fmt).save(path)


def write_detections(detections: DataFrame, path: str, mode: str = "error") -> DataFrame:
    """Keep detections as the audit record and return the stored table, so that a
    second pass reads it instead of searching the texts again."""
    detections.write.mode(mode).parquet(path)
    return detections.sparkSession.read.schema(detections.schema).parquet(path)
