"""Dataset sources."""

from __future__ import annotations

import io
import os
import zipfile
import zlib
from collections.abc import Iterator
from posixpath import basename, splitext

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textveil.sources.ranges import csv_lines, json_lines, restored
from textveil.sources.scratch import arrow_target

TOKEN_SCHEMA = "input_ids array<int>, attention_mask array<int>"


def _kinds(spark: SparkSession, path: str) -> tuple[int, int]:
    """How many files begin with a bracket, and how many with something else. One pass over
    the text, which no Python sees."""
    rows = (
        spark.read.option("lineSep", "{").text(path)
        .select("value", "_metadata.file_path", "_metadata.file_block_start")
        .withColumn("place", F.monotonically_increasing_id())
        .where("file_block_start = 0")
    )
    heads = rows.groupBy("file_path").agg(F.min_by("value", "place").alias("head"))
    array = F.col("head").rlike(r"^[\ufeff \t\r\n]*\[")
    return tuple(heads.agg(F.count_if(array), F.count_if(~array)).first())


def read_json(spark: SparkSession, path: str, schema=None, lines: bool | None = None) -> DataFrame:
    """``.json`` files: one array of records each, or records line by line.

    Say with ``lines`` which of the two all files are; otherwise a pass over the text finds
    out. Lines are read as they are. Arrays are cut into records by many tasks, also those of
    one large file (``ranges.json_lines``), and the records are written as lines.
    """
    reader = spark.read.option("mode", "FAILFAST")
    if schema:
        reader = reader.schema(schema)
    if lines is None:
        arrays, others = _kinds(spark, path)
        lines = not arrays
    return reader.json(path if lines else json_lines(spark, path))


def read_jsonl(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """One record per line; blank lines are skipped, broken ones raise."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def read_csv(
    spark: SparkSession, path: str, infer: bool = True, schema=None, multi_line: bool = True
) -> DataFrame:
    """A CSV file with a header. Without ``infer`` every value is a string and a
    missing one is empty. With ``multi_line`` quoted fields may hold line breaks: the file is
    cut into records by many tasks (``ranges.csv_lines``), and a break reads as a line feed;
    turn it off for files that have none, which saves writing the records."""
    reader = spark.read.option("escape", '"')
    names = None
    if multi_line:
        path, head = csv_lines(spark, path)
        names = spark.read.option("escape", '"').option("header", True).csv(head).columns
    else:
        reader = reader.option("header", True)
    if schema is not None:
        df = reader.schema(schema).csv(path)
        return restored(df) if multi_line else df
    if multi_line and not names:
        return spark.createDataFrame([], "")
    if multi_line and not infer:
        reader = reader.schema(", ".join(f"c{i} string" for i in range(len(names))))
    df = reader.option("inferSchema", infer).csv(path)
    if multi_line:
        # Columns beyond those of the records are null, and no record has more than the header.
        kept = df.columns[: len(names)]
        more = [F.lit(None).cast("string") for _ in range(len(names) - len(kept))]
        df = restored(df.select(*kept, *more).toDF(*names))
    return df if infer else df.na.fill("")


def _text_members(names: list[str], folder: str) -> list[str]:
    """Those of an archive's members that are ``*.txt`` directly inside ``folder``."""
    if not any(n.startswith(folder + "/") for n in names):
        raise ValueError(f"The archive has no directory '{folder}/'.")
    members = [
        n for n in names
        if n.startswith(folder + "/") and "/" not in n[len(folder) + 1 :] and n.endswith(".txt")
    ]
    if not members:
        raise ValueError(f"The archive has no .txt file inside '{folder}/'.")
    return members


def _member_text(data: bytes) -> str:
    """Text mode reads every line ending as a line feed."""
    text = data.decode("utf-8", errors="replace")
    return text.replace("\r\n", "\n").replace("\r", "\n").strip()


def _whole_archives(files: DataFrame) -> DataFrame:
    """Members of archives that come as one value each, 2 GB at most."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for member in _text_members(archive.namelist(), splitext(basename(name))[0]):
                        text = _member_text(archive.read(member))
                        yield pd.DataFrame([(name, member, text)], columns=["archive", "member", "text"])

    return files.select("path", "content").mapInPandas(unpack, "archive string, member string, text string")


_MEMBERS = "archive string, member string, place long, size long, method int"


def _listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Where each archive holds its members, from its directory alone."""
    for batch in batches:
        for path in batch["path"]:
            system, target = arrow_target(path)
            with system.open_input_file(target) as file, zipfile.ZipFile(file) as archive:
                members = {m.filename: m for m in archive.infolist()}
                chosen = [members[n] for n in _text_members(archive.namelist(), splitext(basename(path))[0])]
            if any(m.flag_bits & 1 for m in chosen):
                raise ValueError(f"{path} is encrypted.")
            rows = [(path, m.filename, m.header_offset, m.compress_size, m.compress_type) for m in chosen]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _MEMBERS.split(", ")])


def _unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The text of each member, read by its range of bytes."""
    for batch in batches:
        for archive, member, place, size, method in batch.itertuples(index=False):
            system, target = arrow_target(archive)
            with system.open_input_file(target) as file:
                file.seek(place)
                # Lengths of the name and of more fields, at the end of a header of 30 bytes.
                head = file.read(30)
                skipped = int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little")
                if method in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                    file.seek(place + 30 + skipped)
                    data = file.read(size)
                    data = zlib.decompress(data, -zlib.MAX_WBITS) if method == zipfile.ZIP_DEFLATED else data
                else:
                    file.seek(0)
                    with zipfile.ZipFile(file) as whole:
                        data = whole.read(member)
            yield pd.DataFrame([(archive, member, _member_text(data))], columns=["archive", "member", "text"])


def read_zip_text(spark: SparkSession, path: str, with_origin: bool = False) -> DataFrame:
    """ZIP archives of text files, one row ``text`` per file. ``with_origin`` adds ``archive``
    and ``member``.

    A task lists an archive's members from its directory; the members are dealt out to all
    tasks, which read their ranges of bytes. So an archive may be of any size, and only one
    member of it is in memory. In stores that only Spark's own readers open, an archive is
    read as one value.
    """
    files = spark.read.format("binaryFile").load(path)
    first = files.select("path").first()
    try:
        arrow_target(first[0] if first else "file:///")
    except pa.ArrowException:
        rows = _whole_archives(files)
    else:
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
        members = files.select("path").mapInPandas(_listed, _MEMBERS).repartition(tasks, "archive", "member")
        rows = members.mapInPandas(_unpacked, "archive string, member string, text string")
    rows = rows.where("text != ''")
    return rows if with_origin else rows.select("text")


def from_records(spark: SparkSession, records: list[dict]) -> DataFrame:
    """In-memory records; nested dicts become structs."""
    return spark.createDataFrame(pa.Table.from_pylist(records))


def load(
    spark: SparkSession, path: str | None = None, data: list[dict] | None = None
) -> DataFrame:
    """A dataset from exactly one of a file (or folder, by extension), or records."""
    if path is None and data is None:
        raise ValueError("There is nothing to load: name a file or give records.")
    if path is not None and data is not None:
        raise ValueError("A file and records can't be loaded at once.")
    if data is not None:
        return from_records(spark, data)
    extension = os.path.splitext(path.rstrip("/"))[1].lower()
    readers = {
        ".json": read_json,
        ".jsonl": read_jsonl,
        ".csv": read_csv,
        ".zip": read_zip_text,
        ".parquet": lambda s, p: s.read.parquet(p),
    }
    if extension not in readers:
        raise ValueError(f"Files ending in {extension!r} can't be loaded.")
    return readers[extension](spark, path)


def read_tokenized(spark: SparkSession, path: str) -> DataFrame:
    """Token rows saved earlier. The schema is given, so nothing is inferred."""
    return spark.read.schema(TOKEN_SCHEMA).option("mode", "FAILFAST").json(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows out to as many tasks as the session's ``textveil.read.tasks`` says.

    For small inputs, whose file of one row group one task would read however heavy the
    work on it is. Without the setting the input keeps its splits, which is right for
    anything larger; ``spark.sql.files.maxPartitionBytes`` makes those smaller.
    """
    tasks = df.sparkSession.conf.get("textveil.read.tasks", None)
    return df.repartition(int(tasks)) if tasks else df


def by_rows(df: DataFrame, rows: int, *columns: str) -> DataFrame:
    """Deal the rows out to tasks of about ``rows`` rows, by ``columns`` if any are named: for
    heavy work on narrow rows, of which a split of the input holds any number."""
    return df.repartition(max(1, -(-df.count() // rows)), *columns)
