"""A folder for intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where none is named, a session in one
    process gets a folder of its own, and a cluster an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("Name a folder that all executors share in spark.checkpoint.dir.")
    folder = tempfile.mkdtemp(prefix="textveil-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: what follows does not compute
    it again, whatever executors are lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def may_broadcast(table: DataFrame) -> bool:
    """Whether a ``written`` table is no larger than what the session broadcasts by itself
    (``spark.sql.autoBroadcastJoinThreshold``). Its size is measured, as JSON text."""
    setting = table.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10m")
    number, unit = re.fullmatch(r"(-?\d+)\s*([kmgt]?)b?", setting.strip().lower()).groups()
    limit = int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]
    if limit <= 0:
        return False
    size = table.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).collect()[0][0]
    return (size or 0) <= limit


def arrow_target(path: str) -> tuple[FileSystem, str]:
    """File system and path for writing one file from inside a task."""
    if path.startswith("file:/"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return FileSystem.from_uri(path if "://" in path else f"file://{path}")
