"""Hybrid sanitising as a stream: records, detections that arrive on their own, review.

Records and detections are two streams. Both are keyed by record and put into sessions: a
record waits until ``wait`` has passed, in event time, since the last thing that came for
it, and leaves with all that came. Only waiting records are in the state store; with long
texts or long waits the session should use the RocksDB store
(``spark.sql.streaming.stateStore.providerClass``).

What leaves in a micro-batch is written below ``folder``, in a folder named by the batch, so
that a batch that runs again overwrites its own output:

- ``joined``: record and detections from elsewhere, as they left;
- ``detections``: disjoint hits of rules and detections, the audit table;
- ``queue``: the first ``max_n`` uncertain hits of all batches so far and how many there
  were. It is a state of bounded size, made of the one before and the new batch;
- ``arrived``: every detection and every record's key, as they came.

Nobody's detection is lost: one that came after its record had left, that the watermark
dropped, or that has no time, is in ``arrived`` and in no joined row, which is how
``late_detections`` finds it; ``late_records`` does so for records. ``finish`` is the second
half: it replaces certain hits, and uncertain ones that were queued and not discarded.

Results that are defined: a null key is a key like others; a repeated detection counts
once; a detection without a record is late; a detection without a field is a mark of time
only, which moves the watermark (the last records wait for something later than they are).
A record that comes again is handled as a batch handles a repeated key: both rows stay, and
``finish`` refuses if detections have that key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textveil.functions.rules import Rule
from textveil.functions.sqltext import ident
from textveil.operators.detect import detect_pii, split_by_confidence
from textveil.operators.review import IDENTITY, review_queue
from textveil.plans.sanitize import sanitize_reviewed

#: What a detection on the stream holds besides ``record_id`` and its time.
HIT = ["field_path", "pattern", "match", "start", "end", "score"]
HIT_TYPES = ["string", "string", "string", "int", "int", "double"]


def _common(detections: DataFrame) -> DataFrame:
    """Detections with the columns and types that are compared."""
    values = [F.col(ident(c)).cast(t).alias(c) for c, t in zip(HIT, HIT_TYPES, strict=True)]
    return detections.where("field_path is not null").select("record_id", *values)


def _sessions(records: DataFrame, detections: DataFrame, key: str, time: str, wait: str, delay: str) -> DataFrame:
    """``record_id, records, hits``: what came for a record before it left."""
    kind = records.schema[key].dataType
    values = [F.col(ident(c)).cast(t).alias(c) for c, t in zip(HIT, HIT_TYPES, strict=True)]
    hit = F.when(F.col("field_path").isNotNull(), F.struct(*values))
    texts = records.select(
        F.col(ident(key)).alias("record_id"),
        F.col(ident(time)).alias("__at"),
        F.struct(*[F.col(ident(c)) for c in records.columns]).alias("record"),
    )
    found = detections.select(F.col("record_id").cast(kind), F.col(ident(time)).alias("__at"), hit.alias("hit"))
    events = texts.unionByName(found, allowMissingColumns=True).withWatermark("__at", delay)
    return events.groupBy("record_id", F.session_window("__at", wait)).agg(
        F.collect_list("record").alias("records"), F.collect_set("hit").alias("hits")
    )


def _batch_path(folder: str, table: str, batch: int) -> str:
    return f"{folder}/{table}/batch={batch}"


def _next_queue(spark: SparkSession, folder: str, batch: int, new: DataFrame, max_n: int) -> DataFrame:
    """The first ``max_n`` uncertain hits up to this batch, with the number of all."""
    total = new.count()
    if batch >= 0:
        queues = spark.read.parquet(f"{folder}/queue").where(F.col("batch") < batch)
        # A queue repeats what the one before kept, so the last one that has rows will do.
        last = queues.agg(F.max("batch")).first()[0]
        if last is not None:
            before = queues.where(F.col("batch") == last)
            total += before.first()["uncertain"]
            new = before.select(*new.columns).unionByName(new)
    return review_queue(new, 1.0, max_n).withColumn("uncertain", F.lit(total).cast("long"))


def start_hybrid(
    records: DataFrame,
    detections: DataFrame,
    key: str,
    time: str,
    folder: str,
    wait: str = "10 minutes",
    delay: str = "10 minutes",
    columns: list[str] | None = None,
    rules: list[Rule] | None = None,
    max_n: int | None = 50,
    protect_certain: bool = False,
    continuous: bool = False,
) -> list[StreamingQuery]:
    """Start the first half of a reviewed run; the queries of both parts.

    ``records`` and ``detections`` are streams with a timestamp column ``time``; ``detections``
    also holds ``record_id`` and ``HIT``. ``wait`` is how long a record stays after the last
    thing that came for it, ``delay`` how far the streams may lag behind each other. ``folder``
    must lie on storage that all nodes share.
    """

    def leave(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        # Written first: what follows reads files, not the state.
        rows.select("record_id", "records", "hits").write.mode("overwrite").parquet(_batch_path(folder, "joined", batch))
        joined = spark.read.parquet(_batch_path(folder, "joined", batch))
        if batch >= 0 and joined.isEmpty():
            return
        left = joined.select(F.inline("records"))
        external = joined.where(F.size("records") > 0).select("record_id", F.inline("hits"))
        chosen = columns if columns is not None else [c for c, t in left.dtypes if t == "string" and c not in (key, time)]
        found = detect_pii(left, key, chosen, rules, external, protect_certain)
        found.write.mode("overwrite").parquet(_batch_path(folder, "detections", batch))
        if max_n is not None:
            unsure = split_by_confidence(spark.read.parquet(_batch_path(folder, "detections", batch)))[1]
            queue = _next_queue(spark, folder, batch, unsure, max_n)
            queue.write.mode("overwrite").parquet(_batch_path(folder, "queue", batch))

    def start(writer, name: str) -> StreamingQuery:
        writer = writer.option("checkpointLocation", f"{folder}/progress/{name}")
        return (writer if continuous else writer.trigger(availableNow=True)).start()

    sessions = _sessions(records, detections, key, time, wait, delay)
    # Empty tables, for readers that come before anything has left.
    leave(records.sparkSession.createDataFrame([], sessions.schema), -1)
    keys = records.select(F.col(ident(key)).alias("record_id"), F.lit(True).alias("is_record"))
    arrived = _common(detections).withColumn("record_id", F.col("record_id").cast(records.schema[key].dataType))
    arrived = arrived.unionByName(keys, allowMissingColumns=True)
    return [
        start(sessions.writeStream.outputMode("append").foreachBatch(leave), "joined"),
        start(arrived.writeStream.format("parquet").option("path", f"{folder}/arrived"), "arrived"),
    ]


def _joined(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/joined")


def detections_of(spark: SparkSession, folder: str) -> DataFrame:
    """The audit table of all batches so far."""
    return spark.read.parquet(f"{folder}/detections").drop("batch")


def queue_of(spark: SparkSession, folder: str, ratio: float = 1.0, max_n: int | None = 50) -> DataFrame:
    """The review queue of all batches so far, as ``review_queue`` gives it for a batch.
    ``max_n`` must be no larger than the stream's; None queues from the audit table."""
    if max_n is None:
        return review_queue(split_by_confidence(detections_of(spark, folder))[1], ratio, None)
    queues = spark.read.parquet(f"{folder}/queue")
    last = queues.agg(F.max("batch")).first()[0]
    rows = queues.where(F.col("batch") == last).drop("batch") if last is not None else queues.drop("batch")
    total = (rows.agg(F.max("uncertain")).first()[0]) or 0
    return review_queue(rows.drop("uncertain"), 1.0, min(max_n, int(total * ratio)))


def _absent(rows: DataFrame, others: DataFrame, columns: list[str]) -> DataFrame:
    others = others.select(*[F.col(ident(c)).alias(f"__{c}") for c in columns])
    return rows.join(others, [F.col(ident(c)).eqNullSafe(F.col(f"__{c}")) for c in columns], "left_anti")


def late_detections(spark: SparkSession, folder: str) -> DataFrame:
    """Detections that came but left with no record: too late, dropped, or without one.
    Texts stay where they are; only detections are compared."""
    arrived = spark.read.parquet(f"{folder}/arrived").where("is_record is null").drop("is_record")
    used = _joined(spark, folder).where(F.size("records") > 0).select("record_id", F.inline("hits"))
    return _absent(arrived.dropDuplicates(), used, [*IDENTITY, "match", "score"])


def late_records(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of records that came and have not left: still waiting, or older than the
    watermark. A key is listed once."""
    arrived = spark.read.parquet(f"{folder}/arrived").where("is_record").select("record_id").distinct()
    left = _joined(spark, folder).where(F.size("records") > 0)
    return _absent(arrived, left, ["record_id"])


def finish(
    spark: SparkSession,
    folder: str,
    key: str,
    verdicts: DataFrame | None = None,
    queue: DataFrame | None = None,
    action: str = "redact",
    columns: list[str] | None = None,
    salt: str = "",
    hold_late: bool = True,
) -> DataFrame:
    """Second half: all records that have left, sanitised. ``queue`` is what was reviewed.
    A record with a late detection is kept back unless ``hold_late`` is off, as it would
    show what that detection found."""
    left = _joined(spark, folder).select(F.inline("records"))
    if hold_late:
        late = late_detections(spark, folder).select(F.col("record_id").alias("__late")).distinct()
        left = left.join(late, F.col(ident(key)).eqNullSafe(F.col("__late")), "left_anti")
    found = detections_of(spark, folder)
    return sanitize_reviewed(left, key, found, verdicts, queue, action, columns, salt)
