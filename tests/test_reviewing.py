"""Records and detections as two streams, against the batch run on the same rows."""

import pytest
from pyspark.sql import functions as F

from textveil.functions.rules import select_rules
from textveil.operators.detect import detect_pii, split_by_confidence
from textveil.operators.review import review_queue
from textveil.plans.sanitize import sanitize_reviewed
from textveil.streaming.reviewing import detections_of, finish, late_detections, late_records, queue_of, start_hybrid

TEXTS = "id long, text string, at timestamp"
FOUND = "record_id long, field_path string, pattern string, match string, start int, end int, score double, at timestamp"
RULES = select_rules(["email"])


def text_of(i):
    return f"Ann Bell {i} wrote to a{i}@b.co about Rome"


def name_of(i, second, score=0.95):
    return (i, "text", "person", "Ann Bell", 0, 8, score, second)


def place_of(i, second):
    at = text_of(i).index("Rome")
    return (i, "text", "full address", "Rome", at, at + 4, 0.5 + (i or 0) / 1000, second)


def frame(spark, rows, schema):
    """Rows whose last value is a second (or null) as a timestamp."""
    at = F.timestamp_seconds(F.col("at"))
    return spark.createDataFrame(rows, schema.replace("at timestamp", "at long")).withColumn("at", at)


class Run:
    def __init__(self, spark, folder):
        self.spark, self.folder = spark, str(folder)
        self.texts, self.found = f"{folder}/texts", f"{folder}/found"
        frame(spark, [], TEXTS).write.parquet(self.texts)
        frame(spark, [], FOUND).write.parquet(self.found)

    def add(self, texts=(), found=()):
        frame(self.spark, list(texts), TEXTS).write.mode("append").parquet(self.texts)
        frame(self.spark, list(found), FOUND).write.mode("append").parquet(self.found)
        read = self.spark.readStream
        texts = read.schema(TEXTS).parquet(self.texts)
        found = read.schema(FOUND).parquet(self.found)
        options = {"wait": "60 seconds", "delay": "30 seconds", "columns": ["text"], "rules": RULES, "max_n": 7}
        for query in start_hybrid(texts, found, "id", "at", f"{self.folder}/run", **options):
            query.awaitTermination()


def shown(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


END = (None, None, None, None, None, None, None, 10**8)


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    run = Run(spark, tmp_path_factory.mktemp("stream"))
    # Names come first or with their records, places in a later batch, some of them twice.
    run.add([(i, text_of(i), i) for i in range(20)], [name_of(i, i + 5) for i in range(0, 20, 2)])
    run.add([(i, text_of(i), i + 20) for i in range(20, 40)], [place_of(i, i + 6) for i in range(20)] + [place_of(3, 11)])
    run.add([(None, text_of(99), 70), (60, None, 70), (61, "", 70)], [name_of(None, 75)])
    run.add([], [END])
    # After all records have left: too late, without a time, and for no record.
    run.add([(70, "late text", 5)], [name_of(21, 30), (*name_of(22, 0)[:-1], None), name_of(500, 2 * 10**8)])
    run.add([], [(*END[:-1], 3 * 10**8)])
    return run


def batch(spark):
    rows = [(i, text_of(i), i if i < 20 else i + 20) for i in range(40)]
    rows += [(None, text_of(99), 70), (60, None, 70), (61, "", 70)]
    found = [name_of(i, i) for i in range(0, 20, 2)] + [place_of(i, i) for i in range(20)] + [name_of(None, 0)]
    texts = frame(spark, rows, TEXTS)
    return texts, detect_pii(texts, "id", ["text"], RULES, external=frame(spark, found, FOUND).drop("at"))


def test_detections_and_queue_equal_batch(spark, run):
    _, found = batch(spark)
    streamed = detections_of(spark, f"{run.folder}/run")
    assert shown(streamed.select(*found.columns)) == shown(found)
    unsure = split_by_confidence(found)[1]
    for ratio, n in ((1.0, 7), (0.2, 7), (1.0, 3), (0.0, 7), (0.6, None)):
        queue = queue_of(spark, f"{run.folder}/run", ratio, n)
        assert shown(queue.select(*found.columns)) == shown(review_queue(unsure, ratio, n).select(*found.columns))


def test_late_rows_are_listed(spark, run):
    late = late_detections(spark, f"{run.folder}/run")
    assert sorted(r["record_id"] for r in late.collect()) == [21, 22, 500]
    assert [r["record_id"] for r in late_records(spark, f"{run.folder}/run").collect()] == [70]


def test_clean_equals_batch(spark, run):
    texts, found = batch(spark)
    queue = review_queue(split_by_confidence(found)[1], 1.0, 7)
    verdicts = queue.selectExpr("record_id", "field_path", "start", "end", "pattern", "record_id % 2 = 0 as discard")
    expected = shown(sanitize_reviewed(texts, "id", found, verdicts, queue, "mask", ["text"]))
    folder = f"{run.folder}/run"
    kept = queue_of(spark, folder, 1.0, 7)
    clean = finish(spark, folder, "id", verdicts, kept, "mask", ["text"], hold_late=False)
    assert shown(clean) == expected
    # What a late detection would have hidden is not shown.
    held = shown(finish(spark, folder, "id", verdicts, kept, "mask", ["text"]))
    assert held == [r for r in expected if r[0] not in (21, 22)]


def test_empty_streams(spark, tmp_path):
    run = Run(spark, tmp_path)
    run.add()
    folder = f"{tmp_path}/run"
    assert finish(spark, folder, "id", queue=queue_of(spark, folder), columns=["text"]).collect() == []
    assert late_detections(spark, folder).collect() == [] == late_records(spark, folder).collect()
