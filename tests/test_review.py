import pytest

from textveil.operators.review import IDENTITY, apply_verdicts, final_detections, review_queue
from textveil.plans.sanitize import sanitize_hybrid, sanitize_reviewed
from textveil.sources.writers import write_detections

SCHEMA = (
    "record_id int, field_path string, rule_ord int, pattern string, match string, "
    "start int, end int, score double"
)


@pytest.fixture()
def unsure(spark):
    rows = [(i, "text", 78, "person", "Ann", 0, 3, 0.5 + (i % 4) / 10) for i in range(21)]
    return spark.createDataFrame([*rows, (21, "text", 78, "person", "Ann", 0, 3, None)], SCHEMA)


def _ids(df):
    return [r.record_id for r in df.collect()]


@pytest.mark.parametrize("most", [50, None])
def test_queue_size_and_order(unsure, most):
    ranked = sorted(range(22), key=lambda i: (-(0.5 + (i % 4) / 10) if i < 21 else -0.5, i))
    for ratio in (0.0, 0.1, 0.3, 0.5, 1.0):
        assert sorted(_ids(review_queue(unsure, ratio, most))) == sorted(ranked[: int(22 * ratio)])


def test_queue_cap(unsure):
    assert sorted(_ids(review_queue(unsure, 1.0, 5))) == [3, 7, 11, 15, 19]
    assert _ids(review_queue(unsure.limit(0))) == []


def test_verdicts_and_final(spark, unsure):
    queue = review_queue(unsure, 1.0, 5)
    verdicts = queue.selectExpr(*IDENTITY, "record_id = 7 as discard")
    assert sorted(_ids(apply_verdicts(queue, verdicts))) == [3, 11, 15, 19]
    sure = spark.createDataFrame([(99, "text", 1, "email", "a@b.co", 5, 11, 1.0)], SCHEMA)
    final = final_detections(sure, queue, verdicts)
    assert sorted(_ids(final)) == [3, 11, 15, 19, 99]
    assert _ids(final_detections(sure, queue)) == [99]
    assert sorted(_ids(final_detections(final, queue, verdicts))) == [3, 11, 15, 19, 99]


def test_two_halves_of_a_reviewed_run(spark, tmp_path):
    df = spark.createDataFrame([(1, "Ann and a@b.co"), (2, "Ann alone"), (3, "nothing")], "id int, text string")
    found = spark.createDataFrame(
        [
            (1, "text", 78, "person", "Ann", 0, 3, 0.6),
            (1, "text", 1, "email", "a@b.co", 8, 14, 1.0),
            (2, "text", 78, "person", "Ann", 0, 3, 0.8),
        ],
        SCHEMA,
    )
    stored = write_detections(found, str(tmp_path / "audit"))
    unsure = stored.filter("score < 0.9")
    queue = review_queue(unsure)
    verdicts = queue.selectExpr(*IDENTITY, "record_id = 2 as discard")
    out = {r.id: r.text for r in sanitize_reviewed(df, "id", stored, verdicts, queue, "mask").collect()}
    assert out == {1: "[PERSON] and [EMAIL]", 2: "Ann alone", 3: "nothing"}
    out = {r.id: r.text for r in sanitize_reviewed(df, "id", stored, action="mask").collect()}
    assert out == {1: "Ann and [EMAIL]", 2: "Ann alone", 3: "nothing"}


def test_hybrid_run_with_a_reviewer(spark, tmp_path):
    df = spark.createDataFrame([(1, "Ann and a@b.co"), (2, "Ann alone"), (3, "Bob")], "id int, text string")
    names = spark.createDataFrame(
        [(1, "text", "person", "Ann", 0, 3, 0.6), (2, "text", "person", "Ann", 0, 3, 0.8),
         (3, "text", "person", "Bob", 0, 3, 0.4)],
        "record_id int, field_path string, pattern string, match string, start int, end int, score double",
    )

    def reviewer(queue):
        return queue.selectExpr(*IDENTITY, "score > 0.7 as discard")

    def run(path, **options):
        out = sanitize_hybrid(df, "id", str(tmp_path / path), external=names, action="mask", **options)
        return {r.id: r.text for r in out.collect()}

    assert run("a", reviewer=reviewer) == {1: "[PERSON] and [EMAIL]", 2: "Ann alone", 3: "Bob"}
    assert run("b") == {1: "Ann and [EMAIL]", 2: "Ann alone", 3: "Bob"}
    # Only the surest is looked at; what nobody looked at stays as it is.
    assert run("c", reviewer=reviewer, max_n=1) == {1: "Ann and [EMAIL]", 2: "Ann alone", 3: "Bob"}
    assert spark.read.parquet(str(tmp_path / "a")).count() == 4
