"""Generated values are drawn in many tasks, however few splits the keys are read in."""

from pyspark.sql import functions as F

from textveil.plans.queries import GENERATED_ROWS, pseudonym_distinct, pseudonym_kinds, pseudonym_lengths
from textveil.sources.readers import by_rows


def _tables(spark, folder, customers):
    rows = spark.createDataFrame([(k,) for k in customers], "c_custkey long")
    rows.coalesce(1).write.parquet(f"{folder}/customer.parquet")
    docs = spark.createDataFrame([(1, "mail a.b@example.org"), (1, "nothing"), (2, None)], "doc_id long, text string")
    docs.coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_one_split_of_keys_is_dealt_out(spark, tmp_path):
    folder = _tables(spark, tmp_path, [*range(2 * GENERATED_ROWS), None, 5, 5])
    for query in (pseudonym_kinds, pseudonym_lengths):
        made = query(spark, folder)
        assert made.rdd.getNumPartitions() == 3
        sizes = made.groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in sizes) < 1.1 * GENERATED_ROWS
        assert made.count() == 2 * GENERATED_ROWS + 3 and made.where("c_custkey = 5").count() == 3


def test_distinct_values_with_repeated_and_null_keys(spark, tmp_path):
    folder = _tables(spark, tmp_path, [*range(50), None, None, 5, 5])
    got = {r.kind: (r.originals, r.pseudonyms) for r in pseudonym_distinct(spark, folder).collect()}
    assert [got[k] for k in ("name", "organization", "email", "address", "uri")] == [(52, 52)] * 5
    # One distinct count needs no copy of each row.
    plan = pseudonym_distinct(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan


def test_by_rows_of_nothing(spark):
    assert by_rows(spark.range(0), 10).count() == 0
