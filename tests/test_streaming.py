from textveil.plans.sanitize import sanitize
from textveil.streaming.sanitizing import sanitize_stream


def test_stream_equals_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "id int, text string"
    rows = [(i, f"mail a{i}@b.co or call 987654{i:04d}") for i in range(60)]
    spark.createDataFrame(rows[:30], schema).write.parquet(source)
    target, progress = str(tmp_path / "out"), str(tmp_path / "progress")

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        sanitize_stream(stream, target, progress, "mask", key="id").awaitTermination()

    def clean():
        return sorted(tuple(r) for r in spark.read.schema(schema).parquet(target).collect())

    def batch():
        df = spark.read.parquet(source)
        return sorted(tuple(r) for r in sanitize(df, "mask", "id").collect())

    run()
    assert clean() == batch() and len(clean()) == 30
    # What arrives later is added, nothing is written twice.
    spark.createDataFrame(rows[30:], schema).write.mode("append").parquet(source)
    run()
    assert clean() == batch() and len(clean()) == 60
