"""Detection with a store, and chunks of long texts, against detection of everything at once."""

import random

import pytest
from pyspark.sql import functions as F

from textveil.functions.rules import select_rules
from textveil.operators.detect import detect_pii, detect_with
from textveil.plans import incremental
from textveil.plans.incremental import detect_incremental, stored_texts


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _records(first, count):
    draw = random.Random(first)
    pool = ["mail a@b.co now", "plain words", "ip 10.0.0.1 here", "call 415-555-2671", ""]
    return [(i, draw.choice(pool) + draw.choice(["", f" and x{i}@y.org"]), [draw.choice(pool), None]) for i in range(first, first + count)]


SCHEMA = "id int, text string, notes array<string>"


@pytest.mark.parametrize("limit", ["10m", "-1"])
def test_only_new_texts_are_searched(spark, tmp_path, limit, monkeypatch):
    store = str(tmp_path / "store")
    old = spark.createDataFrame(_records(0, 200), SCHEMA)
    grown = old.unionByName(spark.createDataFrame(_records(200, 20) + [(None, "null key c@d.co", None)], SCHEMA))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        assert collected(detect_incremental(old, "id", store)) == collected(detect_pii(old, "id"))
        distinct = old.select(F.explode(F.concat("notes", F.array("text"))).alias("t")).where("t != ''").distinct()
        assert stored_texts(spark, store).count() == distinct.count()
        searched = []
        plain = incremental.detect_pii
        monkeypatch.setattr(incremental, "detect_pii", lambda df, *a: (searched.append(df), plain(df, *a))[1])
        assert collected(detect_incremental(grown, "id", store)) == collected(detect_pii(grown, "id"))
        # Few rows are looked at again, and each text is stored once.
        assert searched[0].count() <= 70
        runs = spark.read.parquet(f"{store}/texts")
        assert runs.count() == runs.select("digest").distinct().count()
        assert runs.groupBy("commit").count().count() == 2
        searched.clear()
        assert collected(detect_incremental(grown, "id", store)) == collected(detect_pii(grown, "id"))
        assert not searched
        # Other rules are another version.
        emails = select_rules(include=["email"])
        assert collected(detect_incremental(old, "id", store, rules=emails)) == collected(detect_pii(old, "id", rules=emails))
        assert len(searched) == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_runs_that_broke_off_or_met(spark, tmp_path):
    store = str(tmp_path / "store")
    df = spark.createDataFrame(_records(0, 50), SCHEMA)
    expected = collected(detect_incremental(df, "id", store))
    version = incremental.rules_version()
    hits = spark.read.parquet(f"{store}/hits").drop("version", "commit")
    texts = spark.read.parquet(f"{store}/texts").drop("version", "commit")
    # Hits without digests, and a second run over the same texts.
    hits.write.parquet(f"{store}/hits/version={version}/commit=broken")
    hits.write.parquet(f"{store}/hits/version={version}/commit=zz")
    texts.write.parquet(f"{store}/texts/version={version}/commit=zz")
    assert collected(detect_incremental(df, "id", store)) == expected
    assert detect_incremental(df.limit(0), "id", store).collect() == []


def _finder():
    def factory():
        import re

        def entity(m):
            return {"label": "name", "text": m.group(), "start": m.start(), "end": m.end(), "score": 0.8}

        return lambda texts: [[entity(m) for m in re.finditer("N[a-z]{1,7}", t)] for t in texts]

    return factory


def test_chunks_are_rows(spark):
    """One long text is dealt out to many tasks; the result is that of the whole text."""
    draw = random.Random(4)
    words = ["plain", "Nora", "Niklas", "words", "é😀", "N", "xNabcdefgh"]
    long = " ".join(draw.choices(words, k=40_000))
    rows = [(1, long, ["Nora", long[:5000]]), (2, "short Nora", None), (None, long[1000:9000], [""])]
    df = spark.createDataFrame(rows, "id int, text string, notes array<string>")
    whole = collected(detect_with(df, "id", _finder()))
    for chunk, overlap in ((1000, 8), (777, 20), (10**6, 8)):
        assert collected(detect_with(df, "id", _finder(), chunk=chunk, overlap=overlap)) == whole
    from textveil.operators.detect import _chunk_rows
    from textveil.operators.fields import extract_text_fields

    chunks = _chunk_rows(extract_text_fields(df, "id", ["text"]).where("record_id = 1"), 1000, 8)
    parts = chunks.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(parts) >= 4 and max(r["count"] for r in parts) < 0.6 * sum(r["count"] for r in parts)
