"""Detection that searches each text once, however often it is met.

A store keeps, for a version of the rules, the digests of all texts searched so far and the hits
in them. A run looks only at digests of texts: those that the store does not hold are searched,
one place for each, and appended; then every place gets the hits of its text. So a table that
has grown costs the search of what is new, and a text that many records share is searched once.

A run's hits are written first, then its digests, each as a folder of its own; hits whose
digests are not there belong to a run that broke off, and are not read. Two runs at a time may
both search a text; the one whose name comes first counts. Texts never move: rows are chosen by
their keys, by a broadcast only of what is small enough for it.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textveil.functions.rules import CATALOGUE, Rule
from textveil.functions.sqltext import ident
from textveil.operators.detect import detect_pii
from textveil.operators.fields import extract_text_fields, rows_with
from textveil.sources.scratch import may_broadcast, written

TEXTS = "digest binary, version string, commit string"
HITS = "digest binary, rule_ord int, pattern string, match string, start int, end int, score double, version string, commit string"


def rules_version(rules: list[Rule] | None = None) -> str:
    """A name for what the rules find: it changes with any name, expression or place."""
    listed = [f"{r.order}\0{r.name}\0{r.regex}" for r in (CATALOGUE if rules is None else rules)]
    return hashlib.sha256("\1".join(listed).encode()).hexdigest()[:16]


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def stored_texts(spark: SparkSession, store: str, rules: list[Rule] | None = None) -> DataFrame:
    """``digest, commit`` of the texts that the store has searched with these rules."""
    mine = _read(spark, f"{store}/texts", TEXTS).where(F.col("version") == rules_version(rules))
    return mine.groupBy("digest").agg(F.min("commit").alias("commit"))


def stored_hits(spark: SparkSession, store: str, rules: list[Rule] | None = None) -> DataFrame:
    """The hits in those texts."""
    mine = _read(spark, f"{store}/hits", HITS).where(F.col("version") == rules_version(rules))
    return mine.join(stored_texts(spark, store, rules), ["digest", "commit"]).drop("version", "commit")


def _digested(df: DataFrame, key: str, columns: list[str] | None) -> DataFrame:
    fields = extract_text_fields(df, key, columns)
    return fields.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def search_new(
    df: DataFrame, key: str, fields: DataFrame, store: str, columns: list[str] | None = None, rules: list[Rule] | None = None
) -> None:
    """Search the texts of ``fields`` (``record_id, field_path, digest``) that the store does
    not hold, and append them to it."""
    spark = df.sparkSession
    known = stored_texts(spark, store, rules).select("digest")
    place = F.min(F.struct("record_id", "field_path")).alias("place")
    new = written(fields.join(known, "digest", "left_anti").groupBy("digest").agg(place), "new-texts")
    if new.isEmpty():
        return
    keys = written(new.select(F.col("place.record_id").alias("__chosen")).distinct(), "new-keys")
    if may_broadcast(keys):
        rows = df.join(F.broadcast(keys), F.col(ident(key)).eqNullSafe(F.col("__chosen")), "left_semi")
    else:
        rows, _ = rows_with(df, key, keys)
    texts = _digested(rows, key, columns).select("digest", "text")
    found = detect_pii(texts, "digest", ["text"], rules).withColumnRenamed("record_id", "digest").drop("field_path")
    # The chosen rows have other fields, too, and an unchosen row may have the same text.
    found = found.join(new.select("digest"), "digest", "left_semi").distinct()
    run = f"version={rules_version(rules)}/commit={uuid.uuid4().hex}"
    found.write.parquet(f"{store}/hits/{run}")
    new.select("digest").write.parquet(f"{store}/texts/{run}")


def detect_incremental(
    df: DataFrame, key: str, store: str, columns: list[str] | None = None, rules: list[Rule] | None = None
) -> DataFrame:
    """What ``detect_pii`` finds, with the search left out for texts that ``store`` holds.

    Hits are joined to places by digest; both sides are written tables, so that adaptive
    execution can split the places of a text that very many records share.
    """
    fields = written(_digested(df, key, columns).select("record_id", "field_path", "digest"), "digests")
    search_new(df, key, fields, store, columns, rules)
    hits = stored_hits(df.sparkSession, store, rules)
    return fields.join(hits, "digest").select(
        "record_id", "field_path", "rule_ord", "pattern", "match", "start", "end", "score"
    )
