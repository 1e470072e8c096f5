"""Whole sanitising runs.

Rules alone need no second look at the data: detection, overlap resolution and
replacement happen inside the row, without a shuffle. Once detections come from
elsewhere or people review some of them, the run has two halves with the
detection table between them; only that table is shuffled until it is joined back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textveil.functions.rules import (
    CATALOGUE,
    CATEGORY_SOURCES,
    Rule,
    source_categories,
    source_generators,
)
from textveil.functions.sqltext import held, ident, let, lit
from textveil.operators.actions import check_action, check_salt, spliced_sql
from textveil.operators.detect import detect_pii, spans_sql, split_by_confidence
from textveil.operators.fields import joined_by_key, leaves_sql, text_columns, texts_sql, unique_sql, write_back
from textveil.operators.merge import SPAN
from textveil.operators.review import final_detections, review_queue
from textveil.sources.writers import write_detections

# Words the actions themselves write; a second pass would otherwise find them.
PLACEHOLDER_WORDS = ("REDACTED", "PSEUDONYMIZED")


def sanitize(
    df: DataFrame,
    action: str = "redact",
    key: str | None = None,
    columns: list[str] | None = None,
    rules: list[Rule] | None = None,
    salt: str = "",
    skip_placeholders: bool = False,
    luhn: bool = False,
    condense: bool = True,
) -> DataFrame:
    """Replace every rule hit in every string field; the schema stays as it is.

    Works on batch and streaming frames alike. ``skip_placeholders`` leaves words
    that an earlier run wrote; ``luhn`` asks generic card numbers for a valid
    check digit.
    """
    check_action(action)
    check_salt(action, salt)
    chosen = text_columns(df, key, columns)
    if not chosen:
        return df
    # Hits that don't count go before overlaps are resolved: what they would have
    # displaced is still replaced.
    keep = []
    if skip_placeholders:
        words = ", ".join(lit(w) for w in PLACEHOLDER_WORDS)
        keep.append(f"s.match NOT IN ({words})")
    if luhn:
        digits = "regexp_replace(s.match, '[ -]', '')"
        keep.append(f"(s.pattern != 'credit_card_generic' OR luhn_check({digits}))")
    found = spans_sql(
        "leaf", CATALOGUE if rules is None else rules, True, condense, " AND ".join(keep) or None
    )
    new = let(
        "spans",
        found,
        f"CASE WHEN spans IS NOT NULL THEN {spliced_sql('leaf', 'spans', action, salt)} END",
    )
    changed = f"transform({texts_sql(df, chosen)}, leaf -> {new})"
    return write_back(held(df, "__changed", changed), chosen, "__changed")


def apply_detections(
    df: DataFrame,
    key: str,
    detections: DataFrame,
    action: str = "redact",
    columns: list[str] | None = None,
    salt: str = "",
) -> DataFrame:
    """Replace given detections in the records they belong to.

    ``detections`` must be disjoint within a field. They are grouped per record,
    so one group is never larger than what one record holds, and joined back: records
    without any stay where they are. A null key is a key like others; a key with detections
    that stands for several rows is an error.
    """
    check_action(action)
    check_salt(action, salt)
    chosen = text_columns(df, key, columns)
    # Dealt out by record once, for both groupings and the join.
    fields = detections.repartition("record_id").groupBy("record_id", "field_path").agg(
        F.expr(f"array_sort(collect_list({SPAN}))").alias("spans")
    )
    records = fields.groupBy(F.col("record_id").alias("__record")).agg(
        F.map_from_entries(F.collect_list(F.struct("field_path", "spans"))).alias("__spans")
    )
    joined = joined_by_key(df, key, records)
    new = let(
        "own",
        "try_element_at(__spans, leaf.path)",
        f"CASE WHEN own IS NOT NULL THEN {spliced_sql('leaf.text', 'own', action, salt)} END",
    )
    changed = unique_sql(
        key,
        "CASE WHEN __spans IS NULL THEN cast(array() as array<string>) "
        f"ELSE transform({leaves_sql(df, chosen)}, leaf -> {new}) END",
    )
    staged = held(joined, "__changed", changed, drop=("__spans", "__rows"))
    return write_back(staged, chosen, "__changed")


def sanitize_reviewed(
    df: DataFrame,
    key: str,
    detections: DataFrame,
    verdicts: DataFrame | None = None,
    queue: DataFrame | None = None,
    action: str = "redact",
    columns: list[str] | None = None,
    salt: str = "",
) -> DataFrame:
    """Second half of a reviewed run.

    ``detections`` is the table the first half wrote. Certain hits are always
    replaced, uncertain ones only when they were queued and not discarded.
    """
    sure, unsure = split_by_confidence(detections)
    final = final_detections(sure, queue if queue is not None else unsure.limit(0), verdicts)
    return apply_detections(df, key, final, action, columns, salt)


def sanitize_hybrid(
    df: DataFrame,
    key: str,
    audit_path: str,
    external: DataFrame | None = None,
    reviewer: Callable[[DataFrame], DataFrame] | None = None,
    ratio: float = 1.0,
    max_n: int | None = 50,
    action: str = "redact",
    columns: list[str] | None = None,
    rules: list[Rule] | None = None,
    salt: str = "",
    protect_certain: bool = False,
) -> DataFrame:
    """Both halves of a run with external detections and review.

    The merged detections are written to ``audit_path`` first and read from there
    afterwards. ``reviewer`` gets the queue and returns verdicts (the identity of
    a detection and ``discard``); without one only certain hits are replaced.
    """
    check_action(action)
    check_salt(action, salt)
    found = detect_pii(df, key, columns, rules, external, protect_certain)
    stored = write_detections(found, audit_path)
    queue = review_queue(split_by_confidence(stored)[1], ratio, max_n)
    verdicts = reviewer(queue) if reviewer else None
    return sanitize_reviewed(df, key, stored, verdicts, queue, action, columns, salt)


def organize(df: DataFrame, key: str, detections: DataFrame) -> DataFrame:
    """Detections grouped by record, then by field; records without hits stay,
    with an empty map."""
    fields = detections.repartition("record_id").groupBy("record_id", "field_path").agg(
        F.expr(
            "array_sort(collect_list(named_struct('start', start, 'end', end, "
            "'rule_ord', rule_ord, 'pattern', pattern, 'match', match, 'score', score)))"
        ).alias("hits")
    )
    records = fields.groupBy("record_id").agg(
        F.map_from_entries(F.collect_list(F.struct("field_path", "hits"))).alias("fields")
    )
    kind = records.schema["fields"].dataType.simpleString()
    ids = df.select(F.col(ident(key)).alias("own_id"))
    return ids.join(records, F.col("own_id").eqNullSafe(F.col("record_id")), "left").select(
        F.col("own_id").alias("record_id"),
        F.coalesce("fields", F.expr(f"cast(map() as {kind})")).alias("fields"),
    )


def rule_map(spark: SparkSession) -> DataFrame:
    """``(source, category, generator)`` for every known detection name."""
    rows = [(s, c, g) for c, (g, sources) in CATEGORY_SOURCES.items() for s in sources]
    return spark.createDataFrame(rows, "source string, category string, generator string")


def rule_table(spark: SparkSession) -> DataFrame:
    """The catalogue as a small table."""
    categories, generators = source_categories(), source_generators()
    rows = [
        (r.order, r.name, r.regex, categories.get(r.name), generators.get(r.name)) for r in CATALOGUE
    ]
    return spark.createDataFrame(
        rows, "rule_ord int, name string, regex string, category string, generator string"
    )


def with_category(detections: DataFrame) -> DataFrame:
    """Add category and generator. The map holds under 200 rows whatever the
    data, so it is broadcast."""
    names = F.broadcast(rule_map(detections.sparkSession))
    return detections.join(names, detections["pattern"] == names["source"], "left").drop("source")


def summary(detections: DataFrame) -> DataFrame:
    """Hits per category and pattern, for the audit. Counted before the map is
    joined, so the join sees one row per pattern."""
    counts = detections.groupBy("pattern").agg(
        F.count(F.lit(1)).alias("hits"), F.countDistinct("record_id").alias("records")
    )
    return with_category(counts).select("category", "pattern", "hits", "records")
