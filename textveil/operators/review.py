"""Human review of uncertain detections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textveil.functions.sqltext import ident
from textveil.operators.order import with_position

IDENTITY = ["record_id", "field_path", "start", "end", "pattern"]


def review_queue(
    uncertain: DataFrame, ratio: float = 1.0, max_n: int | None = 50
) -> DataFrame:
    """The detections a person should look at, surest first.

    At most ``int(n * ratio)`` of the ``n`` uncertain ones, and at most ``max_n``.
    A missing score counts as 0.5. Equal scores come in the order of arrival: by record,
    column, place in its lists (numbers, not text) and position. With ``max_n`` the top
    rows come from a bounded top-k; without it the queue may be as long as the input, so
    rows are ranked by ranges instead.
    """
    if ratio < 0:
        raise ValueError("ratio must not be negative")
    places = F.regexp_extract_all("field_path", F.lit(r"\[(\d+)\]"), F.lit(1))
    helpers = {
        "__down": -F.coalesce("score", F.lit(0.5)),
        "__column": F.regexp_extract("field_path", r"^[^.\[]*", 0),
        "__places": F.transform(places, lambda x: x.cast("long")),
    }
    ranked = uncertain.withColumns(helpers)
    order = ["__down", "record_id", "__column", "__places", "field_path", "start", "end", "pattern"]
    if max_n is None:
        numbered = with_position(ranked, *order, name="__rank")
        total = numbered.agg(F.count(F.lit(1)).alias("n")).scalar()
        return numbered.filter(F.col("__rank") < F.floor(total * F.lit(float(ratio)))).drop(
            "__rank", *helpers
        )
    total = uncertain.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        ranked.orderBy(*order)
        .limit(int(max_n))
        .withColumn("__rank", F.row_number().over(Window.orderBy(*[ident(c) for c in order])))
        .filter(F.col("__rank") <= F.floor(total * F.lit(float(ratio))))
        .drop("__rank", *helpers)
    )


def apply_verdicts(queue: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Queued detections that were not discarded.

    ``verdicts`` holds the identity of a detection and a boolean ``discard``.
    """
    discarded = verdicts.filter("discard").select(*[F.col(c).alias(f"__{c}") for c in IDENTITY])
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in IDENTITY]
    return queue.join(discarded, same, "left_anti")


def final_detections(
    certain: DataFrame, queue: DataFrame, verdicts: DataFrame | None = None
) -> DataFrame:
    """Certain detections and verified ones. Without verdicts nothing uncertain
    is taken; what was never queued is not taken either."""
    if verdicts is None:
        return certain
    return certain.unionByName(apply_verdicts(queue, verdicts)).dropDuplicates(
        [*IDENTITY, "rule_ord"]
    )
