"""Overlap resolution between detections of one text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textveil.functions.sqltext import BLOCK, let
from textveil.sources.scratch import written

# Field order is the sort order: leftmost first, then longest, then earliest rule.
SPAN_TYPE = "struct<start:int,shorter:int,rule_ord:int,end:int,match:string,score:double,pattern:string>"
# The same as an expression over the columns of a long detection table.
SPAN = (
    "named_struct('start', start, 'shorter', start - end, 'rule_ord', rule_ord, 'end', end, "
    "'match', match, 'score', coalesce(score, 1.0D), 'pattern', pattern)"
)
CERTAIN = 0.9
UNCERTAIN = 0.5


def resolve_overlaps(spans: str) -> str:
    """SQL for the disjoint spans left of an ``array<SPAN_TYPE>``.

    A left fold over the sorted spans that compares with the last kept one only:
    a longer span replaces it, an equally long one needs a higher score, anything
    else that overlaps is dropped.
    """
    none = f"cast(array() as array<{SPAN_TYPE}>)"
    state = f"struct<kept:array<{SPAN_TYPE}>,last:{SPAN_TYPE}>"
    step = (
        "CASE WHEN c.last IS NULL THEN named_struct('kept', c.kept, 'last', x) "
        "WHEN x.start >= c.last.end "
        "THEN named_struct('kept', concat(c.kept, array(c.last)), 'last', x) "
        "WHEN x.shorter < c.last.shorter "
        "OR (x.shorter = c.last.shorter AND x.score > c.last.score) "
        "THEN named_struct('kept', c.kept, 'last', x) ELSE c END"
    )
    block = (
        f"aggregate(slice(s, b * {BLOCK} + 1, {BLOCK}), "
        f"cast(named_struct('kept', {none}, 'last', try_element_at(a, -1).last) as {state}), "
        f"(c, x) -> cast({step} as {state}))"
    )
    blocks = (
        f"aggregate(sequence(0, (size(s) - 1) div {BLOCK}), cast(array() as array<{state}>), "
        f"(a, b) -> concat(a, array({block})))"
    )
    joined = let(
        "p",
        blocks,
        "concat(flatten(transform(p, q -> q.kept)), array(element_at(p, -1).last))",
    )
    return let("s", f"array_sort({spans})", f"CASE WHEN size(s) < 2 THEN s ELSE {joined} END")


#: Characters of a field whose hits are looked at together when it is cut.
STRETCH = 4096


def clusters(detections: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Add ``cluster``, the start of the first of some hits that lie apart from all others.

    In the order of their starts, a cluster begins at each hit that starts where or after all
    hits before it have ended. What comes before a stretch of the text is told by one row per
    stretch: the farthest end, and the last begin of a cluster. So no task reads a field whole.
    """
    field = ["record_id", "field_path"]
    place = [*field, "stretch"]
    rows = detections.withColumn("stretch", F.expr(f"start div {stretch}"))

    def earlier(name: str):
        window = Window.partitionBy(*field).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
        return F.max(name).over(window)

    def joined(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
        right = right.select(*[F.col(c).alias(f"__{c}") for c in place], name)
        same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in place]
        return left.join(right, same).drop(*[f"__{c}" for c in place])

    ends = rows.groupBy(*place).agg(F.max("end").alias("farthest"))
    rows = joined(rows, ends.withColumn("reached", earlier("farthest")), "reached")
    order = Window.partitionBy(*place).orderBy("start")
    # Hits with equal starts are one step: the least of their ends decides nothing.
    inside = F.max("end").over(order.rangeBetween(Window.unboundedPreceding, -1))
    reached = F.greatest("reached", inside)
    begins = F.when(reached.isNull() | (F.col("start") >= reached), F.col("start"))
    rows = rows.withColumn("begins", begins)
    lasts = rows.groupBy(*place).agg(F.max("begins").alias("last"))
    rows = joined(rows, lasts.withColumn("open", earlier("last")), "open")
    upto = order.rangeBetween(Window.unboundedPreceding, 0)
    cluster = F.coalesce(F.max("begins").over(upto), "open")
    return rows.withColumn("cluster", cluster).drop("stretch", "reached", "begins", "open")


def merge_detections(
    detections: DataFrame, protect_certain: bool = False, field_hits: int | None = None
) -> DataFrame:
    """Resolve overlaps per ``(record_id, field_path)`` in a long table.

    Only detections are shuffled, never texts. With ``protect_certain`` an
    uncertain hit cannot displace a certain one that it overlaps.

    A group holds the hits of one field. Hits that lie apart don't touch one another, so with
    ``field_hits`` a field with more hits than that is cut into clusters of hits that overlap,
    which are merged in as many tasks; the result is the same. To know those fields the
    detections are written first.
    """
    if field_hits is None:
        return _merged(detections.withColumn("cluster", F.lit(None).cast("int")), protect_certain)
    detections = written(detections, "hits")
    field = ["record_id", "field_path"]
    counts = detections.groupBy(*field).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > field_hits)
    large = written(counts.select(*[F.col(c).alias(f"__{c}") for c in field]), "large-fields")
    if large.isEmpty():
        return merge_detections(detections, protect_certain)
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in field]
    rest = detections.join(large, same, "left_anti").withColumn("cluster", F.lit(None).cast("int"))
    cut = clusters(detections.join(large, same, "left_semi"))
    return _merged(rest.unionByName(cut), protect_certain)


def _merged(detections: DataFrame, protect_certain: bool) -> DataFrame:
    """Resolve overlaps per ``(record_id, field_path, cluster)``."""
    grouped = detections.groupBy("record_id", "field_path", "cluster").agg(
        F.expr(f"collect_list({SPAN})").alias("spans")
    )
    spans = "spans"
    if protect_certain:
        clash = "exists(sure, y -> x.start < y.end AND y.start < x.end)"
        spans = let(
            "sure",
            f"filter(spans, x -> x.score >= {CERTAIN}D)",
            f"filter(spans, x -> x.score >= {CERTAIN}D OR NOT {clash})",
        )
    merged = grouped.select("record_id", "field_path", F.expr(resolve_overlaps(spans)).alias("spans"))
    return explode_spans(merged)


def explode_spans(df: DataFrame) -> DataFrame:
    """``(record_id, field_path, spans)`` -> one detection per row."""
    return df.select(
        "record_id", "field_path", F.expr("explode(spans)").alias("span")
    ).selectExpr(
        "record_id",
        "field_path",
        "span.rule_ord as rule_ord",
        "span.pattern as pattern",
        "span.match as match",
        "span.start as start",
        "span.end as end",
        "span.score as score",
    )


def certain(detections: DataFrame) -> DataFrame:
    return detections.filter(f"coalesce(score, 1.0D) >= {CERTAIN}D")


def uncertain(detections: DataFrame) -> DataFrame:
    return detections.filter(
        f"coalesce(score, 1.0D) >= {UNCERTAIN}D AND coalesce(score, 1.0D) < {CERTAIN}D"
    )
