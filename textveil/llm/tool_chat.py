"""Chat formatting with tool calls: link, order, validate, serialise.

Calls and results meet in a hash join on the conversation and the call's identifier: an
identifier means a call of its own conversation, whatever others call theirs. A call may use the results
of others (``after``). A call's place comes after the places of all those: it is the call's
turn, as turns do so by themselves wherever calls use earlier ones. Only what is behind a
reference to a later turn is ordered round by round: first the calls that depend on one,
directly or not, then each as soon as all that it uses have a place, one further than the
last of them. What is left over is part of a cycle or behind one. There are as many rounds as
such a chain has calls, and none at all without such references. Arguments are parsed as a
variant, checked against the tool's schema, and written as canonical JSON: keys in order, no
blanks, null fields of a record left out.

DataFrame functions only. Calls, not conversations, are the unit: nothing collects a
conversation, so a very long one is no burden. Identifiers are unique on one side of each
join, which reads written tables; a result that a third of all calls use can be split.

Results that are defined: a null identifier links to nothing, a null conversation is one like
others; of several results the one of
the least turn is taken (then the least text), and ``n_results`` counts all; calls that share
an identifier are all linked only if they are equal in all columns, else those other than the
least get the status ``repeated identifier``; null or broken arguments are no JSON object;
empty texts are texts; other columns are not read; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textveil.llm.shared import stored

#: Types of schema fields and how a variant names them.
TYPES = {
    "string": "^STRING$",
    "integer": r"^BIGINT$|^DECIMAL\(\d+,0\)$",
    "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$",
    "boolean": "^BOOLEAN$",
    "array": "^ARRAY<.*",
    "object": "^OBJECT<.*",
}

Schemas = dict[str, dict[str, tuple[str, bool]]]


def argument_errors(tool: Column, arguments: Column, parsed: Column, schemas: Schemas) -> Column:
    """What is wrong with a call's arguments: an array of messages, empty if nothing is."""
    case = F.when(
        ~F.schema_of_variant(parsed).startswith("OBJECT") | parsed.isNull(), F.array(F.lit("arguments are no JSON object"))
    )
    for name, fields in sorted(schemas.items()):
        checks = []
        for field, (kind, required) in sorted(fields.items()):
            value = F.try_variant_get(parsed, f"$['{field}']", "variant")
            missing = value.isNull() | (F.schema_of_variant(value) == "VOID")
            if required:
                checks.append(F.when(missing, F.lit(f"{field} is missing")))
            checks.append(F.when(~missing & ~F.schema_of_variant(value).rlike(TYPES[kind]), F.lit(f"{field} is no {kind}")))
        known = F.array(*[F.lit(f) for f in sorted(fields)]).cast("array<string>")
        more = F.array_sort(F.array_except(F.json_object_keys(arguments), known))
        extra = F.transform(more, lambda k: F.concat(k, F.lit(" is not known")))
        case = case.when(tool == name, F.concat(F.array_compact(F.array(*checks)), extra))
    return case.otherwise(F.array(F.lit("unknown tool")))


def linked(identifier: Column) -> Column:
    """A call's name among all conversations, null for a null identifier."""
    return F.when(identifier.isNotNull(), F.to_json(F.struct(F.col("conv_id").alias("c"), identifier.alias("i"))))


def places_of(calls: DataFrame) -> DataFrame:
    """``call_id, place`` of all calls that can be ordered, from ``call_id`` (unique), ``turn``
    and ``after``. A reference to a call that isn't there counts as none."""
    turns = calls.select("call_id", "turn")
    used = turns.select(F.col("call_id").alias("parent"), F.col("turn").alias("parent_turn"))
    edges = calls.select("call_id", "turn", F.explode(F.array_distinct("after")).alias("parent"))
    edges = stored(edges.join(used, "parent"), "edges")
    later = edges.where("parent_turn >= turn OR parent_turn IS NULL OR turn IS NULL")
    behind = newest = stored(later.select("call_id").distinct(), "behind")
    if newest.isEmpty():
        return turns.withColumnRenamed("turn", "place")
    while not newest.isEmpty():
        step = edges.join(newest.withColumnRenamed("call_id", "parent"), "parent").select("call_id").distinct()
        newest = stored(step.join(behind, "call_id", "left_anti"), "behind")
        behind = behind.unionByName(newest)
    behind = stored(behind, "behind")
    ahead = stored(turns.join(behind, "call_id", "left_anti").withColumnRenamed("turn", "place"), "places")
    open_ = stored(edges.join(behind, "call_id"), "open")
    needs = stored(open_.groupBy("call_id", "turn").agg(F.count(F.lit(1)).alias("needs")), "needs")
    places = newest = ahead
    met = None
    while not newest.isEmpty():
        # How many of the calls that a call uses have a place, and the last of those.
        step = open_.join(newest.withColumnRenamed("call_id", "parent"), "parent")
        step = step.groupBy("call_id").agg(F.count(F.lit(1)).alias("met"), F.max("place").alias("top"))
        if met is not None:
            step = met.unionByName(step).groupBy("call_id").agg(F.sum("met").alias("met"), F.max("top").alias("top"))
        step = stored(step.join(needs, "call_id"), "met")
        place = F.greatest(F.col("turn"), F.col("top") + 1).alias("place")
        newest = stored(step.where("met = needs").select("call_id", place), "places")
        met = step.where("met < needs").select("call_id", "met", "top")
        places = places.unionByName(newest)
    return places


def link_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row per call: ``conv_id, turn, call_id, tool, place, status, n_results, errors,
    json``.

    ``calls`` has ``conv_id, turn, call_id, tool, arguments`` (JSON text) and ``after`` (an
    array of identifiers); ``results`` has ``conv_id, call_id, turn, content``.
    """
    calls = stored(
        calls.select("conv_id", "turn", "call_id", "tool", "arguments", "after")
        .withColumn("after", F.coalesce("after", F.array().cast("array<string>")))
        .withColumn("name", linked(F.col("call_id"))),
        "calls",
    )
    own = F.struct("turn", "tool", "arguments", "after")
    firsts = stored(
        calls.where("name is not null").groupBy("name").agg(F.min(own).alias("chosen"), F.min("conv_id").alias("conv_id")),
        "firsts",
    )
    answers = stored(
        results.withColumn("name", linked(F.col("call_id")))
        .where("name is not null")
        .groupBy("name")
        .agg(F.min(F.struct("turn", "content")).alias("answer"), F.count(F.lit(1)).alias("n_results")),
        "answers",
    )
    uses = F.transform("chosen.after", linked)
    places = places_of(firsts.select(F.col("name").alias("call_id"), "chosen.turn", uses.alias("after")))
    places = places.withColumnRenamed("call_id", "name")
    known = firsts.drop("conv_id").join(answers, "name", "left").join(places.select("name", "place"), "name", "left")
    known = stored(known, "known")
    parsed = F.try_parse_json("arguments")
    judged = (
        calls.join(known, "name", "left")
        .withColumn("parsed", parsed)
        .withColumn("errors", argument_errors(F.col("tool"), F.col("arguments"), F.col("parsed"), schemas))
        .withColumn("same", F.coalesce(own.eqNullSafe(F.col("chosen")), F.lit(False)))
    )
    unknown = F.array_contains("errors", "unknown tool")
    status = (
        F.when(F.col("call_id").isNull(), "no identifier")
        .when(~F.col("same"), "repeated identifier")
        .when(unknown, "unknown tool")
        .when(F.size("errors") > 0, "invalid arguments")
        .when(F.col("place").isNull(), "in a cycle")
        .when(F.col("answer").isNull(), "no result")
        .otherwise("ok")
    )
    record = F.to_json(
        F.struct(
            F.col("parsed").alias("arguments"),
            F.when(F.size("after") > 0, F.array_sort("after")).alias("after"),
            F.col("call_id").alias("id"),
            F.when(F.col("same"), F.col("answer.content")).alias("result"),
            F.col("tool").alias("tool"),
        )
    )
    return judged.select(
        "conv_id",
        "turn",
        "call_id",
        "tool",
        F.when(F.col("same"), F.col("place")).alias("place"),
        status.alias("status"),
        F.when(F.col("same"), F.coalesce("n_results", F.lit(0))).otherwise(0).cast("long").alias("n_results"),
        "errors",
        record.alias("json"),
    )


def lost_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results whose call isn't there."""
    there = calls.select(linked(F.col("call_id")).alias("name")).where("name is not null").distinct()
    return results.withColumn("name", linked(F.col("call_id"))).join(there, "name", "left_anti").drop("name")


def format_chats(messages: DataFrame, calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """Everything as canonical JSON records, one row each: calls with their results, results
    without a call, and the plain messages (``conv_id, turn, role, text``). A conversation in
    order is its rows by ``place`` (``turn`` where it is null), ``turn`` and ``call_id``."""
    linked = link_calls(calls, results, schemas).withColumn("kind", F.lit("call"))
    lost = lost_results(calls, results).select(
        "conv_id",
        "turn",
        "call_id",
        F.lit("no call").alias("status"),
        F.lit("result").alias("kind"),
        F.to_json(F.struct(F.col("call_id").alias("id"), F.col("content").alias("result"))).alias("json"),
    )
    plain = messages.select(
        "conv_id",
        "turn",
        F.lit("ok").alias("status"),
        F.lit("message").alias("kind"),
        F.to_json(F.struct(F.col("text").alias("content"), "role")).alias("json"),
    )
    everything = linked.unionByName(lost, allowMissingColumns=True).unionByName(plain, allowMissingColumns=True)
    return everything.select(
        "conv_id", "turn", "kind", "call_id", "tool", "place", "status", "n_results", "errors", "json"
    )
