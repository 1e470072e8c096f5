"""Rule and external detection of personal and secret data.

Running every rule over every character is almost all of the cost, and most
characters belong to plain words that no rule can match. So a text is first
condensed: each run of plain words becomes one marker character, and the rules
read what is left. Positions in the condensed text map back exactly. Condensing
changes no result; ``condense=False`` reads the whole text with every rule.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textveil.functions.rules import CATALOGUE, RULE_NAMES, Rule
from textveil.functions.sqltext import BLANKS, ident, let, lit, running_sum
from textveil.functions.workers import new_identity, once_per_worker
from textveil.operators.fields import extract_text_fields, leaves_sql, text_columns
from textveil.operators.merge import (
    SPAN_TYPE,
    certain,
    explode_spans,
    merge_detections,
    resolve_overlaps,
    uncertain,
)
from textveil.sources.scratch import written

MARKER = "\0"
SPLIT = "\x02"

# A plain word: at most one capital, at its start, then letters and sentence
# punctuation, between blanks. No digit, no second capital, none of @ < + - = / ~ :
# \ _ and at most 31 characters, so no condensed-text rule can touch it. The one
# rule with letters apart from its digits needs them one blank away, which is what
# the look-arounds keep. Quantifiers are possessive, so a run of words of any
# length is matched without recursion.
_PLAIN = r"""\p{Lu}?+[\p{Ll}\p{Lo}\p{M}.,;!?'"()«»‘’“”„…]{1,30}+(?!\S)(?!\s\p{Nd})"""
PLAIN_RUN = rf"(?<!\S)(?<!\p{{Nd}}\s){_PLAIN}(?:\s++{_PLAIN})*+"

# Group tests on the condensed text; each rule names at most one of them.
GATES = {
    "digits": r"\p{Nd}",
    "capitals": r"[A-Z\p{Nd}<\-]{7}",
    "lengthy": r"[!-~]{32}",
}

# Word characters as the rules mean them: letters, numbers of any kind and the
# underscore, but no combining marks.
_WORD = r"[\p{L}\p{N}_]"
_EDGE = rf"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
# A part of a rule that stands for one word character. Next to it a word edge is a
# single look-around.
_ONE = r"(?:\\d|\[(?:[A-Za-z0-9]-[A-Za-z0-9]|[A-Za-z0-9])+\]|[A-Za-z0-9])"
_EDGES = {r"\b": _EDGE, r"\W": rf"(?<!{_WORD})", r"\w": rf"(?!{_WORD})"}
_BEFORE = re.compile(rf"\\b(?={_ONE}(?![?*]|\{{0))")
_AFTER = re.compile(rf"({_ONE}(?:\{{[1-9][0-9,]*\}}|\+)?)\\b")


def java_regex(regex: str) -> str:
    """The rule with its Unicode character classes spelled out for Java.

    Ranges that ignore case must also take in the dotted capital I and the Kelvin
    sign, which Java leaves out.
    """
    if regex.startswith("(?i)"):
        regex = regex.replace("A-Z", r"A-Z\u0130\u212A").replace("J-P", r"J-P\u212A")
        regex = regex.replace("(?i)", "(?iu)")
    # \W and \w are in no rule; they stand in for the two one-sided edges here.
    regex = _AFTER.sub(r"\1\\w", _BEFORE.sub(r"\\W", regex))
    out, in_class = [], False
    for piece in re.findall(r"\\.|[^\\]", regex, re.S):
        if piece in "[]":
            in_class = piece == "["
        if piece == r"\s":
            piece = BLANKS if in_class else f"[{BLANKS}]"
        elif piece == r"\d":
            piece = r"\p{Nd}"
        elif piece in _EDGES:
            piece = _EDGES[piece]
        out.append(piece)
    return "".join(out)


def linear_mail_regex(regex: str) -> str:
    """The e-mail rule so that a long run of name characters without @ is read once only,
    not anew from every word edge in it. The hit is group 1.

    A hit begins at the first word edge of a run, or where the last hit ended. Up to that
    edge there are only word characters (after one that is in no name) or only signs.
    """
    name, _, rest = java_regex(regex).removeprefix("(?iu)").partition("+@")
    name = name[name.index("[A-Z") :]
    words, signs = name.replace(".", "").replace("%+-", ""), "[.%+-]"
    start = rf"(?:(?<!{name})|\G)(?:(?<={_WORD}){words}*+|(?<!{_WORD}){signs}*+)"
    return f"(?iu){start}({name}++@{rest})"


def _gaps(text: str, regex: str) -> str:
    """What lies between the hits. Splitting at one character is much faster than at an
    expression; a text that holds that character is split at the expression."""
    marked = f"split(regexp_replace({text}, {regex}, {lit(SPLIT)}), {lit(SPLIT)}, -1)"
    return f"CASE WHEN contains({text}, {lit(SPLIT)}) THEN split({text}, {regex}, -1) ELSE {marked} END"


def _matches(rules: list[Rule], whole: str, condensed: str) -> str:
    """``array<struct>`` of the rules that hit, with matches, what the expression read for
    each (some read on from further left), and the gaps between."""
    cases = []
    for rule in rules:
        text = whole if rule.whole_text else condensed
        mail = rule.name == "email"
        regex = lit(linear_mail_regex(rule.regex) if mail else java_regex(rule.regex))
        test = f"{text} rlike {regex}"
        if rule.literals:
            needed = " OR ".join(f"contains({text}, {lit(x)})" for x in rule.literals)
            test = f"({needed}) AND {test}"
        if rule.gate:
            test = f"{rule.gate} AND {test}"
        cases.append(
            f"CASE WHEN {test} THEN named_struct('rule_ord', {rule.order}, "
            f"'whole', {str(rule.whole_text).lower()}, "
            f"'found', regexp_extract_all({text}, {regex}, {int(mail)}), "
            f"'read', {f'regexp_extract_all({text}, {regex}, 0)' if mail else 'cast(NULL as array<string>)'}, "
            f"'gaps', {_gaps(text, regex)}) END"
        )
    return f"filter(array({', '.join(cases)}), r -> r IS NOT NULL)"


def _located(rule_hit: str, condensed: str, shifts: str) -> str:
    """Spans of one rule. Starts are running sums of gap and match lengths; the
    number of markers before a hit tells which shift brings it back."""
    r = rule_hit
    read = f"coalesce({r}.read, {r}.found)"
    starts = running_sum(
        f"transform({read}, (m, i) -> length({r}.gaps[i]) + length(m) - length({r}.found[i]) "
        f"+ CASE WHEN i = 0 THEN 0 ELSE length({r}.found[i - 1]) END)"
    )
    markers = running_sum(
        f"transform({r}.found, (m, i) -> length({r}.gaps[i]) "
        f"- length(replace({r}.gaps[i], {lit(MARKER)}, '')))"
    )
    shifted = (
        f"CASE WHEN {r}.whole OR NOT {condensed} THEN {starts} "
        f"ELSE zip_with({starts}, {markers}, (s, k) -> s + {shifts}[k]) END"
    )
    names = "array(" + ", ".join(lit(n) for n in RULE_NAMES) + ")"
    span = (
        "named_struct('start', s, 'shorter', -length(m), "
        f"'rule_ord', {r}.rule_ord, 'end', s + length(m), 'match', m, 'score', 1.0D, "
        f"'pattern', element_at({names}, {r}.rule_ord))"
    )
    return f"zip_with({shifted}, {r}.found, (s, m) -> {span})"


def spans_sql(
    text: str, rules: list[Rule], merge: bool, condense: bool = True, keep: str | None = None
) -> str:
    """SQL for the ``array<SPAN_TYPE>`` of a string's hits; null where there are none.

    ``keep`` is a condition on a hit ``s``. It holds before overlaps are resolved, so
    that a hit which goes displaces no other.
    """
    if not rules:
        return f"cast(NULL as array<{SPAN_TYPE}>)"
    if merge:
        # Of two rules with one pattern the later can never win.
        seen: set[str] = set()
        rules = [r for r in rules if not (r.regex in seen or seen.add(r.regex))]
    run = lit(PLAIN_RUN)
    may_condense = f"NOT contains(t, {lit(MARKER)})" if condense else "false"
    short = f"CASE WHEN ok THEN regexp_replace(t, {run}, {lit(MARKER)}) ELSE t END"
    lost = running_sum(f"transform(regexp_extract_all(t, {run}, 0), w -> length(w) - 1)")
    shifts = (
        "CASE WHEN ok AND exists(raw, r -> NOT r.whole) "
        f"THEN concat(array(0), {lost}) ELSE array(0) END"
    )
    spans = f"flatten(transform(raw, r -> {_located('r', 'ok', 'shifts')}))"
    if keep:
        spans = f"filter({spans}, s -> {keep})"
    if merge:
        spans = resolve_overlaps(spans)
    body = f"CASE WHEN size(raw) > 0 THEN {let('shifts', shifts, spans)} END"
    body = let("raw", _matches(rules, "t", "c"), body)
    for gate, regex in GATES.items():
        body = let(gate, f"c rlike {lit(regex)}", body)
    body = let("ok", may_condense, let("c", short, body))
    return let("t", text, f"CASE WHEN t != '' THEN {body} END")


def _rule_hits(
    df: DataFrame,
    key: str,
    columns: list[str] | None,
    rules: list[Rule] | None,
    merge: bool,
    condense: bool,
) -> DataFrame:
    leaves = leaves_sql(df, text_columns(df, key, columns))
    spans = spans_sql("leaf.text", CATALOGUE if rules is None else rules, merge, condense)
    listed = f"transform({leaves}, leaf -> named_struct('path', leaf.path, 'spans', {spans}))"
    hits = df.select(
        F.col(ident(key)).alias("record_id"),
        F.expr(f"explode(filter({listed}, h -> h.spans IS NOT NULL))").alias("hit"),
    )
    return explode_spans(hits.selectExpr("record_id", "hit.path as field_path", "hit.spans as spans"))


def detect_rules(
    df: DataFrame,
    key: str,
    columns: list[str] | None = None,
    rules: list[Rule] | None = None,
    condense: bool = True,
) -> DataFrame:
    """Every hit of every rule, overlaps included. Needs no shuffle."""
    return _rule_hits(df, key, columns, rules, False, condense)


def external_detections(detections: DataFrame) -> DataFrame:
    """Bring detections from elsewhere into the common shape.

    They rank behind all rules; an optional ``arrival`` column orders equal ones.
    """
    arrival = "arrival" if "arrival" in detections.columns else "0"
    return detections.selectExpr(
        "record_id",
        "field_path",
        f"cast({len(CATALOGUE) + 1} + {arrival} as int) as rule_ord",
        "pattern",
        "match",
        "cast(start as int) as start",
        "cast(end as int) as end",
        "cast(score as double) as score",
    )


def _chunk_rows(texts: DataFrame, size: int, overlap: int) -> DataFrame:
    """``record_id, field_path, at, text`` of the chunks of long texts, dealt out to all tasks.
    A chunk reads ``overlap`` characters into the next one."""
    key_type = texts.schema["record_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in enumerate(batch.column("text").to_pylist()):
                starts = range(0, len(text), size)
                # About as many characters as a few chunks or 1 MB leave at a time.
                some = max(1, (1 << 20) // size)
                for first in range(0, len(starts), some):
                    ats = list(starts[first : first + some])
                    origin = pa.array([row] * len(ats))
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("record_id").take(origin),
                            batch.column("field_path").take(origin),
                            pa.array(ats, pa.int32()),
                            pa.array([text[at : at + size + overlap] for at in ats]),
                        ],
                        names=["record_id", "field_path", "at", "text"],
                    )

    spark = texts.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    rows = texts.mapInArrow(cut, f"record_id {key_type}, field_path string, at int, text string")
    return rows.repartition(tasks, "record_id", "field_path", "at")


def _found_by(rows: DataFrame, factory: Callable, until: int | None) -> DataFrame:
    """``record_id, field_path, at, arrival`` and what the detector finds in the texts of
    ``rows``, at most the hits that begin before ``until``; positions are those in the chunk."""
    key_type = rows.schema["record_id"].dataType.simpleString()
    own = new_identity()
    kinds = {
        "pattern": pa.string(),
        "match": pa.string(),
        "start": pa.int32(),
        "end": pa.int32(),
        "score": pa.float64(),
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = once_per_worker(own, factory)
        for batch in batches:
            found = [
                (row, i, e["label"], e["text"], e["start"], e["end"], e["score"])
                for row, entities in enumerate(detector(batch.column("text").to_pylist()))
                for i, e in enumerate(e for e in entities if until is None or e["start"] < until)
            ]
            rows, arrival, *values = zip(*found, strict=True) if found else [()] * 7
            origin = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c).take(origin) for c in ("record_id", "field_path", "at")],
                    pa.array(arrival, pa.int32()),
                    *[pa.array(v, kind) for v, kind in zip(values, kinds.values(), strict=True)],
                ],
                names=["record_id", "field_path", "at", "arrival", *kinds],
            )

    schema = f"record_id {key_type}, field_path string, at int, arrival int, pattern string, match string, start int, end int, score double"
    return rows.select("record_id", "field_path", "at", "text").mapInArrow(run, schema)


def _shifted_hits(found: DataFrame, before: Column) -> DataFrame:
    """The common shape: positions in the whole text, and arrival counted through all chunks."""
    return found.select(
        "record_id",
        "field_path",
        (before + F.col("arrival") + len(CATALOGUE) + 1).cast("int").alias("rule_ord"),
        "pattern",
        "match",
        (F.col("start") + F.col("at")).alias("start"),
        (F.col("end") + F.col("at")).alias("end"),
        "score",
    )


def detect_with(
    df: DataFrame,
    key: str,
    factory: Callable[[], Callable[[list[str]], list[list[dict]]]],
    columns: list[str] | None = None,
    chunk: int | None = None,
    overlap: int = 0,
) -> DataFrame:
    """Detections by a Python model.

    ``factory`` builds the detector once per Python worker. The detector gets a list of
    texts and returns a list of dicts for each, with ``label``, ``text``, ``start``,
    ``end`` and ``score``.

    With ``chunk`` longer texts are cut into chunks of so many characters, each read
    ``overlap`` characters further. Chunks are rows of their own, so one very long text keeps
    all tasks busy; texts of one chunk stay where they are. Positions are shifted back, a hit
    counts for the chunk it begins in, and hits arrive in the order of the chunks: their
    number is that in their chunk plus what all chunks before it hold. ``overlap`` must cover
    the longest entity. What the model finds in chunks is written before it is numbered.
    """
    if chunk is not None and (chunk < 1 or overlap < 0):
        raise ValueError("`chunk` must be positive, and `overlap` not negative.")
    texts = extract_text_fields(df, key, columns).select("record_id", "field_path", "text")
    whole = texts if chunk is None else texts.where(F.length("text") <= chunk)
    whole = whole.select("record_id", "field_path", F.lit(0).alias("at"), "text")
    hits = _shifted_hits(_found_by(whole, factory, None), F.lit(0))
    if chunk is None:
        return hits
    place = ["record_id", "field_path", "at"]
    rows = _chunk_rows(texts.where(F.length("text") > chunk), chunk, overlap)
    found = written(_found_by(rows, factory, chunk), "chunk-hits")
    # One row a chunk.
    counts = found.groupBy(*place).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("record_id", "field_path").orderBy("at"))
    counts = counts.select(*[F.col(c).alias(f"__{c}") for c in place], (upto - F.col("n")).alias("__before"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in place]
    return hits.unionByName(_shifted_hits(found.join(counts, same), F.col("__before")))


def detect_pii(
    df: DataFrame,
    key: str,
    columns: list[str] | None = None,
    rules: list[Rule] | None = None,
    external: DataFrame | None = None,
    protect_certain: bool = False,
    condense: bool = True,
    field_hits: int | None = None,
) -> DataFrame:
    """Disjoint detections of all string fields.

    Without ``external`` overlaps are resolved inside the row. With it, rule hits
    and external ones are brought together by a shuffle of detections alone; ``field_hits``
    lets many tasks share a field with more hits than that (``merge_detections``).
    """
    if external is None:
        return _rule_hits(df, key, columns, rules, True, condense)
    own = detect_rules(df, key, columns, rules, condense)
    return merge_detections(own.unionByName(external_detections(external)), protect_certain, field_hits)


def split_by_confidence(detections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(certain, uncertain)``; anything less sure than 0.5 is in neither."""
    return certain(detections), uncertain(detections)
