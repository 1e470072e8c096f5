"""Files whose records span lines, read by many tasks.

Spark splits a file into ranges at a separator, but only a reader from the file's start knows
what a separator means: a brace may stand inside a string, a line break inside quotes. So each
range is read for every state it may begin in, which gives a function from its first state to
its last one. Functions of neighbouring ranges compose, and a fold over the ranges of a file, one
small row each, tells each range the state that it really begins in. A second pass then cuts
records. Those that lie in one range are whole; the two ends of a range join with those of its
neighbours. The records are written as text, a line each, which any reader then splits.

A piece is what lies between two separators. ``Grammar`` has one method that follows a state
through a piece, and one that says after which pieces a record ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textveil.sources.scratch import may_broadcast, scratch_path, written

#: What stands for a line break inside a record, and for itself.
MARK = "\ue000"


class Grammar(Protocol):
    """States are numbers; a state of a file's start is 0, whatever else a range may begin in
    is in ``starts``. A range also sums up a ``level``."""

    separator: str
    starts: tuple[int, ...]
    #: SQL around ``{array}``, whether a file begins with a bracket, that raises an error for a
    #: file which ``after`` its last range is not complete.
    checked: str

    def step(self, state: int, piece: str) -> tuple[int, int]:
        """The state behind a piece, and by how much the level has changed."""

    def ends(self, state: int, level: int, array: bool) -> bool:
        """Whether a record ends behind a piece with this state and level."""


class JsonText:
    """Braces; state 1 is inside a string. No piece begins behind a backslash, as it begins
    behind a brace. The level counts open brackets of both kinds."""

    separator = "}"
    starts = (0, 1)
    # The bracket at the end, and the brace that is counted behind the last piece.
    checked = (
        "CASE WHEN {array} AND NOT (element_at(after, -1).state = 0 AND element_at(after, -1).level = -1) "
        "THEN raise_error(concat(file_path, ' holds no whole JSON array')) ELSE {array} END"
    )

    def step(self, state: int, piece: str) -> tuple[int, int]:
        text = piece
        if "\\" in text:
            # Two backslashes are one sign, and so is a quote behind one.
            text = text.replace("\\\\", "").replace('\\"', "")
        parts = text.split('"')
        level = 0
        for part in parts[state::2]:
            level += part.count("{") + part.count("[") - part.count("]")
        inside = (state + len(parts) - 1) % 2
        # The brace behind the piece.
        return inside, level - (not inside)

    def ends(self, state: int, level: int, array: bool) -> bool:
        return state == 0 and level == int(array)


class CsvText:
    """Line breaks; state 1 is inside a quoted field. A quote opens a field only at its start,
    and two quotes inside are one sign."""

    separator = "\n"
    starts = (0, 1)
    checked = "{array}"

    def __init__(self, delimiter: str = ","):
        self.delimiter = delimiter

    def step(self, state: int, piece: str) -> tuple[int, int]:
        if '"' not in piece:
            return state, 0
        at, inside = 0, bool(state)
        while True:
            if not inside and piece[at : at + 1] == '"':
                at, inside = at + 1, True
            if inside:
                while (quote := piece.find('"', at)) >= 0 and piece[quote + 1 : quote + 2] == '"':
                    at = quote + 2
                if quote < 0:
                    return 1, 0
                at, inside = quote + 1, False
            after = piece.find(self.delimiter, at)
            if after < 0:
                return 0, 0
            at = after + 1

    def ends(self, state: int, level: int, array: bool) -> bool:
        return state == 0


def _pieces(spark: SparkSession, path: str | list[str], grammar: Grammar) -> DataFrame:
    rows = spark.read.option("lineSep", grammar.separator).text(path)
    return rows.select("_metadata.file_path", "_metadata.file_block_start", "value")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[str]]]:
    """Pieces of a range that lie in one batch, with the range's other columns."""
    for batch in batches:
        others = [batch.column(c).to_pylist() for c in batch.schema.names if c != "value"]
        values = batch.column("value").to_pylist()
        first = 0
        origins = list(zip(*others, strict=True))
        for row in range(1, len(values) + 1):
            if row == len(values) or origins[row] != origins[first]:
                yield origins[first], values[first:row]
                first = row


_RANGES = "file_path string, file_block_start long, head string, last array<int>, levels array<long>"


def _measured(grammar: Grammar):
    """For each range and first state the last state and the change of the level; and the first
    sign of the range that is no blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict = {}
        for origin, pieces in _runs(batches):
            if open_ and open_["origin"] != origin:
                yield row(open_)
                open_ = {}
            if not open_:
                n = len(grammar.starts)
                open_ = {"origin": origin, "head": "", "last": list(grammar.starts), "levels": [0] * n}
            for piece in pieces:
                if not open_["head"]:
                    open_["head"] = (piece + grammar.separator).lstrip("\ufeff \t\r\n")[:1]
                for k, state in enumerate(open_["last"]):
                    open_["last"][k], change = grammar.step(state, piece)
                    open_["levels"][k] += change
        if open_:
            yield row(open_)

    def row(found: dict) -> pa.RecordBatch:
        (path, block), names = found["origin"], _RANGES.replace(" string", "").split(", ")
        return pa.RecordBatch.from_arrays(
            [
                pa.array([path]),
                pa.array([block], pa.int64()),
                pa.array([found["head"]]),
                pa.array([found["last"]], pa.list_(pa.int32())),
                pa.array([found["levels"]], pa.list_(pa.int64())),
            ],
            names=[n.split(" ")[0] for n in names],
        )

    return run


def _begins(ranges: DataFrame, grammar: Grammar) -> DataFrame:
    """``path, block`` and the ``state``, ``level`` and kind of file that each range begins in.
    A group is the ranges of a file, a few numbers each."""
    one = F.struct("file_block_start", "head", "last", "levels")
    files = ranges.groupBy("file_path").agg(F.array_sort(F.collect_list(one)).alias("r"))
    none = "cast(array() as array<struct<state:int,level:bigint>>)"
    step = (
        "concat(a, array(CASE WHEN size(a) = 0 THEN named_struct('state', x.last[0], 'level', x.levels[0]) "
        "ELSE named_struct('state', x.last[element_at(a, -1).state], "
        "'level', element_at(a, -1).level + x.levels[element_at(a, -1).state]) END))"
    )
    folded = files.select("file_path", "r", F.expr(f"aggregate(r, {none}, (a, x) -> {step})").alias("after"))
    # The first sign of the file, in whichever range it is.
    array = "coalesce(filter(r, x -> x.head != '')[0].head, '') = '['"
    folded = folded.select("file_path", "r", "after", F.expr(grammar.checked.format(array=array)).alias("is_array"))
    begun = F.expr(
        "transform(r, (x, i) -> named_struct('block', x.file_block_start, "
        "'state', CASE WHEN i = 0 THEN 0 ELSE after[i - 1].state END, "
        "'level', CASE WHEN i = 0 THEN 0L ELSE after[i - 1].level END))"
    )
    rows = folded.select("file_path", "is_array", F.explode(begun).alias("b"))
    return rows.select(
        F.col("file_path").alias("path"), "is_array", F.col("b.block").alias("block"), F.col("b.state"), F.col("b.level")
    )


_CUT = "file_path string, file_block_start long, number long, kind int, text string"
#: Kinds of cut text: what stands before the first end in a range, a record, what is left.
HEAD, RECORD, TAIL = 0, 1, 2


def _cut(grammar: Grammar):
    """Records of each range, and its two ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, size = None, [], 0
        for origin, pieces in _runs(batches):
            path, block, array, state, level = origin
            if now is None or now["origin"] != (path, block):
                if now is not None:
                    out.append((*now["origin"], now["number"], TAIL if now["number"] else HEAD, "".join(now["text"])))
                now = {"origin": (path, block), "state": state, "level": level, "number": 0, "text": []}
            for piece in pieces:
                now["state"], change = grammar.step(now["state"], piece)
                now["level"] += change
                now["text"] += [piece, grammar.separator]
                size += len(piece)
                if grammar.ends(now["state"], now["level"], array):
                    kind = RECORD if now["number"] else HEAD
                    out.append((path, block, now["number"], kind, "".join(now["text"])))
                    now["text"], now["number"] = [], now["number"] + 1
                if size > 1 << 20:
                    yield rows(out)
                    out, size = [], 0
        if now is not None:
            out.append((*now["origin"], now["number"], TAIL if now["number"] else HEAD, "".join(now["text"])))
        yield rows(out)

    def rows(found: list[tuple]) -> pa.RecordBatch:
        path, block, number, kind, text = zip(*found, strict=True) if found else [()] * 5
        return pa.RecordBatch.from_arrays(
            [
                pa.array(path, pa.string()),
                pa.array(block, pa.int64()),
                pa.array(number, pa.int64()),
                pa.array(kind, pa.int32()),
                pa.array(text, pa.string()),
            ],
            names=["file_path", "file_block_start", "number", "kind", "text"],
        )

    return run


def records(spark: SparkSession, path: str | list[str], grammar: Grammar) -> DataFrame:
    """``file_path, file_block_start, number, text`` of all records, each with its separators;
    number and block tell their order in the file."""
    pieces = _pieces(spark, path, grammar)
    ranges = written(pieces.mapInArrow(_measured(grammar), _RANGES), "ranges")
    begins = written(_begins(ranges, grammar), "begins")
    if may_broadcast(begins):
        begins = F.broadcast(begins)
    same = (F.col("file_path") == F.col("path")) & (F.col("file_block_start") == F.col("block"))
    # The order of pieces is that of the rows of a task, which a broadcast join keeps; beyond
    # that a place tells it.
    placed = pieces.withColumn("place", F.monotonically_increasing_id()).join(begins, same)
    placed = placed.sortWithinPartitions("file_path", "file_block_start", "place")
    placed = placed.select("file_path", "file_block_start", "is_array", "state", "level", "value")
    cut = written(placed.mapInArrow(_cut(grammar), _CUT), "cut")
    whole = cut.where(F.col("kind") == RECORD).drop("kind")
    # A record over several ranges: the tail of the first one, and heads up to the next end.
    order = Window.partitionBy("file_path").orderBy("file_block_start", "kind")
    ends = cut.where(F.col("kind") != RECORD).withColumn("joined", F.sum((F.col("kind") == TAIL).cast("int")).over(order))
    parts = F.array_sort(F.collect_list(F.struct("file_block_start", "kind", "number", "text")))
    joined = ends.groupBy("file_path", "joined").agg(parts.alias("parts"))
    joined = joined.select(
        "file_path",
        F.col("parts")[0]["file_block_start"].alias("file_block_start"),
        F.col("parts")[0]["number"].alias("number"),
        F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"),
    )
    return whole.unionByName(joined)


def json_lines(spark: SparkSession, path: str | list[str]) -> str:
    """Write the records of JSON files, arrays or not, as lines; where they lie."""
    found = records(spark, path, JsonText()).select("text")
    # What is before a record: the array's bracket and commas. Line breaks inside are blanks.
    text = F.regexp_replace("text", r"^[\ufeff\s,]*\[?[\s,]*", "")
    lines = found.select(F.translate(text, "\r\n", "  ").alias("text")).where(~F.col("text").rlike(r"^[\s\]}]*$"))
    target = scratch_path(spark, "json-lines")
    lines.write.text(target)
    return target


def csv_lines(spark: SparkSession, path: str | list[str], delimiter: str = ",") -> tuple[str, str]:
    """Write the records of CSV files as lines, with line breaks marked (``restored``); where
    they lie, and where the first file's header."""
    found = records(spark, path, CsvText(delimiter))
    text = F.regexp_replace(F.regexp_replace("text", r"\r?\n$", ""), "^\ufeff", "")
    marked = F.replace(F.replace(text, F.lit(MARK), F.lit(MARK + "e")), F.lit("\r\n"), F.lit("\n"))
    marked = F.replace(F.replace(marked, F.lit("\r"), F.lit("\n")), F.lit("\n"), F.lit(MARK + "n"))
    rows = found.select("file_path", "file_block_start", "number", marked.alias("text")).where("trim(text) != ''")
    place = F.struct("file_block_start", "number")
    heads = written(rows.groupBy("file_path").agg(F.min(place).alias("first")), "csv-heads")
    own = rows.withColumn("place", place).join(
        heads.withColumnRenamed("file_path", "head_path"), F.col("file_path") == F.col("head_path")
    )
    body, head = scratch_path(spark, "csv-lines"), scratch_path(spark, "csv-head")
    own.where("place != first").select("text").write.text(body)
    first = own.where("place = first").orderBy("file_path").limit(1)
    first.select("text").coalesce(1).write.text(head)
    return body, head


def restored(df: DataFrame) -> DataFrame:
    """Line breaks for their marks, in all strings."""

    def text(column: str):
        return F.replace(F.replace(F.col(column), F.lit(MARK + "n"), F.lit("\n")), F.lit(MARK + "e"), F.lit(MARK))

    names = [f"c{i}" for i in range(len(df.columns))]
    plain = df.toDF(*names)
    out = [text(n).alias(n) if kind == "string" else F.col(n) for n, kind in plain.dtypes]
    return plain.select(*out).toDF(*df.columns)
