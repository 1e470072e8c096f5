"""Suffix-array deduplication by a depth-limited radix sort.

Every suffix is ordered only through its first ``width`` bytes: suffixes that agree that
far are occurrences of one repeated string. The sort goes from the most significant
digit on, and a digit is the name (a hash) of a number of bytes:

1. Among the neighbouring suffixes of any ``width`` bytes, the one whose first 64 bytes
   have the least name stands for all; it depends on those bytes alone, so equal
   strings choose alike. Only those suffixes are ordered by their first digit. A group
   of one is done: nothing that it stands for repeats.
2. What its suffixes stand for is equal in whole (most copies): done, all repeat.
3. The others are ordered anew by a longer digit, and at last by all ``width`` bytes.

So few suffixes are shuffled (about one in 70 bytes), with two numbers each instead of
their text. Python holds one piece of about 1 MB at a time, whatever a text's length.

Results that are defined: null text is empty; a text below ``width`` bytes has no string;
equal rows (ties, copies) count as separate occurrences; rows of one id with different
texts stay apart; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textveil.llm.hashes import ONE, TWO, U, covered, row_of, sliding_min
from textveil.llm.repeats import block_schema, decide, ranges_by_row
from textveil.llm.shared import PIECE, flat, int_lists, keyed, mark_of, numbered, same_row, slices

WIDTH = 200


def digits_for(width: int) -> tuple[int, ...]:
    """Bytes of each digit: about a third, nine tenths, all."""
    return tuple(sorted({max(1, width * 8 // 25), max(1, width * 9 // 10), width}))


def _stretches(at: np.ndarray, width: int) -> Iterator[tuple[int, int, int]]:
    """Where to work in one go: first place, end of the bytes, end of the window
    starts. Rows beyond ``PIECE`` bytes come in overlapping stretches."""
    total = int(at[-1])
    first = 0
    while first < total:
        starts = min(first + PIECE, total)
        yield first, min(starts + width - 1, total), starts
        first = starts


def _blocks_of(data: np.ndarray, at: np.ndarray, digit: int, width: int, wanted: np.ndarray | None):
    """Row, begin, end, key and hull of all blocks of the ``wanted`` window starts."""
    ok = np.zeros(len(data) + 1, np.int64)
    long = np.flatnonzero(np.diff(at) >= width)
    np.add.at(ok, at[long], 1)
    np.add.at(ok, at[long + 1] - width + 1, -1)
    ok = np.cumsum(ok)[:-1] > 0
    if wanted is not None:
        ok &= wanted
    bits = U(PIECE.bit_length())
    low = (U(1) << bits) - U(1)
    for first, end, starts in _stretches(at, width):
        places = np.flatnonzero(ok[first:starts])
        if not len(places):
            continue
        part = data[first:end]
        sums = ONE.sums(part)
        names = ONE.grams(sums, digit)
        if digit < width:
            ranked = (names & ~low) | np.arange(len(names), dtype=U)
            least = (sliding_min(ranked, width - digit + 1) & low).astype(np.int64)[places]
        else:
            least = places
        new = np.ones(len(places), bool)
        new[1:] = (np.diff(places) != 1) | (np.diff(least) != 0)
        new = np.flatnonzero(new)
        lo = places[new]
        hi = places[np.append(new[1:], len(places)) - 1]
        hull = TWO.ranges(TWO.sums(part), lo, hi + width)
        row = row_of(at, lo + first)
        yield row, lo + first - at[row], hi + first - at[row], names[least[new]], hull


def _emit(digit: int, width: int, schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, at = flat(batch.column("text"))
            wanted = None
            if "los" in batch.schema.names:
                los, rows = int_lists(batch.column("los"))
                his, _ = int_lists(batch.column("his"))
                wanted = covered(len(data), los + at[rows], his + at[rows] + 1)
            for row, lo, hi, key, hull in _blocks_of(data, at, digit, width, wanted):
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(take).cast(schema.field("id").type),
                        batch.column("mark").take(take),
                        pa.array(lo.astype(np.int32)),
                        pa.array(hi.astype(np.int32)),
                        pa.array(key.view(np.int64)),
                        pa.array(hull.view(np.int64)),
                    ],
                    names=["id", "mark", "lo", "hi", "key", "hull"],
                )

    return run


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``id, mark, los, his`` for each row with windows that repeat: ranges of byte
    places at which such a window starts."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    rows = keyed(docs, id_col, text_col)
    schema = block_schema(rows.schema["id"].dataType.simpleString())
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    done, look = None, None
    for digit in digits_for(width):
        if look is None:
            source = rows
        else:
            near = ranges_by_row(look)
            source = rows.join(near, same_row(rows, near)).select(rows["id"], rows["mark"], "text", "los", "his")
        found = decide(source.mapInArrow(_emit(digit, width, arrow), schema), last=digit == width)
        whole = found.where("whole")
        done = whole if done is None else done.unionByName(whole)
        look = found.where("look")
    return ranges_by_row(done)


def _kept(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Places of the texts, running numbers of removed bytes and spans, and what is left."""
    data, at = flat(batch.column("text"))
    los, rows = int_lists(batch.column("los"))
    his, _ = int_lists(batch.column("his"))
    gone = covered(len(data), los + at[rows], his + at[rows] + width)
    total = np.append(0, np.cumsum(gone))
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    heads = at[:-1][np.diff(at) > 0]
    begins[heads] = gone[heads]
    spans = np.append(0, np.cumsum(begins))
    kept, kept_at = data[~gone].tobytes(), at - total[at]
    return at, total, spans, [kept[kept_at[i] : kept_at[i + 1]] for i in range(batch.num_rows)]


def _digests(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at, total, spans, texts = _kept(batch, width)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(np.diff(at)),
                    pa.array(np.diff(total[at])),
                    pa.array(np.diff(spans[at])),
                    pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()),
                ],
                names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """What is left without every byte that a repeated string of ``width`` bytes covers.

    Returns the id column with ``n_bytes, n_removed, n_spans, kept_sha256``, one row per row
    of ``docs``.
    """
    rows = keyed(docs, id_col, text_col)
    found = repeated_windows(docs, id_col, text_col, width)
    both = rows.join(found, same_row(rows, found), "left").select(rows["id"], "text", "los", "his")
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return both.mapInArrow(_digests(width), schema).withColumnRenamed("id", id_col)


def _texts(width: int, names: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            *_, texts = _kept(batch, width)
            kept = pa.array([x.decode("utf-8", "ignore") for x in texts], pa.string())
            columns = [kept if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``docs`` without the repeated bytes of their texts. What a cut leaves of a character
    goes too; a text that repeats from end to end is empty."""
    found = repeated_windows(docs, id_col, text_col, width).withColumnsRenamed({"id": "__id", "mark": "__mark"})
    plain, (id_, own) = numbered(docs, id_col, text_col)
    text = F.coalesce(F.col(own).cast("string"), F.lit(""))
    plain = plain.withColumn("text", text).drop(own)
    both = plain.join(found, F.col(id_).eqNullSafe(F.col("__id")) & (mark_of(F.col("text")) == F.col("__mark")), "left")
    schema = plain.schema
    cut = both.select(*plain.columns, "los", "his").mapInArrow(_texts(width, plain.columns), schema)
    order = ["text" if f"c{i}" == own else f"c{i}" for i in range(len(docs.columns))]
    return cut.select(*order).toDF(*docs.columns)
