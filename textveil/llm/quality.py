"""Quality rules by repetition coverage.

For several lengths n, all n-grams of words of a text get rolling hashes in numpy; those
found twice or more in the text mark the words they cover, and what counts is the share of
the text's characters inside them. Lines are treated alike. All texts of an Arrow batch are
measured together, about 1 MB at a time; the measure of a text needs no other text, so
nothing is shuffled and no group forms, and memory follows the longest text.

Words are ``[^\\x20\\x09-\\x0D]+``, characters are code points. Null and empty texts have no
words and fail the base rule, texts of any length are read whole, equal rows get equal
measures, an empty table stays empty, and other columns are kept unless they are named like
a measure, which then takes their place.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from textveil.llm.hashes import ONE, PLAIN, U, byte_table, covered, mix, row_of, word_bounds
from textveil.llm.shared import flat, numbered, slices

SYMBOLS = byte_table(lambda b: chr(b) in "#*$%&|<>")
#: Window of the base rule, in words.
BASE_GRAM = 8
#: Largest share, in percent, of a text's word characters inside repeated n-grams.
GRAM_LIMITS = {5: 40, 6: 38, 7: 36, 8: 34, 9: 32, 10: 30}
#: Largest share, in percent, of a text's word characters in lines seen before in it.
LINE_LIMIT = 30
#: Largest number of symbols, in percent of a text's word characters.
SYMBOL_LIMIT = 10


def twice(names: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which names occur twice or more in their row, and which of them came before."""
    own = mix(names + mix(rows.astype(U)))
    order = np.argsort(own, kind="stable")
    same = own[order][1:] == own[order][:-1]
    later = np.zeros(len(own), bool)
    later[order[1:][same]] = True
    any_ = later.copy()
    any_[order[:-1][same]] = True
    return any_, later


def repeated_grams(sums: np.ndarray, rows: np.ndarray, n: int, among: np.ndarray) -> np.ndarray:
    """At which of the words ``among`` begins an ``n``-gram that its row has twice or more."""
    inside = among[among + n <= len(rows)]
    inside = inside[rows[inside] == rows[inside + n - 1]]
    return inside[twice(ONE.grams_at(sums, inside, n), rows[inside])[0]]


def measure(data: np.ndarray, at: np.ndarray, grams: Iterable[int]) -> dict[str, np.ndarray]:
    """All measures of each text."""
    n = len(at) - 1
    begin, end = word_bounds(data, at, PLAIN)
    word_at = np.searchsorted(begin, at)
    rows = row_of(word_at, np.arange(len(begin)))
    points = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    chars = points[end] - points[begin]

    def total(values: np.ndarray, where: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(values))[where])

    sums = ONE.sums(ONE.ranges(ONE.sums(data), begin, end))
    out = {
        "n_words": np.diff(word_at),
        "word_chars": total(chars, word_at),
        "n_symbols": total(SYMBOLS[data].astype(np.int64), at) if len(data) else np.zeros(n, np.int64),
    }
    # Lines end before each line feed and at the end of the text.
    feeds = np.flatnonzero(data == 0x0A)
    first = np.sort(np.concatenate([at[:-1], feeds + 1]))
    line_row = np.sort(np.concatenate([np.arange(n), row_of(at, feeds)]))
    stop = np.append(first[1:], len(data) + 1) - 1
    stop[np.append(line_row[1:] != line_row[:-1], True)] += 1
    stop = np.minimum(stop, at[line_row + 1])
    first_word, last_word = np.searchsorted(begin, first), np.searchsorted(begin, stop)
    full = np.flatnonzero(last_word > first_word)
    again = full[twice(ONE.ranges(ONE.sums(data), first[full], stop[full]), line_row[full])[1]]
    out["n_dup_lines"] = np.bincount(line_row[again], minlength=n)
    running = np.append(0, np.cumsum(chars))
    out["dup_line_chars"] = np.bincount(
        line_row[again], running[last_word[again]] - running[first_word[again]], minlength=n
    ).astype(np.int64)
    found = np.arange(len(rows))
    for k in sorted({BASE_GRAM, *grams}):
        # A repeated n-gram begins with repeated shorter ones.
        found = repeated_grams(sums, rows, k, found)
        hit = covered(len(rows), found, found + k)
        if k == BASE_GRAM:
            out["n_repeat_words"] = total(hit.astype(np.int64), word_at)
        if k in grams:
            out[f"dup_chars_{k}"] = total(np.where(hit, chars, 0), word_at)
    return out


def _names(grams: Iterable[int]) -> list[str]:
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars"]
    return base + [f"dup_chars_{k}" for k in sorted(grams)]


def _scan(text_col: str, keep: list[str], grams: tuple[int, ...], schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            found = measure(*flat(batch.column(text_col)), grams)
            columns = [batch.column(c) for c in keep] + [pa.array(found[c].astype(np.int64)) for c in _names(grams)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def covered_too_much(limits: dict[int, int], line_limit: int, symbol_limit: int) -> Column:
    """Whether repeated n-grams, repeated lines or symbols hold more characters than allowed."""
    chars = F.col("word_chars")
    bad = (F.col("dup_line_chars") * 100 > chars * line_limit) | (F.col("n_symbols") * 100 > chars * symbol_limit)
    for n, limit in limits.items():
        bad = bad | (F.col(f"dup_chars_{n}") * 100 > chars * limit)
    return bad


def judge(
    docs: DataFrame,
    text_col: str = "text",
    limits: dict[int, int] | None = None,
    line_limit: int = LINE_LIMIT,
    symbol_limit: int = SYMBOL_LIMIT,
) -> DataFrame:
    """``docs`` with its measures, ``base_failed`` and ``kept``."""
    limits = GRAM_LIMITS if limits is None else limits
    grams = tuple(sorted(limits))
    names = [*_names(grams), "base_failed", "kept"]
    keep = [c for c in docs.columns if c not in names or c == text_col]
    source = docs.select(*[f"`{c}`" for c in keep])
    added = StructType.fromDDL(", ".join(f"{c} long" for c in _names(grams)))
    schema = StructType(list(source.schema.fields) + list(added.fields))
    return (
        source.mapInArrow(_scan(text_col, keep, grams, to_arrow_schema(schema)), schema)
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & ~covered_too_much(limits, line_limit, symbol_limit))
    )


def keep_good(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns."""
    plain, (text,) = numbered(docs, text_col)
    return judge(plain, text, **options).where("kept").select(*plain.columns).toDF(*docs.columns)
