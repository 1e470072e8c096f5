"""Substring deduplication by recompression.

A row's words become names, then runs of equal words get a name of their own, and then
round after round names the pairs of neighbours of which the first is on the left and the
second on the right side of that round's split of all names. A name is a digest of what
it stands for, so every task gives equal substrings equal names without asking; the Spark
rounds afterwards count the names over all rows, which reveals what is shared.

For every symbol the parse also keeps from where to where the words decided it. A symbol
decided inside a window occurs at the same place in every other occurrence of that
window, whatever surrounds it: these are the window's interior symbols. The highest one
(least name, then first) stands for the window; a single word always decides itself at
least together with its neighbours, and a window without any such symbol, a run of one
word, stands for itself. Windows next to each other with the same symbol form a block,
blocks with equal symbols are compared in ``repeats.decide``, and where they agree only in
part, a last round compares the windows themselves by two independent digests.

Results that are defined: null text has no words; a row with fewer words than a window has
no window; equal rows count as separate occurrences; rows of one id with different texts
stay apart; other columns are not read; an empty table gives an empty result. One row's
words are held at a time, so memory follows the longest text, never a group of texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textveil.llm.hashes import ONE, PLAIN, TWO, U, covered, mix, row_of, word_bounds
from textveil.llm.repeats import block_schema, decide, ranges_by_row
from textveil.llm.shared import flat, int_lists, keyed, same_row, slices

WINDOW = 35
ROUNDS = 6
#: Words parsed in one go; longer texts come in overlapping stretches.
STRETCH = 1 << 19


class Symbols:
    """One level of the parse: names, word ranges, and the words that decided them."""

    def __init__(self, name, first, end, left, right, row):
        self.name, self.first, self.end, self.left, self.right, self.row = name, first, end, left, right, row

    def pick(self, keep: np.ndarray) -> Symbols:
        return Symbols(*(getattr(self, x)[keep] for x in ("name", "first", "end", "left", "right", "row")))


def name_runs(words: np.ndarray, row: np.ndarray) -> Symbols:
    """Each maximal run of one word as a symbol. Its two neighbours decide it too."""
    new = np.ones(len(words), bool)
    new[1:] = (words[1:] != words[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    end = np.append(first[1:], len(words))
    size = (end - first).astype(U)
    name = np.where(size > U(1), mix(words[first] + size * U(0x9E3779B97F4A7C15)), words[first])
    return Symbols(name, first, end, first - 1, end + 1, row[first])


def name_pairs(s: Symbols, salt: int) -> Symbols:
    """Replace each left-right pair of neighbours by its name."""
    n = len(s.name)
    on_left = (mix(s.name + U(salt)) >> U(63)).astype(bool)
    joined = np.zeros(n, bool)  # with the next one
    joined[:-1] = on_left[:-1] & ~on_left[1:] & (s.row[:-1] == s.row[1:])
    taken = np.zeros(n, bool)
    taken[1:] = joined[:-1]
    nxt = np.minimum(np.arange(n) + 1, n - 1)
    before = np.maximum(np.arange(n) - 1, 0)
    # A symbol that stays alone does so because of one neighbour.
    left = np.where(on_left, s.left, s.left[before])
    right = np.where(on_left, s.right[nxt], s.right)
    if n:
        left[0] = s.left[0] if on_left[0] else min(int(s.left[0]), int(s.first[0]) - 1)
        right[-1] = max(int(s.right[-1]), int(s.end[-1]) + 1) if on_left[-1] else s.right[-1]
    left[joined] = s.left[joined]
    right[joined] = s.right[nxt][joined]
    name = s.name.copy()
    name[joined] = mix(mix(s.name[joined] + U(salt)) * U(0x9E3779B97F4A7C15) + s.name[nxt][joined])
    end = s.end.copy()
    end[joined] = s.end[nxt][joined]
    return Symbols(name, s.first, end, left, right, s.row).pick(~taken)


def interior(levels: list[Symbols], starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window start its symbol: level (-1: none), number in the level, and the
    levels' usable symbols."""
    level = np.full(len(starts), -1, np.int64)
    number = np.zeros(len(starts), np.int64)
    usable = []
    open_ = np.arange(len(starts))
    for i in range(len(levels) - 1, -1, -1):
        s = levels[i].pick(levels[i].right - levels[i].left <= window)
        usable.append(s)
        n = len(s.name)
        if not n or not len(open_):
            continue
        p = starts[open_]
        begin = np.searchsorted(s.left, p, "left")
        stop = np.searchsorted(s.right, p + window, "right")
        has = stop > begin
        who, begin, stop = open_[has], begin[has], stop[has]
        bits = U(max(1, n.bit_length()))
        low = (U(1) << bits) - U(1)
        ranked = (mix(s.name) & ~low) | np.arange(n, dtype=U)
        # Least of every 1, 2, 4, … symbols: two of them cover any range.
        count = stop - begin
        best = np.empty(len(who), U)
        power, table = 1, ranked
        while True:
            now = (count >= power) & (count < 2 * power)
            if now.any():
                best[now] = np.minimum(table[begin[now]], table[stop[now] - power])
            if not (count >= 2 * power).any():
                break
            table = np.minimum(table[:-power], table[power:])
            power *= 2
        level[who] = i
        number[who] = (best & low).astype(np.int64)
        open_ = open_[~has]
    return level, number, usable[::-1]


def _stretches(at: np.ndarray, window: int) -> Iterator[tuple[int, int, int]]:
    total, first = int(at[-1]), 0
    while first < total:
        starts = min(first + STRETCH, total)
        yield first, min(starts + window - 1, total), starts
        first = starts


def _words(data: np.ndarray, at: np.ndarray):
    """Begin, end and two independent names of each word, and where each row's words begin."""
    begin, end = word_bounds(data, at, PLAIN)
    names = [f.ranges(f.sums(data), begin, end) for f in (ONE, TWO)]
    return begin, end, names, np.searchsorted(begin, at)


def _starts(word_at: np.ndarray, window: int) -> np.ndarray:
    """Which words begin a window."""
    ok = np.zeros(int(word_at[-1]) + 1, np.int64)
    long = np.flatnonzero(np.diff(word_at) >= window)
    np.add.at(ok, word_at[long], 1)
    np.add.at(ok, word_at[long + 1] - window + 1, -1)
    return np.cumsum(ok)[:-1] > 0


def _symbol_blocks(names: list[np.ndarray], word_at: np.ndarray, window: int):
    """Blocks of windows around their highest interior symbols."""
    words, seconds = names
    ok = _starts(word_at, window)
    rows = row_of(word_at, np.arange(len(words)))
    for first, stop, starts in _stretches(word_at, window):
        places = np.flatnonzero(ok[first:starts])
        if not len(places):
            continue
        part = words[first:stop]
        levels = [name_runs(part, rows[first:stop])]
        for salt in range(1, ROUNDS):
            levels.append(name_pairs(levels[-1], salt))
        level, number, usable = interior(levels, places, window)
        new = np.ones(len(places), bool)
        new[1:] = (np.diff(places) != 1) | (np.diff(level) != 0) | (np.diff(number) != 0) | (level[1:] < 0)
        new = np.flatnonzero(new)
        lo, hi = places[new], places[np.append(new[1:], len(places)) - 1]
        one, two = ONE.sums(part), TWO.sums(seconds[first:stop])
        level, number = level[new], number[new]
        left, right, shape = lo.copy(), lo + window, np.zeros(len(lo), np.int64)
        for i, s in enumerate(usable):
            of = level == i
            k = number[of]
            left[of], right[of] = s.left[k], s.right[k]
            shape[of] = ((i + 1) << 16) + (s.first[k] - s.left[k] << 8) + (s.right[k] - s.end[k])
        key = mix(ONE.ranges(one, left, right) + shape.astype(U))
        hull = TWO.ranges(two, lo, hi + window)
        row = rows[first + lo]
        yield row, lo + first - word_at[row], hi + first - word_at[row], key, hull


def _window_blocks(names: list[np.ndarray], word_at: np.ndarray, window: int, wanted: np.ndarray):
    """Every wanted window as a block of its own."""
    words, seconds = names
    lo = np.flatnonzero(_starts(word_at, window) & wanted)
    if len(lo):
        row = row_of(word_at, lo)
        key = ONE.ranges(ONE.sums(words), lo, lo + window)
        hull = TWO.ranges(TWO.sums(seconds), lo, lo + window)
        yield row, lo - word_at[row], lo - word_at[row], key, hull


def _emit(window: int, schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, at = flat(batch.column("text"))
            _, _, names, word_at = _words(data, at)
            if "los" in batch.schema.names:
                los, rows = int_lists(batch.column("los"))
                his, _ = int_lists(batch.column("his"))
                wanted = covered(len(names[0]), los + word_at[rows], his + word_at[rows] + 1)
                blocks = _window_blocks(names, word_at, window, wanted)
            else:
                blocks = _symbol_blocks(names, word_at, window)
            for row, lo, hi, key, hull in blocks:
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


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``id, mark, los, his`` for each row with windows that repeat: ranges of the words
    at which such a window starts."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    rows = keyed(docs, id_col, text_col)
    schema = block_schema(rows.schema["id"].dataType.simpleString())
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    first = decide(rows.mapInArrow(_emit(window, arrow), schema), last=False)
    near = ranges_by_row(first.where("look"))
    closer = rows.join(near, same_row(rows, near)).select(rows["id"], rows["mark"], "text", "los", "his")
    second = decide(closer.mapInArrow(_emit(window, arrow), schema), last=True)
    return ranges_by_row(first.where("whole").unionByName(second))


def _removal(window: int, with_text: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, at = flat(batch.column("text"))
            begin, end = word_bounds(data, at, PLAIN)
            word_at = np.searchsorted(begin, at)
            los, rows = int_lists(batch.column("los"))
            his, _ = int_lists(batch.column("his"))
            gone = covered(len(begin), los + word_at[rows], his + word_at[rows] + window)
            total = np.append(0, np.cumsum(gone))
            # Each kept word, and the blank behind it unless it is the row's last one.
            kept = np.flatnonzero(~gone)
            row = row_of(word_at, kept)
            last = np.ones(len(kept), bool)
            last[:-1] = row[1:] != row[:-1]
            blank = np.where(PLAIN[data], data, 0x20).astype(np.uint8) if len(data) else data
            stay = covered(len(data), begin[kept], end[kept] + ~last)
            chars = np.append(0, np.cumsum(stay))[at]
            out = blank[stay].tobytes()
            texts = [out[chars[i] : chars[i + 1]] for i in range(batch.num_rows)]
            columns = [
                batch.column("id"),
                pa.array(np.diff(word_at)),
                pa.array(np.diff(total[word_at])),
                pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()),
            ]
            names = ["id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns.append(pa.array([x.decode("utf-8") for x in texts], pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = False
) -> DataFrame:
    """Remove every word that a repeated window of ``window`` words covers.

    Returns the id column with ``n_words, n_removed, kept_sha256``, and with ``kept_text``
    (kept words joined by one blank) if asked for, one row per row of ``docs``.
    """
    rows = keyed(docs, id_col, text_col)
    found = repeated_windows(docs, id_col, text_col, window)
    both = rows.join(found, same_row(rows, found), "left").select(rows["id"], "text", "los", "his")
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return both.mapInArrow(_removal(window, with_text), schema).withColumnRenamed("id", id_col)
