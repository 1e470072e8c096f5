"""Benchmark decontamination with suffix arrays over the training text.

The documents of an Arrow batch are a shard. Each task builds the shard's suffix array
over words, ordered through as many words as a window has (every sort triples the depth),
and binary-searches every test suffix in it, one word further at a time: what is left of
the range after the last word are the places of all verbatim occurrences. How far a match
goes on is read off the suffix array of the test items: the longest common prefix with any
test suffix is that with one of its two neighbours there, found by bisection over the array
and, inside it, over the length. So a match of any length takes as many steps as its length
has binary digits. A document lies in one shard, so nothing is shuffled.

The test items travel to the tasks in blocks of a bounded size (``block_bytes`` of text on
average, rows dealt by digest); a benchmark beyond one block is searched block after block
and the finds of a document are united afterwards. An item that a match of a whole window
goes on with holds that window too, so it is in a block that finds it: results are the same
however items are dealt. A whole item shorter than a window counts with its own length.

Words are runs of digits, letters a-z after lower-casing A-Z, and anything beyond ASCII.
An item of fewer words than a window is one window; an item without words has none. Null
texts have no words. Equal items count each by its id, a null id reads ``null``. Equal or
repeated documents each get their own row. Other columns are kept but for those named like
a result, which give way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from textveil.llm.hashes import ONE, U, byte_table, covered, row_of, word_bounds
from textveil.llm.shared import flat, numbered, slices

WINDOW = 13
STRETCH = 1 << 20

LETTERS = byte_table(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of all words, none of them 0, and where each row's words begin."""
    data = LOWER[data] if len(data) else data
    begin, end = word_bounds(data, at, LETTERS)
    return np.maximum(ONE.ranges(ONE.sums(data), begin, end), U(1)), np.searchsorted(begin, at)


@dataclass
class Tests:
    """Test windows of a block: places in ``words`` and lengths of the distinct ones, and
    the items of each."""

    words: np.ndarray
    item_at: np.ndarray
    start: np.ndarray
    size: np.ndarray
    owners: np.ndarray
    owners_at: np.ndarray
    ids: list[str]
    #: The items' words with a 0 behind each item, the order of all suffixes, and how many
    #: words follow each place inside its item.
    spaced: np.ndarray
    order: np.ndarray
    left: np.ndarray


def tests_of(ids: list[str], texts: list[str], window: int) -> Tests:
    data, at = flat(pa.array(texts, pa.string()))
    words, item_at = words_of(data, at)
    sizes = np.diff(item_at)
    count = np.where(sizes >= window, sizes - window + 1, (sizes > 0).astype(np.int64))
    item = np.repeat(np.arange(len(sizes)), count)
    start = item_at[item] + np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
    size = np.minimum(sizes[item], window)
    name = ONE.ranges(ONE.sums(words), start, start + size) if len(start) else start.astype(U)
    _, first, which = np.unique(name, return_index=True, return_inverse=True)
    pairs = np.unique(which * max(1, len(ids)) + item)
    owner_of, owners = np.divmod(pairs, max(1, len(ids)))
    spaced, place = _spaced(words, item_at)
    ends = item_at[1:] + np.arange(len(sizes))
    left = ends[np.searchsorted(ends, np.arange(len(spaced)))] - np.arange(len(spaced)) if len(ends) else place
    order = suffix_array(spaced, int(sizes.max(initial=0)) + 1) if len(words) else place[:0]
    return Tests(
        words,
        item_at,
        start[first],
        size[first],
        owners,
        np.searchsorted(owner_of, np.arange(len(first) + 1)),
        ids,
        spaced,
        order[place[order] >= 0],
        left,
    )


def _spaced(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All words with a blank name, 0, behind each row, and the place of each in ``words``."""
    rows = row_of(at, np.arange(len(words)))
    spaced = np.zeros(len(words) + len(at) - 1, U)
    spaced[np.arange(len(words)) + rows] = words
    place = np.full(len(spaced), -1, np.int64)
    place[np.arange(len(words)) + rows] = np.arange(len(words))
    return spaced, place


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of the next ``depth`` words; beyond the end there are none."""
    n = len(words)
    bits = max(1, (n + 1).bit_length())
    _, rank = np.unique(words, return_inverse=True)
    rank = rank.astype(U) + U(1)
    reach = 1
    while True:
        padded = np.zeros(n + 2 * reach, U)
        padded[:n] = rank
        near, far = min(reach, depth - reach), min(2 * reach, depth - reach)
        near, far = padded[near : near + n], padded[far : far + n]
        if 3 * bits <= 64:
            order = np.argsort((((rank << U(bits)) | near) << U(bits)) | far, kind="stable")
        else:  # one text of millions of words
            order = np.lexsort((far, near, rank))
        reach *= 3
        if reach >= depth:
            return order
        parts = [x[order] for x in (rank, near, far)]
        new = np.any([x[1:] != x[:-1] for x in parts], axis=0)
        rank = np.empty(n, U)
        rank[order] = np.cumsum(np.append(True, new)).astype(U)


def search(words: np.ndarray, order: np.ndarray, tests: Tests) -> tuple[np.ndarray, np.ndarray]:
    """Where in ``order`` the range of each test suffix begins and ends."""
    lo = np.zeros(len(tests.start), np.int64)
    hi = np.full(len(tests.start), len(order))
    padded = np.append(words, np.zeros(WINDOW if not len(tests.size) else int(tests.size.max()), U))
    for k in range(int(tests.size.max(initial=0))):
        open_ = np.flatnonzero((tests.size > k) & (hi > lo))
        if not len(open_):
            break
        word = tests.words[tests.start[open_] + k]
        ends = []
        for after in (False, True):
            a, b = lo[open_].copy(), hi[open_].copy()
            while (wide := a < b).any():
                mid = (a + b) >> 1
                here = padded[order[np.minimum(mid, len(order) - 1)] + k]
                less = (here <= word) if after else (here < word)
                a = np.where(wide & less, mid + 1, a)
                b = np.where(wide & ~less, mid, b)
            ends.append(a)
        lo[open_], hi[open_] = ends
    return lo, hi


def _stretches(n: int, overlap: int) -> Iterator[tuple[int, int]]:
    for first in range(0, max(n, 1), STRETCH):
        yield first, min(first + STRETCH + overlap, n)


def finds(words: np.ndarray, word_at: np.ndarray, tests: Tests) -> tuple[np.ndarray, np.ndarray]:
    """Places of all occurrences of test windows, and the number of the window."""
    # A blank name behind each row keeps matches inside it.
    spaced, place = _spaced(words, word_at)
    depth = int(tests.size.max(initial=1))
    places, which = [], []
    for first, stop in _stretches(len(spaced), depth - 1):
        part = spaced[first:stop]
        if not len(part) or not len(tests.start):
            continue
        order = suffix_array(part, depth)
        lo, hi = search(part, order, tests)
        found = np.repeat(np.arange(len(lo)), hi - lo)
        at = order[np.arange(len(found)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[found]]
        places.append(place[at + first])
        which.append(found)
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.unique(np.stack([np.concatenate(places), np.concatenate(which)]), axis=1)
    return both[0], both[1]


def common_words(words: np.ndarray, places: np.ndarray, room: np.ndarray, tests: Tests) -> np.ndarray:
    """The longest common prefix of the document at each place, ``room`` words at most, with
    any test suffix."""
    own, other = ONE.sums(words), ONE.sums(tests.spaced)
    best = np.zeros(len(places), np.int64)
    lo, hi = np.zeros(len(places), np.int64), np.full(len(places), len(tests.order))
    while (open_ := np.flatnonzero(lo < hi)).size:
        middle = (lo[open_] + hi[open_]) >> 1
        here, there = places[open_], tests.order[middle]
        most = np.minimum(room[open_], tests.left[there])
        # As many words as agree, by bisection.
        short, long = np.zeros(len(open_), np.int64), most.copy()
        while (short < long).any():
            size = (short + long + 1) >> 1
            same = ONE.ranges(own, here, here + size) == ONE.ranges(other, there, there + size)
            short, long = np.where(same, size, short), np.where(same, long, size - 1)
        best[open_] = np.maximum(best[open_], short)
        # Behind the end of either there is a name below all others.
        mine = np.where(short < room[open_], words[np.minimum(here + short, len(words) - 1)], U(0))
        above = mine > tests.spaced[there + short]
        lo[open_] = np.where(above, middle + 1, lo[open_])
        hi[open_] = np.where(above, hi[open_], middle)
    return best


def longest_matches(words: np.ndarray, word_at: np.ndarray, places: np.ndarray, size: np.ndarray, window: int, tests: Tests) -> np.ndarray:
    """For each find, for how many words the document agrees with some item."""
    longest = size.copy()
    whole = np.flatnonzero(size == window)
    starts, which = np.unique(places[whole], return_inverse=True)
    room = word_at[row_of(word_at, starts) + 1] - starts
    longest[whole] = common_words(words, starts, room, tests)[which]
    return longest


RESULTS = (
    "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
    "longest_match long, spans array<struct<first:int,end:int>>, items array<string>"
)


def _digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def _scan(broadcast, window: int, text_col: str, keep: list[str], schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests: Tests = broadcast.value
        for batch in slices(batches, text_col):
            data, at = flat(batch.column(text_col))
            words, word_at = words_of(data, at)
            places, which = finds(words, word_at, tests)
            size = tests.size[which]
            row = row_of(word_at, places)
            longest = longest_matches(words, word_at, places, size, window, tests)
            hit = covered(len(words), places, places + size)
            n_words, total = np.diff(word_at), np.append(0, np.cumsum(hit))
            n_hit = np.diff(total[word_at])
            most = np.zeros(batch.num_rows, np.int64)
            np.maximum.at(most, row, longest)
            spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            items: list[list[str]] = [[] for _ in range(batch.num_rows)]
            for r in np.unique(row):
                mine = hit[word_at[r] : word_at[r + 1]].astype(np.int8)
                edges = np.diff(np.concatenate([[0], mine, [0]]))
                spans[r] = [
                    {"first": int(a), "end": int(b)}
                    for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True)
                ]
                owners = {int(o) for w in np.unique(which[row == r]) for o in tests.owners[tests.owners_at[w] : tests.owners_at[w + 1]]}
                items[r] = sorted({tests.ids[o] for o in owners})
            columns = [batch.column(c) for c in keep] + [
                pa.array(n_words),
                pa.array(n_hit),
                pa.array([len(x) for x in items], pa.int64()),
                pa.array([_digest(x) for x in items], pa.string()),
                pa.array((n_hit > 0) & (20 * n_hit >= n_words)),
                pa.array(most),
                pa.array(spans, schema.field("spans").type),
                pa.array(items, schema.field("items").type),
            ]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int) -> Iterator[Tests]:
    """The test items in blocks: only one is in the driver at a time."""
    rows = benchmark.select(
        F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")).alias("item"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    ).distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-total // block_bytes))
    for k in range(count):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k).orderBy("item", "text").collect()
        yield tests_of([r["item"] for r in part], [r["text"] for r in part], window)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = 4 << 20,
) -> DataFrame:
    """``docs`` with the columns of ``RESULTS``: words, words inside an occurrence of a
    window of ``window`` test words, items found (number, digest and list), whether a
    twentieth of the words or more is hit, the longest match, and the hit ranges of words.
    """
    spark = docs.sparkSession
    names = [f.name for f in StructType.fromDDL(RESULTS)]
    keep = [c for c in docs.columns if c not in names]
    source = docs.select(*[f"`{c}`" for c in keep])
    schema = StructType(list(source.schema.fields) + list(StructType.fromDDL(RESULTS).fields))
    arrow = to_arrow_schema(schema)
    parts = []
    for tests in _blocks(benchmark, item_col, item_text_col, window, block_bytes):
        shared = spark.sparkContext.broadcast(tests)
        parts.append(source.mapInArrow(_scan(shared, window, text_col, keep, arrow), schema))
    if len(parts) == 1:
        return parts[0]
    return _united(source, parts, text_col, names)


def _united(source: DataFrame, parts: list[DataFrame], text_col: str, names: list[str]) -> DataFrame:
    """Join what the blocks found, by the document's text."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    marks = [F.sha2(text, 256).alias("__mark")]
    found = None
    for part in parts:
        part = part.where("n_hit > 0").select(*marks, "longest_match", "spans", "items")
        found = part if found is None else found.unionByName(part)
    found = found.groupBy("__mark").agg(
        F.max("longest_match").alias("longest_match"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("spans")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    # Ranges in order: one that begins inside the last is joined with it.
    merged = F.expr(
        "aggregate(spans, cast(array() as array<struct<first:int,end:int>>), (a, s) -> "
        "if(size(a) > 0 and s.first <= a[size(a) - 1].end, "
        "concat(slice(a, 1, size(a) - 1), array(struct(a[size(a) - 1].first as first, greatest(s.end, a[size(a) - 1].end) as end))), "
        "concat(a, array(s))))"
    )
    found = found.withColumn("spans", merged).withColumn(
        "n_hit", F.expr("aggregate(spans, 0L, (a, s) -> a + s.end - s.first)")
    )
    found = found.select("__mark", "n_hit", "longest_match", "spans", "items")
    counted = parts[0].drop("n_hit", "n_items", "items_sha256", "contaminated", "longest_match", "spans", "items")
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return (
        counted.withColumns({"__mark": marks[0]})
        .join(found, "__mark", "left")
        .select(
            *[f"`{c}`" for c in source.columns],
            "n_words",
            hit.alias("n_hit"),
            F.size(items).cast("long").alias("n_items"),
            F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
            ((hit > 0) & (hit * 20 >= F.col("n_words"))).alias("contaminated"),
            F.coalesce("longest_match", F.lit(0).cast("long")).alias("longest_match"),
            F.coalesce("spans", F.array().cast("array<struct<first:int,end:int>>")).alias("spans"),
            items.alias("items"),
        )
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that no benchmark item contaminates, with their own columns."""
    plain, (text,) = numbered(docs, text_col)
    judged = find_contamination(plain, benchmark, text, **options)
    return judged.where("not contaminated").select(*plain.columns).toDF(*docs.columns)
