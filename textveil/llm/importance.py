"""Rows drawn so that they resemble a target: importance resampling over hashed n-grams.

Features of a text are its runs of one to three words, words being ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``
after A-Z are lower-cased; a feature's bucket is the CRC of its bytes. Buckets are counted over
all rows and over all target rows, a bucket's gain is the logarithm of the ratio, and a text
weighs the sum of its features' gains. Rows with the highest weights plus Gumbel noise are
drawn, which draws without replacement in proportion to the exponents of the weights.

Texts are read by an Aho-Corasick automaton. Its dictionary holds the distinct words of some
texts, about 256 KB of them, each between two delimiters, and each word carries the place of its
CRC and its length. Scanning the texts gives the words' payloads in order; as the CRC of joined
strings follows from their CRCs and the second one's length, payloads of neighbours compose to
those of two and three words without a look at the characters again.

Texts are read once and never moved: the buckets of their features are written, two bytes each
(four beyond 65,536 buckets), counted from there, and read again for the weights; then the files
go. A task sends one count for each bucket; the driver holds counts and gains of all buckets,
whose number is a parameter. Only numbers of the rows that may be drawn are ordered, by ranges,
never in one task.

Null and empty texts have no features and weigh 0; texts of any length are read whole. Equal
scores: the smaller id first, a null id before others and read as an empty one by the noise; equal
rows are drawn one by one. An empty table gives an empty result, an empty target counts nothing.
``score_rows`` keeps all other columns; a column named like a measure is replaced.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from textveil.llm.shared import discard, flat, slices, stored
from textveil.operators.order import with_position

BUCKETS = 10000
LONGEST = 3
#: Rows with fewer words are never drawn.
LEAST_WORDS = 20
BLANK = zlib.crc32(b" ")
#: Bytes of text for one automaton: a larger one leaves the processor's cache, smaller ones hold
#: the common words more often.
SCANNED = 1 << 18
#: Joined strings below this length have a table of their own.
SHORT = 64

#: Capitals become small letters, and all that is in no word becomes a blank.
_PLAIN = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)
_TABLE = np.frombuffer(_PLAIN, np.uint8)


@cache
def _jumps(power: int) -> np.ndarray:
    """What ``2 ** power`` zero bytes do to a CRC: 4 x 256, for each byte of the CRC."""
    if power:
        half = _jumps(power - 1)
        columns = [_jump(np.array([half[i // 8, 1 << i % 8]], np.uint32), half)[0] for i in range(32)]
    else:
        # A CRC is linear: a bit's part is what changes where only that bit does.
        zero = zlib.crc32(b"\0", 0)
        columns = [np.uint32(zlib.crc32(b"\0", 1 << i) ^ zero) for i in range(32)]
    table = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for bit in range(8):
            step = 1 << bit
            table[byte, step : 2 * step] = table[byte, :step] ^ columns[8 * byte + bit]
    return table


def _jump(crc: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


@cache
def _moves() -> np.ndarray:
    """What 0, 1, … zero bytes do to a CRC, up to ``SHORT``: a table like that of a jump for each."""
    steps = [np.arange(256, dtype=np.uint32) << np.array([[0], [8], [16], [24]], np.uint32)]
    for _ in range(1, SHORT):
        steps.append(_jump(steps[-1], _jumps(0)))
    return np.concatenate(steps).ravel()


def composed(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs of joined strings, from those of both and the length of the second."""
    table, at = _moves(), np.where(length < SHORT, length, 0) * 1024
    out = table[at + (first & 255)]
    for byte in (1, 2, 3):
        out ^= table[at + (256 * byte + (first >> 8 * byte & 255))]
    rest = np.flatnonzero(length >= SHORT)
    for power in range(int(length[rest].max(initial=0)).bit_length()):
        where = rest[(length[rest] >> power & 1).astype(bool)]
        out[where] = _jump(out[where], _jumps(power))
    return out ^ second


def automaton(words: Iterable[bytes]) -> ahocorasick.Automaton:
    """Words between delimiters; the payload is a word's number."""
    found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for number, word in enumerate(words):
        found.add_word(f" {word.decode('latin-1')} ", number)
    found.make_automaton()
    return found


@dataclass(frozen=True)
class Words:
    """CRC, CRC with a blank before it, length and row of each word of some texts, in order."""

    crc: np.ndarray
    after: np.ndarray
    length: np.ndarray
    row: np.ndarray


def payloads(data: np.ndarray, at: np.ndarray) -> Words:
    rows = len(at) - 1
    wide = np.full(len(data) + rows + 1, 0x20, np.uint8)
    wide[np.arange(len(data)) + np.repeat(np.arange(1, rows + 1), np.diff(at))] = _TABLE[data]
    text = wide.tobytes()
    words = list(set(text.split()))
    if not words:
        return Words(np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64))
    crc = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    length = np.fromiter(map(len, words), np.int64, len(words))
    after = composed(np.full(len(words), BLANK, np.uint32), crc, length)
    hits = np.fromiter(chain.from_iterable(automaton(words).iter(text.decode("latin-1"))), np.int64).reshape(-1, 2)
    # A hit ends at the delimiter behind its word.
    row = np.searchsorted(at[:-1] + np.arange(rows), hits[:, 0] - 1, "right") - 1
    word = hits[:, 1]
    return Words(crc[word], after[word], length[word], row)


def features(words: Words, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """CRCs of the runs of 1, 2, … words from each word on, as far as there are words, and which
    of them lie in one row."""
    runs, row = words.crc, words.row
    for n in range(longest):
        if n:
            size = max(0, len(row) - n)
            runs = composed(runs[:size], words.after[n : n + size], words.length[n : n + size] + 1)
        yield runs, row[: len(runs)] == row[n : n + len(runs)]


def _number(buckets: int) -> np.dtype:
    """How a bucket is written."""
    return np.dtype("<u2" if buckets <= 1 << 16 else "<u4")


def _hash(keep: list[str], longest: int, buckets: int, schema: pa.Schema):
    number = _number(buckets)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", limit=SCANNED):
            words, n = payloads(*flat(batch.column("text"))), batch.num_rows
            found = np.zeros((len(words.row), longest), number)
            within = np.zeros(found.shape, bool)
            for k, (names, same) in enumerate(features(words, longest)):
                found[: len(names), k], within[: len(names), k] = names % buckets, same
            size = np.bincount(words.row, minlength=n)
            # A row's features follow one another, by words.
            ends = np.cumsum(np.maximum(size[:, None] - np.arange(longest), 0).sum(1)) * number.itemsize
            offsets = pa.array(np.concatenate([[0], ends]), pa.int64())
            own = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), n, [None, offsets.buffers()[1], pa.py_buffer(found[within].tobytes())]
            )
            columns = [batch.column(c) for c in keep] + [pa.array(size), own]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def hashed(docs: DataFrame, text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """``docs`` without its text, the columns named ``c0, c1, …``, with ``n_words`` and the buckets
    of all features, ``found``."""
    keep = [c for c in docs.columns if c != text_col]
    named = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]
    source = docs.select(*named, F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = StructType(source.schema.fields[:-1] + StructType.fromDDL("n_words long, found binary").fields)
    kept = [f"c{i}" for i in range(len(keep))]
    return source.mapInArrow(_hash(kept, longest, buckets, to_arrow_schema(schema)), schema)


def _counts(buckets: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches, "found"):
            total += np.bincount(flat(batch.column("found"))[0].view(_number(buckets)), minlength=buckets)
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total[place])], ["bucket", "n"])

    return run


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all ``hashed`` rows fall into each bucket."""
    counted = rows.select("found").mapInArrow(_counts(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in counted.collect():  # a row a bucket
        out[bucket] = n
    return out


@dataclass(frozen=True)
class Model:
    """Gain of each bucket, in thousandths."""

    gains: np.ndarray
    longest: int


def compare(s: np.ndarray, t: np.ndarray, longest: int = LONGEST) -> Model:
    """Gains, from the counts of all rows and of all target rows."""
    all_s, all_t = float(s.sum() + len(s)), float(t.sum() + len(t))
    gains = [
        math.floor(1000 * math.log((float(b) + 1) * all_s / ((float(a) + 1) * all_t)))
        for a, b in zip(s.tolist(), t.tolist(), strict=True)
    ]
    return Model(np.array(gains, np.int64), longest)


def _counted(rows: DataFrame, text_col: str, longest: int, buckets: int) -> np.ndarray:
    return bucket_counts(hashed(rows.select(F.col(f"`{text_col}`").alias("text")), "text", longest, buckets), buckets)


def fit(
    raw: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text",
    longest: int = LONGEST, buckets: int = BUCKETS,
) -> Model:
    """Compare all rows with all target rows."""
    return compare(_counted(raw, text_col, longest, buckets), _counted(target, target_col, longest, buckets), longest)


MEASURES = ["n_words", "n_features", "weight", "score"]


def noise(name: str) -> int:
    """Gumbel noise in thousandths, from a name alone."""
    h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _weigh(model: Model, seed: int, keep: list[str], schema: pa.Schema):
    number = _number(len(model.gains))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "found"):
            found, at = flat(batch.column("found"))
            at = at // number.itemsize
            sums = np.concatenate([[0], np.cumsum(model.gains[found.view(number)])])
            weight = sums[at[1:]] - sums[at[:-1]]
            drawn = [noise(f"{seed}:{name or ''}") for name in batch.column("__name").to_pylist()]
            measures = [batch.column("n_words"), *map(pa.array, (np.diff(at), weight, weight + np.array(drawn, np.int64)))]
            columns = [batch.column(c) for c in keep] + measures
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def weighed(rows: DataFrame, model: Model, id_col: str, seed: int = 42) -> DataFrame:
    """``hashed`` rows with ``n_words, n_features, weight, score`` instead of their buckets;
    ``id_col`` is what the noise is drawn from."""
    keep = [c for c in rows.columns if c not in ("n_words", "found")]
    schema = StructType([rows.schema[c] for c in keep] + StructType.fromDDL(", ".join(f"{m} long" for m in MEASURES)).fields)
    named = rows.withColumn("__name", F.col(id_col).cast("string"))
    return named.mapInArrow(_weigh(model, seed, keep, to_arrow_schema(schema)), schema)


def score_rows(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", seed: int = 42) -> DataFrame:
    """``docs`` without its text, with ``n_words, n_features, weight, score``."""
    keep = [c for c in docs.columns if c != text_col and (c not in MEASURES or c == id_col)]
    rows = hashed(docs.select(*[F.col(f"`{c}`") for c in [*keep, text_col]]), text_col, model.longest, len(model.gains))
    return weighed(rows, model, f"c{keep.index(id_col)}", seed).toDF(*keep, *MEASURES)


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    percent: int = 5,
    least_words: int = LEAST_WORDS,
    seed: int = 42,
    longest: int = LONGEST,
    buckets: int = BUCKETS,
) -> DataFrame:
    """``id, n_words, n_features, weight, score, rank`` of each row; ``rank`` counts the drawn
    ones from 1 in the order of their scores, and is null for the others."""
    if not 0 <= percent <= 100:
        raise ValueError("A share is drawn from 0 to 100 percent.")
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = stored(hashed(own, "text", longest, buckets), "buckets")
    model = compare(bucket_counts(rows, buckets), _counted(target, target_col, longest, buckets), longest)
    scored = stored(weighed(rows, model, "c0", seed).toDF("id", *MEASURES), "scores")
    discard(rows)
    eligible = scored.where(F.col("n_words") >= least_words)
    size = eligible.count() * percent // 100
    if not size:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    # No more than 0.5 percent off by its guarantee, so at least the share is at or above it.
    floor = eligible.approxQuantile("score", [max(0.0, 1 - percent / 100 - 0.006)], 0.005)[0]
    may: Column = (F.col("n_words") >= least_words) & (F.col("score") >= floor)
    ordered = with_position(scored.where(may).withColumn("__down", -F.col("score")), "__down", "id", name="__place")
    rank = F.when(F.col("__place") < size, F.col("__place") + 1).cast("long").alias("rank")
    rest = scored.where(~may).withColumn("rank", F.lit(None).cast("long"))
    return ordered.select(*scored.columns, rank).unionByName(rest)


def drawn_rows(docs: DataFrame, sampled: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that ``resample`` has drawn, by ids; ids must be unique."""
    ids = sampled.where("rank is not null").select(F.col("id").alias("__drawn"))
    return docs.join(ids, F.col(f"`{id_col}`").eqNullSafe(F.col("__drawn")), "left_semi")
