"""Product codes of vectors: codebooks by k-means, with norm-of-sum bounds.

Components become integers, vectors are cut into equal parts, and each part position has a
codebook of its own. A round assigns every part to the nearest entry and replaces each entry
by the mean of its parts. From the second round on most entries needn't be looked at: for
each group of entries a vector keeps a lower bound of its distance to all of them but its
own, and the *stamp* of the round in which the bound was measured. All codebooks of the past
rounds are retained, so the bound is lowered by how far an entry lies from where it was at
that stamp, the norm of the sum of its moves; that is never more, and usually less, than the
sum of the norms of its moves. A group whose lowered bound is still above the exact distance
to the own entry is skipped; all others are scanned exactly, and their bounds stamped anew.

Distances are integers and compared exactly, so bounds only save work. Vectors never move
between tasks: a round is one pass over a stored table, and what leaves the tasks is one sum
for each component of each entry. The driver holds the codebooks, whose size the parameters
set.

Rows whose vector is null or holds null, infinite or undefined components are dropped, and so
are rows whose vector is longer or shorter than that of the smallest kept id. Codebooks start
from the smallest ids, nulls last, equal ids by their vectors; fewer rows than entries give as
many entries as rows. Equally near entries: the lower index. Repeated rows count as often as
they occur, an empty table gives an empty result. Only the columns named are read. Components
beyond 2^24 after scaling are an error, as sums of their squares leave 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from textveil.llm.shared import discard, stored

#: Bounds that a vector keeps for each of its parts.
GROUPS = 4
LARGEST = 1 << 24
#: Rows that a task works on at a time.
ROWS = 4096


@dataclass
class State:
    """What is known of each part of some vectors: its entry, and bounds for the others."""

    near: np.ndarray  # rows x parts
    error: np.ndarray  # rows x parts, squared distance to ``near``
    bound: np.ndarray  # rows x parts x groups
    stamp: np.ndarray  # rows x parts x groups


def grouped(entries: int) -> list[tuple[int, int]]:
    """Ranges of entries that share a bound."""
    cuts = [entries * g // GROUPS for g in range(GROUPS + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances between all rows and entries, as exact integers."""
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * max(1, x.shape[1]) * largest**2 < 1 << 53:  # whole numbers that floats hold exactly
        x, entries = x.astype(np.float64), entries.astype(np.float64)
    out = (x * x).sum(1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(1)
    return out.astype(np.int64)


def below(squares: np.ndarray) -> np.ndarray:
    """A number just under the root; nothing to compare with: infinity."""
    return np.nextafter((np.sqrt(squares.astype(np.float64)) * (1 - 1e-12)).astype(np.float32), np.float32(-1))


def net_moves(history: np.ndarray) -> np.ndarray:
    """rounds x parts x groups: how far the farthest entry of a group has got since a round."""
    gaps = (history[-1] - history).astype(np.float64)
    norms = np.sqrt((gaps * gaps).sum(-1))
    return np.stack([norms[:, :, a:b].max(-1, initial=0) for a, b in grouped(norms.shape[2])], -1) * (1 + 1e-12)


def first_scan(x: np.ndarray, books: np.ndarray) -> State:
    rows, parts, _ = x.shape
    entries = books.shape[1]
    out = State(
        np.zeros((rows, parts), np.int64),
        np.zeros((rows, parts), np.int64),
        np.full((rows, parts, GROUPS), np.inf, np.float32),
        np.zeros((rows, parts, GROUPS), np.int64),
    )
    each = np.arange(rows)
    for p in range(parts):
        d = squared(x[:, p], books[p])
        out.near[:, p] = d.argmin(1)
        out.error[:, p] = d[each, out.near[:, p]]
        others = d.astype(np.float64)
        others[each, out.near[:, p]] = np.inf
        for g, (a, b) in enumerate(grouped(entries)):
            if b > a:
                out.bound[:, p, g] = below(others[:, a:b].min(1))
    return out


def next_scan(x: np.ndarray, history: np.ndarray, old: State) -> State:
    """Entries after a round, looking only at groups whose bounds do not rule them out."""
    rows, parts, _ = x.shape
    now = len(history) - 1
    books, moves = history[-1], net_moves(history)
    spans = grouped(books.shape[1])
    home = np.searchsorted([b for _, b in spans], np.arange(books.shape[1]), "right")
    out = State(old.near.copy(), old.error.copy(), old.bound.copy(), old.stamp.copy())
    for p in range(parts):
        own = old.near[:, p]
        gap = x[:, p] - books[p][own]
        best = own_error = (gap * gap).sum(1)
        best_at = own.copy()
        low = old.bound[:, p] - moves[old.stamp[:, p], p, np.arange(GROUPS)]
        reach = np.sqrt(own_error.astype(np.float64)) * (1 + 1e-12)
        scanned = []
        for g, (a, b) in enumerate(spans):
            open_ = np.flatnonzero(~(reach < low[:, g])) if b > a else np.zeros(0, np.int64)
            d = squared(x[open_, p], books[p][a:b])
            scanned.append((open_, d))
            if len(open_):
                at = d.argmin(1)
                least, at = d[np.arange(len(open_)), at], at + a
                nearer = (least < best[open_]) | ((least == best[open_]) & (at < best_at[open_]))
                best = best.copy()
                best[open_[nearer]], best_at[open_[nearer]] = least[nearer], at[nearer]
        # The entry that was left is now one of the others of its group.
        left = np.flatnonzero(best_at != own)
        g = home[own[left]]
        out.bound[left, p, g] = np.minimum(
            np.nextafter(low[left, g].astype(np.float32), np.float32(-np.inf)), below(own_error[left])
        )
        out.stamp[left, p, g] = now
        for g, ((a, b), (open_, d)) in enumerate(zip(spans, scanned, strict=True)):
            if len(open_):
                others = d.astype(np.float64)
                mine = np.flatnonzero((best_at[open_] >= a) & (best_at[open_] < b))
                others[mine, best_at[open_[mine]] - a] = np.inf
                out.bound[open_, p, g] = below(others.min(1))
                out.stamp[open_, p, g] = now
        out.near[:, p], out.error[:, p] = best_at, best
    return out


def _raw(column: pa.Array, kind: type, *shape: int) -> np.ndarray:
    """Binary values of equal length as one array, a row for each."""
    n = len(column)
    size = int(np.prod(shape, dtype=np.int64))
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, kind).reshape(n, *shape) if n and size else np.zeros((n, *shape), kind)


def _bytes(values: np.ndarray, kind: type) -> pa.Array:
    values = np.ascontiguousarray(values.astype(kind))
    return pa.array([row.tobytes() for row in values], pa.binary())


def _vectors(batch: pa.RecordBatch, dims: int, scale: int) -> np.ndarray:
    """Components as whole numbers, all floors going down."""
    values = np.asarray(batch.column("vector").flatten()).astype(np.float64)
    x = np.floor(values * scale)
    if len(x) and np.abs(x).max() > LARGEST:
        raise ValueError(f"A component is beyond {LARGEST} after scaling; sums of squares would leave 64 bits.")
    return x.astype(np.int64).reshape(-1, dims)


_STATE = "x binary, near binary, error long, bound binary, stamp binary"


def _assign(history: np.ndarray, scale: int, schema: pa.Schema):
    """One pass: the first over vectors, later ones over what the pass before stored."""
    rounds, parts, _, width = history.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                batch = whole.slice(first, ROWS)
                if rounds == 1:
                    x = _vectors(batch, parts * width, scale).reshape(-1, parts, width)
                    found = first_scan(x, history[0])
                else:
                    x = _raw(batch.column("x"), np.int32, parts, width).astype(np.int64)
                    near = _raw(batch.column("near"), np.uint16, parts).astype(np.int64)
                    bound = _raw(batch.column("bound"), np.float32, parts, GROUPS)
                    stamp = _raw(batch.column("stamp"), np.uint8, parts, GROUPS).astype(np.int64)
                    found = next_scan(x, history, State(near, near * 0, bound, stamp))
                new = [
                    _bytes(x, np.int32),
                    _bytes(found.near, np.uint16),
                    pa.array(found.error.sum(1)),
                    _bytes(found.bound, np.float32),
                    _bytes(found.stamp, np.uint8),
                ]
                kept = [batch.column("id"), batch.column("label")]
                columns = [c.cast(f.type) for c, f in zip(kept + new, schema, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _sums(parts: int, entries: int, width: int):
    """For each entry how many parts it has, and the sum of each component; one row a task
    for each, whatever the rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width + 1), np.int64)
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                batch = whole.slice(first, ROWS)
                x = _raw(batch.column("x"), np.int32, parts, width)
                near = _raw(batch.column("near"), np.uint16, parts).astype(np.int64)
                for p in range(parts):
                    total[p, :, width] += np.bincount(near[:, p], minlength=entries)
                    for j in range(width):
                        # Sums of ROWS such numbers are exact as floats.
                        total[p, :, j] += np.bincount(near[:, p], x[:, p, j], entries).astype(np.int64)
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total.ravel()[place])], ["place", "total"])

    return run


def _means(state: DataFrame, books: np.ndarray) -> np.ndarray:
    parts, entries, width = books.shape
    sums = state.select("x", "near").mapInArrow(_sums(parts, entries, width), "place long, total long")
    total = np.zeros((parts, entries, width + 1), np.int64)
    # parts x entries x (width + 1) rows at most.
    for place, value in sums.groupBy("place").agg(F.sum("total")).collect():
        total.ravel()[place] = value
    count = total[:, :, width:]
    return np.where(count > 0, total[:, :, :width] // np.maximum(count, 1), books)


def usable(vector: Column) -> Column:
    """Whether a vector is there, without null, infinite or undefined components."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~odd


def _start(kept: DataFrame, entries: int, parts: int, scale: int) -> np.ndarray | None:
    """First codebooks, parts x entries x width, or None without rows."""
    order = [F.col("id").asc_nulls_last(), F.col("vector")]
    vectors = [row[0] for row in kept.orderBy(*order).limit(entries).select("vector").collect()]
    if not vectors:
        return None
    dims = len(vectors[0])
    if dims % parts:
        raise ValueError(f"Vectors of {dims} components can't be cut into {parts} equal parts.")
    first = np.floor(np.array(vectors, np.float64).reshape(len(vectors), dims) * scale)
    return first.astype(np.int64).reshape(len(vectors), parts, dims // parts).transpose(1, 0, 2)


def compress(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
    scale: int = 256,
) -> tuple[DataFrame, np.ndarray]:
    """``id, label, codes array<int>, error`` of each kept row, and the codebooks, an array
    parts x entries x width. ``reconstructed`` undoes the codes."""
    if not (parts > 0 and 0 < entries < 1 << 16 and 0 <= rounds < 256):
        raise ValueError("Parts and entries must be positive, entries below 65536 and rounds below 256.")
    kept = vectors.select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{label_col}`").alias("label"),
        F.col(f"`{vector_col}`").cast("array<double>").alias("vector"),
    ).where(usable(F.col("vector")))
    head = kept.orderBy(F.col("id").asc_nulls_last(), "vector").limit(1).select(F.size("vector")).collect()
    if head:
        kept = kept.where(F.size("vector") == head[0][0])
    books = _start(kept, entries, parts, scale)
    source = StructType(kept.schema.fields[:2])
    schema = StructType(source.fields + StructType.fromDDL(_STATE).fields)
    if books is None:
        empty = kept.select("id", "label", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error"))
        return empty, np.zeros((parts, 0, 0), np.int64)
    history = books[None]
    state = kept
    for round_ in range(rounds + 1):
        run = _assign(history, scale, to_arrow_schema(schema))
        found = state.mapInArrow(run, schema)
        if round_ == rounds:
            unhexed = F.transform(
                F.sequence(F.lit(0), F.lit(parts - 1)),
                # Two bytes, the lower one first.
                lambda p: F.conv(
                    F.concat(F.hex(F.substring("near", 2 * p + 2, F.lit(1))), F.hex(F.substring("near", 2 * p + 1, F.lit(1)))),
                    16,
                    10,
                ).cast("int"),
            )
            coded = stored(found.select("id", "label", unhexed.alias("codes"), "error"), "codes")
        else:
            new = stored(found, "parts")
            history = np.concatenate([history, _means(new, history[-1])[None]])
        if round_:
            discard(state)
        state = coded if round_ == rounds else new
    return coded, history[-1]


def reconstructed(coded: DataFrame, codebooks: np.ndarray, scale: int = 256) -> DataFrame:
    """``coded`` with ``vector``: for each part the middle of its entry's cell. The codebooks
    are literals of the plan; their size does not depend on the data."""
    books = F.array(*[
        F.array(*[F.array(*[F.lit((int(v) + 0.5) / scale) for v in entry]) for entry in part]) for part in codebooks
    ])
    pieces = F.transform("codes", lambda code, p: F.element_at(F.element_at(books, p + 1), code + 1))
    return coded.withColumn("vector", F.flatten(pieces))


def listed(codebooks: np.ndarray) -> str:
    """All components by part, entry and place, as text."""
    return ",".join(map(str, codebooks.ravel().tolist()))


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the error summed over rows of its label. Null is a
    label of its own. Sums are written before they are joined, so that adaptive execution
    can split the rows of a frequent label."""
    sums = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    sums = sums.withColumnRenamed("label", "sum_label")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("sum_label")), "left").drop("sum_label")
