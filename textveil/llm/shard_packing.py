"""Shards of near equal size by best-fit-decreasing bin packing.

Rows with equal texts are a group that no shard border divides. Groups sorted by size, the
largest first, go each into the shard with the least room that still holds it, found in a
balanced tree of the rooms. With a fixed capacity a further shard opens where none has room.
For a given number of shards the capacity is the least found, by bisection, with which
packing needs no more shards; a group as large as a fair share of what is left has a shard
of its own.

What is packed are *items*: each group that holds at least one part in ``512 * shards`` of all
bytes, and bundles of all smaller groups, dealt out by their digests into ``512 * shards``
bundles. So the driver packs 1,024 items a shard at most, whatever the rows, and both tables
that tell the shard of an item are as small: they are broadcast. Texts are read once and never
moved; what is stored between passes are sizes and digests. Slots are counted inside each
task's rows, and the counts of the tasks before are added.

Null texts are empty and one group with empty ones; very long texts are like others. Groups of
equal size come in the order of their digests, equally tight shards in the order of their
numbers; repeated rows share a shard and have slots of their own. An empty table gives an empty
result. Only the columns named are read, except by ``with_shard``, which keeps all others and
replaces a column ``shard``.
"""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from textveil.llm.shared import discard, numbered, stored

#: Bundles of small groups, and large groups at most, for each shard.
ITEMS_PER_SHARD = 512


class Rooms:
    """Shards by their free room, in a balanced tree: a treap of ``(room, shard)``."""

    def __init__(self) -> None:
        self._root = None
        self._draw = random.Random(5)

    def put(self, room: int, shard: int) -> None:
        low, high = self._split(self._root, (room, shard))
        self._root = self._merge(self._merge(low, [(room, shard), self._draw.random(), None, None]), high)

    def take(self, size: int) -> tuple[int, int] | None:
        """Take out the shard with the least room of at least ``size``."""
        low, high = self._split(self._root, (size, -1))
        if high is None:
            self._root = low
            return None
        parent, node = None, high
        while node[2] is not None:
            parent, node = node, node[2]
        if parent is None:
            high = node[3]
        else:
            parent[2] = node[3]
        self._root = self._merge(low, high)
        return node[0]

    def _split(self, node, key):
        """Nodes below ``key``, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], high = self._split(node[3], key)
            return node, high
        low, node[2] = self._split(node[2], key)
        return low, node

    def _merge(self, low, high):
        if low is None or high is None:
            return high if low is None else low
        if low[1] < high[1]:
            low[3] = self._merge(low[3], high)
            return low
        high[2] = self._merge(low, high[2])
        return high


def best_fit(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """The shard of each item; sizes fall. None where more than ``most`` shards are needed.
    An item beyond the capacity has a shard of its own."""
    rooms, shards, out = Rooms(), 0, []
    for size in sizes:
        found = rooms.take(size)
        if found is None:
            if shards == most:
                return None
            found, shards = (max(capacity, size), shards), shards + 1
        out.append(found[1])
        rooms.put(found[0] - size, found[1])
    return out


def even(sizes: list[int], shards: int) -> list[int]:
    """The shard of each item, for a given number of shards; sizes fall."""
    out, left = [], sum(sizes)
    # A fair share or more: a shard of its own.
    while len(out) < min(shards - 1, len(sizes)) and sizes[len(out)] * (shards - len(out)) >= left:
        left -= sizes[len(out)]
        out.append(len(out))
    alone, rest = len(out), sizes[len(out) :]
    if not rest:
        return out
    bins = shards - alone
    low = max(-(-left // bins), rest[0])
    high = -(-left // bins) + rest[0]  # always enough: else all bins would hold more than the mean
    best = best_fit(rest, high, bins)
    while low < high:
        middle = (low + high) // 2
        found = best_fit(rest, middle, bins)
        if found is None:
            low = middle + 1
        else:
            best, high = found, middle
    return out + [alone + shard for shard in best]


def text_size(text: Column) -> Column:
    """What a row counts for: the bytes of its text, and one."""
    return F.octet_length(text).cast("long") + 1


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _bundle(digest: Column, bundles: int) -> Column:
    return F.pmod(F.conv(F.hex(F.substring(digest, 1, 6)), 16, 10).cast("long"), F.lit(bundles))


class Packing:
    """Which shard each group goes to: two small tables."""

    def __init__(self, large: DataFrame, small: DataFrame, bundles: int, shards: int):
        self.large, self.small, self.bundles, self.shards = large, small, bundles, shards

    def apply(self, rows: DataFrame, digest: str) -> DataFrame:
        """``rows`` with ``shard``; both tables hold ``bundles`` rows at most."""
        rows = rows.withColumn("__bundle", _bundle(F.col(digest), self.bundles))
        rows = rows.join(F.broadcast(self.large), rows[digest] == self.large["__digest"], "left")
        rows = rows.join(F.broadcast(self.small), "__bundle", "left")
        shard = F.coalesce("__own", "__with").alias("shard")
        return rows.select(*[c for c in rows.columns if not c.startswith("__")], shard)


def pack(groups: DataFrame, shards: int | None = None, capacity: int | None = None) -> Packing:
    """Pack groups, ``digest binary, size long``, into a number of shards or into as few as
    possible of a fixed capacity."""
    if (shards is None) == (capacity is None) or (shards or capacity) < 1:
        raise ValueError("Name either a number of shards or a capacity, at least 1.")
    spark = groups.sparkSession
    total = groups.agg(F.coalesce(F.sum("size"), F.lit(0))).collect()[0][0]
    bundles = ITEMS_PER_SHARD * (shards or max(1, -(-total // capacity)))
    sized = groups.withColumns({
        "is_large": F.col("size") * bundles >= total,
        "bundle": _bundle(F.col("digest"), bundles),
    })
    own = sized.where("is_large").select("digest", "size").collect()
    rest = sized.where("not is_large").groupBy("bundle").agg(F.sum("size").alias("size")).collect()
    items = [(size, 0, digest) for digest, size in own] + [(size, 1, bundle) for bundle, size in rest]
    items.sort(key=lambda item: (-item[0], item[1], item[2]))
    sizes = [item[0] for item in items]
    found = even(sizes, shards) if shards else best_fit(sizes, capacity)
    large = [(item[2], shard) for item, shard in zip(items, found, strict=True) if item[1] == 0]
    small = [(item[2], shard) for item, shard in zip(items, found, strict=True) if item[1] == 1]
    return Packing(
        spark.createDataFrame(large, "__digest binary, __own int"),
        spark.createDataFrame(small, "__bundle long, __with int"),
        bundles,
        shards or max(found, default=-1) + 1,
    )


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(
        F.col(f"`{id_col}`").alias("id"),
        text_size(text).alias("size"),
        F.crc32(text.cast("binary")).alias("crc32"),
        _digest(text).alias("digest"),
    )


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.sum("size").alias("size"))


def _placed(schema: pa.Schema):
    """The rows with the number of their task, and of rows of their shard before them in it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        chunk = TaskContext.get().partitionId()
        for batch in batches:
            shard = np.asarray(batch.column("shard"))
            place = np.zeros(len(shard), np.int64)
            for s in np.unique(shard).tolist():
                mine = np.flatnonzero(shard == s)
                place[mine] = seen.get(s, 0) + np.arange(len(mine))
                seen[s] = seen.get(s, 0) + len(mine)
            columns = [*batch.columns, pa.array(np.full(len(shard), chunk, np.int32)), pa.array(place)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def with_slots(rows: DataFrame) -> DataFrame:
    """``rows`` with ``slot``, which counts the rows of each ``shard`` from 0 without gaps.
    Rows are written once with their places, so a task that runs again changes nothing."""
    schema = StructType(list(rows.schema.fields) + StructType.fromDDL("chunk int, place long").fields)
    placed = stored(rows.mapInArrow(_placed(to_arrow_schema(schema)), schema), "placed")
    # One row a shard and task.
    counts = placed.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("shard").orderBy("chunk"))
    before = stored(counts.select("shard", "chunk", (upto - F.col("n")).alias("before")), "before")
    joined = placed.join(before, ["shard", "chunk"])
    return joined.select(*rows.columns, (F.col("before") + F.col("place")).alias("slot"))


def assign(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int | None = 8,
    capacity: int | None = None,
) -> DataFrame:
    """``id, size, crc32, shard, slot`` of each row."""
    rows = stored(_rows(docs, id_col, text_col), "sizes")
    packing = pack(_groups(rows), None if capacity else shards, capacity)
    return with_slots(packing.apply(rows, "digest").drop("digest"))


def with_shard(docs: DataFrame, text_col: str = "text", shards: int | None = 8, capacity: int | None = None) -> DataFrame:
    """``docs`` with ``shard``; rows stay where they are."""
    rows = stored(_rows(docs, docs.columns[0], text_col).select("digest", "size"), "sizes")
    packing = pack(_groups(rows), None if capacity else shards, capacity)
    discard(rows)
    plain, (text,) = numbered(docs, text_col)
    own = plain.withColumn("own_digest", _digest(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    found = packing.apply(own, "own_digest").drop("own_digest")
    old = [c for c, name in zip(plain.columns, docs.columns, strict=True) if name != "shard"]
    return found.select(*[F.col(c).alias(name) for c, name in zip(plain.columns, docs.columns, strict=True) if c in old], "shard")


def write_shards(docs: DataFrame, path: str, text_col: str = "text", shards: int | None = 8, capacity: int | None = None) -> None:
    """One folder of Parquet files for each shard."""
    with_shard(docs, text_col, shards, capacity).write.partitionBy("shard").parquet(path)
