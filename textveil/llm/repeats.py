"""Which blocks of windows repeat: the part of a pass that needs all tasks' blocks.

A block is a run of neighbouring windows of one row. ``key`` names what all of its
windows have in common, in such a way that a window's block has the same key wherever
the window occurs. ``hull`` names everything that the block covers. Blocks with equal
keys form a group:

- a key that occurs once: none of its windows repeats;
- equal hulls occur twice or more: all of their windows repeat;
- else windows may repeat in part: a later pass looks closer. One block stands for all
  with an equal hull, as the others would only say the same again.

Counting aggregates before the shuffle. Counts are written before they are joined back: so
both sides of a join are plain exchanges, one with a row per key, and adaptive execution
splits a hot key's other side. Nothing collects a group. Tables go once the next is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textveil.llm.shared import discard, stored

BLOCK = "id {id}, mark long, lo int, hi int, key long, hull long"


def block_schema(id_type: str) -> str:
    return BLOCK.format(id=id_type)


def decide(blocks: DataFrame, last: bool) -> DataFrame:
    """``id, mark, lo, hi, whole, look`` of blocks whose windows repeat, or may do so.
    ``last``: blocks are single windows, and none needs a closer look."""
    place = ["id", "mark", "lo", "hi"]
    blocks = stored(blocks, "blocks")
    counts = stored(
        blocks.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.min("hull").alias("least"), F.max("hull").alias("most"))
        .where("n > 1")
        .select("key", (F.col("least") == F.col("most")).alias("alike")),
        "counts",
    )
    shared = stored(blocks.join(counts, "key"), "shared")
    discard(blocks, counts)
    odd = shared.where("not alike")
    hulls = stored(
        odd.groupBy("key", "hull").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*place)).alias("chosen")), "hulls"
    )
    odd = odd.join(hulls, ["key", "hull"])
    whole, look = F.col("n") > 1, F.struct(*place) == F.col("chosen")
    if last:
        # Windows with equal keys and different hulls agree by chance only.
        odd, look = odd.where(whole), F.lit(False)
    plain = shared.where("alike").select(*place, F.lit(True).alias("whole"), F.lit(False).alias("look"))
    decided = stored(plain.unionByName(odd.select(*place, whole.alias("whole"), look.alias("look"))), "decided")
    discard(shared, hulls)
    return decided


def ranges_by_row(found: DataFrame) -> DataFrame:
    """All ranges of a row together, at most one per place in its text."""
    return found.groupBy("id", "mark").agg(F.collect_list("lo").alias("los"), F.collect_list("hi").alias("his"))
