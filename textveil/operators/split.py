"""Train and validation parts, and a shuffled order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textveil.functions.sqltext import ident, lit
from textveil.operators.order import with_position

_SPACE = 1 << 32


def _draw(key: str, seed: int | str) -> str:
    """A number in ``[0, 2**32)`` that depends on the key and the seed only."""
    digest = f"md5(concat(cast({ident(key)} as string), {lit(f'|{seed}')}))"
    return f"cast(conv(substring({digest}, 1, 8), 16, 10) as bigint)"


def train_val_split(
    df: DataFrame, ratio: float, key: str, seed: int = 42, exact: bool = False
) -> DataFrame:
    """Add a ``split`` column with ``train`` or ``validation``.

    By default each record decides for itself: no shuffle, and the answer never
    changes. ``exact`` makes the validation part ``ceil(ratio * n)`` records, the
    ones with the smallest draws: counts per range of draws tell in which range the
    limit falls, only that range is ranked, and every record is then compared with
    the one limiting draw.
    """
    if not 0 < ratio < 1:
        raise ValueError(f"A share of {ratio} can't be split off: it must lie between 0 and 1.")
    drawn = df.withColumn("__draw", F.expr(_draw(key, seed)))
    if not exact:
        limit = int(ratio * _SPACE)
        return drawn.withColumn(
            "split", F.expr(f"CASE WHEN __draw < {limit}L THEN 'validation' ELSE 'train' END")
        ).drop("__draw")
    # 65,536 ranges of draws, whatever the data.
    ranged = drawn.select(
        F.shiftright("__draw", 16).alias("__range"), "__draw", F.col(ident(key)).alias("__key")
    )
    counts = (
        ranged.groupBy("__range")
        .agg(F.count(F.lit(1)).alias("__rows"))
        .withColumn("__upto", F.sum("__rows").over(Window.orderBy("__range")))
        .withColumn("__wanted", F.ceil(F.sum("__rows").over(Window.partitionBy()) * F.lit(ratio)))
        .withColumn("__left", F.col("__wanted") - F.col("__upto") + F.col("__rows"))
        .filter("__left BETWEEN 1 AND __rows")
        .select("__range", "__left")
    )
    ranks = Window.partitionBy("__range").orderBy("__draw", "__key")
    last = (
        ranged.join(F.broadcast(counts), "__range")
        .withColumn("__rank", F.row_number().over(ranks))
        .filter("__rank = __left")
        .select(F.struct("__draw", "__key").alias("last"))
        .scalar()
    )
    mine = F.struct(F.col("__draw"), F.col(ident(key)).alias("__key"))
    return drawn.withColumn(
        "split", F.when(mine <= last, F.lit("validation")).otherwise(F.lit("train"))
    ).drop("__draw")


def shuffled(df: DataFrame, key: str, seed: int = 42, name: str = "position") -> DataFrame:
    """Add the place of each record in a shuffled order, 0, 1, 2, … without gaps.

    The order is that of draws from the key and the seed, then of the key, so it is the same
    however often and wherever it is worked out; the draws are others than those that split.
    Places come from counts per range of draws: only keys are moved to find them, and no task
    ever sorts all.
    """
    drawn = df.withColumn("__shuffle", F.expr(_draw(key, f"{seed}|order")))
    return with_position(drawn, "__shuffle", key, name=name).drop("__shuffle")
