"""Positions in a total order, without ever sorting in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textveil.functions.sqltext import ident
from textveil.sources.scratch import written


def _first_positions(keys: DataFrame, order: list[str]) -> DataFrame:
    """The columns ``order`` of each distinct key and ``__first``, how many rows come
    before it. Only keys and their counts are moved and written, never the rows.

    Keys are dealt out in ranges, counted inside each range, and one number per range says
    what all ranges before it hold.
    """
    counted = keys.groupBy(*order).agg(F.count(F.lit(1)).alias("__rows"))
    ranged = written(
        counted.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "positions"
    )
    # One row per range, a number that the session's settings bound.
    parts = ranged.groupBy("__part").agg(F.sum("__rows").alias("__all"))
    parts = parts.select(
        "__part", (F.sum("__all").over(Window.orderBy("__part")) - F.col("__all")).alias("__before")
    )
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    first = F.sum("__rows").over(inside) - F.col("__rows") + F.col("__before")
    return ranged.join(F.broadcast(parts), "__part").select(*order, first.alias("__first"))


def with_file_order(df: DataFrame, name: str = "record_id") -> DataFrame:
    """Number the records of a dataset without a key in reading order: by file path, then
    by place in the file, however Spark deals the files out.

    Without a key nothing but its place tells a row, so the rows are written once, with
    their places, before they are numbered.
    """
    rows = written(
        df.withColumns(
            {
                "__file": F.input_file_name(),
                "__block": F.input_file_block_start(),
                "__row": F.monotonically_increasing_id(),
            }
        ),
        "rows",
    )
    return with_position(rows, "__file", "__block", "__row", name=name).drop("__file", "__block", "__row")


def with_position(df: DataFrame, *order: str, name: str = "position") -> DataFrame:
    """Add the 0-based position of each row in the ascending order of the columns ``order``.

    The columns should identify a row: rows with equal values are numbered among
    themselves in no particular order, in one task. Positions are worked out on the keys
    alone; the rows meet them in one shuffle.
    """
    names = [f"__order{i}" for i in range(len(order))]
    keys = df.select(*[F.col(ident(c)).alias(n) for c, n in zip(order, names, strict=True)])
    first = _first_positions(keys, names)
    same = [F.col(ident(c)).eqNullSafe(F.col(n)) for c, n in zip(order, names, strict=True)]
    ties = Window.partitionBy(*names).orderBy(F.lit(0))
    placed = df.join(first, same).withColumn(name, F.col("__first") + F.row_number().over(ties) - 1)
    return placed.drop("__first", *names)


def running_total(df: DataFrame, order: str, value: str, name: str, group: int = 65536) -> DataFrame:
    """Inclusive running total of ``value`` in the order of a whole number.

    Two levels: inside groups of ``group`` consecutive numbers, then over the
    groups. No window ever covers all rows.
    """
    rows = df.withColumn("__block", F.expr(f"{ident(order)} div {group}"))
    blocks = rows.groupBy("__block").agg(F.sum(value).alias("__sum"))
    before = blocks.withColumn(
        "__before",
        F.sum("__sum").over(Window.orderBy("__block")) - F.col("__sum"),
    ).drop("__sum")
    inside = Window.partitionBy("__block").orderBy(ident(order)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        rows.withColumn(name, F.sum(value).over(inside))
        .join(before, "__block")
        .withColumn(name, F.col(name) + F.col("__before"))
        .drop("__block", "__before")
    )
