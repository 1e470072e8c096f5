"""From a raw dataset to token rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textveil.functions.sqltext import let
from textveil.operators.messages import ChatTemplate, eos_sql, messages_sql, render_sql
from textveil.operators.order import with_file_order
from textveil.operators.schema import detect_schema, keep_only, lower_columns
from textveil.operators.split import train_val_split
from textveil.operators.tokens import (
    Codec,
    dropped_tokens,
    frame_documents,
    in_batches,
    pack,
    tokenize,
    tokenize_with,
    truncate,
)
from textveil.sources.readers import load


def chat_text(
    df: DataFrame, layout: str, template: ChatTemplate = ChatTemplate(), eos: str = "<eos>"
) -> DataFrame:
    """Add ``rendered``: the chat of each record, ended by the end marker."""
    rendered = render_sql(messages_sql(df, layout), template)
    return df.withColumn("rendered", F.expr(let("chat", rendered, eos_sql("chat", eos))))


def _token_rows(
    df: DataFrame,
    layout: str,
    key: str,
    max_length: int | None,
    overlap: float,
    dense: bool,
    shuffle: int | None,
    template: ChatTemplate,
    codec: Codec,
    encoder: Callable | None,
) -> DataFrame:
    def ids(column: str, limit: int | None = None):
        return tokenize_with(column, encoder) if encoder else tokenize(column, codec, limit)

    if layout == "DAPT":
        packed = pack(_document_ids(df, key, dense, shuffle, codec, ids), max_length, overlap)
        return keep_only(packed, "input_ids", "attention_mask")
    rendered = chat_text(df, layout, template, codec.eos)
    tokens = rendered.select(ids("rendered", max_length).alias("input_ids"))
    return truncate(tokens, max_length) if max_length is not None else tokens.withColumn(
        "attention_mask", F.expr("array_repeat(1, size(input_ids))")
    )


def _document_ids(df: DataFrame, key: str, dense: bool, shuffle: int | None, codec: Codec, ids: Callable) -> DataFrame:
    """``batch, in_batch, input_ids`` of the framed documents. Only key and text travel; a
    null text is no document."""
    texts = df.select(key, "text").filter("text IS NOT NULL")
    framed = frame_documents(in_batches(texts, key, dense=dense, shuffle=shuffle), "text", codec)
    return framed.withColumn("input_ids", ids("text"))


def _loaded(
    spark: SparkSession, path: str | None, data: list[dict] | DataFrame | None, key: str | None, split: float | None
) -> tuple[DataFrame, str, str | None, bool | None]:
    """The dataset with lower-cased columns, its layout, its key, and whether the key was
    made here and counts from 0."""
    if isinstance(data, DataFrame):
        if path is not None:
            raise ValueError("A file and records can't be loaded at once.")
        df = data
    else:
        df = load(spark, path, data)
    df = lower_columns(df)
    layout = detect_schema(df)
    if split is not None and not 0 < split < 1:
        raise ValueError(f"A share of {split} can't be split off: it must lie between 0 and 1.")
    if key is None and (split is not None or layout == "DAPT"):
        return with_file_order(df, "record_id"), layout, "record_id", True
    return df, layout, key, None


def prepare_report(
    spark: SparkSession,
    path: str | None = None,
    data: list[dict] | DataFrame | None = None,
    max_length: int | None = 512,
    split: float | None = None,
    overlap: float = 0.0,
    key: str | None = None,
    seed: int = 42,
    exact: bool = False,
    dense: bool = False,
    template: ChatTemplate = ChatTemplate(),
    codec: Codec = Codec(),
    encoder: Callable | None = None,
) -> DataFrame:
    """What ``prepare`` with the same arguments reads and leaves out: for each part the
    ``records``, how many of them are null documents (``left_out``), their ``tokens``, and how
    many of those are in no row of the result (``dropped``): the rest of each batch that fills
    no window, or what chats have beyond ``max_length``."""

    def ids(column: str):
        return tokenize_with(column, encoder) if encoder else tokenize(column, codec)

    df, layout, key, made = _loaded(spark, path, data, key, split)
    parts = train_val_split(df, split, key.lower(), seed, exact) if split is not None else df.withColumn("split", F.lit("train"))
    if layout != "DAPT":
        size = F.size("input_ids").cast("long")
        over = F.greatest(size - max_length, F.lit(0)) if max_length is not None else F.lit(0)
        tokens = chat_text(parts, layout, template, codec.eos).select("split", ids("rendered").alias("input_ids"))
        return tokens.groupBy("split").agg(
            F.count(F.lit(1)).alias("records"),
            F.lit(0).cast("long").alias("left_out"),
            F.sum(size).alias("tokens"),
            F.sum(over).cast("long").alias("dropped"),
        )
    read = parts.groupBy("split").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("text").isNull()).alias("left_out"))
    names = ("train",) if split is None else ("train", "validation")
    counted = None
    for name in names:
        part = parts.filter(F.col("split") == name).drop("split")
        shuffle = None if split is None else seed
        rows = _document_ids(part, key.lower(), bool(made or dense) and split is None, shuffle, codec, ids)
        lost = dropped_tokens(rows, 512 if max_length is None else max_length, overlap)
        lost = lost.agg(F.sum("tokens").alias("tokens"), F.sum("dropped").alias("dropped")).withColumn("split", F.lit(name))
        counted = lost if counted is None else counted.unionByName(lost)
    return read.join(F.broadcast(counted), "split", "left").fillna(0, ["tokens", "dropped"])


def prepare(
    spark: SparkSession,
    path: str | None = None,
    data: list[dict] | DataFrame | None = None,
    max_length: int | None = 512,
    split: float | None = None,
    overlap: float = 0.0,
    key: str | None = None,
    seed: int = 42,
    exact: bool = False,
    dense: bool = False,
    template: ChatTemplate = ChatTemplate(),
    codec: Codec = Codec(),
    encoder: Callable | None = None,
) -> dict[str, DataFrame]:
    """``{"train": …}`` or ``{"train": …, "validation": …}`` with ``input_ids`` and
    ``attention_mask``.

    Chat layouts are projections of the input. Documents are packed, which needs
    an order: that of ``key``, or the reading order where there is no key. A split also
    shuffles: the documents of each part are packed in the ``shuffled`` order of the seed, so
    that no window joins neighbours by key. ``encoder`` is the factory of a Python tokeniser
    (``Vocabulary.encoder`` is one); without it the built-in codec is used. What is left out
    or dropped is counted by ``prepare_report``.
    """
    df, layout, key, made = _loaded(spark, path, data, key, split)
    rest = (max_length, overlap)
    if split is None:
        return {"train": _token_rows(df, layout, key, *rest, made or dense, None, template, codec, encoder)}
    parts = train_val_split(df, split, key.lower(), seed, exact)
    return {
        name: _token_rows(
            parts.filter(F.col("split") == name).drop("split"),
            layout, key.lower(), *rest, False, seed, template, codec, encoder,
        )
        for name in ("train", "validation")
    }
