"""Token ids, fixed-length windows and batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textveil.functions.batches import pieces
from textveil.functions.sqltext import ident, let, lit
from textveil.functions.workers import new_identity, once_per_worker
from textveil.operators.messages import eos_sql
from textveil.operators.order import running_total, with_position
from textveil.operators.split import shuffled

BATCH_ROWS = 1000
IGNORED_LABEL = -100


@dataclass(frozen=True)
class Codec:
    """A tokeniser made of built-in functions.

    Markers and line breaks have fixed ids; every other piece gets an id from its
    checksum, so there is no vocabulary to ship or to join. For a given
    vocabulary use ``textveil.operators.vocabulary``, for a library ``tokenize_with``.
    """

    pad: str = "<pad>"
    eos: str = "<eos>"
    bos: str = "<bos>"
    # Ids of the markers in the stored sample rows.
    markers: dict[str, int] = field(
        default_factory=lambda: {
            "<pad>": 0,
            "<eos>": 1,
            "<bos>": 2,
            "<start_of_turn>": 105,
            "<end_of_turn>": 106,
            "\n": 107,
            "\n\n": 108,
        }
    )
    first_id: int = 256
    vocabulary: int = 262144

    @property
    def pad_id(self) -> int:
        return self.markers[self.pad]

    @property
    def named(self) -> list[str]:
        return sorted((m for m in self.markers if m.strip()), key=len, reverse=True)

    @property
    def pattern(self) -> str:
        """Words, punctuation, markers, line breaks and blanks. A word or sign
        takes one blank before it along; a marker never does. Written with class
        names, which match many times faster than lists of ranges."""
        return "|".join(
            [
                r" ?[^\s\p{Punct}]++",
                r" ?[\p{Punct}&&[^<]]",
                *self.named,
                r"\n\n|\n|<",
                r"[ \t\r\f\x0B]+",
            ]
        )

    def ids_sql(self, text: str, limit: int | None = None) -> str:
        """SQL for the ``array<int>`` of ids of a string, or of its first ``limit``."""
        pieces = f"regexp_extract_all({text}, {lit(self.pattern)}, 0)"
        if limit is not None:
            pieces = f"slice({pieces}, 1, {limit})"
        fixed = " ".join(f"WHEN {lit(m)} THEN {i}" for m, i in self.markers.items())
        spread = self.vocabulary - self.first_id
        drawn = f"{self.first_id} + crc32(p) % {spread}"
        return f"transform({pieces}, p -> cast(CASE p {fixed} ELSE {drawn} END as int))"


def tokenize(text: str, codec: Codec = Codec(), limit: int | None = None) -> Column:
    """Token ids of a string column. A ``limit`` saves the work for ids that
    ``truncate`` would cut off again."""
    return F.expr(codec.ids_sql(ident(text), limit))


def tokenize_with(
    text: str | Column, factory: Callable[[], Callable[[list[str]], list[list[int]]]]
) -> Column:
    """Token ids by a Python tokeniser, in pieces of Arrow batches. ``factory`` builds the
    encoder once per Python worker. A null text has null ids."""
    own = new_identity()

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = once_per_worker(own, factory)
        for batch in batches:
            for piece in pieces(batch):
                given = iter(encoder(piece.drop_null().to_pylist()))
                rows = [next(given) if there else None for there in piece.is_valid().to_pylist()]
                yield pa.array(rows, pa.list_(pa.int32()))

    return encode(F.col(ident(text)) if isinstance(text, str) else text)


def truncate(df: DataFrame, max_length: int, ids: str = "input_ids") -> DataFrame:
    """Cut ids on the right and add the attention mask; nothing is padded."""
    if max_length < 1:
        raise ValueError("`max_length` must be positive.")
    cut = F.slice(F.col(ident(ids)), 1, max_length)
    return df.withColumn(ids, cut).withColumn(
        "attention_mask", F.expr(f"array_repeat(1, size({ident(ids)}))")
    )


def in_batches(
    df: DataFrame, key: str, rows: int = BATCH_ROWS, dense: bool = False, shuffle: int | None = None
) -> DataFrame:
    """Add ``batch`` and ``in_batch`` for ``rows`` consecutive records by key.

    ``dense`` says the key already counts 0, 1, 2, … without gaps or null texts;
    else positions are worked out from the keys. With ``shuffle``, a seed, records follow one
    another in the ``shuffled`` order instead.
    """
    if shuffle is not None:
        placed, dense = shuffled(df, key, shuffle, "__position"), False
    else:
        placed = df if dense else with_position(df, key, name="__position")
    position = ident(key) if dense else "__position"
    return (
        placed.withColumn("batch", F.expr(f"{position} div {rows}"))
        .withColumn("in_batch", F.expr(f"{position} % {rows}"))
        .drop("__position")
    )


def frame_sql(text: str, first: str, codec: Codec = Codec()) -> str:
    """SQL for a document with its begin and end markers. The first of a batch
    gets its begin marker from the tokeniser, and no line break before it."""
    t = "framed"
    begun = (
        f"CASE WHEN {first} THEN concat({lit(codec.bos)}, {t}) "
        f"WHEN startswith({t}, {lit(codec.bos)}) THEN concat('\\n', {t}) "
        f"ELSE concat('\\n', {lit(codec.bos)}, {t}) END"
    )
    return let(t, eos_sql(text, codec.eos), begun)


def frame_documents(df: DataFrame, text: str = "text", codec: Codec = Codec()) -> DataFrame:
    """Frame the documents of ``in_batches``; null texts are left out."""
    rows = df.filter(F.col(ident(text)).isNotNull())
    return rows.withColumn(text, F.expr(frame_sql(ident(text), "in_batch = 0", codec)))


def window_step(max_length: int, overlap: float) -> int:
    if max_length < 1:
        raise ValueError("`max_length` must be positive.")
    step = max_length - int(max_length * overlap)
    if not 0 <= overlap < 1 or step < 1:
        raise ValueError("`overlap` must be at least 0 and leave a step of at least 1.")
    return step


def pack(
    df: DataFrame,
    max_length: int | None = 512,
    overlap: float = 0.0,
    keep_tail: bool = False,
) -> DataFrame:
    """Fixed-length windows over the joined tokens of each batch.

    ``df`` has ``batch``, ``in_batch`` and ``input_ids``. A document is cut into
    the pieces that its windows need, and pieces meet again per window: no row
    ever holds a batch. Windows start every ``step`` tokens below the last whole
    multiple of ``max_length``; tokens behind that are dropped per batch unless
    ``keep_tail``.
    """
    length = 512 if max_length is None else max_length
    step = window_step(length, overlap)
    order = Window.partitionBy("batch").orderBy("in_batch")
    size = F.size("input_ids")
    placed = (
        df.select("batch", "in_batch", "input_ids", size.cast("long").alias("n"))
        .withColumn(
            "start", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
        )
        .withColumn("total", F.sum("n").over(Window.partitionBy("batch")))
        .filter("n > 0")
    )
    limit = "total" if keep_tail else f"(total div {length}) * {length}"
    first = f"CASE WHEN start < {length} THEN 0L ELSE (start - {length}) div {step} + 1 END"
    last = f"least((start + n - 1) div {step}, ({limit} - 1) div {step})"
    # The pieces are cut inside the row, so that a long document is not copied
    # along with each of its windows.
    low, high = f"greatest(start, w * {step})", f"least(start + n, w * {step} + {length})"
    piece = (
        f"named_struct('window', w, 'low', {low}, 'ids', "
        f"slice(input_ids, cast({low} - start + 1 as int), cast({high} - {low} as int)))"
    )
    pieces = (
        placed.filter(f"{limit} > 0")
        .withColumn("first", F.expr(first))
        .withColumn("last", F.expr(last))
        .filter("first <= last")
        .select("batch", F.expr(f"explode(transform(sequence(first, last), w -> {piece}))").alias("cut"))
        .select("batch", "cut.window", F.struct("cut.low", "cut.ids").alias("piece"))
    )
    joined = F.expr("flatten(transform(array_sort(collect_list(piece)), p -> p.ids))")
    return (
        pieces.groupBy("batch", "window")
        .agg(joined.alias("input_ids"))
        .withColumn("attention_mask", F.expr("array_repeat(1, size(input_ids))"))
    )


def dropped_tokens(df: DataFrame, max_length: int = 512, overlap: float = 0.0) -> DataFrame:
    """Tokens per batch and how many of them are in no window."""
    step = window_step(max_length, overlap)
    totals = df.groupBy("batch").agg(F.sum(F.size("input_ids").cast("long")).alias("tokens"))
    limit = f"(tokens div {max_length}) * {max_length}"
    covered = (
        f"CASE WHEN {limit} = 0 THEN 0L "
        f"ELSE least(tokens, (({limit} - 1) div {step}) * {step} + {max_length}) END"
    )
    return totals.withColumn("dropped", F.expr(f"tokens - {covered}"))


def null_documents(df: DataFrame, text: str = "text") -> DataFrame:
    """How many records hold no document and are left out by ``frame_documents``."""
    return df.agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col(ident(text)).isNull()).alias("left_out")
    )


def length_stats(df: DataFrame, ids: str = "input_ids") -> DataFrame:
    size = F.size(ident(ids))
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(size.cast("long")).alias("tokens"),
        F.min(size).alias("shortest"),
        F.max(size).alias("longest"),
    )


def token_accounting(
    df: DataFrame,
    position: str,
    batch_size: int,
    logging_steps: int = 1,
    padded: bool = True,
    accumulation: int = 1,
) -> DataFrame:
    """Tokens seen after each logged training step.

    ``position`` counts the records 0, 1, 2, …; a step reads ``accumulation`` batches of
    ``batch_size`` records. ``padded`` counts what right-padded batches hold, as a trainer
    sees them; without it only the records' own tokens count.
    """
    if batch_size < 1 or logging_steps < 1 or accumulation < 1:
        raise ValueError("Batch size, logging steps and accumulation must be positive.")
    size = F.size("input_ids").cast("long")
    tokens = F.max(size) * F.count(F.lit(1)) if padded else F.sum(size)
    batches = df.groupBy(F.expr(f"{ident(position)} div {batch_size}").alias("batch")).agg(tokens.alias("tokens"))
    steps = batches.groupBy(F.expr(f"batch div {accumulation} + 1").alias("step")).agg(
        F.sum("tokens").alias("tokens")
    )
    return running_total(steps, "step", "tokens", "tokens_seen").filter(
        F.col("step") % logging_steps == 0
    )


def collate(
    df: DataFrame, position: str, batch_size: int, codec: Codec = Codec()
) -> DataFrame:
    """Right-padded training batches: ids, mask and labels of equal length per
    batch. Labels are the ids, with pads left out of the loss."""
    if batch_size < 1:
        raise ValueError("`batch_size` must be positive.")
    batched = df.withColumn("batch", F.expr(f"{ident(position)} div {batch_size}")).withColumn(
        "__longest", F.max(F.size("input_ids")).over(Window.partitionBy("batch"))
    )
    pads = "array_repeat({}, __longest - size(input_ids))"
    masked = f"transform(input_ids, t -> CASE WHEN t = {codec.pad_id} THEN {IGNORED_LABEL} ELSE t END)"
    return batched.select(
        "batch",
        ident(position),
        F.expr(f"concat(input_ids, {pads.format(codec.pad_id)})").alias("input_ids"),
        F.expr(f"concat(array_repeat(1, size(input_ids)), {pads.format(0)})").alias("attention_mask"),
        F.expr(f"concat({masked}, {pads.format(IGNORED_LABEL)})").alias("labels"),
    )
