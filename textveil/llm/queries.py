"""One query per operator, with production parameters over whole tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textveil.llm import (
    bpe_codec,
    decontaminate,
    importance,
    near_dedup,
    quality,
    recompress_dedup,
    shard_packing,
    suffix_dedup,
    token_counts,
    tool_chat,
    url_filters,
    vector_codes,
    warc,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Where the vocabulary file of a public tokenizer lies, on every machine alike."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select(*first, *[c for c in judged.columns if c not in first and c != "text"])


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match"
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, tokenizer("piece_bpe_32k.model")).drop("text")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def page_is_good() -> Column:
    """The outcome of a page: whether its text is free of runs of symbols."""
    return F.regexp_count("html", F.lit("[#*$%]{3}")) < 5


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_filters.judge_urls(pages, page_is_good()).select("page_id", "host", "path", "rule", "verdict")


#: Fields of the tools that the calls below use, with type and whether they must be there.
TOOLS: tool_chat.Schemas = {
    "search": {"text": ("string", True), "limit": ("integer", True)},
    "summarize": {"text": ("string", True), "limit": ("integer", False)},
    "translate": {"text": ("string", True), "limit": ("integer", False)},
}


def chat_tables(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Plain messages, calls and results, read out of conversations.

    A user turn is a call whose tool and arguments follow from its text (some of them with
    an unknown tool or bad arguments); it uses the result of the user's last turn, and at
    every fourth turn also that of the one before. An assistant turn is the result of the
    call before it. System turns are plain messages.
    """
    text = F.coalesce("text", F.lit(""))
    size, turn, conv = F.length(text), F.col("turn"), F.col("conv_id")
    tool = F.element_at(
        F.array(*[F.lit(x) for x in ("search", "translate", "summarize", "search", "search", "translate", "summarize", "lookup")]),
        (size % 8 + 1).cast("int"),
    )
    limit = (size % 50).alias("limit")
    arguments = (
        F.when(size % 17 == 0, "not json")
        .when(size % 13 == 0, F.to_json(F.struct(limit)))
        .when(size % 11 == 0, F.to_json(F.struct(text.alias("text"), F.lit("many").alias("limit"))))
        .when(size % 7 == 0, F.to_json(F.struct(text.alias("text"), limit, F.lit(True).alias("now"))))
        .otherwise(F.to_json(F.struct(text.alias("text"), limit)))
    )

    def call_id(back: int) -> Column:
        return F.concat_ws("-", conv, turn - back)

    after = F.array_compact(
        F.array(F.when(turn >= 2, call_id(2)), F.when((turn >= 4) & (turn % 4 == 0), call_id(4)))
    )
    calls = conversations.where("role = 'user'").select(
        "conv_id", "turn", call_id(0).alias("call_id"), tool.alias("tool"), arguments.alias("arguments"), after.alias("after")
    )
    results = conversations.where("role = 'assistant'").select(
        "conv_id", "turn", call_id(1).alias("call_id"), text.alias("content")
    )
    messages = conversations.where("role not in ('user', 'assistant') or role is null")
    return messages.select("conv_id", "turn", "role", "text"), calls, results


def op7_tool_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages, calls, results = chat_tables(_table(spark, sf_dir, "conversations"))
    return tool_chat.format_chats(messages, calls, results, TOOLS).withColumn("errors", F.array_join("errors", "; "))


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_codec.encode_texts(docs, tokenizer("byte_bpe_50k.json")).drop("text")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups_of(_table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(_table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(vector_codes.listed(books).encode()).hexdigest()
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return vector_codes.with_label_error(coded).select(
        F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_packing.assign(_table(spark, sf_dir, "documents"), shards=8)
    return placed.select(
        F.col("id").alias("doc_id"),
        "size",
        F.col("crc32").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    sampled = importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return sampled.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_decontamination": op3_decontamination,
    "op4_token_counts": op4_token_counts,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_url_filters": op6_url_filters,
    "op7_tool_chat": op7_tool_chat,
    "op8_bpe_codec": op8_bpe_codec,
    "op9_near_dedup": op9_near_dedup,
    "op10_warc": op10_warc,
    "op11_vector_codes": op11_vector_codes,
    "op12_sharding": op12_sharding,
    "op13_importance": op13_importance,
}
