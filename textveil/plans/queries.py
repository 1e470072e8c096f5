"""One Spark query per operator, over the whole of the given tables."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textveil.functions.batches import lists, pieces
from textveil.functions.rules import CATALOGUE, select_rules, source_generators
from textveil.functions.sqltext import held, lit, running_sum
from textveil.operators.actions import clean_control_whitespace
from textveil.operators.detect import (
    detect_pii,
    detect_rules,
    detect_with,
    external_detections,
    java_regex,
    split_by_confidence,
)
from textveil.operators.fields import extract_text_fields, set_text_fields
from textveil.operators.merge import merge_detections
from textveil.operators.messages import (
    ChatTemplate,
    ensure_eos,
    messages_from_turns,
    render_chat,
    to_messages,
)
from textveil.operators.order import with_position
from textveil.operators.pseudonym import FALLBACK, generated, replacement_sql
from textveil.operators.review import apply_verdicts, final_detections, review_queue
from textveil.operators.schema import detect_schema, keep_only, lower_columns, preview
from textveil.operators.split import shuffled, train_val_split
from textveil.operators.tokens import (
    collate,
    dropped_tokens,
    frame_documents,
    in_batches,
    length_stats,
    pack,
    token_accounting,
    tokenize,
    tokenize_with,
    truncate,
)
from textveil.operators.vocabulary import Vocabulary, vocabulary_ids, vocabulary_text
from textveil.plans.incremental import detect_incremental
from textveil.plans.prepare import chat_text, prepare, prepare_report
from textveil.plans.samples import SAMPLES
from textveil.plans.sanitize import (
    apply_detections,
    organize,
    rule_map,
    rule_table,
    sanitize,
    sanitize_hybrid,
    sanitize_reviewed,
    summary,
    with_category,
)
from textveil.sources.readers import (
    by_rows,
    load,
    read_csv,
    read_json,
    read_jsonl,
    read_tokenized,
    read_zip_text,
    spread,
)
from textveil.sources.scratch import arrow_target, scratch_path
from textveil.sources.writers import write_detections, write_records, write_tokenized
from textveil.streaming.reviewing import finish, queue_of, start_hybrid
from textveil.streaming.sanitizing import sanitize_stream

# What the stand-in for an entity model finds.
ENTITY = r"[A-Z][a-z]+ [A-Z][a-z]+|[A-Za-z0-9.@_-]*[0-9@][A-Za-z0-9.@_-]* [a-z]+"
MINIMAL_RULES = ["email", "ip_ipv4", "gcp_private_key_id"]
#: Rows that a task draws values for. A table of few columns is one split for millions of rows.
GENERATED_ROWS = 4000
KINDS = "name organization email phone address ssn uri license passport api_token".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def chats(spark, sf_dir) -> DataFrame:
    """``conv_id, messages`` from the table of turns."""
    return messages_from_turns(
        table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text"
    )


def mixed_chats(spark, sf_dir) -> DataFrame:
    """``chat_id, messages`` of all conversations and, a line being a message, of all
    documents: nested texts with something to find in them."""
    role = "CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END"
    lines = f"transform(split(text, '\\n'), (l, i) -> named_struct('role', {role}, 'content', l))"
    talks = chats(spark, sf_dir).select(F.concat(F.lit("c"), "conv_id").alias("chat_id"), "messages")
    docs = documents(spark, sf_dir).select(
        F.concat(F.lit("d"), "doc_id").alias("chat_id"), F.expr(lines).alias("messages")
    )
    return talks.unionByName(docs)


def pairs(spark, sf_dir) -> DataFrame:
    """Every user turn with the answer that follows it and the system turn before it."""
    turns = table(spark, sf_dir, "conversations")
    order = Window.partitionBy("conv_id").orderBy("turn")
    near = {
        "answer": F.when(F.lead("role").over(order) == "assistant", F.lead("text").over(order)),
        "system_text": F.when(F.lag("role").over(order) == "system", F.lag("text").over(order)),
    }
    return turns.withColumns(near).where("role = 'user'").select(
        "conv_id", "turn", "system_text", F.col("text").alias("user_text"), "answer"
    )


# Sources and sinks


def read_json_array(spark, sf_dir):
    path = scratch_path(spark, "array") + ".json"
    write_records(documents(spark, sf_dir), path)
    return read_json(spark, path).select("doc_id", "text", "lang", "source", "n_chars")


def read_json_lines(spark, sf_dir):
    path = scratch_path(spark, "lines") + ".jsonl"
    write_records(documents(spark, sf_dir), path)
    return read_jsonl(spark, path).select("doc_id", "text", "lang", "source", "n_chars")


def read_csv_typed(spark, sf_dir):
    path = scratch_path(spark, "table") + ".csv"
    documents(spark, sf_dir).write.option("header", True).option("escape", '"').csv(path)
    return read_csv(spark, path, multi_line=True)


def read_csv_strings(spark, sf_dir):
    path = scratch_path(spark, "strings") + ".csv"
    table(spark, sf_dir, "labels").write.option("header", True).csv(path)
    return read_csv(spark, path, infer=False)


def read_zip_archives(spark, sf_dir):
    path = scratch_path(spark, "archives")

    def store(batch: pd.DataFrame) -> pd.DataFrame:
        # 200 documents each; a task that runs again writes the same file again.
        name = f"part{batch['archive'].iloc[0]}"
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                archive.writestr(f"{name}/{doc_id}.txt", text)
        target, folder = arrow_target(path)
        target.create_dir(folder, recursive=True)
        with target.open_output_stream(f"{folder}/{name}.zip") as out:
            out.write(buffer.getvalue())
        return pd.DataFrame({"archive": [name]})

    docs = table(spark, sf_dir, "documents").selectExpr("doc_id div 200 as archive", "doc_id", "text")
    docs.groupBy("archive").applyInPandas(store, "archive string").count()
    return read_zip_text(spark, path + "/*.zip", with_origin=True).select("member", "text")


def load_by_extension(spark, sf_dir):
    return load(spark, path=f"{sf_dir}/documents.parquet")


def _token_table(spark, sf_dir) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", tokenize("text").alias("input_ids"))
    return rows.withColumn("attention_mask", F.expr("array_repeat(1, size(input_ids))"))


def read_tokenized_rows(spark, sf_dir):
    path = scratch_path(spark, "tokens")
    write_tokenized(keep_only(_token_table(spark, sf_dir), "input_ids", "attention_mask"), path)
    return read_tokenized(spark, path).select(
        F.md5(F.array_join("input_ids", " ")).alias("ids_md5"),
        F.size("attention_mask").alias("n_tokens"),
    )


def write_tokenized_splits(spark, sf_dir):
    path = scratch_path(spark, "splits")
    rows = train_val_split(_token_table(spark, sf_dir), 0.1, "doc_id")
    write_tokenized(rows, path, fmt="parquet")
    stored = spark.read.parquet(path)
    return stored.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("input_ids").cast("long")).alias("tokens")
    )


def write_detection_audit(spark, sf_dir):
    found = detect_pii(documents(spark, sf_dir), "doc_id", ["text"])
    return write_detections(found, scratch_path(spark, "audit"))


# Schema and fields


def lower_column_names(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return lower_columns(docs.toDF("DOC_ID", "Text", "Lang", "SOURCE", "N_Chars"))


def _layouts(spark, sf_dir) -> list[DataFrame]:
    base = pairs(spark, sf_dir)
    shared = chats(spark, sf_dir).selectExpr(
        "conv_id",
        "transform(messages, m -> named_struct('from', m.role, 'value', m.content)) as conversations",
    )
    return [
        table(spark, sf_dir, "documents"),
        base.selectExpr("conv_id", "user_text as instruction", "system_text as input", "answer as output"),
        chats(spark, sf_dir),
        shared,
        base.selectExpr("user_text as prompt", "answer as response"),
        base.selectExpr("user_text as question", "answer"),
        base.selectExpr("user_text as question", "answer as long_answer"),
    ]


def detect_layouts(spark, sf_dir):
    counts = [
        df.agg(F.lit(detect_schema(df)).alias("layout"), F.count(F.lit(1)).alias("records"))
        for df in _layouts(spark, sf_dir)
    ]
    out = counts[0]
    for df in counts[1:]:
        out = out.unionByName(df)
    return out


def extract_fields_nested(spark, sf_dir):
    return extract_text_fields(chats(spark, sf_dir), "conv_id")


def extract_fields_events(spark, sf_dir):
    return extract_text_fields(table(spark, sf_dir, "events"), "event_id")


def set_fields_nested(spark, sf_dir):
    records = chats(spark, sf_dir)
    fields = extract_text_fields(records, "conv_id")
    marked = fields.filter("field_path LIKE '%.content'").withColumn(
        "text", F.concat("text", F.lit(" ("), F.length("text"), F.lit(")"))
    )
    changed = set_text_fields(records, "conv_id", marked)
    return changed.select("conv_id", F.expr("posexplode(messages)").alias("n", "m")).select(
        "conv_id", "n", "m.role", "m.content"
    )


def preview_sanitized(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sanitize(preview(docs, "doc_id", 3), "redact", "doc_id")


# Detection


def _shown(detections: DataFrame) -> DataFrame:
    return detections.select(
        "record_id", "field_path", "rule_ord", "pattern", "match", "start", "end", "score"
    )


def detect_rules_documents(spark, sf_dir):
    return _shown(detect_rules(documents(spark, sf_dir), "doc_id", ["text"]))


def detect_rules_pages(spark, sf_dir):
    return _shown(detect_rules(spread(table(spark, sf_dir, "pages")), "page_id"))


def rule_catalogue_hits(spark, sf_dir):
    """Hits of every rule in the documents, each with the sample text of one rule added."""
    sample = f"array({', '.join(lit(t) for t in SAMPLES)})[cast(doc_id % {len(SAMPLES)} as int)]"
    docs = documents(spark, sf_dir).select("doc_id", F.expr(f"concat(text, '\n', {sample})").alias("text"))
    found = detect_rules(docs, "doc_id", ["text"])
    counts = found.groupBy("rule_ord").agg(F.count(F.lit(1)).alias("hits"))
    rules = rule_table(spark).select("rule_ord", "name", "category", "generator")
    return rules.join(F.broadcast(counts), "rule_ord", "left").fillna(0, ["hits"])


def _named_entities(spark, sf_dir) -> DataFrame:
    """Detections as an entity model would give them: everywhere in each document two
    capitalised words, or a piece with a digit or @ and the word after it, persons and
    addresses in turn, the longer the surer."""
    # One pass of the expression marks all finds; every second part between marks is one.
    marked = f"regexp_replace(translate(text, '\\u0001', ' '), {lit(ENTITY)}, '\\u0001$0\\u0001')"
    # Held, as the filter that comes with a generator would else search all texts before
    # they are dealt out, and then once more.
    rows = held(documents(spark, sf_dir).select("doc_id", "text"), "parts", f"split({marked}, '\\u0001')", drop=("text",))
    rows = rows.select(
        "doc_id",
        F.expr("filter(parts, (p, i) -> i % 2 = 1)").alias("found"),
        F.expr("filter(parts, (p, i) -> i % 2 = 0)").alias("gaps"),
    )
    before = "transform(found, (m, i) -> length(gaps[i]) + CASE WHEN i = 0 THEN 0 ELSE length(found[i - 1]) END)"
    rows = rows.withColumn("starts", F.expr(running_sum(before)))
    return rows.select("doc_id", "starts", F.posexplode("found").alias("arrival", "match")).selectExpr(
        "doc_id as record_id",
        "'text' as field_path",
        "CASE WHEN arrival % 2 = 0 THEN 'person' ELSE 'full address' END as pattern",
        "match",
        "starts[arrival] as start",
        "starts[arrival] + length(match) as end",
        "least(cast(length(match) as double) / 40 + 0.4D, 0.97D) as score",
        "arrival",
    )


def detect_external_table(spark, sf_dir):
    return _shown(external_detections(_named_entities(spark, sf_dir)))


def _name_finder():
    names = re.compile(r"\b[A-Z][a-z]+ [A-Z][a-z]+\b", re.ASCII)

    def find(texts: list[str]) -> list[list[dict]]:
        return [
            [
                {"label": "person name", "text": m.group(), "start": m.start(), "end": m.end(), "score": 0.75}
                for m in names.finditer(text)
            ]
            for text in texts
        ]

    return find


def detect_with_model(spark, sf_dir):
    return _shown(
        detect_with(documents(spark, sf_dir), "doc_id", _name_finder, ["text"])
    ).drop("rule_ord")


def merge_long_table(spark, sf_dir):
    return _shown(merge_detections(detect_rules(documents(spark, sf_dir), "doc_id", ["text"])))


def detect_pii_documents(spark, sf_dir):
    return _shown(detect_pii(documents(spark, sf_dir), "doc_id", ["text"]))


def detect_incremental_documents(spark, sf_dir):
    """One language first, then all documents: the second run searches what is new."""
    docs, store = documents(spark, sf_dir), scratch_path(spark, "store")
    detect_incremental(docs.where("lang = 'en'"), "doc_id", store, ["text"])
    return _shown(detect_incremental(docs, "doc_id", store, ["text"]))


def detect_pii_conversations(spark, sf_dir):
    return _shown(detect_pii(mixed_chats(spark, sf_dir), "chat_id"))


def _hybrid(spark, sf_dir, **options) -> DataFrame:
    return detect_pii(
        documents(spark, sf_dir), "doc_id", ["text"], external=_named_entities(spark, sf_dir), **options
    )


def detect_pii_hybrid(spark, sf_dir):
    return _shown(_hybrid(spark, sf_dir))


def detect_pii_protected(spark, sf_dir):
    return _shown(_hybrid(spark, sf_dir, protect_certain=True))


def split_confidence(spark, sf_dir):
    sure, unsure = split_by_confidence(_hybrid(spark, sf_dir))
    return (
        sure.withColumn("confidence", F.lit("certain"))
        .unionByName(unsure.withColumn("confidence", F.lit("uncertain")))
        .groupBy("confidence", "pattern")
        .agg(F.count(F.lit(1)).alias("hits"))
    )


def organize_detections(spark, sf_dir):
    docs = documents(spark, sf_dir)
    grouped = organize(docs, "doc_id", detect_pii(docs, "doc_id", ["text"]))
    return grouped.select(
        "record_id",
        F.size("fields").alias("n_fields"),
        F.expr(
            "coalesce(array_join(transform(try_element_at(fields, 'text'), "
            "h -> concat(h.start, '-', h.end, ':', h.pattern)), ' '), '')"
        ).alias("listing"),
    )


def detection_summary(spark, sf_dir):
    return summary(detect_pii(documents(spark, sf_dir), "doc_id", ["text"]))


def detection_categories(spark, sf_dir):
    found = detect_pii(spread(table(spark, sf_dir, "pages")), "page_id")
    return with_category(found).select(
        "record_id", "field_path", "start", "pattern", "category", "generator"
    )


def source_map_use(spark, sf_dir):
    """Every known source with its hits among all rule hits of the documents."""
    found = detect_rules(documents(spark, sf_dir), "doc_id", ["text"])
    counts = found.groupBy(F.col("pattern").alias("source")).agg(F.count(F.lit(1)).alias("hits"))
    return rule_map(spark).join(F.broadcast(counts), "source", "left").fillna(0, ["hits"])


# Actions


def redact_minimal(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return sanitize(docs, "redact", "doc_id", rules=select_rules(include=MINIMAL_RULES))


def redact_documents(spark, sf_dir):
    return sanitize(documents(spark, sf_dir), "redact", "doc_id", ["text"])


def mask_documents(spark, sf_dir):
    return sanitize(documents(spark, sf_dir).select("doc_id", "text"), "mask", "doc_id")


def mask_pages(spark, sf_dir):
    return sanitize(spread(table(spark, sf_dir, "pages")), "mask", "page_id")


def mask_conversations(spark, sf_dir):
    return _turn_rows(sanitize(mixed_chats(spark, sf_dir), "mask", "chat_id"), "chat_id")


def redact_luhn(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return sanitize(docs, "redact", "doc_id", luhn=True)


def redact_twice(spark, sf_dir):
    """A second pass that leaves the placeholders of the first alone."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    once = sanitize(docs, "redact", "doc_id")
    return sanitize(once, "redact", "doc_id", skip_placeholders=True)


def pseudonymize_documents(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return sanitize(docs, "pseudonymize", "doc_id", salt="demo")


def pseudonym_shapes(spark, sf_dir):
    """Per rule: hits, and pseudonyms the rule accepts where it shapes them."""
    found = detect_pii(documents(spark, sf_dir), "doc_id", ["text"])
    made = found.withColumn("made", F.expr(replacement_sql("pattern", "match", "demo")))
    accepted = " ".join(
        f"WHEN pattern = {lit(r.name)} THEN made rlike {lit('^(?:' + java_regex(r.regex) + ')$')}"
        for r in CATALOGUE
        if source_generators().get(r.name) == "regex"
    )
    valid = f"CASE WHEN made = {lit(FALLBACK)} THEN false {accepted} ELSE made != '' END"
    return made.groupBy("pattern").agg(
        F.count(F.lit(1)).alias("hits"),
        F.count_if(F.expr(valid)).alias("valid"),
        F.count_if(F.col("made") == F.col("match")).alias("unchanged"),
    )


def pseudonym_kinds(spark, sf_dir):
    """A value of every generator for every customer."""
    customers = by_rows(table(spark, sf_dir, "customer").select("c_custkey"), GENERATED_ROWS).select(
        "c_custkey", F.col("c_custkey").cast("string").alias("k")
    )
    return customers.select("c_custkey", *[generated(k, "k", "demo").alias(k) for k in KINDS])


def pseudonym_lengths(spark, sf_dir):
    """Fixed-form generators checked for every customer."""
    made = pseudonym_kinds(spark, sf_dir)
    forms = {
        "ssn": r"^(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}$",
        "license": r"^[A-Z0-9]{15}$",
        "passport": r"^[A-Z0-9]{9}$",
        "api_token": r"^[0-9a-f]{32}$",
        "email": r"^[a-z]+\.[a-z]+[0-9]+@example\.(com|org|net)$",
        "uri": r"^https://example\.(com|org|net)/[a-z]+/[0-9]+$",
    }
    return made.select("c_custkey", *[F.col(c).rlike(rx).alias(f"{c}_ok") for c, rx in forms.items()])


#: Rules that allow one or few strings.
SINGLE_VALUED = ("crypto_keys_rsa_private_key", "crypto_keys_ssh_private_key")


def pseudonym_distinct(spark, sf_dir):
    """How many originals there are and how many pseudonyms: matches of each rule, and names
    and the like for all customers and documents."""
    found = detect_pii(documents(spark, sf_dir), "doc_id", ["text"])
    shaped = [r.name for r in CATALOGUE if source_generators().get(r.name) == "regex" and r.name not in SINGLE_VALUED]
    matches = found.where(F.col("pattern").isin(shaped)).select("pattern", "match").distinct()
    made = matches.withColumn("made", F.expr(replacement_sql("pattern", "match", "demo")))
    rules = made.groupBy(F.col("pattern").alias("kind")).agg(
        F.count(F.lit(1)).alias("originals"), F.countDistinct("made").alias("pseudonyms")
    )
    keys = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("k"))
    keys = keys.unionByName(documents(spark, sf_dir).select(F.concat(F.lit("d"), "doc_id").alias("k")))
    # Each original once: one distinct count is left, in tasks that hold few rows.
    keys = by_rows(keys, GENERATED_ROWS, "k").distinct()
    kinds = ["name", "organization", "email", "address", "uri"]
    values = keys.select(
        "k", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), generated(k, "k", "demo").alias("made")) for k in kinds])).alias("v")
    ).select("k", "v.*")
    people = values.groupBy("kind").agg(F.count("k").alias("originals"), F.countDistinct("made").alias("pseudonyms"))
    return rules.unionByName(people)


def pseudonym_keeps_dates(spark, sf_dir):
    """Dates of birth are found but keep their value."""
    records = table(spark, sf_dir, "events").selectExpr(
        "event_id", "concat('user ', user_id, ', DOB: ', date_format(ts, 'dd/MM/yyyy'), ' .') as text"
    )
    return sanitize(
        records, "pseudonymize", "event_id", rules=select_rules(include=["dob_generic"]), salt="demo"
    )


def clean_whitespace(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", clean_control_whitespace("text").alias("text"))


# Review


def _audit(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    stored = write_detections(_hybrid(spark, sf_dir), scratch_path(spark, "hybrid"))
    return split_by_confidence(stored)


def review_top(spark, sf_dir):
    return _shown(review_queue(_audit(spark, sf_dir)[1], ratio=0.3, max_n=10))


def review_uncapped(spark, sf_dir):
    return _shown(review_queue(_audit(spark, sf_dir)[1], ratio=0.25, max_n=None))


def _verdicts(queue: DataFrame) -> DataFrame:
    """A reviewer who does not believe in hits across sentences."""
    return queue.selectExpr(
        "record_id", "field_path", "start", "end", "pattern", "match LIKE '%.%' as discard"
    )


def review_verdicts(spark, sf_dir):
    queue = review_queue(_audit(spark, sf_dir)[1], ratio=1.0, max_n=50)
    return _shown(apply_verdicts(queue, _verdicts(queue)))


def review_final(spark, sf_dir):
    sure, unsure = _audit(spark, sf_dir)
    queue = review_queue(unsure, ratio=1.0, max_n=50)
    return _shown(final_detections(sure, queue, _verdicts(queue)))


def sanitize_with_review(spark, sf_dir):
    return sanitize_hybrid(
        documents(spark, sf_dir).select("doc_id", "text"),
        "doc_id",
        scratch_path(spark, "hybrid"),
        external=_named_entities(spark, sf_dir),
        reviewer=_verdicts,
        action="mask",
    )


def sanitize_unreviewed(spark, sf_dir):
    """Hybrid detection with nobody to ask: certain hits only."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return sanitize_reviewed(docs, "doc_id", _hybrid(spark, sf_dir), action="redact")


def sanitize_null_key(spark, sf_dir):
    """A record without a key is cleaned like others."""
    docs = documents(spark, sf_dir).select(F.expr("nullif(doc_id, 0)").alias("doc_id"), "text")
    return sanitize_reviewed(docs, "doc_id", detect_pii(docs, "doc_id", ["text"]), action="redact")


def apply_found_detections(spark, sf_dir):
    pages = spread(table(spark, sf_dir, "pages"))
    return apply_detections(pages, "page_id", detect_pii(pages, "page_id"), "redact")


# Preparation


def _turn_rows(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.expr("posexplode(messages)").alias("n", "m")).select(
        *keys, "n", "m.role", "m.content"
    )


def messages_alpaca(spark, sf_dir):
    source = pairs(spark, sf_dir).selectExpr(
        "conv_id", "turn", "user_text as instruction", "system_text as input", "answer as output"
    )
    return _turn_rows(to_messages(source, "ALPACA"), "conv_id", "turn")


def messages_chatml(spark, sf_dir):
    return _turn_rows(to_messages(chats(spark, sf_dir), "CHATML"), "conv_id")


def messages_share_gpt(spark, sf_dir):
    source = chats(spark, sf_dir).selectExpr(
        "conv_id",
        "transform(messages, m -> named_struct('from', CASE m.role WHEN 'user' THEN 'Human' "
        "WHEN 'system' THEN 'SYSTEM' ELSE 'gpt' END, 'value', "
        "CASE WHEN m.role = 'system' THEN NULL ELSE m.content END)) as conversations",
    )
    return _turn_rows(to_messages(source, "SHARE_GPT"), "conv_id")


def messages_prompt_response(spark, sf_dir):
    source = pairs(spark, sf_dir).selectExpr("conv_id", "turn", "user_text as prompt", "answer as response")
    return _turn_rows(to_messages(source, "PROMPT_RESPONSE"), "conv_id", "turn")


def messages_qa(spark, sf_dir):
    source = pairs(spark, sf_dir).selectExpr("conv_id", "turn", "user_text as question", "answer")
    return _turn_rows(to_messages(source, "QA"), "conv_id", "turn")


def messages_qla(spark, sf_dir):
    source = pairs(spark, sf_dir).selectExpr("conv_id", "turn", "user_text as question", "answer as long_answer")
    return _turn_rows(to_messages(source, "QLA"), "conv_id", "turn")


def render_conversations(spark, sf_dir):
    return chat_text(chats(spark, sf_dir), "CHATML").select("conv_id", "rendered")


def render_plain_markers(spark, sf_dir):
    """Other markers and role names, system turn not folded."""
    template = ChatTemplate(
        bos="<s>", turn_open="[", turn_close="\n", assistant_name="bot", role_break="] ",
        fold_system=False, trim=False,
    )
    return chats(spark, sf_dir).select("conv_id", render_chat("messages", template).alias("rendered"))


def end_markers(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", ensure_eos("text").alias("text"), ensure_eos("text", ".").alias("dotted")
    )


def _framed(spark, sf_dir) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return frame_documents(in_batches(docs, "doc_id", dense=True))


def frame_batches(spark, sf_dir):
    return _framed(spark, sf_dir).select("doc_id", "batch", "in_batch", "text")


def _digest(ids: str = "input_ids"):
    return F.md5(F.array_join(ids, " ")).alias("ids_md5")


def tokenize_documents(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", tokenize("text").alias("input_ids"))
    return rows.select("doc_id", F.size("input_ids").alias("n_tokens"), _digest())


def tokenize_with_adapter(spark, sf_dir):
    """A Python encoder: ids are the character codes of the text."""

    def factory():
        return lambda texts: [[ord(c) for c in t] for t in texts]

    turns = table(spark, sf_dir, "conversations")
    rows = turns.select("conv_id", "turn", tokenize_with("text", factory).alias("input_ids"))
    return rows.select("conv_id", "turn", F.size("input_ids").alias("n_tokens"), _digest())


def tokenize_with_library(spark, sf_dir):
    """A public tokenizer's file as the encoder, and its decoder on the ids."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")

    def encoder():
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        return lambda texts: [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]

    @F.arrow_udf("string")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        for batch in batches:
            for piece in pieces(batch):
                texts = iter(model.decode_batch(lists(piece.drop_null()), skip_special_tokens=False))
                rows = [next(texts) if there else None for there in piece.is_valid().to_pylist()]
                yield pa.array(rows, pa.string())

    rows = documents(spark, sf_dir).select("doc_id", tokenize_with("text", encoder).alias("input_ids"))
    return rows.select("doc_id", F.md5(decoded("input_ids")).alias("text_md5"))


def tokenize_vocabulary(spark, sf_dir):
    """Ids of a public vocabulary by longest match, read back to text."""
    import public_tokenizers

    vocabulary = Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rows = documents(spark, sf_dir).select("doc_id", "text", vocabulary_ids("text", vocabulary).alias("input_ids"))
    return rows.select(
        "doc_id",
        F.md5(vocabulary_text("input_ids", vocabulary)).alias("text_md5"),
        (F.size("input_ids") <= F.octet_length("text")).alias("shorter"),
    )


def truncate_documents(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", tokenize("text", limit=128).alias("input_ids"))
    return truncate(rows, 128).select("doc_id", _digest(), F.size("attention_mask").alias("n_tokens"))


def _packed(spark, sf_dir, length: int, overlap: float) -> DataFrame:
    rows = _framed(spark, sf_dir).withColumn("input_ids", tokenize("text"))
    return pack(rows, length, overlap).select(
        "batch", "window", _digest(), F.size("attention_mask").alias("n_tokens")
    )


def pack_documents(spark, sf_dir):
    return _packed(spark, sf_dir, 512, 0.0)


def pack_overlapping(spark, sf_dir):
    return _packed(spark, sf_dir, 256, 0.25)


def pack_dropped(spark, sf_dir):
    rows = _framed(spark, sf_dir).withColumn("input_ids", tokenize("text"))
    return dropped_tokens(rows, 512)


def token_lengths(spark, sf_dir):
    return length_stats(documents(spark, sf_dir).select(tokenize("text").alias("input_ids")))


def token_progress(spark, sf_dir):
    return token_accounting(
        _token_table(spark, sf_dir), "doc_id", batch_size=4, logging_steps=5, accumulation=4
    )


def collate_batches(spark, sf_dir):
    rows = collate(_token_table(spark, sf_dir).select("doc_id", "input_ids"), "doc_id", 8)
    return rows.select(
        "batch",
        "doc_id",
        _digest(),
        F.md5(F.array_join("attention_mask", " ")).alias("mask_md5"),
        F.md5(F.array_join("labels", " ")).alias("labels_md5"),
    )


def split_by_hash(spark, sf_dir):
    return train_val_split(table(spark, sf_dir, "documents"), 0.1, "doc_id")


def split_exact(spark, sf_dir):
    return train_val_split(table(spark, sf_dir, "documents"), 0.15, "doc_id", exact=True)


def consecutive_positions(spark, sf_dir):
    return with_position(table(spark, sf_dir, "documents"), "n_chars", "doc_id")


def prepare_chats(spark, sf_dir):
    return _both(prepare(spark, data=chats(spark, sf_dir), max_length=128, split=0.2, key="conv_id"))


def _both(parts: dict[str, DataFrame]) -> DataFrame:
    out = [
        df.select(F.lit(name).alias("split"), _digest(), F.size("attention_mask").alias("n_tokens"))
        for name, df in parts.items()
    ]
    return out[0].unionByName(out[1])


def prepare_documents(spark, sf_dir):
    """Split, then pack each part in the order of its keys."""
    docs = documents(spark, sf_dir)
    return _both(prepare(spark, data=docs, max_length=512, split=0.1, key="doc_id"))


def prepare_counts(spark, sf_dir):
    return prepare_report(spark, data=documents(spark, sf_dir), max_length=512, split=0.1, key="doc_id")


def shuffle_documents(spark, sf_dir):
    return shuffled(documents(spark, sf_dir).select("doc_id"), "doc_id", seed=7)


# Streaming


def redact_stream(spark, sf_dir):
    source = table(spark, sf_dir, "documents")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/documents.parque[t]")
    target = scratch_path(spark, "clean")
    query = sanitize_stream(
        stream.select("doc_id", "text"),
        target,
        scratch_path(spark, "progress"),
        tasks=spark.sparkContext.defaultParallelism,
        key="doc_id",
    )
    query.awaitTermination()
    return spark.read.schema("doc_id long, text string").parquet(target)


def review_stream(spark, sf_dir):
    """Documents and detections as two streams, reviewed; a mark of time ends both."""
    folder = scratch_path(spark, "stream")
    at = F.timestamp_seconds(F.col("record_id") % 3600).alias("at")
    found = _named_entities(spark, sf_dir).drop("arrival").select("*", at)
    end = spark.range(1).select(F.lit(None).cast("long").alias("record_id"), F.timestamp_seconds(F.lit(10**9)).alias("at"))
    found.unionByName(end, allowMissingColumns=True).write.parquet(f"{folder}/found")
    source = table(spark, sf_dir, "documents")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/documents.parque[t]")
    texts = stream.select("doc_id", "text", F.timestamp_seconds(F.col("doc_id") % 3600).alias("at"))
    arriving = spark.readStream.schema(spark.read.parquet(f"{folder}/found").schema).parquet(f"{folder}/found")
    for query in start_hybrid(texts, arriving, "doc_id", "at", f"{folder}/run", columns=["text"]):
        query.awaitTermination()
    queue = queue_of(spark, f"{folder}/run")
    clean = finish(spark, f"{folder}/run", "doc_id", _verdicts(queue), queue, "mask", ["text"])
    return clean.select("doc_id", "text")


QUERIES = {
    f.__name__: f
    for f in (
        read_json_array, read_json_lines, read_csv_typed, read_csv_strings, read_zip_archives,
        load_by_extension, read_tokenized_rows, write_tokenized_splits, write_detection_audit,
        lower_column_names, detect_layouts, extract_fields_nested, extract_fields_events,
        set_fields_nested, preview_sanitized,
        detect_rules_documents, detect_rules_pages, rule_catalogue_hits, detect_external_table,
        detect_with_model, merge_long_table, detect_pii_documents,
        detect_incremental_documents, detect_pii_conversations,
        detect_pii_hybrid, detect_pii_protected, split_confidence, organize_detections,
        detection_summary, detection_categories, source_map_use,
        redact_minimal, redact_documents, mask_documents, mask_pages, mask_conversations,
        redact_luhn, redact_twice, pseudonymize_documents, pseudonym_shapes, pseudonym_kinds,
        pseudonym_lengths, pseudonym_distinct, pseudonym_keeps_dates, clean_whitespace,
        review_top, review_uncapped, review_verdicts, review_final, sanitize_with_review,
        sanitize_unreviewed, sanitize_null_key, apply_found_detections,
        messages_alpaca, messages_chatml, messages_share_gpt, messages_prompt_response,
        messages_qa, messages_qla, render_conversations, render_plain_markers, end_markers,
        frame_batches, tokenize_documents, tokenize_with_adapter,
        tokenize_with_library, truncate_documents,
        pack_documents, pack_overlapping, pack_dropped, token_lengths, token_progress,
        collate_batches, split_by_hash, split_exact, consecutive_positions, shuffle_documents,
        prepare_chats, prepare_documents, prepare_counts, tokenize_vocabulary, redact_stream, review_stream,
    )
}
