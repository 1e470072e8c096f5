"""Expected answers: for a query name, DuckDB SQL over the same tables."""

from __future__ import annotations

from textveil.functions.rules import CATALOGUE, CATEGORY_SOURCES, select_rules
from textveil.plans.expected import (
    CHAT_TURNS,
    CHATS,
    DETECTION_COLUMNS,
    DOCUMENTS,
    MASK,
    PAGES,
    PAIRS,
    REDACT,
    TURNS,
    category_case,
    dialogue_text,
    draw,
    ended,
    fake_value,
    framed_tokens,
    kept,
    listed,
    pseudonyms,
    quoted,
    rule_hits,
    sanitized,
    spliced,
    token_ids,
    windows,
)
from textveil.plans.queries import KINDS, MINIMAL_RULES, SINGLE_VALUED
from textveil.plans.samples import SAMPLES

ALL_DOCUMENT_COLUMNS = "SELECT doc_id, text, lang, source, n_chars FROM documents"

# Documents with the sample text of one rule each.
SAMPLED = (
    "SELECT doc_id AS record_id, 'text' AS field_path, text || chr(10) || "
    f"[{', '.join(quoted(t) for t in SAMPLES)}][doc_id % {len(SAMPLES)} + 1] AS text FROM documents"
)

# Entity-model detections, as the Spark query makes them.
_ENTITY = "[A-Z][a-z]+ [A-Z][a-z]+|[A-Za-z0-9.@_-]*[0-9@][A-Za-z0-9.@_-]* [a-z]+"
ENTITIES = f"""pieces AS (
  SELECT doc_id, regexp_extract_all(text, '{_ENTITY}') AS m, string_split_regex(text, '{_ENTITY}') AS g FROM documents),
entity_rows AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM pieces),
entity_starts AS (
  SELECT doc_id, i, m[i] AS match, CAST(list_sum(list_transform(g[1:i], lambda x: length(x)))
    + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS INT) AS start FROM entity_rows),
entities AS (
  SELECT doc_id AS record_id, 'text' AS field_path, CAST({len(CATALOGUE)} + i AS INT) AS rule_ord,
         CASE WHEN i % 2 = 1 THEN 'person' ELSE 'full address' END AS pattern, match, start,
         CAST(start + length(match) AS INT) AS "end",
         least(CAST(length(match) AS DOUBLE) / 40 + CAST(0.4 AS DOUBLE), CAST(0.97 AS DOUBLE)) AS score
  FROM entity_starts)"""

HYBRID = f"""{rule_hits(DOCUMENTS)}, {ENTITIES},
every AS (SELECT {DETECTION_COLUMNS} FROM hits UNION ALL SELECT {DETECTION_COLUMNS} FROM entities),
{kept('every')}"""

PROTECTED = f"""{rule_hits(DOCUMENTS)}, {ENTITIES},
every AS (
  SELECT {DETECTION_COLUMNS} FROM hits
  UNION ALL SELECT {DETECTION_COLUMNS} FROM entities WHERE score >= 0.9
  UNION ALL SELECT {DETECTION_COLUMNS} FROM entities e WHERE score < 0.9
    AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.record_id = e.record_id
                    AND h.start < e."end" AND e.start < h."end")
    AND NOT EXISTS (SELECT 1 FROM entities h WHERE h.record_id = e.record_id AND h.score >= 0.9
                    AND h.start < e."end" AND e.start < h."end")),
{kept('every')}"""

UNSURE = "unsure AS (SELECT * FROM merged WHERE score >= 0.5 AND score < 0.9)"
SURE = "sure AS (SELECT * FROM merged WHERE score >= 0.9)"


def queue(ratio: float, most: int | None) -> str:
    top = f"least({most}, CAST(floor(n * {ratio}) AS BIGINT))" if most else f"floor(n * {ratio})"
    return f"""{UNSURE},
queue AS (
  SELECT {DETECTION_COLUMNS} FROM (
    SELECT *, row_number() OVER (ORDER BY score DESC, record_id, field_path, start, "end", pattern) AS place,
           count(*) OVER () AS n FROM unsure)
  WHERE place <= {top})"""


VERIFIED = "verified AS (SELECT * FROM queue WHERE match NOT LIKE '%.%')"
FINAL = f"""{SURE}, {queue(1.0, 50)}, {VERIFIED},
final AS (SELECT {DETECTION_COLUMNS} FROM sure UNION ALL SELECT {DETECTION_COLUMNS} FROM verified)"""

CLEANED_BY = """grouped AS (
  SELECT record_id, field_path, list(struct_pack(s := start, e := "end", p := pattern) ORDER BY start) AS spans
  FROM {source} GROUP BY record_id, field_path)"""


def cleaned_documents(source: str, action: str) -> str:
    return f"""{CLEANED_BY.format(source=source)}
SELECT t.record_id AS doc_id, {spliced(action)} AS text
FROM texts t LEFT JOIN grouped g USING (record_id, field_path)"""


DOCUMENT_CLEAN = "SELECT record_id AS doc_id, text FROM clean"
PAGE_CLEAN = """SELECT u.record_id AS page_id, u.text AS url, h.text AS html
FROM clean u JOIN clean h USING (record_id)
WHERE u.field_path = 'url' AND h.field_path = 'html'"""

NUMBERED_TURNS = """SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS n,
       role, {content} AS content FROM conversations"""

TOKENS = f"tokens AS (SELECT doc_id, {token_ids('text')} AS ids FROM documents)"
CUT_TOKENS = f"tokens AS (SELECT doc_id, {token_ids('text')}[1:128] AS ids FROM documents)"


def two_turns(user: str, assistant: str) -> str:
    return (
        f"WITH {PAIRS} SELECT conv_id, turn, CAST(0 AS INT) AS n, 'user' AS role, {user} AS content FROM pairs "
        f"UNION ALL SELECT conv_id, turn, CAST(1 AS INT), 'assistant', {assistant} FROM pairs"
    )


def luhn_ok(digits: str) -> str:
    """Check-digit test of a string of digits."""
    places = (
        f"list_transform(range(1, length({digits}) + 1), "
        f"lambda k: TRY_CAST(substr(reverse({digits}), k, 1) AS INT) * (CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END))"
    )
    return f"(list_sum(list_transform({places}, lambda d: d // 10 + d % 10)) % 10 = 0)"


# Hits that don't count go before overlaps are resolved.
_valid_cards = f"""valid AS (SELECT * FROM hits
  WHERE pattern <> 'credit_card_generic' OR {luhn_ok("replace(replace(match, ' ', ''), '-', '')")})"""
_new_words = "fresh AS (SELECT * FROM hits2 WHERE match NOT IN ('REDACTED', 'PSEUDONYMIZED'))"

_second_texts = "SELECT record_id, field_path, text FROM once"
_second_hits = (
    rule_hits(_second_texts)
    .replace("texts AS", "texts2 AS").replace("FROM texts)", "FROM texts2)")
    .replace("folds AS", "folds2 AS").replace("FROM folds ", "FROM folds2 ")
    .replace("placed AS", "placed2 AS").replace("FROM placed p JOIN texts t", "FROM placed2 p JOIN texts2 t")
    .replace("hits AS", "hits2 AS")
)
_second_kept = kept("fresh").replace("kept AS", "kept2 AS").replace("FROM kept)", "FROM kept2)").replace("merged AS", "merged2 AS")
_generators = (
    "VALUES "
    + ", ".join(
        f"({r.order}, {quoted(r.name)})" for r in CATALOGUE
    )
)
_sources = "VALUES " + ", ".join(
    f"({quoted(s)}, {quoted(c)}, {quoted(g)})"
    for c, (g, sources) in CATEGORY_SOURCES.items()
    for s in sources
)

EXPECTED: dict[str, str] = {
    # sources and sinks
    "read_json_array": ALL_DOCUMENT_COLUMNS,
    "read_json_lines": ALL_DOCUMENT_COLUMNS,
    "read_csv_typed": "SELECT CAST(doc_id AS INTEGER) AS doc_id, text, lang, source, "
    "CAST(n_chars AS INTEGER) AS n_chars FROM documents",
    "read_csv_strings": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(quality AS VARCHAR) AS quality, "
    "CAST(toxic AS VARCHAR) AS toxic FROM labels",
    "read_zip_archives": r"""SELECT 'part' || (doc_id // 200) || '/' || doc_id || '.txt' AS member,
       regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '^\s+|\s+$', '', 'g') AS text
FROM documents WHERE regexp_matches(text, '\S')""",
    "load_by_extension": ALL_DOCUMENT_COLUMNS,
    "read_tokenized_rows": f"WITH {TOKENS} SELECT {listed('ids')} AS ids_md5, CAST(len(ids) AS INT) AS n_tokens FROM tokens",
    "write_tokenized_splits": f"""WITH {TOKENS}
SELECT CASE WHEN {draw('doc_id')} < {int(0.1 * 2**32)} THEN 'validation' ELSE 'train' END AS split,
       count(*) AS n, CAST(sum(len(ids)) AS BIGINT) AS tokens FROM tokens GROUP BY 1""",
    "write_detection_audit": f"WITH {rule_hits(DOCUMENTS)}, {kept()} SELECT {DETECTION_COLUMNS} FROM merged",
    # schema and fields
    "lower_column_names": ALL_DOCUMENT_COLUMNS,
    "detect_layouts": "SELECT 'DAPT' AS layout, count(*) AS records FROM documents UNION ALL "
    + " UNION ALL ".join(
        f"SELECT '{name}', " + ("count(DISTINCT conv_id)" if whole else "count(*) FILTER (WHERE role = 'user')")
        + " FROM conversations"
        for name, whole in (
            ("ALPACA", False), ("CHATML", True), ("SHARE_GPT", True), ("PROMPT_RESPONSE", False), ("QA", False), ("QLA", False)
        )
    ),
    "extract_fields_nested": """WITH numbered AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n, role, text FROM conversations),
fields AS (
  SELECT conv_id, 2 * n AS place, 'messages[' || n || '].role' AS field_path, role AS text FROM numbered
  UNION ALL SELECT conv_id, 2 * n + 1, 'messages[' || n || '].content', text FROM numbered)
SELECT conv_id AS record_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY place) - 1 AS INT) AS field_ord,
       field_path, text FROM fields WHERE text <> ''""",
    "extract_fields_events": """SELECT event_id AS record_id, CAST(0 AS INT) AS field_ord, 'event_type' AS field_path,
       event_type AS text FROM events UNION ALL
SELECT event_id, CAST(1 AS INT), 'props', props FROM events""",
    "set_fields_nested": NUMBERED_TURNS.format(content="text || ' (' || length(text) || ')'"),
    "preview_sanitized": f"WITH {sanitized(DOCUMENTS, REDACT)} {DOCUMENT_CLEAN} ORDER BY doc_id LIMIT 3",
    # detection
    "detect_rules_documents": f"WITH {rule_hits(DOCUMENTS)} SELECT {DETECTION_COLUMNS} FROM hits",
    "detect_rules_pages": f"WITH {rule_hits(PAGES)} SELECT {DETECTION_COLUMNS} FROM hits",
    "rule_catalogue_hits": f"""WITH {rule_hits(SAMPLED)}, rules(rule_ord, name) AS ({_generators})
SELECT r.rule_ord, r.name, {category_case('r.name')} AS category,
       {category_case('r.name', True)} AS generator, count(h.rule_ord) AS hits
FROM rules r LEFT JOIN hits h ON h.rule_ord = r.rule_ord GROUP BY 1, 2""",
    "detect_external_table": f"WITH {ENTITIES} SELECT {DETECTION_COLUMNS} FROM entities",
    "detect_with_model": r"""WITH found AS (
  SELECT doc_id, regexp_extract_all(text, '\b[A-Z][a-z]+ [A-Z][a-z]+\b') AS m,
         string_split_regex(text, '\b[A-Z][a-z]+ [A-Z][a-z]+\b') AS g FROM documents),
rows AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found),
placed AS (SELECT doc_id, m[i] AS match, list_sum(list_transform(g[1:i], lambda x: length(x)))
  + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start FROM rows)
SELECT doc_id AS record_id, 'text' AS field_path, 'person name' AS pattern, match,
       CAST(start AS INT) AS start, CAST(start + length(match) AS INT) AS "end",
       CAST(0.75 AS DOUBLE) AS score FROM placed""",
    "merge_long_table": f"WITH {rule_hits(DOCUMENTS)}, {kept()} SELECT {DETECTION_COLUMNS} FROM merged",
    "detect_pii_documents": f"WITH {rule_hits(DOCUMENTS)}, {kept()} SELECT {DETECTION_COLUMNS} FROM merged",
    "detect_pii_conversations": f"WITH {rule_hits(TURNS)}, {kept()} SELECT {DETECTION_COLUMNS} FROM merged",
    "detect_pii_hybrid": f"WITH {HYBRID} SELECT {DETECTION_COLUMNS} FROM merged",
    "detect_pii_protected": f"WITH {PROTECTED} SELECT {DETECTION_COLUMNS} FROM merged",
    "split_confidence": f"""WITH {HYBRID}
SELECT CASE WHEN score >= 0.9 THEN 'certain' ELSE 'uncertain' END AS confidence, pattern, count(*) AS hits
FROM merged WHERE score >= 0.5 GROUP BY 1, 2""",
    "organize_detections": f"""WITH {rule_hits(DOCUMENTS)}, {kept()}
SELECT d.doc_id AS record_id, CAST(count(DISTINCT m.field_path) AS INT) AS n_fields,
       coalesce(string_agg(m.start || '-' || m."end" || ':' || m.pattern, ' ' ORDER BY m.start), '') AS listing
FROM documents d LEFT JOIN merged m ON m.record_id = d.doc_id GROUP BY 1""",
    "detection_summary": f"""WITH {rule_hits(DOCUMENTS)}, {kept()}
SELECT {category_case('pattern')} AS category, pattern, count(*) AS hits, count(DISTINCT record_id) AS records
FROM merged GROUP BY 1, 2""",
    "detection_categories": f"""WITH {rule_hits(PAGES)}, {kept()}
SELECT record_id, field_path, start, pattern, {category_case('pattern')} AS category,
       {category_case('pattern', True)} AS generator FROM merged""",
    "source_map_use": f"""WITH {rule_hits(DOCUMENTS)}, known(source, category, generator) AS ({_sources})
SELECT source, category, generator, count(h.pattern) AS hits
FROM known LEFT JOIN hits h ON h.pattern = source GROUP BY 1, 2, 3""",
    # actions
    "redact_minimal": f"WITH {sanitized(DOCUMENTS, REDACT, select_rules(include=MINIMAL_RULES))} {DOCUMENT_CLEAN}",
    "redact_documents": f"""WITH {sanitized(DOCUMENTS, REDACT)}
SELECT d.doc_id, c.text, d.lang, d.source, d.n_chars FROM documents d JOIN clean c ON c.record_id = d.doc_id""",
    "mask_documents": f"WITH {sanitized(DOCUMENTS, MASK)} {DOCUMENT_CLEAN}",
    "mask_pages": f"WITH {sanitized(PAGES, MASK)} {PAGE_CLEAN}",
    "mask_conversations": f"""WITH {sanitized(TURNS, MASK)}
SELECT t.chat_id, t.n, t.role, c.text AS content
FROM ({CHAT_TURNS}) t JOIN clean c ON c.record_id = t.chat_id AND c.field_path = 'messages[' || t.n || '].content'""",
    "redact_luhn": f"""WITH {rule_hits(DOCUMENTS)}, {_valid_cards}, {kept('valid')}
SELECT t.record_id AS doc_id, {spliced(REDACT)} AS text
FROM texts t LEFT JOIN kept k USING (record_id, field_path)""",
    "redact_twice": f"""WITH {sanitized(DOCUMENTS, REDACT)}, once AS (SELECT * FROM clean),
{_second_hits}, {_new_words}, {_second_kept}
SELECT t.record_id AS doc_id, {spliced(REDACT)} AS text
FROM texts2 t LEFT JOIN kept2 k USING (record_id, field_path)""",
    "pseudonymize_documents": f"""WITH RECURSIVE {rule_hits(DOCUMENTS)}, {kept()}, {pseudonyms('demo')},
grouped AS (
  SELECT record_id, field_path, list(struct_pack(s := start, e := "end", v := value) ORDER BY start) AS spans
  FROM made GROUP BY record_id, field_path)
SELECT t.record_id AS doc_id, {spliced('z.v')} AS text
FROM texts t LEFT JOIN grouped g USING (record_id, field_path)""",
    "pseudonym_kinds": "WITH seeds AS (SELECT c_custkey, unnest(kinds) AS kind, "
    "sha256('demo|' || kind || '|' || c_custkey) AS seed FROM customer, (SELECT "
    + "[" + ", ".join(quoted(k) for k in KINDS) + "] AS kinds)), "
    + "made AS (SELECT c_custkey, kind, CASE kind "
    + " ".join(f"WHEN {quoted(k)} THEN {fake_value(k)}" for k in KINDS)
    + " END AS value FROM seeds) SELECT c_custkey, "
    + ", ".join(f"max(value) FILTER (WHERE kind = {quoted(k)}) AS {k}" for k in KINDS)
    + " FROM made GROUP BY 1",
    "pseudonym_shapes": f"""WITH RECURSIVE {rule_hits(DOCUMENTS)}, {kept()}, {pseudonyms('demo')}
SELECT pattern, count(*) AS hits, count(*) FILTER (WHERE value <> '[PSEUDONYMIZED]') AS valid,
       count(*) FILTER (WHERE value = match) AS unchanged FROM made GROUP BY 1""",
    "pseudonym_lengths": "SELECT c_custkey, true AS ssn_ok, true AS license_ok, true AS passport_ok, "
    "true AS api_token_ok, true AS email_ok, true AS uri_ok FROM customer",
    # The matches of a rule, and people and places, are told apart by what replaces them.
    "pseudonym_distinct": f"""WITH {rule_hits(DOCUMENTS)}, {kept()}
SELECT pattern AS kind, count(DISTINCT match) AS originals, count(DISTINCT match) AS pseudonyms
FROM merged WHERE {category_case('pattern', True)} = 'regex' AND pattern NOT IN {SINGLE_VALUED} GROUP BY 1
UNION ALL
SELECT kind, n, n FROM (SELECT unnest(['name', 'organization', 'email', 'address', 'uri']) AS kind,
  (SELECT count(*) FROM customer) + (SELECT count(*) FROM documents) AS n)""",
    "pseudonym_keeps_dates": "SELECT event_id, 'user ' || user_id || ', DOB: ' || strftime(ts, '%d/%m/%Y') || ' .' AS text FROM events",
    "clean_whitespace": r"""SELECT doc_id, regexp_replace(regexp_replace(
  regexp_replace(text, '[\t\n\r\f\v]', ' ', 'g'), '\s{2,}', ' ', 'g'), '^\s+|\s+$', '', 'g') AS text FROM documents""",
    # review
    "review_top": f"WITH {HYBRID}, {queue(0.3, 10)} SELECT {DETECTION_COLUMNS} FROM queue",
    "review_uncapped": f"WITH {HYBRID}, {queue(0.25, None)} SELECT {DETECTION_COLUMNS} FROM queue",
    "review_verdicts": f"WITH {HYBRID}, {queue(1.0, 50)}, {VERIFIED} SELECT {DETECTION_COLUMNS} FROM verified",
    "review_final": f"WITH {HYBRID}, {FINAL} SELECT {DETECTION_COLUMNS} FROM final",
    "sanitize_with_review": f"WITH {HYBRID}, {FINAL}, {cleaned_documents('final', MASK)}",
    "sanitize_unreviewed": f"WITH {HYBRID}, {SURE}, {cleaned_documents('sure', REDACT)}",
    "sanitize_null_key": f"WITH {sanitized(DOCUMENTS, REDACT)} SELECT nullif(record_id, 0) AS doc_id, text FROM clean",
    "apply_found_detections": f"WITH {sanitized(PAGES, REDACT)} {PAGE_CLEAN}",
    # preparation
    "messages_alpaca": two_turns(
        r"coalesce(user_text, '') || CASE WHEN regexp_matches(coalesce(system_text, ''), '\S') "
        "THEN chr(10) || chr(10) || 'Input: ' || system_text ELSE '' END",
        "coalesce(answer, '')",
    ),
    "messages_chatml": NUMBERED_TURNS.format(content="text"),
    "messages_share_gpt": NUMBERED_TURNS.format(content="CASE WHEN role = 'system' THEN '' ELSE text END"),
    "messages_prompt_response": two_turns("coalesce(user_text, '')", "coalesce(answer, '')"),
    "messages_qa": two_turns("coalesce(user_text, '')", "coalesce(answer, '')"),
    "messages_qla": two_turns("coalesce(user_text, '')", "coalesce(answer, '')"),
    "render_conversations": f"WITH {CHATS} SELECT conv_id, rendered FROM chats",
    "render_plain_markers": """SELECT conv_id, '<s>' || string_agg('[' || CASE WHEN role = 'assistant' THEN 'bot' ELSE role END
  || '] ' || text || chr(10), '' ORDER BY turn) AS rendered FROM conversations GROUP BY conv_id""",
    "end_markers": f"""SELECT doc_id, {ended('text')} AS text,
       CASE WHEN text LIKE '%.' THEN text ELSE text || '.' END AS dotted FROM documents""",
    "frame_batches": f"""SELECT doc_id, doc_id // 1000 AS batch, doc_id % 1000 AS in_batch,
       CASE WHEN doc_id % 1000 = 0 THEN '<bos>' || {ended('text')}
            WHEN text LIKE '<bos>%' THEN chr(10) || {ended('text')}
            ELSE chr(10) || '<bos>' || {ended('text')} END AS text FROM documents""",
    "tokenize_documents": f"""WITH tokens AS (SELECT doc_id, {token_ids('text')} AS ids FROM documents)
SELECT doc_id, CAST(len(ids) AS INT) AS n_tokens, {listed('ids')} AS ids_md5 FROM tokens""",
    "tokenize_with_adapter": """WITH codes AS (SELECT conv_id, turn,
  list_transform(string_split(text, ''), lambda c: unicode(c)) AS ids FROM conversations)
SELECT conv_id, turn, CAST(len(ids) AS INT) AS n_tokens, md5(array_to_string(ids, ' ')) AS ids_md5 FROM codes""",
    "tokenize_with_library": "SELECT doc_id, md5(text) AS text_md5 FROM documents",
    "truncate_documents": f"WITH {CUT_TOKENS} SELECT doc_id, {listed('ids')} AS ids_md5, CAST(len(ids) AS INT) AS n_tokens FROM tokens",
    "pack_documents": f"""WITH {framed_tokens()}, {windows(512, 0.0)}
SELECT batch, "window", {listed('ids')} AS ids_md5, CAST(len(ids) AS INT) AS n_tokens FROM packed""",
    "pack_overlapping": f"""WITH {framed_tokens()}, {windows(256, 0.25)}
SELECT batch, "window", {listed('ids')} AS ids_md5, CAST(len(ids) AS INT) AS n_tokens FROM packed""",
    "pack_dropped": f"""WITH {framed_tokens()}
SELECT batch, CAST(sum(len(ids)) AS BIGINT) AS tokens, CAST(sum(len(ids)) % 512 AS BIGINT) AS dropped
FROM framed GROUP BY 1""",
    "token_lengths": f"""WITH tokens AS (SELECT {token_ids('text')} AS ids FROM documents)
SELECT count(*) AS rows, CAST(sum(len(ids)) AS BIGINT) AS tokens, CAST(min(len(ids)) AS INT) AS shortest,
       CAST(max(len(ids)) AS INT) AS longest FROM tokens""",
    "token_progress": f"""WITH {TOKENS},
batches AS (SELECT doc_id // 4 AS batch, max(len(ids)) * count(*) AS tokens FROM tokens GROUP BY 1),
steps AS (SELECT batch // 4 + 1 AS step, CAST(sum(tokens) AS BIGINT) AS tokens FROM batches GROUP BY 1)
SELECT * FROM (SELECT step, tokens, CAST(sum(tokens) OVER (ORDER BY step) AS BIGINT) AS tokens_seen FROM steps)
WHERE step % 5 = 0""",
    "collate_batches": f"""WITH {TOKENS}, wide AS (
  SELECT doc_id // 8 AS batch, doc_id, ids, max(len(ids)) OVER (PARTITION BY doc_id // 8) - len(ids) AS pads FROM tokens)
SELECT batch, doc_id,
       md5(array_to_string(list_concat(ids, list_transform(range(0, pads), lambda k: 0)), ' ')) AS ids_md5,
       md5(array_to_string(list_concat(list_transform(ids, lambda t: 1), list_transform(range(0, pads), lambda k: 0)), ' ')) AS mask_md5,
       md5(array_to_string(list_concat(list_transform(ids, lambda t: CASE WHEN t = 0 THEN -100 ELSE t END),
                                       list_transform(range(0, pads), lambda k: -100)), ' ')) AS labels_md5
FROM wide""",
    "split_by_hash": f"""SELECT *,
  CASE WHEN {draw('doc_id')} < {int(0.1 * 2**32)} THEN 'validation' ELSE 'train' END AS split FROM documents""",
    "split_exact": f"""SELECT *, CASE WHEN row_number() OVER (ORDER BY {draw('doc_id')}, doc_id)
  <= ceil(0.15 * count(*) OVER ()) THEN 'validation' ELSE 'train' END AS split FROM documents""",
    "consecutive_positions": """SELECT *,
  row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS position FROM documents""",
    "prepare_chats": f"""WITH {CHATS}, tokens AS (SELECT conv_id, {token_ids('rendered')}[1:128] AS ids FROM chats)
SELECT CASE WHEN {draw('conv_id')} < {int(0.2 * 2**32)} THEN 'validation' ELSE 'train' END AS split,
       {listed('ids')} AS ids_md5, CAST(len(ids) AS INT) AS n_tokens FROM tokens""",
    "prepare_documents": " UNION ALL ".join(
        f"""SELECT '{name}' AS split, * FROM (WITH part AS (
  SELECT row_number() OVER (ORDER BY {draw('doc_id', '42|order')}, doc_id) - 1 AS place, text FROM documents
  WHERE {draw('doc_id')} {test} {int(0.1 * 2**32)}),
{framed_tokens('part', 'place')}, {windows(512, 0.0)}
SELECT {listed('ids')} AS ids_md5, CAST(len(ids) AS INT) AS n_tokens FROM packed)"""
        for name, test in (("train", ">="), ("validation", "<"))
    ),
    "shuffle_documents": f"""SELECT doc_id,
  row_number() OVER (ORDER BY {draw('doc_id', '7|order')}, doc_id) - 1 AS position FROM documents""",
    "prepare_counts": " UNION ALL ".join(
        f"""SELECT '{name}' AS split, * FROM (WITH part AS (
  SELECT row_number() OVER (ORDER BY {draw('doc_id', '42|order')}, doc_id) - 1 AS place, text FROM documents
  WHERE text IS NOT NULL AND {draw('doc_id')} {test} {int(0.1 * 2**32)}),
{framed_tokens('part', 'place')},
sizes AS (SELECT batch, sum(len(ids)) AS tokens FROM framed GROUP BY 1)
SELECT (SELECT count(*) FROM documents WHERE {draw('doc_id')} {test} {int(0.1 * 2**32)}) AS records,
       (SELECT count(*) FROM documents WHERE text IS NULL AND {draw('doc_id')} {test} {int(0.1 * 2**32)}) AS left_out,
       CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(tokens % 512) AS BIGINT) AS dropped FROM sizes)"""
        for name, test in (("train", ">="), ("validation", "<"))
    ),
    # Ids of a vocabulary stand for the whole text.
    "tokenize_vocabulary": "SELECT doc_id, md5(text) AS text_md5, true AS shorter FROM documents",
    "redact_stream": f"WITH {sanitized(DOCUMENTS, REDACT)} {DOCUMENT_CLEAN}",
}

EXPECTED["review_stream"] = EXPECTED["sanitize_with_review"]
EXPECTED["detect_incremental_documents"] = EXPECTED["detect_pii_documents"]
