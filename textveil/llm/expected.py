"""DuckDB SQL with the expected rows of the queries that SQL can express."""

from __future__ import annotations

#: Sums of a level's groups: mean, and the strength of the prior that they estimate.
_STRENGTH = """
{name}_sums AS (
  SELECT count(*) AS g, sum(n)::DOUBLE AS n, sum(good) / sum(n) AS mean, sum(n::DOUBLE * n) AS squares,
         sum(good::DOUBLE * good / n) AS between_groups
  FROM {source} WHERE n > 0
),
{name}_moments AS (
  SELECT mean, CASE WHEN mean * (1 - mean) = 0 OR n - squares / n - (g - 1) <= 0 THEN 0.001::DOUBLE
    ELSE least(greatest(((between_groups - n * mean * mean) / (mean * (1 - mean)) - (g - 1)) / (n - squares / n - (g - 1)), 0.001), 0.999)
    END AS correlation
  FROM {name}_sums
),
{name}_prior AS (SELECT mean, (1 - correlation) / correlation AS strength FROM {name}_moments)"""

URL_FILTERS = f"""
WITH parts AS (
  SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
),
cut AS (SELECT page_id, html, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM parts),
hosted AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path,
         CASE WHEN html IS NULL THEN NULL ELSE len(regexp_extract_all(html, '[#*$%]{{3}}')) < 5 END AS outcome
  FROM cut
),
named AS (
  SELECT host, count(outcome) AS n, count(CASE WHEN outcome THEN 1 END) AS good,
         regexp_replace(regexp_replace(string_split(host, '@')[-1], ':[0-9]*$', ''), '[.]$', '') AS name
  FROM hosted GROUP BY host
),
labelled AS (
  SELECT *, regexp_matches(name, '^[0-9.]+$|^\\[') AS address, string_split(name, '.') AS labels,
         CASE WHEN regexp_matches(name, '[^.][.](ac|co|com|edu|gov|gob|go|mil|ne|net|nom|or|org)[.][a-z][a-z]$') THEN 1 ELSE 0 END AS more
  FROM named
),
hosts AS (
  SELECT host, n, good,
         CASE WHEN address THEN '' ELSE array_to_string(labels[greatest(1, len(labels) - more):], '.') END AS suffix,
         CASE WHEN address THEN name ELSE array_to_string(labels[greatest(1, len(labels) - more - 1):], '.') END AS domain
  FROM labelled
),
domains AS (SELECT domain, min(suffix) AS suffix, sum(n) AS n, sum(good) AS good FROM hosts GROUP BY domain),
suffixes AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM hosts GROUP BY suffix),
{_STRENGTH.format(name="host", source="hosts")},
{_STRENGTH.format(name="domain", source="domains")},
{_STRENGTH.format(name="suffix", source="suffixes")},
suffix_means AS (
  SELECT suffix, (good + mean * strength) / (n + strength) AS prior FROM suffixes CROSS JOIN suffix_prior
),
domain_means AS (
  SELECT d.domain, (d.good + s.prior * p.strength) / (d.n + p.strength) AS prior
  FROM domains d JOIN suffix_means s USING (suffix) CROSS JOIN domain_prior p
),
posterior AS (
  SELECT h.host, h.n + p.strength + 1 AS total, (h.good + d.prior * p.strength) / (h.n + p.strength) AS mean
  FROM hosts h JOIN domain_means d USING (domain) CROSS JOIN host_prior p
),
ruled AS (
  SELECT page_id, host, path, CASE
    WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule
  FROM hosted
)
SELECT page_id, r.host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN mean + 1.645 * sqrt(mean * (1 - mean) / total) < 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled r JOIN posterior q ON q.host = r.host
"""

TOOL_CHAT = """
WITH turns AS (
  SELECT conv_id, turn, role, text, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM conversations
),
calls AS (
  SELECT conv_id, turn, conv_id || '-' || turn AS call_id, t, n,
         ['search', 'translate', 'summarize', 'search', 'search', 'translate', 'summarize', 'lookup'][n % 8 + 1] AS tool,
         CASE WHEN turn >= 4 AND turn % 4 = 0 THEN [conv_id || '-' || (turn - 2), conv_id || '-' || (turn - 4)]
              WHEN turn >= 2 THEN [conv_id || '-' || (turn - 2)] ELSE [] END AS uses
  FROM turns WHERE role = 'user'
),
results AS (SELECT conv_id, turn, conv_id || '-' || (turn - 1) AS call_id, t FROM turns WHERE role = 'assistant'),
judged AS (
  SELECT c.*, r.call_id IS NOT NULL AS answered, r.t AS content,
    CASE WHEN tool = 'lookup' AND n % 17 <> 0 THEN 'unknown tool'
         WHEN n % 17 = 0 THEN 'arguments are no JSON object'
         WHEN n % 13 = 0 THEN 'text is missing'
         WHEN n % 11 = 0 THEN 'limit is no integer'
         WHEN n % 7 = 0 THEN 'now is not known' ELSE '' END AS errors,
    CASE WHEN n % 17 = 0 THEN NULL
         WHEN n % 13 = 0 THEN '{"limit":' || (n % 50) || '}'
         WHEN n % 11 = 0 THEN '{"limit":"many","text":' || to_json(c.t) || '}'
         WHEN n % 7 = 0 THEN '{"limit":' || (n % 50) || ',"now":true,"text":' || to_json(c.t) || '}'
         ELSE '{"limit":' || (n % 50) || ',"text":' || to_json(c.t) || '}' END AS arguments
  FROM calls c LEFT JOIN results r USING (call_id)
)
SELECT conv_id, turn, 'call' AS kind, call_id, tool, turn AS place,
  CASE WHEN errors = 'unknown tool' THEN errors WHEN errors <> '' THEN 'invalid arguments'
       WHEN NOT answered THEN 'no result' ELSE 'ok' END AS status,
  CASE WHEN answered THEN 1 ELSE 0 END::BIGINT AS n_results, errors,
  '{' || coalesce('"arguments":' || arguments || ',', '')
      || CASE WHEN len(uses) > 0 THEN '"after":' || replace(to_json(list_sort(uses))::VARCHAR, ' ', '') || ',' ELSE '' END
      || '"id":"' || call_id || '"' || CASE WHEN answered THEN ',"result":' || to_json(content) ELSE '' END
      || ',"tool":"' || tool || '"}' AS json
FROM judged
UNION ALL
SELECT conv_id, turn, 'result', call_id, NULL, NULL, 'no call', NULL, NULL,
  '{"id":"' || call_id || '","result":' || to_json(t) || '}'
FROM results WHERE call_id NOT IN (SELECT call_id FROM calls)
UNION ALL
SELECT conv_id, turn, 'message', NULL, NULL, NULL, 'ok', NULL, NULL,
  '{' || coalesce('"content":' || to_json(text) || ',', '') || '"role":"' || role || '"}'
FROM turns WHERE role NOT IN ('user', 'assistant')
"""

def _joined(name: str, steps: range) -> str:
    """The strings ``name`` at this place and so many places on, one after the other."""
    return " || ".join(f"lead({name}, {n}) OVER w" if n else name for n in steps)


#: Strings of 8, 64 and 200 bytes, the longer ones put together from shorter ones.
SUFFIX_DEDUP = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(hex(coalesce(text, '')), '..') AS b FROM documents),
bytes AS (SELECT r, unnest(generate_series(1, len(b))) AS p, unnest(b) AS b FROM docs),
eights AS (SELECT r, p, b, {_joined("b", range(8))} AS g FROM bytes WINDOW w AS (PARTITION BY r ORDER BY p)),
blocks AS (SELECT r, p, b, g, md5({_joined("g", range(0, 64, 8))}) AS h FROM eights WINDOW w AS (PARTITION BY r ORDER BY p)),
strings AS (
  SELECT r, p, b, md5({_joined("h", range(0, 192, 64))} || lead(g, 192) OVER w) AS name FROM blocks WINDOW w AS (PARTITION BY r ORDER BY p)
),
repeated AS (SELECT r, p, b, CASE WHEN name IS NOT NULL AND count(*) OVER (PARTITION BY name) > 1 THEN p END AS start FROM strings),
judged AS (
  SELECT r, p, b, coalesce(max(start) OVER (PARTITION BY r ORDER BY p) > p - 200, false) AS gone FROM repeated
),
edged AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY p), false) AS first FROM judged),
kept AS (
  SELECT r, count(CASE WHEN gone THEN 1 END) AS n_removed, count(CASE WHEN first THEN 1 END) AS n_spans,
         string_agg(CASE WHEN NOT gone THEN b END, '' ORDER BY p) AS rest
  FROM edged GROUP BY r
)
SELECT doc_id, len(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(rest, ''))) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""

QUALITY_RULES = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
texts AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM docs),
words AS (SELECT r, unnest(generate_series(1, len(w))) AS p, unnest(w) AS word FROM texts),
sized AS (SELECT r, p, length(word) AS chars FROM words),
lines AS (
  SELECT r, i, line, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars
  FROM (SELECT r, unnest(generate_series(1, len(l))) AS i, unnest(l) AS line FROM (SELECT r, string_split(t, chr(10)) AS l FROM texts))
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
),
later AS (SELECT r, chars, row_number() OVER (PARTITION BY r, line ORDER BY i) > 1 AS again FROM lines),
repeats AS (
  SELECT r, count(*) AS n_dup_lines, sum(chars)::BIGINT AS dup_line_chars FROM later WHERE again GROUP BY r
),
starts AS (
  SELECT r, n, unnest(generate_series(1, len(w) - n + 1)) AS p, w FROM texts, (SELECT unnest([5, 6, 7, 8, 9, 10]) AS n)
  WHERE len(w) >= n
),
grams AS (SELECT r, n, p, md5(array_to_string(w[p:p + n - 1], ' ')) AS gram FROM starts),
twice AS (SELECT r, n, p FROM grams QUALIFY count(*) OVER (PARTITION BY r, n, gram) > 1),
hit AS (SELECT DISTINCT r, n, unnest(generate_series(p, p + n - 1)) AS p FROM twice),
covered AS (
  SELECT r, count(CASE WHEN n = 8 THEN 1 END) AS n_repeat_words,
         sum(CASE WHEN n = 5 THEN chars END) AS c5, sum(CASE WHEN n = 6 THEN chars END) AS c6,
         sum(CASE WHEN n = 7 THEN chars END) AS c7, sum(CASE WHEN n = 8 THEN chars END) AS c8,
         sum(CASE WHEN n = 9 THEN chars END) AS c9, sum(CASE WHEN n = 10 THEN chars END) AS c10
  FROM hit JOIN sized USING (r, p) GROUP BY r
),
chars AS (SELECT r, sum(chars) AS word_chars FROM sized GROUP BY r),
measured AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(dup_line_chars, 0)::BIGINT AS dup_line_chars,
         coalesce(c5, 0)::BIGINT AS dup_chars_5, coalesce(c6, 0)::BIGINT AS dup_chars_6, coalesce(c7, 0)::BIGINT AS dup_chars_7,
         coalesce(c8, 0)::BIGINT AS dup_chars_8, coalesce(c9, 0)::BIGINT AS dup_chars_9, coalesce(c10, 0)::BIGINT AS dup_chars_10
  FROM texts LEFT JOIN chars USING (r) LEFT JOIN repeats USING (r) LEFT JOIN covered USING (r)
),
based AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured)
SELECT *, NOT base_failed AND 100 * dup_line_chars <= 30 * word_chars AND 100 * n_symbols <= 10 * word_chars
  AND 100 * dup_chars_5 <= 40 * word_chars AND 100 * dup_chars_6 <= 38 * word_chars AND 100 * dup_chars_7 <= 36 * word_chars
  AND 100 * dup_chars_8 <= 34 * word_chars AND 100 * dup_chars_9 <= 32 * word_chars AND 100 * dup_chars_10 <= 30 * word_chars AS kept
FROM based
"""

#: ``w``, the words of a text for comparison with the benchmark.
_TEST_WORDS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

DECONTAMINATION = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_TEST_WORDS} AS w FROM documents),
tests AS (SELECT row_number() OVER () AS t, item_id, {_TEST_WORDS} AS w FROM benchmark),
test_starts AS (
  SELECT t, item_id, least(13, len(w)) AS n, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS q FROM tests WHERE len(w) > 0
),
test_windows AS (SELECT t, item_id, n, q, md5(array_to_string(w[q:q + n - 1], ' ')) AS name FROM test_starts),
lengths AS (SELECT DISTINCT n FROM test_windows),
doc_starts AS (
  SELECT r, n, w, unnest(generate_series(1, len(w) - n + 1)) AS p FROM docs, lengths WHERE len(w) >= n
),
doc_windows AS (SELECT r, n, p, md5(array_to_string(w[p:p + n - 1], ' ')) AS name FROM doc_starts),
found AS (SELECT r, n, p, t, item_id, q FROM doc_windows JOIN test_windows USING (n, name)),
hits AS (
  SELECT r, count(*) AS n_hit FROM (
    SELECT DISTINCT r, unnest(generate_series(p, p + n - 1)) AS p FROM (SELECT DISTINCT r, n, p FROM found)
  ) GROUP BY r
),
items AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, coalesce(item_id::VARCHAR, 'null') AS id FROM found) GROUP BY r
),
runs AS (
  SELECT r, n, p, p - row_number() OVER (PARTITION BY r, t, n, p - q ORDER BY p) AS run, t, p - q AS line FROM found
),
longest AS (
  SELECT r, max(size) AS longest_match FROM (SELECT r, count(*) + n - 1 AS size FROM runs GROUP BY r, t, n, line, run) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated,
       coalesce(longest_match, 0)::BIGINT AS longest_match
FROM docs LEFT JOIN hits USING (r) LEFT JOIN items USING (r) LEFT JOIN longest USING (r)
"""

SUBSTRING_DEDUP = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT r, w, unnest(generate_series(1, len(w) - 34)) AS p FROM docs WHERE len(w) >= 35),
windows AS (SELECT r, p, md5(array_to_string(w[p:p + 34], ' ')) AS name FROM starts),
repeated AS (SELECT r, p AS start FROM windows QUALIFY count(*) OVER (PARTITION BY name) > 1),
words AS (SELECT r, unnest(generate_series(1, len(w))) AS p, unnest(w) AS word FROM docs),
judged AS (
  SELECT w.r, w.p, word, coalesce(max(start) OVER (PARTITION BY w.r ORDER BY w.p) > w.p - 35, false) AS gone
  FROM words w LEFT JOIN repeated s ON s.r = w.r AND s.start = w.p
),
kept AS (
  SELECT r, count(CASE WHEN gone THEN 1 END) AS n_removed, string_agg(CASE WHEN NOT gone THEN word END, ' ' ORDER BY p) AS rest
  FROM judged GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""

WARC = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS size FROM pages),
tops AS (SELECT *, CASE WHEN size >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS top FROM payloads)
SELECT page_id, size AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN top IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN top IS DISTINCT FROM page_id THEN top END AS refers_to, NULL::VARCHAR AS problem
FROM tops
"""



def _vector_round(n: int) -> str:
    """Assignment ``near{n}`` to the entries ``books{n}``, and the entries after it."""
    return f"""
distances{n} AS (
  SELECT r, part, entry, sum((c.v - b.v) * (c.v - b.v))::BIGINT AS d FROM cells c JOIN books{n} b USING (part, place) GROUP BY r, part, entry
),
near{n} AS (
  SELECT r, part, entry, d FROM distances{n} QUALIFY row_number() OVER (PARTITION BY r, part ORDER BY d, entry) = 1
),
means{n} AS (
  SELECT part, entry, place, floor(sum(v) / count(*)::DOUBLE)::BIGINT AS v FROM near{n} JOIN cells USING (r, part) GROUP BY part, entry, place
),
books{n + 1} AS (
  SELECT part, entry, place, coalesce(m.v, b.v) AS v FROM books{n} b LEFT JOIN means{n} m USING (part, entry, place)
),"""


VECTOR_CODES = f"""
WITH finite AS (
  SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id) AS r,
         len(embedding) = first_value(len(embedding)) OVER (ORDER BY vec_id) AS fits
  FROM embeddings
  WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND isfinite(coalesce(list_sum(embedding::DOUBLE[]), 0))
),
spread AS (
  SELECT r, len(embedding) // 16 AS size, unnest(generate_series(0, len(embedding) - 1)) AS j, unnest(embedding)::DOUBLE AS x FROM finite WHERE fits
),
cells AS (SELECT r, j // size AS part, j % size AS place, floor(256 * x)::BIGINT AS v FROM spread),
books0 AS (SELECT part, dense_rank() OVER (ORDER BY r) - 1 AS entry, place, v FROM cells QUALIFY dense_rank() OVER (ORDER BY r) <= 64),
{"".join(_vector_round(n) for n in range(3))}
coded AS (SELECT r, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near2 GROUP BY r),
digest AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM books2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN finite USING (r) CROSS JOIN digest
"""

EXPECTED: dict[str, str] = {
    "op1_suffix_dedup": SUFFIX_DEDUP,
    "op2_quality_rules": QUALITY_RULES,
    "op3_decontamination": DECONTAMINATION,
    "op5_substring_dedup": SUBSTRING_DEDUP,
    "op10_warc": WARC,
    "op11_vector_codes": VECTOR_CODES,
    "op6_url_filters": URL_FILTERS,
    "op7_tool_chat": TOOL_CHAT,
}
