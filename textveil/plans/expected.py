"""The same answers in DuckDB SQL, for checking the Spark queries.

DuckDB's regular expressions know ASCII word characters only and have no
look-ahead. Accented letters are therefore folded to ``_`` (same length) before a
rule runs, and the rules with look-ahead run without it and are filtered.
"""

from __future__ import annotations

from textveil.functions import pools
from textveil.functions.rules import CATALOGUE, CATEGORY_SOURCES, Rule, source_generators
from textveil.operators import pseudonym
from textveil.operators.tokens import Codec

FOLDED = r"[\x{00C0}-\x{024F}]"
# Rule pattern without look-ahead, and the condition that replaces it.
NO_LOOKAHEAD = {
    "national_ids_us_ssn": (
        r"\b\d{3}-\d{2}-\d{4}\b",
        "substr(match, 1, 1) <> '9' AND substr(match, 1, 3) NOT IN ('000', '666') "
        "AND substr(match, 5, 2) <> '00' AND substr(match, 8, 4) <> '0000'",
    ),
    "national_ids_uk_nino": (
        r"(?i)\b[A-CEGHJ-PR-TW-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]?\b",
        "upper(substr(match, 1, 2)) NOT IN ('BG', 'GB', 'NK', 'KN', 'TN', 'NT', 'ZZ')",
    ),
}

DOCUMENTS = "SELECT doc_id AS record_id, 'text' AS field_path, text FROM documents"
PAGES = (
    "SELECT page_id AS record_id, 'url' AS field_path, url AS text FROM pages "
    "UNION ALL SELECT page_id, 'html', html FROM pages"
)
# Messages of all conversations and, line by line, of all documents.
CHAT_TURNS = """SELECT 'c' || conv_id AS chat_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS n,
       role, text AS content FROM conversations
UNION ALL
SELECT 'd' || doc_id, CAST(i - 1 AS INT), CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END, lines[i]
FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
      FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))"""
TURNS = (
    f"SELECT chat_id AS record_id, 'messages[' || n || '].content' AS field_path, content AS text FROM ({CHAT_TURNS})"
)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rule_hits(texts: str, rules: list[Rule] = CATALOGUE) -> str:
    """CTEs ``texts`` and ``hits(record_id, field_path, rule_ord, pattern, match,
    start, "end", score)``."""
    branches = []
    for rule in rules:
        regex, keep = NO_LOOKAHEAD.get(rule.name, (rule.regex, "true"))
        # A rule whose classes hold the fold character reads the text unfolded.
        source = "text" if "_" in regex else "folded"
        branches.append(
            f"SELECT record_id, field_path, {rule.order} AS rule_ord, '{rule.name}' AS pattern, "
            f"found, starts, i FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM ("
            f"SELECT record_id, field_path, text, "
            f"regexp_extract_all({source}, {quoted(regex)}) AS found, "
            f"string_split_regex({source}, {quoted(regex)}) AS gaps, "
            f"list_transform(range(1, len(found) + 1), lambda k: "
            f"list_sum(list_transform(gaps[1:k], lambda g: length(g))) "
            f"+ coalesce(list_sum(list_transform(found[1:k - 1], lambda m: length(m))), 0)) AS starts "
            f"FROM folds WHERE regexp_matches({source}, {quoted(regex)}))) "
            f"CROSS JOIN (SELECT 1) WHERE {keep.replace('match', 'found[i]')}"
        )
    union = "\nUNION ALL ".join(branches)
    return f"""texts AS ({texts}),
folds AS (SELECT *, regexp_replace(text, '{FOLDED}', '_', 'g') AS folded FROM texts),
placed AS ({union}),
hits AS (
  SELECT record_id, field_path, p.rule_ord, p.pattern,
         substr(t.text, CAST(starts[i] AS BIGINT) + 1, length(found[i])) AS match,
         CAST(starts[i] AS INT) AS start, CAST(starts[i] + length(found[i]) AS INT) AS "end",
         CAST(1.0 AS DOUBLE) AS score
  FROM placed p JOIN texts t USING (record_id, field_path))"""


def kept(source: str = "hits") -> str:
    """CTE ``kept(record_id, field_path, spans)`` after overlap resolution."""
    return f"""kept AS (
  SELECT record_id, field_path, list_reduce(
    list_transform(list(struct_pack(s := start, e := "end", o := rule_ord, p := pattern,
                                    m := match, c := score)
                        ORDER BY start, "end" DESC, rule_ord, match, score, pattern),
                   lambda x: [x]),
    lambda a, x: CASE
      WHEN x[1].s >= a[-1].e THEN list_concat(a, x)
      WHEN x[1].e - x[1].s > a[-1].e - a[-1].s
        OR (x[1].e - x[1].s = a[-1].e - a[-1].s AND x[1].c > a[-1].c)
      THEN list_concat(a[:-2], x) ELSE a END) AS spans
  FROM {source} GROUP BY record_id, field_path),
merged AS (
  SELECT record_id, field_path, z.o AS rule_ord, z.p AS pattern, z.m AS match,
         z.s AS start, z.e AS "end", z.c AS score
  FROM (SELECT record_id, field_path, unnest(spans) AS z FROM kept))"""


DETECTION_COLUMNS = 'record_id, field_path, rule_ord, pattern, match, start, "end", score'


def spliced(replacement: str, spans: str = "spans") -> str:
    """Text with its spans replaced; ``replacement`` sees one span as ``z``."""
    before = f"(CASE WHEN i = 1 THEN 0 ELSE {spans}[i - 1].e END)"
    new = replacement.replace("z.", f"{spans}[i].")
    return (
        f"CASE WHEN {spans} IS NULL THEN text ELSE array_to_string(list_transform("
        f"range(1, len({spans}) + 1), lambda i: substr(text, {before} + 1, {spans}[i].s - {before}) "
        f"|| {new}), '') || substr(text, {spans}[-1].e + 1) END"
    )


REDACT = "'[REDACTED]'"
MASK = "'[' || upper(z.p) || ']'"


def sanitized(texts: str, action: str, rules: list[Rule] = CATALOGUE) -> str:
    """CTEs ending in ``clean(record_id, field_path, text)``."""
    return f"""{rule_hits(texts, rules)}, {kept()},
clean AS (SELECT t.record_id, t.field_path, {spliced(action)} AS text
          FROM texts t LEFT JOIN kept k USING (record_id, field_path))"""


def category_case(column: str, generator: bool = False) -> str:
    cases = [
        f"WHEN {column} IN ({', '.join(quoted(s) for s in sources)}) "
        f"THEN {quoted(kind if generator else category)}"
        for category, (kind, sources) in CATEGORY_SOURCES.items()
    ]
    return f"CASE {' '.join(cases)} END"


def _pick(part: str, n: int, seed: str = "seed") -> str:
    return f"CAST('0x' || substr(sha256({seed} || '|{part}'), 1, 8) AS BIGINT) % {n}"


def _choice(part: str, values: list[str]) -> str:
    return f"[{', '.join(quoted(v) for v in values)}][1 + {_pick(part, len(values))}]"


def _byte(stream: str) -> str:
    return f"CAST('0x' || substr({stream}, 2 * k - 1, 2) AS INT)"


def _shape(shape: str, part: str) -> str:
    """Characters of a shape drawn by the pairs of one digest."""
    abc = (
        "(CASE substr({s}, k, 1) WHEN '#' THEN '0123456789' WHEN 'N' THEN '23456789' WHEN 'M' THEN '6789' "
        "WHEN '?' THEN 'ABCDEFGHJKLMNPRSTUWXYZ' WHEN 'x' THEN '0123456789abcdef' "
        "WHEN '*' THEN 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789' ELSE substr({s}, k, 1) END)"
    ).format(s=shape)
    digest = f"sha256(seed || '|{part}')"
    return (
        f"array_to_string(list_transform(range(1, length({shape}) + 1), "
        f"lambda k: substr({abc}, 1 + {_byte(digest)} % length({abc}), 1)), '')"
    )


def _locale(field: str) -> str:
    """A field of the locale drawn by the column ``seed``."""
    listed = ", ".join(
        "{"
        + ", ".join(
            f"'{f}': " + (quoted(v) if isinstance(v, str) else "[" + ", ".join(map(quoted, v)) + "]")
            for f, v in locale._asdict().items()
        )
        + "}"
        for locale in pools.LOCALES
    )
    return f"([{listed}][1 + {_pick('locale', len(pools.LOCALES))}]).{field}"


def _syllables(part: str, count: int) -> str:
    """Syllables drawn by the bytes of one digest: a consonant and a vowel each."""
    byte = _byte(f"sha256(seed || '|{part}')")
    return (
        f"array_to_string(list_transform(range(1, {count + 1}), lambda k: "
        f"substr({_locale('c')}, 1 + {byte} % 16, 1) || substr({_locale('v')}, 1 + {byte} // 16 % 4, 1)), '')"
    )


def _ending(part: str, field: str) -> str:
    return f"({_locale(field)})[1 + {_pick(part, pools.LISTED)}]"


def _capital(word: str) -> str:
    return f"upper(substr({word}, 1, 1)) || substr({word}, 2)"


def fake_value(kind: str) -> str:
    """A generated value of one kind for the column ``seed``."""
    first, last = _syllables("first", 4), f"({_syllables('last', 5)} || {_ending('end', 'surnames')})"
    town = f"({_syllables('town', 3)} || {_ending('townend', 'towns')})"
    area = f"(1 + {_pick('area', 898)})"
    return {
        "name": f"{_capital(first)} || ' ' || {_capital(last)}",
        "organization": f"{_capital(_syllables('stem', 4))} || ' ' || {_capital(_syllables('more', 4))} || ' ' || "
        f"{_choice('end', pools.COMPANY_ENDS)}",
        "email": f"{first} || '.' || {last} || (1 + {_pick('no', 9999)}) || '@' || {_choice('host', pools.MAIL_HOSTS)}",
        "phone": _shape(_choice("shape", pools.PHONE_SHAPES), "digit"),
        "address": f"(1 + {_pick('house', 999)}) || ' ' || {_capital(_syllables('street', 4))} || ' ' || "
        f"{_ending('road', 'roads')} || ', ' || {_capital(town)} || {_ending('region', 'regions')} || ' ' || "
        f"{_shape(_locale('post'), 'post')}",
        "ssn": f"lpad(CAST(CASE WHEN {area} >= 666 THEN {area} + 1 ELSE {area} END AS VARCHAR), 3, '0') || '-' || "
        f"lpad(CAST(1 + {_pick('group', 99)} AS VARCHAR), 2, '0') || '-' || "
        f"lpad(CAST(1 + {_pick('serial', 9999)} AS VARCHAR), 4, '0')",
        "uri": f"'https://' || {_choice('host', pools.MAIL_HOSTS)} || '/' || {_syllables('word', 6)} || '/' || "
        f"{_pick('no', 99999)}",
        "license": _shape("repeat('*', 15)", "licence"),
        "passport": _shape("repeat('*', 9)", "passport"),
        "api_token": _shape("repeat('x', 32)", "token"),
    }[kind]


def _classes() -> str:
    """CTEs from ``keyed`` to ``sorted_out(…, classes)``: the sign of each character's class."""
    signs = {c: sign for sign in "DUVWuv" for c in pseudonym.CLASSES[sign]} | {"Q": "="}
    letters = ", ".join(map(quoted, pseudonym.KEPT_LETTERS))
    octet = (
        "CASE WHEN o LIKE '25_' THEN '==H' WHEN o LIKE '2__' THEN '=JD' WHEN o LIKE '___' THEN 'BDD' "
        "ELSE repeat('D', length(o)) END"
    )

    def changed(test: str) -> str:
        one = "substr(general, k, 1)"
        return (
            f"array_to_string(list_transform(range(1, length(general) + 1), lambda k: "
            f"CASE WHEN {test} THEN '=' ELSE {one} END), '')"
        )

    spots = " ".join(
        f"WHEN {quoted(n)} THEN {changed(f'k IN ({", ".join(map(str, p))})')}" for n, p in pseudonym.KEPT_POSITIONS.items()
    )
    digits = " ".join(
        f"WHEN {quoted(n)} THEN " + changed(f"substr(general, k, 1) = 'D' AND k IN ({', '.join(map(str, p))})")
        for n, p in pseudonym.KEPT_DIGITS.items()
    )
    inside = " ".join(
        f"WHEN pattern = {quoted(n)} AND instr(shape, {quoted(t)}) > 0 THEN "
        f"substr(spotted, 1, instr(shape, {quoted(t)}) - 1) || repeat('=', {len(t)}) || "
        f"substr(spotted, instr(shape, {quoted(t)}) + {len(t)})"
        for n, t in pseudonym.KEPT_INSIDE.items()
    )
    return f"""generals AS (
  SELECT *, CASE WHEN pattern IN ({letters}) THEN regexp_replace(plain, '[^D]', '=', 'g') ELSE plain END AS general
  FROM (SELECT *, regexp_replace(translate(shape, {quoted(''.join(signs))}, {quoted(''.join(signs.values()))}),
                                 '[^DUVWuv]', '=', 'g') AS plain FROM keyed)),
spotted AS (
  SELECT *, CASE pattern WHEN 'ip_ipv4' THEN array_to_string(list_transform(string_split(shape, '.'), lambda o: {octet}), '=')
    {spots} {digits} ELSE general END AS spotted FROM generals),
inner_ones AS (SELECT *, CASE {inside} ELSE spotted END AS inside FROM spotted),
sorted_out AS (
  SELECT pattern, match, shape, permkey, length(shape) // 2 AS middle,
         substr(begun, 1, length(begun) - tail) || repeat('=', tail) AS classes
  FROM (SELECT *, repeat('=', front) || substr(inside, front + 1) AS begun FROM inner_ones))"""


def _round(r: int, source: str) -> str:
    """One round over the column ``s``."""
    if r % 2 == 0:
        part, mine, other = "substr(s, 1, middle)", "substr(classes, 1, middle)", "substr(s, middle + 1)"
    else:
        part, mine, other = "substr(s, middle + 1)", "substr(classes, middle + 1)", "substr(s, 1, middle)"
    alphabet = " ".join(f"WHEN '{sign}' THEN '{chars}'" for sign, chars in pseudonym.CLASSES.items())
    abc, h = f"(CASE substr(mine, k, 1) {alphabet} ELSE '' END)", "substr(part, k, 1)"
    moved = (
        f"array_to_string(list_transform(range(1, length(part) + 1), lambda k: CASE WHEN instr({abc}, {h}) = 0 THEN {h} "
        f"ELSE substr({abc}, 1 + (instr({abc}, {h}) - 1 + {_byte('stream')}) % length({abc}), 1) END), '')"
    )
    whole = f"{moved} || other" if r % 2 == 0 else f"other || {moved}"
    return f"""SELECT pattern, match, shape, permkey, middle, classes, i, {whole} AS s FROM (
  SELECT *, array_to_string(list_transform(range(0, greatest(length(part) - 1, 0) // 32 + 1),
      lambda b: sha256(permkey || '|{r}|' || b || '|' || other)), '') AS stream
  FROM (SELECT *, {part} AS part, {mine} AS mine, {other} AS other FROM ({source})))"""


def pseudonyms(salt: str) -> str:
    """CTE ``made(… of merged, value)`` with the replacement of each detection. Needs
    ``WITH RECURSIVE``."""
    starts = " ".join(f"WHEN {quoted(n)} THEN {k}" for n, k in pseudonym.KEPT_START.items())
    openings = " ".join(
        f"WHEN {quoted(n)} THEN length(regexp_extract(match, {quoted(rx)}))"
        for n, rx in pseudonym.KEPT_OPENING.items()
    )
    ends = " ".join(f"WHEN {quoted(n)} THEN {len(e)}" for n, e in pseudonym.KEPT_ENDING.items())
    cuts = ", ".join(
        f"regexp_replace(match, '([A-Za-z0-9+/=_-]{{{k}}})[A-Za-z0-9+/=_-]+', '\\1', 'g')" for k in (64, 40, 24, 16)
    )
    shorter = f"CASE WHEN length(match) <= 200 THEN match ELSE list_filter([{cuts}], lambda c: length(c) <= 200)[1] END"
    rules = [r for r in CATALOGUE if source_generators().get(r.name) == "regex"]
    accepted = " ".join(
        f"WHEN {quoted(r.name)} THEN regexp_full_match(s, {quoted(NO_LOOKAHEAD.get(r.name, (r.regex,))[0])})"
        for r in rules
    )
    known = ", ".join(quoted(r.name) for r in rules)
    step = f"SELECT *, made AS s FROM walk WHERE NOT ok AND i < {pseudonym.STEPS}"
    for r in range(pseudonym.ROUNDS):
        step = _round(r, step)
    key = f"'-----BEGIN ' || {_choice('key', pseudonym.KEY_KINDS)} || ' PRIVATE KEY-----'"
    kinds = " ".join(
        f"WHEN {quoted(k)} THEN {fake_value(k)}" for k in ("name", "organization", "email", "phone", "address", "ssn")
    )
    return f"""seeded AS (
  SELECT *, {category_case('pattern', True)} AS kind,
         sha256(concat_ws('|', {quoted(salt)}, {category_case('pattern')}, match)) AS seed FROM merged),
keyed AS (
  SELECT *, sha256(concat_ws('|', {quoted(salt)}, pattern, CASE WHEN shape = match THEN '' ELSE sha256(match) END)) AS permkey
  FROM (SELECT DISTINCT pattern, match, CASE pattern {starts} {openings} ELSE 0 END AS front,
               CASE pattern {ends} ELSE 0 END AS tail, {shorter} AS shape
        FROM seeded WHERE kind = 'regex' AND pattern IN ({known})) WHERE shape <> ''),
{_classes()},
walk AS (
  SELECT *, shape AS made, 0 AS i, false AS ok FROM sorted_out
  UNION ALL
  SELECT pattern, match, shape, permkey, middle, classes, s, i, CASE pattern {accepted} ELSE false END
  FROM (SELECT * REPLACE (i + 1 AS i) FROM ({step}))),
best AS (SELECT pattern, match, made AS shaped FROM walk WHERE ok AND made <> match),
made AS (
  SELECT s.*, CASE
      WHEN kind IS NULL THEN '[' || upper(s.pattern) || ']'
      WHEN kind = 'keep' OR s.pattern = 'crypto_keys_rsa_private_key' THEN s.match
      WHEN s.pattern = 'crypto_keys_ssh_private_key' THEN {key}
      WHEN kind = 'regex' THEN regexp_replace(trim(regexp_replace(
        coalesce(b.shaped, {quoted(pseudonym.FALLBACK)}), '[\\t\\n\\r\\f\\v]', ' ', 'g')), '\\s{{2,}}', ' ', 'g')
      ELSE CASE kind {kinds} END END AS value
  FROM seeded s LEFT JOIN best b ON b.pattern = s.pattern AND b.match = s.match)"""


def token_pattern(codec: Codec) -> str:
    """The codec's pattern with every character class spelled out."""
    signs = r"!-/:;=>?@\[-`{-~"
    word = rf" ?[^ \t\n\r\f\x0B<{signs}]+"
    return "|".join([word, rf" ?[{signs}]", *codec.named, r"\n\n|\n|<", r"[ \t\r\f\x0B]+"])


def _crc_table() -> list[int]:
    table = list(range(256))
    for _ in range(8):
        table = [(v >> 1) ^ 0xEDB88320 if v & 1 else v >> 1 for v in table]
    return table


def crc32(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of a string, which DuckDB has no function for."""
    octets = (
        f"list_transform(range(1, length(hex({text})) // 2 + 1), "
        f"lambda i: CAST('0x' || substr(hex({text}), 2 * i - 1, 2) AS BIGINT))"
    )
    step = f"xor(({_crc_table()})[1 + (xor(c, b) & 255)], c >> 8)"
    return f"xor(list_reduce({octets}, lambda c, b: {step}, 4294967295), 4294967295)"


def token_ids(text: str, codec: Codec = Codec()) -> str:
    """``INTEGER[]`` of the built-in codec."""
    breaks = {"\n": "chr(10)", "\n\n": "chr(10) || chr(10)"}
    fixed = " ".join(f"WHEN {breaks.get(m) or quoted(m)} THEN {i}" for m, i in codec.markers.items())
    drawn = f"{codec.first_id} + {crc32('p')} % {codec.vocabulary - codec.first_id}"
    return (
        f"list_transform(regexp_extract_all({text}, {quoted(token_pattern(codec))}), "
        f"lambda p: CAST(CASE p {fixed} ELSE {drawn} END AS INTEGER))"
    )


def ended(text: str) -> str:
    return f"CASE WHEN {text} LIKE '%<eos>' THEN {text} ELSE {text} || '<eos>' END"


def listed(ids: str) -> str:
    """A short digest of an id list."""
    return f"md5(array_to_string({ids}, ' '))"


def chat_turn(role: str, content: str, lead: str = "''") -> str:
    stripped = rf"regexp_replace({content}, '^\s+|\s+$', '', 'g')"
    name = f"CASE WHEN {role} = 'assistant' THEN 'model' ELSE {role} END"
    return (
        f"'<start_of_turn>' || {name} || chr(10) || {lead} || {stripped} || '<end_of_turn>' || chr(10)"
    )


def dialogue_text(user: str, assistant: str) -> str:
    return f"'<bos>' || {chat_turn(quoted('user'), user)} || {chat_turn(quoted('assistant'), assistant)} || '<eos>'"


# Conversations as rendered chats; the opening system turn joins the next one.
CHATS = f"""turns AS (
  SELECT conv_id, turn, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS role_before,
         lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS text_before
  FROM conversations),
chats AS (
  SELECT conv_id, '<bos>' || coalesce(string_agg({chat_turn(
      "role", "text",
      "CASE WHEN n = 2 AND role_before = 'system' THEN text_before || chr(10) || chr(10) ELSE '' END",
  )}, '' ORDER BY turn) FILTER (WHERE NOT (n = 1 AND role = 'system')), '') || '<eos>' AS rendered
  FROM turns GROUP BY conv_id)"""

# One row per user turn, with the system turn before and the answer after it.
PAIRS = """pairs AS (
  SELECT conv_id, turn, text AS user_text,
         CASE WHEN role_before = 'system' THEN text_before END AS system_text,
         CASE WHEN role_after = 'assistant' THEN text_after END AS answer
  FROM (SELECT *, lag(role) OVER w AS role_before, lag(text) OVER w AS text_before,
               lead(role) OVER w AS role_after, lead(text) OVER w AS text_after
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user')"""


def framed_tokens(part: str = "documents", number: str = "doc_id") -> str:
    """CTE ``framed(batch, in_batch, ids)`` of framed, tokenised documents."""
    done = ended("text")
    return f"""numbered AS (SELECT {number} AS position, text FROM {part}),
framed AS (
  SELECT position // 1000 AS batch, position % 1000 AS in_batch, {token_ids(
      f"CASE WHEN position % 1000 = 0 THEN '<bos>' || {done} "
      f"WHEN text LIKE '<bos>%' THEN chr(10) || {done} ELSE chr(10) || '<bos>' || {done} END"
  )} AS ids FROM numbered)"""


def windows(length: int, overlap: float) -> str:
    """CTE ``packed(batch, window, ids)`` from ``framed``: every token goes to each
    window that covers its position."""
    step = length - int(length * overlap)
    return f"""sized AS (
  SELECT batch, in_batch, ids, sum(len(ids)) OVER (PARTITION BY batch ORDER BY in_batch) - len(ids) AS start,
         (sum(len(ids)) OVER (PARTITION BY batch) // {length}) * {length} AS top FROM framed),
placed_ids AS (SELECT batch, top, unnest(ids) AS id, start + unnest(range(0, len(ids))) AS pos FROM sized),
members AS (
  SELECT batch, pos, id, unnest(range(CAST(CASE WHEN pos < {length} THEN 0 ELSE (pos - {length}) // {step} + 1 END AS BIGINT),
    CAST(least(pos // {step}, (top - 1) // {step}) AS BIGINT) + 1)) AS "window" FROM placed_ids WHERE top > 0),
packed AS (SELECT batch, "window", list(id ORDER BY pos) AS ids FROM members GROUP BY 1, 2)"""


def draw(key: str, seed: int | str = 42) -> str:
    return f"CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || '|{seed}'), 1, 8) AS BIGINT)"
