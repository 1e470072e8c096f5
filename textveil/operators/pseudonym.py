"""Replacement values for detected spans.

Every value follows from the salt and the match: a re-run task writes the same output, and
one person keeps one pseudonym across the whole dataset.

Values of a rule's shape are *permuted*, so that different matches of a rule never share one.
Each character has a class (digits, some sets of letters) or is fixed; classes are chosen so
that a character never leaves its class and what fixes a class is not changed itself. A keyed
Feistel network over both halves of the string shifts each character inside its class by what
a digest of the other half says, and is applied again until the rule accepts the value: a walk
along a cycle of the permutation, which leads each accepted string to another one that no other
walk ends at. Only the single string that a cycle may hold, or one without any letter or digit
to change, has no value and gets the placeholder, as its match may not stay.

Values of other kinds are spelled out of syllables drawn by the digest of the match, from
spaces of 2^48 and more, so that different people share none by chance.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textveil.functions import pools
from textveil.functions.rules import CATALOGUE, CATEGORY_SOURCES, source_generators
from textveil.functions.sqltext import BLANKS, ident, let, lit, stripped
from textveil.operators.detect import java_regex

FALLBACK = "[PSEUDONYMIZED]"
MAX_LENGTH = 200
ROUNDS = 4
# Steps along a cycle. The strictest rule accepts two values in three of their shape.
STEPS = 48
# A match beyond MAX_LENGTH gives a shorter value: each unbroken run in it is cut to the
# first of these lengths that makes it short enough, and the digest of the whole match takes
# part in the permutation.
RUN_LENGTHS = (64, 40, 24, 16)
LONG_RUN = "[A-Za-z0-9+/=_-]"

CONTROL_WHITESPACE = r"[\t\n\r\f\x0B]"
BLANK_RUN = rf"[{BLANKS}]{{2,}}"

# How many leading characters a regex-shaped value keeps, because its rule fixes
# them. Other fixed positions are listed by number, counted from 1.
KEPT_START = {
    "credit_card_visa": 1,
    "credit_card_mastercard": 4,
    "credit_card_amex": 2,
    "credit_card_discover": 4,
    "national_ids_uk_nino": 2,
    "payment_tokens_bitcoin_address": 3,
    "payment_tokens_ethereum_address": 2,
    "payment_tokens_stripe_token": 4,
    "passport_mrz_regex": 2,
    "api_keys_google_api": 4,
    "api_keys_aws_access_key_id": 4,
    "api_keys_slack_token": 5,
    "api_keys_stripe_secret_key": 8,
    "api_keys_stripe_publishable_key": 8,
    "jwt_token": 3,
    "github_token": 4,
    "gitlab_token": 6,
    "npm_token": 4,
}
KEPT_POSITIONS = {"uuid_regex": (15, 20)}
# Rules with a literal inside, kept where it first occurs.
KEPT_INSIDE = {
    "aws_secrets_manager_arn": ":secret:",
    "terraform_cloud_token": ".atlasv1.",
    "slack_webhook_url": "/B",
}
# Rules with letters that are no free choice.
KEPT_LETTERS = ["national_ids_china_resident_id"]
# Rules that allow one digit only among some of their letters, at these positions.
KEPT_DIGITS = {"driving_license_uk": (1, 2, 3, 4, 5, 12, 13)}
# Classes of characters, each by a sign of its own: two halves of the letters, so that hex
# digits stay such, apart from letters that some rules leave out.
CLASSES = {
    "D": "0123456789",
    "U": "ABCDEF",
    "V": "GHJKLMNPRSTUVWXYZ",
    "W": "IO",
    "u": "abcdef",
    "v": "ghijklmnopqrstuvwxyz",
    # First to third digits of numbers up to 255.
    "B": "01",
    "J": "01234",
    "H": "012345",
}
# Rules with a literal opening of varying length, kept as matched.
KEPT_OPENING = {
    "db_credentials_mongo_uri": r"^mongodb(?:\+srv)?://",
    "db_credentials_redis_uri": r"^redis://",
    "crypto_keys_ssh_public_key": r"^ssh-(?:rsa|dss|ed25519)\sAAAA",
    "aws_secrets_manager_arn": r"^arn:aws:secretsmanager:",
    "slack_webhook_url": r"^https://hooks\.slack\.com/services/T",
    "env_var_secrets_regex": r"(?i)^(?:API_KEY|SECRET|TOKEN|PASSWORD|PRIVATE_KEY)",
}
KEY_KINDS = ["RSA", "DSA", "EC", "OPENSSH"]
# Rules with a literal ending, kept as matched.
KEPT_ENDING = {
    "gcp_client_email": ".iam.gserviceaccount.com",
    "azure_storage_account_key": "==",
}


def _pick(seed: str, part: str, n: int) -> str:
    """An integer in ``[0, n)`` for one part of a value."""
    head = f"substring(sha2(concat({seed}, '|{part}'), 256), 1, 8)"
    return f"cast(cast(conv({head}, 16, 10) as bigint) % {n} as int)"


def _choice(seed: str, part: str, values: list[str]) -> str:
    listed = ", ".join(lit(v) for v in values)
    return f"element_at(array({listed}), {_pick(seed, part, len(values))} + 1)"


def _drawn(alphabet: str) -> str:
    """A character of ``alphabet``, by the ``k``-th pair of digits of ``stream``."""
    byte = "cast(conv(substring(stream, 2 * k + 1, 2), 16, 10) as int)"
    return let("abc", alphabet, f"substring(abc, 1 + {byte} % length(abc), 1)")


def _shape(seed: str, shape: str, part: str) -> str:
    """Fill a shape of at most 32 characters: '#' digit, 'N' 2-9, 'M' 6-9,
    '?' capital, 'x' hex, '*' capital or digit."""
    alphabet = (
        "CASE WHEN h = '#' THEN '0123456789' WHEN h = 'N' THEN '23456789' WHEN h = 'M' THEN '6789' "
        "WHEN h = '?' THEN 'ABCDEFGHJKLMNPRSTUWXYZ' WHEN h = 'x' THEN '0123456789abcdef' "
        "WHEN h = '*' THEN 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789' ELSE h END"
    )
    filled = f"array_join(transform(split({shape}, ''), (h, k) -> {_drawn(alphabet)}), '')"
    return let("stream", f"sha2(concat({seed}, '|{part}'), 256)", filled)


def _syllables(seed: str, part: str, count: int, sounds: str) -> str:
    """``count`` syllables drawn by one digest. ``sounds`` is SQL for a struct of 16 consonants
    ``c`` and 4 vowels ``v``."""
    byte = "cast(conv(substring(stream, 2 * k + 1, 2), 16, 10) as int)"
    one = let("byte", byte, f"concat(substring({sounds}.c, 1 + byte % 16, 1), substring({sounds}.v, 1 + byte div 16 % 4, 1))")
    spelled = f"array_join(transform(sequence(0, {count - 1}), k -> {one}), '')"
    return let("stream", f"sha2(concat({seed}, '|{part}'), 256)", spelled)


def _locale(seed: str, body: str) -> str:
    """``body`` with ``loc``, one of the locales."""
    fields = pools.LOCALES[0]._fields
    listed = ", ".join(
        "named_struct("
        + ", ".join(
            f"'{f}', " + (lit(v) if isinstance(v, str) else "array(" + ", ".join(map(lit, v)) + ")")
            for f, v in zip(fields, locale, strict=True)
        )
        + ")"
        for locale in pools.LOCALES
    )
    return let("loc", f"element_at(array({listed}), {_pick(seed, 'locale', len(pools.LOCALES))} + 1)", body)


def _listed(seed: str, part: str, field: str) -> str:
    """An element of an array of the locale; all locales have as many."""
    return f"element_at({field}, {_pick(seed, part, pools.LISTED)} + 1)"


def generator_sql(kind: str, seed: str) -> str:
    """SQL for a value of one kind, drawn with the string ``seed``."""
    first = f"initcap({_syllables(seed, 'first', 4, 'loc')})"
    last = f"initcap(concat({_syllables(seed, 'last', 5, 'loc')}, {_listed(seed, 'end', 'loc.surnames')}))"
    if kind == "name":
        return _locale(seed, f"concat({first}, ' ', {last})")
    if kind == "organization":
        stem = f"initcap({_syllables(seed, 'stem', 4, 'loc')})"
        more = f"initcap({_syllables(seed, 'more', 4, 'loc')})"
        return _locale(seed, f"concat({stem}, ' ', {more}, ' ', {_choice(seed, 'end', pools.COMPANY_ENDS)})")
    if kind == "email":
        host = _choice(seed, "host", pools.MAIL_HOSTS)
        number = f"1 + {_pick(seed, 'no', 9999)}"
        return _locale(seed, f"concat(lower({first}), '.', lower({last}), {number}, '@', {host})")
    if kind == "phone":
        return _shape(seed, _choice(seed, "shape", pools.PHONE_SHAPES), "digit")
    if kind == "address":
        street = f"initcap({_syllables(seed, 'street', 4, 'loc')})"
        town = f"initcap(concat({_syllables(seed, 'town', 3, 'loc')}, {_listed(seed, 'townend', 'loc.towns')}))"
        return _locale(
            seed,
            f"concat(1 + {_pick(seed, 'house', 999)}, ' ', {street}, ' ', {_listed(seed, 'road', 'loc.roads')}, ', ', "
            f"{town}, {_listed(seed, 'region', 'loc.regions')}, ' ', {_shape(seed, 'loc.post', 'post')})",
        )
    if kind == "ssn":
        area = let(
            "area", f"1 + {_pick(seed, 'area', 898)}", "CASE WHEN area >= 666 THEN area + 1 ELSE area END"
        )
        return (
            f"concat(lpad({area}, 3, '0'), '-', lpad(1 + {_pick(seed, 'group', 99)}, 2, '0'), '-', "
            f"lpad(1 + {_pick(seed, 'serial', 9999)}, 4, '0'))"
        )
    if kind == "uri":
        host = _choice(seed, "host", pools.MAIL_HOSTS)
        word = _syllables(seed, "word", 6, "loc")
        return _locale(seed, f"concat('https://', {host}, '/', {word}, '/', {_pick(seed, 'no', 99999)})")
    if kind == "license":
        return _shape(seed, "repeat('*', 15)", "licence")
    if kind == "passport":
        return _shape(seed, "repeat('*', 9)", "passport")
    if kind == "api_token":
        return _shape(seed, "repeat('x', 32)", "token")
    raise ValueError(f"Unknown generator: {kind}")


def generated(kind: str, value: str, salt: str = "") -> Column:
    """A column of ``kind`` values keyed by the string column ``value``."""
    seed = f"sha2(concat({lit(f'{salt}|{kind}|')}, {ident(value)}), 256)"
    return F.expr(let("seed", seed, generator_sql(kind, "seed")))


def _kept_chars(pattern: str, match: str) -> str:
    """How many leading characters stay."""
    cases = [f"WHEN {pattern} = {lit(n)} THEN {k}" for n, k in KEPT_START.items()]
    cases += [
        f"WHEN {pattern} = {lit(n)} THEN length(regexp_extract({match}, {lit(rx)}, 0))"
        for n, rx in KEPT_OPENING.items()
    ]
    return f"CASE {' '.join(cases)} ELSE 0 END"


def _ending(pattern: str) -> str:
    cases = [f"WHEN {pattern} = {lit(n)} THEN {lit(end)}" for n, end in KEPT_ENDING.items()]
    return f"CASE {' '.join(cases)} ELSE '' END"


def _kept_end(pattern: str) -> str:
    cases = [f"WHEN {pattern} = {lit(n)} THEN {len(end)}" for n, end in KEPT_ENDING.items()]
    return f"CASE {' '.join(cases)} ELSE 0 END"


def _shortened(match: str) -> str:
    """The match, or a shorter string of its shape if it is too long."""
    cut = [
        f"regexp_replace({match}, {lit(f'({LONG_RUN}{{{k}}}){LONG_RUN}+')}, '$1')" for k in RUN_LENGTHS
    ]
    tried = f"filter(array({', '.join(cut)}), c -> length(c) <= {MAX_LENGTH})"
    return f"CASE WHEN length({match}) <= {MAX_LENGTH} THEN {match} ELSE try_element_at({tried}, 1) END"


def _ipv4_classes(match: str) -> str:
    """Classes of the digits of numbers up to 255."""
    octet = (
        "CASE WHEN o LIKE '25_' THEN '==H' WHEN o LIKE '2__' THEN '=JD' WHEN o LIKE '___' THEN 'BDD' "
        "ELSE repeat('D', length(o)) END"
    )
    return f"array_join(transform(split({match}, '[.]'), o -> {octet}), '=')"


def _overlaid(classes: str, place: str, size: str) -> str:
    """``classes`` with ``size`` characters from ``place`` on, counted from 1, fixed."""
    return f"concat(substring({classes}, 1, {place} - 1), repeat('=', {size}), substring({classes}, {place} + {size}))"


def _classes(match: str) -> str:
    """For each character of ``match`` the sign of its class, or '='."""
    signs = {c: sign for sign in "DUVWuv" for c in CLASSES[sign]} | {"Q": "="}
    general = (
        f"regexp_replace(translate({match}, {lit(''.join(signs))}, {lit(''.join(signs.values()))}), '[^DUVWuv]', '=')"
    )
    letters = ", ".join(map(lit, KEPT_LETTERS))
    general = f"CASE WHEN pattern IN ({letters}) THEN regexp_replace({general}, '[^D]', '=') ELSE {general} END"
    cases = [f"WHEN pattern = 'ip_ipv4' THEN {_ipv4_classes(match)}"]
    for name, spots in KEPT_DIGITS.items():
        spots = ", ".join(map(str, spots))
        cases.append(
            f"WHEN pattern = {lit(name)} THEN array_join(transform(split(general, ''), "
            f"(t, k) -> CASE WHEN t = 'D' AND k + 1 IN ({spots}) THEN '=' ELSE t END), '')"
        )
    for name, spots in KEPT_POSITIONS.items():
        out = "general"
        for spot in spots:
            out = _overlaid(out, str(spot), "1")
        cases.append(f"WHEN pattern = {lit(name)} THEN {out}")
    body = f"CASE {' '.join(cases)} ELSE general END"
    inside = [
        f"WHEN pattern = {lit(name)} AND instr({match}, {lit(text)}) > 0 THEN "
        + _overlaid("spotted", f"instr({match}, {lit(text)})", str(len(text)))
        for name, text in KEPT_INSIDE.items()
    ]
    kept = (
        f"concat(repeat('=', {_kept_chars('pattern', match)}), substring(inner, {_kept_chars('pattern', match)} + 1))"
    )
    ended = let("tail", _kept_end("pattern"), "concat(substring(begun, 1, length(begun) - tail), repeat('=', tail))")
    return let(
        "general",
        general,
        let("spotted", body, let("inner", f"CASE {' '.join(inside)} ELSE spotted END", let("begun", kept, ended))),
    )


def _shifted() -> str:
    """A half ``part`` with classes ``mine``, each character shifted inside its class by a byte
    of the digests of ``other``. Every 32 characters have a digest of their own."""
    alphabet = " ".join(f"WHEN '{sign}' THEN '{chars}'" for sign, chars in CLASSES.items())
    byte = "cast(conv(substring(stream, 2 * k + 1, 2), 16, 10) as int)"
    moved = let(
        "abc",
        f"CASE substring(mine, k + 1, 1) {alphabet} END",
        f"CASE WHEN abc IS NULL OR instr(abc, h) = 0 THEN h ELSE substring(abc, 1 + (instr(abc, h) - 1 + {byte}) % length(abc), 1) END",
    )
    digest = "sha2(concat(permkey, '|', r, '|', block, '|', other), 256)"
    stream = f"array_join(transform(sequence(0, (length(part) - 1) div 32), block -> {digest}), '')"
    # An empty half has no characters to shift.
    return let("stream", stream, f"array_join(transform(split(part, ''), (h, k) -> {moved}), '')")


def _permuted(text: str) -> str:
    """One application of the permutation to ``text`` with its ``classes`` and key ``permkey``."""
    left, right = "substring(s, 1, middle)", "substring(s, middle + 1)"

    def half(part: str, mine: str, other: str) -> str:
        return let("part", part, let("mine", mine, let("other", other, _shifted())))

    low = half(left, "substring(classes, 1, middle)", right)
    high = half(right, "substring(classes, middle + 1)", left)
    step = f"CASE WHEN r % 2 = 0 THEN concat({low}, {right}) ELSE concat({left}, {high}) END"
    folded = f"aggregate(sequence(0, {ROUNDS - 1}), {text}, (s, r) -> {step})"
    return let("middle", f"length({text}) div 2", folded)


def _accepts(name: str, regex: str) -> str:
    whole = rf"^(?:{java_regex(regex)})\z"
    return f"WHEN pattern = {lit(name)} THEN made rlike {lit(whole)}"


def _regex_valued(match: str, salt: str) -> str:
    """The next string along the match's cycle that the rule itself accepts."""
    shaped = [r for r in CATALOGUE if source_generators().get(r.name) == "regex"]
    accepts = " ".join(_accepts(r.name, r.regex) for r in shaped)
    ok = f"CASE {accepts} ELSE false END"
    step = let("made", _permuted("w.made"), f"named_struct('made', made, 'ok', {ok})")
    walk = (
        f"aggregate(sequence(1, {STEPS}), named_struct('made', shape, 'ok', false), "
        f"(w, i) -> CASE WHEN w.ok THEN w ELSE {step} END)"
    )
    # A string that the walk comes back to has no other value.
    found = let("walked", walk, f"CASE WHEN walked.ok AND walked.made != {match} THEN walked.made END")
    # What a long match loses takes part by a digest.
    key = f"sha2(concat_ws('|', {lit(salt)}, pattern, CASE WHEN shape = {match} THEN '' ELSE sha2({match}, 256) END), 256)"
    known = f"pattern IN ({', '.join(lit(r.name) for r in shaped)})"
    found = let("permkey", key, let("classes", _classes("shape"), found))
    # A rule's fixed ending is put back where the cut took it.
    ending = _ending("pattern")
    shape = let(
        "short",
        _shortened(match),
        f"CASE WHEN {ending} != '' AND NOT endswith(short, {ending}) "
        f"THEN concat(substring(short, 1, length(short) - length({ending})), {ending}) ELSE short END",
    )
    found = let("shape", f"CASE WHEN {known} THEN {shape} END", f"CASE WHEN shape != '' THEN {found} END")
    key_kind = _choice("seed", "key", KEY_KINDS)
    return (
        # The only string its rule allows, and the one rule that lists words.
        f"CASE WHEN pattern = 'crypto_keys_rsa_private_key' THEN {match} "
        "WHEN pattern = 'crypto_keys_ssh_private_key' "
        f"THEN concat('-----BEGIN ', {key_kind}, ' PRIVATE KEY-----') "
        f"ELSE coalesce({found}, {lit(FALLBACK)}) END"
    )


def replacement_sql(pattern: str, match: str, salt: str) -> str:
    """SQL for the pseudonym of one detection; a name without a generator gets
    the mask placeholder."""
    categories, values = [], []
    for category, (kind, sources) in CATEGORY_SOURCES.items():
        member = f"pattern IN ({', '.join(lit(x) for x in sources)})"
        categories.append(f"WHEN {member} THEN {lit(category)}")
        values.append((kind, member))
    branches = []
    for kind in dict.fromkeys(k for k, _ in values):
        member = " OR ".join(m for k, m in values if k == kind)
        if kind == "regex":
            value = _regex_valued(match, salt)
        elif kind == "keep":
            value = match
        else:
            value = generator_sql(kind, "seed")
        branches.append(f"WHEN {member} THEN {value}")
    drawn = f"CASE {' '.join(branches)} END"
    value = f"coalesce({let('drawn', drawn, cleaned_sql('drawn'))}, concat('[', upper(pattern), ']'))"
    category = f"CASE {' '.join(categories)} END"
    seeded = let("seed", f"sha2(concat_ws('|', {lit(salt)}, {category}, {match}), 256)", value)
    return let("pattern", pattern, seeded)


def cleaned_sql(value: str) -> str:
    """SQL for control whitespace and blank runs as one blank, ends trimmed."""
    blanks = f"regexp_replace({value}, {lit(CONTROL_WHITESPACE)}, ' ')"
    return stripped(f"regexp_replace({blanks}, {lit(BLANK_RUN)}, ' ')")
