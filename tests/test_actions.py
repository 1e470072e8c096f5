import re

import pytest
from pyspark.sql import functions as F

from plain import overlap_free, replaced, rule_hits
from test_detect import POSITIVE, TRICKY, _frame, _random_texts
from textveil.functions.rules import CATALOGUE, RULE_NAMES, select_rules, source_generators
from textveil.operators.actions import clean_control_whitespace
from textveil.operators.detect import detect_pii
from textveil.operators.fields import rows_with
from textveil.operators.pseudonym import FALLBACK, generated, replacement_sql
from textveil.plans.sanitize import apply_detections, sanitize
from textveil.sources.readers import from_records

# The stored sample: sanitised value, winning rule.
SAMPLE = [
    ("xox" + "r-495488446906-793998215666-764479700890-Pn55L5R9m0sqw1UrrZmHsENn1TP4glxi", "api_keys_slack_token"),
    ("e68ab0cc-b778-8251-3c0a-adc54663e9fa", "api_keys_generic_alphanumeric"),
    ("6K78GB4tgpf0lMaKGplzIr909a19ZTnmDGMMCtLeToWnIkvDgAqJf8C7ZK8y342WywEAPFrD7q2P/qt3qScIdV==", "azure_storage_account_key"),
    ("90529719621031092x", "national_ids_china_resident_id"),
    ("pilot.xyz@yahoo.in", "email"),
]


def _texts(df):
    return [r.text for r in df.orderBy("id").collect()]


def test_sample_records(spark):
    lines = [f"Oops – it’s your info: {value}, or *that* finally works." for value, _ in SAMPLE]
    records = [
        {"instruction": "Tidy this note.", "input": t, "output": t} for t in lines
    ] + [{"instruction": "x", "input": "okay, it's 4, but", "output": "it's 4"}]
    df = from_records(spark, records)
    rows = {r.input: r for r in sanitize(df, "redact").collect()}
    assert set(rows) == {"Oops – it’s your info: [REDACTED], or *that* finally works.", "okay, it's 4, but"}
    masked = sorted(r.output for r in sanitize(df, "mask").collect())
    expected = [f"Oops – it’s your info: [{rule.upper()}], or *that* finally works." for _, rule in SAMPLE]
    assert masked == sorted(expected + ["it's 4"])
    assert sanitize(df, "redact").schema == df.schema


@pytest.mark.parametrize("action", ["redact", "mask"])
def test_same_texts_as_plain_python(spark, action):
    texts = POSITIVE + TRICKY + _random_texts(5, 300)
    new = {
        "redact": lambda s: "[REDACTED]",
        "mask": lambda s: f"[{RULE_NAMES[s[2] - 1].upper()}]",
    }[action]
    expected = [replaced(t, overlap_free(rule_hits(t)), new) for t in texts]
    df = _frame(spark, texts)
    assert _texts(sanitize(df, action, "id")) == expected
    assert _texts(apply_detections(df, "id", detect_pii(df, "id"), action)) == expected


def test_many_spans(spark):
    text = " ".join(f"é{i} a{i}@b.co 😀" for i in range(1500))
    df = spark.createDataFrame([(1, text)], "id int, text string")
    rules = select_rules(include=["email"])
    expected = " ".join(f"é{i} [REDACTED] 😀" for i in range(1500))
    assert _texts(sanitize(df, "redact", "id", rules=rules)) == [expected]


def test_unknown_action(spark):
    df = spark.createDataFrame([(1, "x")], "id int, text string")
    with pytest.raises(ValueError):
        sanitize(df, "shred", "id")
    with pytest.raises(ValueError):
        apply_detections(df, "id", detect_pii(df, "id"), "shred")


def test_pseudonyms_keep_the_text_around_and_the_shape(spark):
    texts = POSITIVE + _random_texts(13, 200)
    df = _frame(spark, texts)
    clean = _texts(sanitize(df, "pseudonymize", "id", salt="s"))
    again = _texts(sanitize(df.repartition(3), "pseudonymize", "id", salt="s"))
    other = _texts(sanitize(df, "pseudonymize", "id", salt="t"))
    assert clean == again
    assert clean != other
    for text, new in zip(texts, clean):
        spans = overlap_free(rule_hits(text))
        parts, at = [], 0
        for start, end, order, match in spans:
            parts.append(re.escape(text[at:start]))
            parts.append(".*?")
            at = end
        parts.append(re.escape(text[at:]))
        found = re.fullmatch("".join(parts), new, re.S)
        assert found, (text, new)


def test_pseudonyms_follow_their_rule(spark):
    hits = [(r.name, re.search(r.regex, t).group()) for r, t in zip(CATALOGUE, POSITIVE)]
    df = spark.createDataFrame(hits, "pattern string, match string")
    made = df.withColumn("made", F.expr(replacement_sql("pattern", "match", "s"))).collect()
    regexes = {r.name: r.regex for r in CATALOGUE}
    fallbacks = []
    for name, match, value in made:
        kind = source_generators().get(name)
        if kind is None:
            assert value == f"[{name.upper()}]"
        elif kind == "keep" or name == "crypto_keys_rsa_private_key":
            assert value == match
        elif kind == "regex" and value == FALLBACK:
            fallbacks.append(name)
        elif kind == "regex":
            assert re.fullmatch(regexes[name], value), (name, value)
            assert value != match or name == "crypto_keys_ssh_private_key"
    assert not fallbacks


def test_pseudonyms_are_a_permutation(spark):
    """All values of a small shape give as many pseudonyms, each again of the rule; another
    salt gives another permutation."""
    octets = [f"{a}.{b}.0.1" for a in range(0, 256, 3) for b in (0, 7, 99, 100, 199, 200, 249, 250, 255)]
    rows = [("ip_ipv4", x) for x in octets] + [("ip_ipv4", "010.001.2.3"), ("ip_ipv4", "10.1.2.3")]
    rows += [("medical_icd10_code", f"{c}{i:02d}") for c in "ABCDEFGHIJKLMNOPQRSTVWXYZ" for i in range(100)]
    rows += [("national_ids_china_resident_id", f"1101051949123100{i:01d}{x}") for i in range(10) for x in "0123456789Xx"]
    rows += [("credit_card_visa", f"4{i:012d}") for i in range(500)]
    rows += [("driving_license_uk", f"MORG9{i:06d}S9AB") for i in range(200)]
    rows += [("national_ids_india_aadhaar", f"{a}{i:03d} 1234 5678") for a in "23456789" for i in range(40)]
    rows += [("uuid_regex", f"123e4567-e89b-1{i:03x}-a456-426614174000") for i in range(300)]
    df = spark.createDataFrame(rows, "pattern string, match string")
    made = df.select("*", *[F.expr(replacement_sql("pattern", "match", s)).alias(s) for s in ("one", "two")]).collect()
    regexes = {r.name: r.regex for r in CATALOGUE}
    for name in {r.pattern for r in made}:
        mine = [r for r in made if r.pattern == name]
        for salt in ("one", "two"):
            values = [r[salt] for r in mine if r[salt] != FALLBACK]
            # A placeholder stands for a value that the permutation leaves as it is.
            assert len(set(values)) == len(values) >= len(mine) - 5
            assert all(re.fullmatch(regexes[name], v) for v in values)
            assert all(r[salt] != r.match for r in mine)
        assert sum(r.one == r.two for r in mine) < 0.05 * len(mine)


def test_values_of_nothing_to_change(spark):
    rows = [("api_keys_generic_alphanumeric", "-" * 40), ("national_ids_passport_uk_passport", "\u0663" * 9), ("no_rule", "x")]
    df = spark.createDataFrame(rows, "pattern string, match string")
    made = [r[0] for r in df.select(F.expr(replacement_sql("pattern", "match", "s"))).collect()]
    assert made == [FALLBACK, FALLBACK, "[NO_RULE]"]


def test_people_and_places_have_room(spark):
    keys = spark.range(60_000).selectExpr("cast(id as string) as k")
    for kind in ("name", "organization", "email", "address", "uri"):
        assert keys.select(generated(kind, "k", "s")).distinct().count() == 60_000


def test_generators(spark):
    df = spark.range(500).selectExpr("cast(id as string) as k")
    kinds = ["name", "organization", "email", "phone", "address", "ssn", "uri", "license", "passport", "api_token"]
    rows = df.select(*[generated(k, "k", "x").alias(k) for k in kinds]).collect()
    for r in rows:
        assert re.fullmatch(r"[A-Z][a-z]+ [A-Z][a-z]+", r.name)
        assert re.fullmatch(r"[a-z]+\.[a-z]+\d+@example\.(com|org|net)", r.email)
        assert re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}", r.ssn)
        assert re.fullmatch(r"[A-Z0-9]{15}", r.license)
        assert re.fullmatch(r"[A-Z0-9]{9}", r.passport)
        assert re.fullmatch(r"[0-9a-f]{32}", r.api_token)
        assert 10 <= len(re.sub(r"\D", "", r.phone)) <= 12
        assert r.organization and r.address and r.uri.startswith("https://")
    assert len({r.api_token for r in rows}) == 500


def test_external_labels(spark):
    df = spark.createDataFrame([(1, "Ann Lee met Bob")], "id int, text string")
    found = spark.createDataFrame(
        [(1, "text", 78, "person name", "Ann Lee", 0, 7, 0.95), (1, "text", 78, "passport number", "Bob", 12, 15, 0.9)],
        "record_id int, field_path string, rule_ord int, pattern string, match string, start int, end int, score double",
    )
    assert _texts(apply_detections(df, "id", found, "mask")) == ["[PERSON NAME] met [PASSPORT NUMBER]"]
    # A label of the regex kind has no rule to shape a value by.
    assert _texts(apply_detections(df, "id", found, "pseudonymize", salt="s"))[0].endswith(" met " + FALLBACK)


def test_whitespace_cleaning(spark):
    values = [" a\tb\r\nc  d\f", "\x0bx\u00a0\u00a0y", None, "", "plain", "\x1c a\u3000\u2009b\x1f"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(clean_control_whitespace("v")).collect()]
    assert got == ["a b c d", "x y", None, "", "plain", "a b"]


def test_second_pass_and_luhn(spark):
    df = spark.createDataFrame(
        [(1, "mail a@b.co now"), (2, "card 1234 5678 9012 3452 or 1234 5678 9012 3456")], "id int, text string"
    )
    once = sanitize(df, "redact", "id")
    assert _texts(sanitize(once, "redact", "id"))[0] == "mail [[REDACTED]] now"
    assert _texts(sanitize(once, "redact", "id", skip_placeholders=True))[0] == "mail [REDACTED] now"
    cards = select_rules(include=["credit_card_generic"])
    valid = _texts(sanitize(df, "redact", "id", rules=cards, luhn=True))[1]
    assert valid == "card [REDACTED] or 1234 5678 9012 3456"


def test_displaced_hits_are_still_replaced(spark):
    """A card number with a wrong check digit hides the identity number inside it."""
    df = spark.createDataFrame([(1, "card 4111 1111 1111 1112 end")], "id int, text string")
    assert "1111" not in _texts(sanitize(df, "redact", "id", luhn=True))[0]


def test_pseudonyms_need_a_salt(spark):
    df = spark.createDataFrame([(1, "mail a@b.co now")], "id int, text string")
    with pytest.raises(ValueError, match="salt"):
        sanitize(df, "pseudonymize", "id")
    with pytest.raises(ValueError, match="salt"):
        apply_detections(df, "id", detect_pii(df, "id"), "pseudonymize")


def test_records_without_key_are_cleaned(spark):
    df = spark.createDataFrame([(None, "mail a@b.co now"), (2, "none")], "id int, text string")
    clean = apply_detections(df, "id", detect_pii(df, "id"))
    assert sorted(r.text for r in clean.collect()) == ["mail [REDACTED] now", "none"]


@pytest.mark.parametrize("key", [1, None])
def test_a_key_of_several_rows_is_an_error(spark, key):
    df = spark.createDataFrame([(key, "mail a@b.co now"), (key, "please write to someone")], "id int, text string")
    with pytest.raises(Exception, match="not unique"):
        apply_detections(df, "id", detect_pii(df, "id")).collect()


def _moves_texts(df):
    """Whether the plan shuffles what it reads together with the texts."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return any("hashpartitioning" in line or "rangepartitioning" in line for line in plan.splitlines())


def test_few_detections_move_no_text(spark, tmp_path):
    texts = [(i, f"mail a{i}@b.co now" if i % 100 == 7 else f"plain words {i}") for i in range(1000)] + [(None, "plain")]
    spark.createDataFrame(texts, "id int, text string").write.parquet(str(tmp_path / "texts"))
    df = spark.read.parquet(str(tmp_path / "texts"))
    found = detect_pii(df, "id")
    clean = apply_detections(df, "id", found)
    assert not _moves_texts(clean)
    expected = sorted(t.replace(f"a{i}@b.co", "[REDACTED]") for i, t in texts)
    assert sorted(_texts(clean)) == expected
    # Too many to broadcast: rows without detections still pass by.
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for limit in ("-1", "100", "1k"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            moved = apply_detections(df, "id", found)
            assert sorted(_texts(moved)) == expected
            near, far = rows_with(df, "id", found.select("record_id"))
            assert far.count() > 980 and near.count() + far.count() == 1001
            assert not _moves_texts(far) and not _moves_texts(near)
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_repeated_keys_without_detections_are_kept(spark):
    df = spark.createDataFrame([(1, "plain"), (1, "words"), (2, "mail a@b.co now")], "id int, text string")
    clean = apply_detections(df, "id", detect_pii(df, "id"))
    assert sorted(r.text for r in clean.collect()) == ["mail [REDACTED] now", "plain", "words"]


def test_long_matches_get_shaped_values(spark):
    """A value is bounded and its rule accepts it, however long the match is."""
    token = "eyJ" + "aB3" * 60 + "." + "eyJ" + "Cd4" * 90 + "." + "xY5" * 50
    df = spark.createDataFrame([(1, f"token {token} end")], "id int, text string")
    made = _texts(sanitize(df, "pseudonymize", "id", rules=select_rules(include=["jwt_token"]), salt="s"))[0]
    value = made.removeprefix("token ").removesuffix(" end")
    assert value != FALLBACK and value not in token and len(value) <= 200
    regex = next(r.regex for r in select_rules(include=["jwt_token"]))
    assert re.fullmatch(regex, value)
