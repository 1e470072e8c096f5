import random
import re
import time

import pytest

from plain import overlap_free, rule_hits
from textveil.functions.rules import CATALOGUE, RULE_NAMES, select_rules, source_generators
from textveil.operators.detect import detect_pii, detect_rules, detect_with
from textveil.plans.samples import HEX40, SAMPLES as POSITIVE

TRICKY = [
    "Kelvin nino \u212ab 12 34 56 and ſk 12 34 56 c.",
    "Arabic digits ٠١٢٣٤٥٦٧٨ and phone ٤١٥-٥٥٥-٢٦٧١ here",
    "café12345678 naïve 12345678é 12345678",
    "😀😀 mail a@b.co 😀 and 9876543210 😀",
    "nbsp 123\u00a0456\u00a07890 and thin 123\u2009456\u20097890",
    "nul \x00 text a@b.co \x00 then 9876543210",
    "1234 - 5678 - 9012 - 3456 and\n415\n555\n2671",
    "ab\u00a012 34 56",
    "A 12 34 56 B\tCD 12 34 56",
    "DOB\n:\n1/2/90 secret\n=\nplainwordvalue token: another_word",
    "PASSWORD : kopfkissenbezug nextword",
    "AB-CD-EF-GH é-ABCDEFGH-é ÀBCDEFGH12",
    "x" * 31 + " " + "y" * 32 + " " + "z" * 33 + " " + "É" + "q" * 40,
    "(123) 456-7890, (0)123 456 7890; +1 415 555 2671",
    "Hello, World! No numbers here at all. Just words; and more words?",
    "m²123456789 x½ 123456789 ①12345678 Ⅷ12345678 12345678²",
    "cafe\u030112345678 12345678\u0301 ABCDEFGH\u0301 a\u0301b 12 34 56",
    "415\x1c555\x1f2671 and ab\x1c12 34 56 and 415\x85555\x852671",
    "[REDACTED] [PSEUDONYMIZED]",
    "",
]


def _found(df):
    return sorted((r.record_id, r.start, r.end, r.rule_ord, r.match) for r in df.collect())


def _frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(4)


def _random_texts(seed, count):
    rng = random.Random(seed)
    words = "der die Haus été où naïve the And I a ist. (so) \"quoted\" état – it’s ok, A B CD".split(" ")
    pieces = [t for t in POSITIVE + TRICKY if t]
    out = []
    for _ in range(count):
        parts = []
        for _ in range(rng.randint(1, 25)):
            kind = rng.random()
            if kind < 0.6:
                parts.append(rng.choice(words))
            elif kind < 0.75:
                piece = rng.choice(pieces)
                cut = sorted(rng.sample(range(len(piece) + 1), 2)) if len(piece) > 1 else [0, 1]
                parts.append(piece[cut[0] : cut[1]])
            elif kind < 0.9:
                parts.append(rng.choice(pieces))
            else:
                parts.append("".join(rng.choice("09aZ-_ .@+:é²½\u0301\x1c\u00a0٣一") for _ in range(rng.randint(1, 14))))
        out.append(rng.choice([" ", "  ", "\n", " "]).join(parts))
    return out


def test_catalogue():
    assert len(CATALOGUE) == 77
    assert len(set(RULE_NAMES)) == 77
    unmapped = [n for n in RULE_NAMES if n not in source_generators()]
    assert unmapped == ["driving_license_us_generic"]
    assert [r.name for r in select_rules(include=["ip_ipv4", "email"])] == ["email", "ip_ipv4"]
    assert len(select_rules(exclude=["email"])) == 76
    with pytest.raises(ValueError):
        select_rules(include=["no_such_rule"])


def test_every_rule_has_a_hit(spark):
    hits = detect_rules(_frame(spark, POSITIVE), "id").collect()
    found = {(r.record_id, r.rule_ord) for r in hits}
    missing = [CATALOGUE[i].name for i in range(77) if (i, i + 1) not in found]
    assert not missing
    assert all(r.score == 1.0 and r.pattern == RULE_NAMES[r.rule_ord - 1] for r in hits)


@pytest.mark.parametrize("condense", [True, False])
def test_same_hits_as_plain_python(spark, condense):
    texts = POSITIVE + TRICKY + _random_texts(7, 400)
    expected = sorted((i, *h) for i, t in enumerate(texts) for h in rule_hits(t))
    assert _found(detect_rules(_frame(spark, texts), "id", condense=condense)) == expected


@pytest.mark.parametrize("condense", [True, False])
def test_same_merged_hits_as_plain_python(spark, condense):
    texts = POSITIVE + TRICKY + _random_texts(11, 400)
    expected = sorted((i, *h) for i, t in enumerate(texts) for h in overlap_free(rule_hits(t)))
    assert _found(detect_pii(_frame(spark, texts), "id", condense=condense)) == expected


def test_long_texts(spark):
    """A long run of plain words, and a text with thousands of hits."""
    words = "lorem ipsum dolor " * 60000
    many = " ".join(f"word a{i}@mail.example.com and {i:09d} plus" for i in range(3000))
    texts = [words + "write to a@b.co " + words, many]
    expected = sorted((i, *h) for i, t in enumerate(texts) for h in overlap_free(rule_hits(t)))
    assert len(expected) > 6000
    assert _found(detect_pii(_frame(spark, texts), "id")) == expected


def test_rule_choice_and_null_texts(spark):
    df = spark.createDataFrame(
        [(1, "a@b.co 10.0.0.1"), (2, None), (3, "")], "id int, text string"
    )
    got = _found(detect_pii(df, "id", rules=select_rules(include=["ip_ipv4"])))
    assert got == [(1, 7, 15, RULE_NAMES.index("ip_ipv4") + 1, "10.0.0.1")]
    assert detect_pii(df, "id", rules=[]).count() == 0


def test_python_detector(spark):
    def factory():
        def find(texts):
            return [
                [] if (at := text.find("Sydney")) < 0 else [
                    {"label": "location", "text": "Sydney", "start": at, "end": at + 6, "score": 0.7}
                ]
                for text in texts
            ]

        return find

    df = spark.createDataFrame(
        [(1, [("user", "I live in Sydney")]), (2, [("user", "no")])],
        "id int, messages array<struct<role:string,content:string>>",
    )
    external = detect_with(df, "id", factory)
    row = external.collect()
    assert [(r.record_id, r.field_path, r.pattern, r.start, r.end) for r in row] == [
        (1, "messages[0].content", "location", 10, 16)
    ]
    merged = detect_pii(df, "id", external=external).collect()
    assert [(r.pattern, r.score) for r in merged] == [("location", 0.7)]


def _finder(word):
    def factory():
        def find(texts):
            return [
                [{"label": word, "text": word, "start": m.start(), "end": m.end(), "score": 1.0} for m in re.finditer(word, t)]
                for t in texts
            ]

        return find

    return factory


def test_two_detectors_do_not_share_an_object(spark):
    df = spark.createDataFrame([(1, "cat and dog")], "id int, text string").coalesce(1)
    first = detect_with(df, "id", _finder("cat")).collect()
    second = detect_with(df, "id", _finder("dog")).collect()
    assert [r.match for r in first + second] == ["cat", "dog"]


def test_detector_reads_chunks(spark):
    text = "x" * 7 + "needle" + "y" * 20 + "needle" + "z" * 3 + "needle"
    df = spark.createDataFrame([(1, text), (2, ""), (None, "needle")], "id int, text string")
    whole = detect_with(df, "id", _finder("needle"))
    cut = detect_with(df, "id", _finder("needle"), chunk=10, overlap=6)
    assert sorted(map(tuple, cut.collect()), key=repr) == sorted(map(tuple, whole.collect()), key=repr)
    assert whole.count() == 4


@pytest.mark.parametrize("condense", [True, False])
def test_mail_rule_reads_runs_once(spark, condense):
    """Same hits as the rule itself on mail-like texts, and a long run takes no long time."""
    draw = random.Random(7)
    pieces = ["a", "B1", ".", "-", "%", "_", "@", "é", "co", "com", ".de", " ", "+", "@x.org", "a.b@c.dd", "\x02", "K", "İ"]
    texts = ["".join(draw.choice(pieces) for _ in range(draw.randrange(1, 30))) for _ in range(4000)]
    rules = select_rules(include=["email"])
    df = _frame(spark, texts)
    found = sorted((r.record_id, r.start, r.match) for r in detect_rules(df, "id", rules=rules, condense=condense).collect())
    want = [(i, m.start(), m.group()) for i, t in enumerate(texts) for m in re.finditer(rules[0].regex, t)]
    assert found == sorted(want)
    long = "a." * 500_000 + " b@c.de"
    begun = time.time()
    hits = detect_rules(_frame(spark, [long]), "id", rules=rules, condense=condense).collect()
    assert [r.match for r in hits] == ["b@c.de"] and time.time() - begun < 20
