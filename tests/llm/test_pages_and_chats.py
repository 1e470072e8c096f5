"""URL filters, tool calls and WARC archives."""

import base64
import gzip
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from textveil.llm import tool_chat, url_filters, warc


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_rules(spark):
    rows = [
        (1, "http://A.Example.NET/en/x?y", "example.net/en/", "allow", "a.example.net", "/en/x"),
        (2, "http://example.net/de/", "net/", "block", "example.net", "/de/"),
        (3, "http://example.net", None, "allow", "example.net", ""),
        (4, "https://www.example.com/de/1", "example.com/de/", "block", "www.example.com", "/de/1"),
        (5, "x://notexample.com/de/", None, "allow", "notexample.com", "/de/"),
        (6, "http://q.org/fr/#a", "org/fr/", "allow", "q.org", "/fr/"),
        (7, None, None, "allow", "", ""),
        (8, "no scheme", None, "allow", "", ""),
        (9, "a://b?c/d", None, "allow", "b", ""),
        (9, "a://b?c/d", None, "allow", "b", ""),
    ]
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string").selectExpr("*", "'x' AS host")
    found = url_filters.judge_urls(pages, F.lit(True)).select("page_id", "rule", "verdict", "host", "path")
    assert collected(found) == sorted(((r[0], *r[2:]) for r in rows), key=repr)
    assert url_filters.judge_urls(pages.limit(0), F.lit(True)).collect() == []


def test_reputation(spark):
    """A host with much evidence against it is blocked, one with little is not."""
    rows = [("http://bad.info/", False)] * 80 + [("http://few.info/", False)]
    rows += [(f"http://h{i % 40}.info/{i}", i // 40 % 5 > 0) for i in range(800)] + [("http://unknown.info/", None)]
    pages = spark.createDataFrame(rows, "url string, good boolean")
    found = url_filters.judge_urls(pages, F.col("good")).select("host", "verdict").distinct()
    blocked = {r["host"] for r in found.collect() if r["verdict"] == "block"}
    assert blocked == {"bad.info"}


def test_registered_domains(spark):
    want = {
        "a.b.example.com": ("example.com", "com"),
        "www.shop.co.uk": ("shop.co.uk", "co.uk"),
        "shop.co.uk:8080": ("shop.co.uk", "co.uk"),
        "me:secret@x.shop.co.uk.": ("shop.co.uk", "co.uk"),
        "co.uk": ("co.uk", "uk"),
        "news.com": ("news.com", "com"),
        "a.co.info": ("co.info", "info"),
        "localhost": ("localhost", "localhost"),
        "10.0.0.1:80": ("10.0.0.1", ""),
        "[::1]:80": ("[::1]", ""),
        "": ("", ""),
        "a." * 50000 + "org.au": ("a.org.au", "org.au"),
        "ä..de": (".de", "de"),
    }
    hosts = spark.createDataFrame([(h,) for h in want], "host string")
    domain, suffix = url_filters.domain_and_suffix(F.col("host"))
    found = {r["host"]: (r["domain"], r["suffix"]) for r in hosts.select("host", domain.alias("domain"), suffix.alias("suffix")).collect()}
    assert found == want


def test_registries_keep_domains_apart(spark):
    """A bad name under a registry says little about another one there."""
    rows = [(f"http://h{i % 20}.bad.co.uk/{i}", False) for i in range(400)]
    rows += [(f"http://h{i % 40}.d{i % 8}.co.uk/{i}", True) for i in range(400)]
    rows += [("http://new.bad.co.uk:81/", None), ("http://user@new.good.co.uk/", None)]
    pages = spark.createDataFrame(rows, "url string, good boolean")
    found = url_filters.judge_urls(pages, F.col("good")).select("host", "verdict").distinct()
    blocked = {r["host"] for r in found.collect() if r["verdict"] == "block"}
    assert blocked == {f"h{i}.bad.co.uk" for i in range(20)} | {"new.bad.co.uk:81"}


SCHEMAS = {"add": {"a": ("integer", True), "b": ("number", False)}, "say": {"text": ("string", True)}}


def test_linking(spark):
    calls = spark.createDataFrame(
        [
            ("c", 1, "1", "add", '{"b":1.50,"a":2}', []),
            ("c", 2, "2", "say", '{"text":"é\\n"}', ["1", "gone"]),
            ("c", 3, "3", "say", '{"text":1}', ["2", "1"]),
            ("c", 4, "4", "add", '{"a":1,"z":0}', None),
            ("c", 5, "5", "fly", "{}", ["6"]),
            ("c", 6, "6", "add", '{"a":1}', ["5"]),
            ("c", 7, "7", "add", "nope", []),
            ("c", 8, None, "add", '{"a":1}', []),
            ("c", 9, "1", "add", '{"a":3}', []),
            ("c", 10, "10", "add", '{"a":1}', ["10"]),
            ("c", 11, "11", "add", None, []),
            ("c", 12, "12", "add", '{"a":null}', []),
        ],
        "conv_id string, turn int, call_id string, tool string, arguments string, after array<string>",
    )
    results = spark.createDataFrame(
        [("c", 2, "1", "late"), ("c", 1, "1", "r1"), ("c", 3, "2", ""), ("c", 4, "3", None), ("c", 9, "99", "lost"), ("c", 9, None, "x")],
        "conv_id string, turn int, call_id string, content string",
    )
    rows = {(r["turn"]): r for r in tool_chat.link_calls(calls, results, SCHEMAS).collect()}
    status = {t: (r["status"], r["place"]) for t, r in rows.items()}
    assert status == {
        1: ("ok", 1),
        2: ("ok", 2),
        3: ("invalid arguments", 3),
        4: ("invalid arguments", 4),
        5: ("unknown tool", None),
        6: ("in a cycle", None),
        7: ("invalid arguments", 7),
        8: ("no identifier", None),
        9: ("repeated identifier", None),
        10: ("in a cycle", None),
        11: ("invalid arguments", 11),
        12: ("invalid arguments", 12),
    }
    assert rows[1]["json"] == '{"arguments":{"a":2,"b":1.5},"id":"1","result":"r1","tool":"add"}'
    assert rows[2]["json"] == '{"arguments":{"text":"é\\n"},"after":["1","gone"],"id":"2","result":"","tool":"say"}'
    assert rows[1]["n_results"] == 2 and rows[4]["errors"] == ["z is not known"]
    assert rows[3]["errors"] == ["text is no string"] and rows[12]["errors"] == ["a is missing"]
    assert [r["content"] for r in tool_chat.lost_results(calls, results).collect()].count("lost") == 1
    messages = spark.createDataFrame([("c", 0, "system", "s"), ("c", 0, None, None)], "conv_id string, turn int, role string, text string")
    everything = tool_chat.format_chats(messages, calls, results, SCHEMAS)
    assert everything.count() == 12 + 2 + 2
    assert tool_chat.format_chats(messages.limit(0), calls.limit(0), results.limit(0), SCHEMAS).collect() == []


def test_identifiers_of_two_conversations(spark):
    """Each conversation's identifiers are its own: calls, references and results."""
    calls = spark.createDataFrame(
        [
            ("a", 1, "call_1", "add", '{"a":1}', []),
            ("a", 3, "call_2", "add", '{"a":2}', ["call_1"]),
            ("b", 5, "call_1", "add", '{"a":3}', ["call_2"]),
            (None, 1, "call_1", "add", '{"a":4}', []),
            ("d", 1, "call_1", "add", '{"a":5}', []),
        ],
        "conv_id string, turn int, call_id string, tool string, arguments string, after array<string>",
    )
    results = spark.createDataFrame(
        [("a", 2, "call_1", "ra"), ("b", 6, "call_1", "rb"), (None, 2, "call_1", "rn"), ("b", 7, "call_2", "none of b's")],
        "conv_id string, turn int, call_id string, content string",
    )
    rows = {(r.conv_id, r.turn): (r.status, r.place, r.n_results, r.json) for r in tool_chat.link_calls(calls, results, SCHEMAS).collect()}
    assert {k: v[:3] for k, v in rows.items()} == {
        ("a", 1): ("ok", 1, 1),
        ("a", 3): ("no result", 3, 0),
        ("b", 5): ("ok", 5, 1),
        (None, 1): ("ok", 1, 1),
        ("d", 1): ("no result", 1, 0),
    }
    assert '"result":"ra"' in rows["a", 1][3] and '"result":"rb"' in rows["b", 5][3]
    assert [r.content for r in tool_chat.lost_results(calls, results).collect()] == ["none of b's"]


def test_places(spark):
    """Every call comes after all that it uses, also later ones; cycles get no place; a long
    chain of earlier ones takes no rounds."""
    draw = random.Random(1)
    calls = [(f"x{i}", i, [f"x{i - 1}", "gone"] if i else None) for i in range(300)]
    for i in range(200):
        after = [f"y{draw.randrange(200)}" for _ in range(draw.choice([0, 0, 1, 1, 2]))]
        calls.append((f"y{i}", draw.randrange(30), after))
    found = tool_chat.places_of(spark.createDataFrame(calls, "call_id string, turn int, after array<string>"))
    places = {r["call_id"]: r["place"] for r in found.collect()}
    uses = {c: {p for p in after or [] if p != "gone"} for c, _, after in calls}
    turns = {c: t for c, t, _ in calls}
    done = {}
    while ready := {c for c in uses if c not in done and uses[c] <= set(done)}:
        done |= {c: max([turns[c]] + [done[p] + 1 for p in uses[c]]) for c in ready}
    assert set(places) == set(done) and len(done) < len(calls)
    assert all(places[c] > places[p] for c in places for p in uses[c])
    assert all(places[f"x{i}"] == i for i in range(300))


def plain_pages(rows):
    top = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 1000:
            top[data] = max(top.get(data, -1), -1 if i is None else i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        best = top.get(data)
        again = best is not None and best != -1 and best != i
        digest = hashlib.sha1(data).hexdigest()
        out.append((i, len(data), digest, "revisit" if again else "response", best if again else None, None))
    return sorted(out, key=repr)


NAMES = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem"]


@pytest.mark.parametrize("options", [{}, {"segment_bytes": 700, "chunk_bytes": 13, "file_records": 5}])
def test_archives(spark, options):
    draw = random.Random(5)
    pool = ["a", "é", "語", "\r\n", "\r\n\r\n", "WARC/1.1\r\n", "0\r\n\r\n", "<p>", "\x00"]
    payloads = ["".join(draw.choice(pool) for _ in range(draw.randrange(draw.choice([20, 900, 3000])))) for _ in range(25)]
    payloads += ["", None, "x" * 999, "y" * 1000, "z" * 40000]
    rows = [(i if i != 4 else None, draw.choice([None, "http://a/b\r\nX: y"]), draw.choice(payloads)) for i in range(100)]
    rows += [(3, "u", "y" * 1000)] * 2 + [(500, "u", "z" * 40000)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS name")
    assert collected(warc.round_trip(pages, **options).select(*NAMES)) == plain_pages(rows)
    assert warc.round_trip(pages.limit(0), **options).collect() == []


def test_lost_segments(spark, tmp_path):
    """A record whose segments are missing or too short says so."""
    row = {"kind": "response", "name": "<urn:uuid:1>", "url": None, "page_id": "1", "payload": b"p" * 3000, "refers_to": None}
    row["digest"] = hashlib.sha1(row["payload"]).hexdigest()
    records = warc.page_records(row, 1000, 500)
    for name, kept in {"all": records, "no-second": records[:1] + records[2:], "no-first": records[1:], "no-last": records[:-1]}.items():
        (tmp_path / name).mkdir()
        data = b"".join(r + warc.END for r in reversed(kept))
        (tmp_path / name / "a.warc.gz").write_bytes(gzip.compress(data))
        found = warc.reassemble(warc.read_records(spark, str(tmp_path / name))).collect()
        assert len(found) == 1
        want = {"all": None, "no-second": "segments missing", "no-first": "no first segment", "no-last": "no last segment"}
        assert found[0]["problem"] == want[name]
    assert warc.unchunked(b"3\r\nabc\r\n0\r\n\r\n") == b"abc"
    assert warc.unchunked(b"zz\r\n") is None and warc.unchunked(b"9\r\nabc") is None


def test_members_and_foreign_archives(spark, tmp_path):
    """Every record is a gzip member; archives zipped as a whole, or plain, are read too."""
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 300) for i in range(30)], "page_id long, url string, html string")
    ours = str(tmp_path / "ours")
    warc.write_archives(pages, ours, segment_bytes=900, file_records=50)
    files = [p.read_bytes() for p in (tmp_path / "ours").glob("part-*")]
    assert files
    for data in files:
        while data:
            member = zlib.decompressobj(wbits=31)
            record = member.decompress(data)
            assert record.startswith(b"WARC/1.1\r\n") and record.endswith(warc.END) and record.count(b"WARC-Type") == 1
            assert member.eof
            data = member.unused_data
    body = b"<p>hello</p>" * 50
    block = b"HTTP/1.1 200 OK\r\n\r\n" + body
    stated = "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x:1>"), ("Page-ID", "7"), ("WARC-Payload-Digest", stated)]
    info = warc._record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:x:0>")], b"software: x")
    data = info + warc.END + warc._record(fields, block) + warc.END
    wrong = data.replace(b"hello", b"jello")
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "a.warc").write_bytes(data)
    (tmp_path / "plain" / "b.warc.gz").write_bytes(gzip.compress(data))
    (tmp_path / "plain" / "c.warc").write_bytes(wrong)
    found = warc.read_pages(spark, str(tmp_path / "plain")).select("page_id", "payload_digest", "problem")
    digest = hashlib.sha1(body).hexdigest()
    assert collected(found) == sorted([(7, digest, None), (7, digest, None), (7, None, "digest differs")], key=repr)
    assert warc.stated_sha1("sha256:ab") is None is warc.stated_sha1("sha1:?")


def test_long_page(spark):
    """A page of 80 MB in 5,000 segments, and a record longer than one gzip member."""
    pages = spark.range(1).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.expr("repeat('0123456789abcdef', 5000000)").alias("html"))
    found = warc.round_trip(pages).collect()
    body = b"0123456789abcdef" * 5000000
    assert [tuple(r)[:4] for r in found] == [(0, len(body), hashlib.sha1(body).hexdigest(), "response")]
    assert found[0]["problem"] is None
    record = bytes(range(256)) * (3 * warc.MEMBER // 256)
    pieces = warc.members(record)
    assert len(pieces) == 4 and all(p[-1] == 0 for p in pieces)
    assert gzip.decompress(b"".join(pieces)) == record + warc.END
