"""Files cut into records by many tasks, against readers that begin at a file's start."""

import csv
import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from textveil.sources import readers
from textveil.sources.ranges import CsvText, JsonText, records
from textveil.sources.readers import read_csv, read_json, read_zip_text


@pytest.fixture(params=["500", "100000"])
def small_ranges(spark, request):
    """Ranges of so many bytes; below the size of most records, some lie in several."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"]
    before = {n: spark.conf.get(n, None) for n in names}
    spark.conf.set(names[0], request.param)
    spark.conf.set(names[1], "1")
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _text(draw):
    return "".join(draw.choices(["a", '"', "\\", "{", "}", "[", "]", ",", " ", "\n", "\r\n", "é", "😀", "\\\"", "", ":"], k=draw.randint(0, 12)))


def _records(seed, count):
    draw = random.Random(seed)
    return [
        {"id": i, "text": _text(draw), "more": {"xs": [_text(draw) for _ in range(draw.randint(0, 3))], "y": {"z": i}}}
        for i in range(count)
    ]


SCHEMA = "id long, text string, more struct<xs:array<string>,y:struct<z:long>>"


@pytest.mark.parametrize("indent", [None, 2])
def test_json_arrays(spark, small_ranges, tmp_path, indent):
    rows = _records(3, 24)
    for k in range(3):
        data = json.dumps(rows[8 * k : 8 * k + 8], indent=indent, ensure_ascii=bool(k))
        (tmp_path / f"{k}.json").write_bytes(("﻿" if k == 1 else "").encode() + data.encode())
    (tmp_path / "none.json").write_text(" [ ]\n")
    found = read_json(spark, str(tmp_path), SCHEMA)
    assert [r.asDict(True) for r in sorted(found.collect())] == rows
    inferred = read_json(spark, str(tmp_path))
    assert [r.asDict(True) for r in sorted(inferred.select("id", "text", "more.y").collect(), key=lambda r: r.id)] == [
        {"id": r["id"], "text": r["text"], "y": r["more"]["y"]} for r in rows
    ]
    # Files of lines beside arrays.
    (tmp_path / "lines.json").write_text("".join(json.dumps(r) + "\n\n" for r in rows[:7]))
    assert read_json(spark, str(tmp_path), SCHEMA).count() == 31


@pytest.mark.parametrize("text", ['[{"a":1},{"b":2', '[{"a":1}', '[{"a":"}', '[{"a":1}] x', '[1, 2]', '[{"a":1} {"a" 2}]'])
def test_broken_arrays(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception):
        read_json(spark, str(tmp_path / "a.json"), "a long, b long").collect()


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_quoted_line_breaks(spark, small_ranges, tmp_path, ending):
    draw = random.Random(8)
    signs = ["a", '"', ",", "\n", "é", "😀", "b c", '""', "", "n", "5\"", "\t"]
    rows = [[str(i), "x" + "".join(draw.choices(signs, k=draw.randint(0, 9))) + "x", "v" * draw.randint(1, 40)] for i in range(80)]
    for k in range(2):
        out = io.StringIO(newline="")
        writer = csv.writer(out, lineterminator=ending)
        writer.writerow(["id", "text", "odd name"])
        writer.writerows(rows[40 * k : 40 * k + 40])
        data = out.getvalue()
        (tmp_path / f"{k}.csv").write_text(data if k else data.rstrip("\r\n"), newline="")
    found = read_csv(spark, str(tmp_path), infer=False)
    assert found.columns == ["id", "text", "odd name"]
    assert sorted((list(r) for r in found.collect()), key=lambda r: int(r[0])) == rows
    assert dict(read_csv(spark, str(tmp_path)).dtypes)["id"] == "int"
    typed = read_csv(spark, str(tmp_path), schema="i long, t string, o string")
    assert sorted(typed.collect())[7].t == rows[7][1]


def test_odd_csv_files(spark, tmp_path):
    (tmp_path / "head.csv").write_text("a,b\n")
    assert read_csv(spark, str(tmp_path / "head.csv"), infer=False).columns == ["a", "b"]
    assert read_csv(spark, str(tmp_path / "head.csv"), infer=False).count() == 0
    (tmp_path / "quote.csv").write_text('﻿size,n\n5" pipe,1\n\n"6"" pipe",2\n,3\n')
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "quote.csv"), infer=False).collect()] == [
        ('5" pipe', "1"), ('6" pipe', "2"), ("", "3"),
    ]


@pytest.mark.parametrize("grammar", [JsonText(), CsvText()])
def test_states_compose(spark, grammar):
    """A range read for both first states tells what reading from the start does."""
    draw = random.Random(5)
    for _ in range(300):
        if isinstance(grammar, JsonText):
            text = json.dumps(_records(draw.randint(0, 99), 3))
        else:
            out = io.StringIO(newline="")
            csv.writer(out, lineterminator="\n").writerows([_text(draw).replace("\r", ""), _text(draw)] for _ in range(4))
            text = out.getvalue()
        pieces = text.split(grammar.separator)[:-1]
        cut = draw.randint(0, len(pieces))
        state = 0
        for piece in pieces[:cut]:
            state, _ = grammar.step(state, piece)
        last = {}
        for first in grammar.starts:
            last[first] = first
            for piece in pieces[cut:]:
                last[first], _ = grammar.step(last[first], piece)
        whole = 0
        for piece in pieces:
            whole, _ = grammar.step(whole, piece)
        assert last[state] == whole == 0


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(_records(1, 4000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        found = records(spark, str(tmp_path / "a.json"), JsonText())
        assert found.select("file_block_start").distinct().count() > 4
        assert read_json(spark, str(tmp_path / "a.json")).select(F.spark_partition_id()).distinct().count() >= 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def _archive(path, members, method):
    with zipfile.ZipFile(path, "w", method) as archive:
        for name, data in members.items():
            archive.writestr(name, data)


@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2])
def test_members_are_read_by_many_tasks(spark, tmp_path, method, monkeypatch):
    members = {f"one/{i}.txt": f" text é {i}\r\nline\r " * (i % 5) for i in range(300)}
    members |= {"one/sub/x.txt": "no", "one/y.md": "no", "two.txt": "no", "one/bad.txt": b"\xff ok"}
    _archive(tmp_path / "one.zip", members, method)
    _archive(tmp_path / "two.zip", {"two/a.txt": "a"}, method)
    rows = read_zip_text(spark, str(tmp_path), with_origin=True).collect()
    expected = {n: t.replace("\r\n", "\n").replace("\r", "\n").strip() for n, t in members.items() if n.startswith("one/") and n.count("/") == 1 and n.endswith(".txt") and isinstance(t, str)}
    expected = {n: t for n, t in expected.items() if t} | {"one/bad.txt": "� ok", "two/a.txt": "a"}
    assert {r.member: r.text for r in rows} == expected
    parts = read_zip_text(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().count()
    assert parts >= 4
    # A store that only Spark opens: the same, archive by archive.
    monkeypatch.setattr(readers, "arrow_target", lambda path: (_ for _ in ()).throw(readers.pa.ArrowInvalid("unknown")))
    again = read_zip_text(spark, str(tmp_path), with_origin=True).collect()
    assert {r.member: r.text for r in again} == expected
    _archive(tmp_path / "three.zip", {"else/a.txt": "a"}, method)
    monkeypatch.undo()
    with pytest.raises(Exception, match="no directory"):
        read_zip_text(spark, str(tmp_path)).collect()
