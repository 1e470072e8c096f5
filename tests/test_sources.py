import json
import zipfile

import pytest

from textveil.operators.schema import detect_schema, lower_columns, preview
from textveil.sources.readers import (
    from_records,
    load,
    read_csv,
    read_json,
    read_jsonl,
    read_tokenized,
    read_zip_text,
    spread,
)
from textveil.sources.writers import write_records, write_tokenized

RECORDS = [
    {"id": 1, "text": "Grüße, 世界 😀", "note": None, "turns": [{"role": "user", "content": "a\nb"}]},
    {"id": 2, "text": 'quoted "x"', "note": "n", "turns": []},
]


def _rows(df):
    return sorted((r.asDict(True) for r in df.collect()), key=lambda r: r["id"])


@pytest.mark.parametrize("style", ["indent", "flat", "lines"])
def test_json_files(spark, tmp_path, style):
    path = tmp_path / "in.json"
    if style == "lines":
        path.write_text("\n".join(json.dumps(r) for r in RECORDS))
    else:
        path.write_text(json.dumps(RECORDS, indent=2 if style == "indent" else None))
    assert _rows(read_json(spark, str(path))) == RECORDS
    assert _rows(load(spark, str(path))) == RECORDS


def test_jsonl_with_blank_lines(spark, tmp_path):
    path = tmp_path / "in.JSONL"
    path.write_text("\n\n".join(json.dumps(r) for r in RECORDS) + "\n\n")
    assert _rows(load(spark, str(path))) == RECORDS
    path.write_text('{"id": 1}\n{"id": \n')
    with pytest.raises(Exception):
        read_jsonl(spark, str(path), schema="id int").collect()


@pytest.mark.parametrize("extension", ["jsonl", "json", "parquet"])
def test_written_records_come_back(spark, tmp_path, extension):
    df = from_records(spark, RECORDS * 40).repartition(3)
    path = str(tmp_path / f"out.{extension}")
    write_records(df, path)
    assert _rows(load(spark, path)) == _rows(df)
    parts = list((tmp_path / f"out.{extension}").glob(f"part-*"))
    assert len(parts) == 3
    if extension != "parquet":
        raw = parts[0].read_text()
        assert "世界" in raw and '"note":null' in raw
    if extension == "json":
        assert sum(len(json.loads(p.read_text())) for p in parts) == 80
    with pytest.raises(ValueError):
        write_records(df, path, fmt="xml")


def test_csv(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('id,text,n\n1,"a, ""b""\nc",2.5\n2,,\n')
    typed = read_csv(spark, str(path)).collect()
    assert [tuple(r) for r in typed] == [(1, 'a, "b"\nc', 2.5), (2, None, None)]
    plain = read_csv(spark, str(path), infer=False).collect()
    assert [tuple(r) for r in plain] == [("1", 'a, "b"\nc', "2.5"), ("2", "", "")]


def _zip(path, members):
    with zipfile.ZipFile(path, "w") as archive:
        for name, content in members.items():
            archive.writestr(name, content)


def test_zip_of_texts(spark, tmp_path):
    _zip(
        tmp_path / "corp.zip",
        {
            "corp/a.txt": " hi ",
            "corp/b.md": "no",
            "corp/sub/c.txt": "no",
            "corp/d.txt": " \n",
            "corp/e.txt": b"bad \xff byte\r\nline",
            "other/f.txt": "no",
        },
    )
    got = sorted(r.text for r in load(spark, str(tmp_path / "corp.zip")).collect())
    assert got == ["bad � byte\nline", "hi"]
    origin = read_zip_text(spark, str(tmp_path / "*.zip"), with_origin=True)
    assert sorted(r.member for r in origin.collect()) == ["corp/a.txt", "corp/e.txt"]
    assert detect_schema(origin) == "DAPT"


def test_broken_zips(spark, tmp_path):
    _zip(tmp_path / "x.zip", {"y/a.txt": "hi"})
    with pytest.raises(Exception, match="no directory"):
        read_zip_text(spark, str(tmp_path / "x.zip")).collect()
    _zip(tmp_path / "z.zip", {"z/a.md": "hi"})
    with pytest.raises(Exception, match="no .txt file"):
        read_zip_text(spark, str(tmp_path / "z.zip")).collect()
    _zip(tmp_path / "w.zip", {"w/a.txt": "  "})
    assert read_zip_text(spark, str(tmp_path / "w.zip")).count() == 0


def test_load_arguments(spark):
    with pytest.raises(ValueError):
        load(spark)
    with pytest.raises(ValueError):
        load(spark, path="a.json", data=RECORDS)
    with pytest.raises(ValueError):
        load(spark, path="a.xml")
    assert _rows(load(spark, data=RECORDS)) == RECORDS


def test_token_rows(spark, tmp_path):
    rows = spark.createDataFrame([([1, 2], [1, 1], "train"), ([3], [1], "validation")],
                                 "input_ids array<int>, attention_mask array<int>, split string")
    write_tokenized(rows, str(tmp_path / "tokens"))
    back = read_tokenized(spark, str(tmp_path / "tokens" / "split=train")).collect()
    assert [(r.input_ids, r.attention_mask) for r in back] == [([1, 2], [1, 1])]


LAYOUTS = [
    ("text string", "DAPT"),
    ("instruction string, output string", "ALPACA"),
    ("instruction string, output string, input string", "ALPACA"),
    ("messages array<struct<role:string,content:string>>", "CHATML"),
    ("conversations array<struct<from:string,value:string>>", "SHARE_GPT"),
    ("prompt string, response string", "PROMPT_RESPONSE"),
    ("question string, answer string", "QA"),
    ("question string, long_answer string", "QLA"),
    ("question string, long_answer string, answer string", "QA"),
    ("messages string, instruction string, output string", "ALPACA"),
    ("text int", None),
    ("text int, prompt string, response string", None),
    ("messages array<struct<role:string,content:string,extra:string>>", None),
    ("messages string, prompt string, response string", None),
    ("conversations array<struct<role:string,content:string>>", None),
    ("foo string", None),
]


@pytest.mark.parametrize("schema, layout", LAYOUTS)
def test_layouts(spark, schema, layout):
    df = spark.createDataFrame([], schema)
    if layout is None:
        with pytest.raises(ValueError, match="No known layout"):
            detect_schema(df)
    else:
        assert detect_schema(df) == layout


def test_column_names_and_preview(spark):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b"), (4, "d")], "ID int, Text string")
    assert lower_columns(df).columns == ["id", "text"]
    assert [r.ID for r in preview(df, "ID").collect()] == [1, 2, 3]
    with pytest.raises(ValueError):
        lower_columns(spark.createDataFrame([(1, 2)], "a int, A int"))


def test_inputs_are_spread_on_demand(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    stored = spark.read.parquet(str(tmp_path / "one"))
    assert spread(stored) is stored
    spark.conf.set("textveil.read.tasks", "6")
    try:
        assert spread(stored).rdd.getNumPartitions() == 6 and spread(stored).count() == 100
    finally:
        spark.conf.unset("textveil.read.tasks")


def test_folder_of_arrays_and_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(RECORDS, indent=1))
    (tmp_path / "b.json").write_text("\n".join(json.dumps(r) for r in RECORDS))
    assert _rows(read_json(spark, str(tmp_path))) == sorted(RECORDS * 2, key=lambda r: r["id"])
    assert _rows(read_json(spark, str(tmp_path / "b.json"), lines=True)) == RECORDS
