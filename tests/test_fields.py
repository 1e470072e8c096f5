from pyspark.sql import functions as F

from textveil.functions.rules import select_rules
from textveil.operators.fields import extract_text_fields, set_text_fields
from textveil.plans.sanitize import organize, sanitize, summary
from textveil.operators.detect import detect_pii

SCHEMA = (
    "id int, text string, n double, tags array<string>, "
    "nested struct<a:string, deep:array<struct<b:string, k:int>>>, "
    "free map<string, string>, `odd.name` string, grid array<array<string>>"
)
ROW = (
    7, "t a@b.co", 1.5, ["x", "", "c@d.co"],
    ("na", [("b0", 1), (None, 2), ("e@f.co", 3)]),
    {"k.1": "g@h.co", "plain": "v"}, "odd i@j.co", [["p"], ["q", "k@l.co"]],
)
EMPTY = (8, None, None, None, None, None, None, None)


def _df(spark):
    return spark.createDataFrame([ROW, EMPTY], SCHEMA)


def test_paths(spark):
    fields = extract_text_fields(_df(spark), "id").orderBy("field_ord").collect()
    # Entries of a map have no order of their own.
    fields[6:8] = sorted(fields[6:8], key=lambda r: r.field_path)
    assert [(r.record_id, r.field_path, r.text) for r in fields] == [
        (7, "text", "t a@b.co"),
        (7, "tags[0]", "x"),
        (7, "tags[2]", "c@d.co"),
        (7, "nested.a", "na"),
        (7, "nested.deep[0].b", "b0"),
        (7, "nested.deep[2].b", "e@f.co"),
        (7, "free.k.1", "g@h.co"),
        (7, "free.plain", "v"),
        (7, "odd.name", "odd i@j.co"),
        (7, "grid[0][0]", "p"),
        (7, "grid[1][0]", "q"),
        (7, "grid[1][1]", "k@l.co"),
    ]


def test_every_leaf_is_sanitised_in_place(spark):
    df = _df(spark)
    out = sanitize(df, "redact", "id", rules=select_rules(include=["email"]))
    assert out.dtypes == df.dtypes
    rows = {r.id: r.asDict(recursive=True) for r in out.collect()}
    x = "[REDACTED]"
    assert rows[7] == {
        "id": 7, "text": f"t {x}", "n": 1.5, "tags": ["x", "", x],
        "nested": {"a": "na", "deep": [{"b": "b0", "k": 1}, {"b": None, "k": 2}, {"b": x, "k": 3}]},
        "free": {"k.1": x, "plain": "v"}, "odd.name": f"odd {x}", "grid": [["p"], ["q", x]],
    }
    assert all(v is None for k, v in rows[8].items() if k != "id")


def test_names_that_look_like_paths(spark):
    df = spark.createDataFrame(
        [(1, "a@b.co", ("plain",))], "id int, `s.t` string, s struct<t:string>"
    )
    row = sanitize(df, "redact", "id").collect()[0]
    assert row["s.t"] == "[REDACTED]" and row["s"]["t"] == "plain"


def test_set_fields(spark):
    df = _df(spark)
    fields = extract_text_fields(df, "id")
    same = set_text_fields(df, "id", fields)
    assert [r.asDict(True) for r in same.orderBy("id").collect()] == [
        r.asDict(True) for r in df.orderBy("id").collect()
    ]
    one = fields.filter("field_path = 'nested.deep[2].b'").withColumn("text", F.lit("new"))
    row = set_text_fields(df, "id", one).filter("id = 7").collect()[0]
    assert row.nested.deep[2].b == "new" and row.text == "t a@b.co"


def test_columns_and_string_keys(spark):
    df = spark.createDataFrame([("a@b.co", "c@d.co", "e@f.co")], "k string, x string, y string")
    row = sanitize(df, "redact", "k", columns=["y"]).collect()[0]
    assert tuple(row) == ("a@b.co", "c@d.co", "[REDACTED]")
    assert sanitize(df, "redact", "k").collect()[0]["k"] == "a@b.co"
    assert sanitize(df, "redact").collect()[0]["k"] == "[REDACTED]"


def test_organize_and_summary(spark):
    df = _df(spark)
    found = detect_pii(df, "id", rules=select_rules(include=["email"]))
    grouped = {r.record_id: r.fields for r in organize(df, "id", found).collect()}
    assert grouped[8] == {}
    assert sorted(grouped[7]) == [
        "free.k.1", "grid[1][1]", "nested.deep[2].b", "odd.name", "tags[2]", "text"
    ]
    assert grouped[7]["text"][0].match == "a@b.co"
    assert [tuple(r) for r in summary(found).collect()] == [("CONTACT_EMAIL", "email", 6, 1)]


def test_leaves_behind_values_of_changing_size(spark):
    schema = (
        "id int, a array<struct<xs:array<string>, y:string>>, m map<string, array<string>>, "
        "z struct<q:array<string>, r:string>, last string"
    )
    rows = [
        (1, [(["p", "a@b.co"], "y0"), (None, "c@d.co"), ([], None), (["e@f.co"], "y3")],
         {"k": ["g@h.co", "v"]}, (["w", "i@j.co"], "r"), "k@l.co"),
        (2, None, {"k": None, "l": ["m@n.co"]}, None, "plain"),
        (3, [], {}, (None, "o@p.co"), "q@r.co"),
    ]
    df = spark.createDataFrame(rows, schema)
    emails = select_rules(include=["email"])
    out = {r.id: r.asDict(True) for r in sanitize(df, "redact", "id", rules=emails).collect()}
    before = {r.id: r.asDict(True) for r in df.collect()}

    def clean(value):
        if isinstance(value, str):
            return "[REDACTED]" if "@" in value else value
        if isinstance(value, dict):
            return {k: clean(v) for k, v in value.items()}
        if isinstance(value, list):
            return [clean(v) for v in value]
        return value

    assert out == {k: clean(v) for k, v in before.items()}


def test_one_very_long_conversation(spark):
    turns = spark.range(30000).selectExpr("id", "concat('turn ', id, ' by a', id, '@b.co') as text")
    df = turns.groupBy(F.lit(1).alias("id")).agg(
        F.expr("transform(array_sort(collect_list(struct(id, text))), t -> struct('user' as role, t.text as content))").alias("messages")
    )
    out = sanitize(df, "redact", "id", rules=select_rules(include=["email"]))
    row = out.select(F.expr("exists(messages, m -> m.content LIKE '%@%')"), F.expr("size(messages)"),
                     F.expr("messages[29999].content")).collect()[0]
    assert tuple(row) == (False, 30000, "turn 29999 by [REDACTED]")


def test_column_names_like_variables(spark):
    names = ["x0", "i0", "s0", "s", "t", "c", "r", "h", "leaf", "v", "raw"]
    schema = ", ".join(f"{n} array<struct<{n}:array<string>>>" for n in names)
    value = [(["a@b.co", "plain"],), (["x"],)]
    df = spark.createDataFrame([tuple(value for _ in names)], schema)
    row = sanitize(df, "redact", rules=select_rules(include=["email"])).collect()[0]
    assert all(row[n] == [(["[REDACTED]", "plain"],), (["x"],)] for n in names)
    paths = extract_text_fields(df.selectExpr("1 as id", "*"), "id").collect()
    assert len(paths) == 3 * len(names)
