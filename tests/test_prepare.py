import pytest
from pyspark.sql import functions as F

from plain import windows
from textveil.operators.messages import ChatTemplate, ensure_eos, render_chat, to_messages
from textveil.operators.order import running_total, with_file_order, with_position
from textveil.operators.split import shuffled, train_val_split
from textveil.operators.tokens import (
    Codec,
    collate,
    dropped_tokens,
    frame_documents,
    in_batches,
    length_stats,
    null_documents,
    pack,
    token_accounting,
    tokenize,
    tokenize_with,
    truncate,
    window_step,
)
from textveil.plans.prepare import chat_text, prepare, prepare_report
from textveil.sources.readers import from_records

CHATS = [
    {
        "messages": [
            {"role": "system", "content": "Answer in the manner of a ship's cook."},
            {"role": "user", "content": " You and I live in Sydney "},
            {"role": "assistant", "content": "Then the harbour\n\nis close by..."},
        ]
    },
    {"messages": [{"role": "user", "content": "Hi"}, {"role": "assistant", "content": "Hello"}]},
]


def _messages(df, layout):
    return [[(m.role, m.content) for m in r.messages] for r in to_messages(df, layout).collect()]


def test_alpaca(spark):
    df = spark.createDataFrame(
        [("do", "x", "y"), ("do", " ", "y"), ("do", None, None), (None, " z ", "y")],
        "instruction string, input string, output string",
    )
    assert _messages(df, "ALPACA") == [
        [("user", "do\n\nInput: x"), ("assistant", "y")],
        [("user", "do"), ("assistant", "y")],
        [("user", "do"), ("assistant", "")],
        [("user", "\n\nInput:  z "), ("assistant", "y")],
    ]
    assert _messages(df.drop("input"), "ALPACA")[0] == [("user", "do"), ("assistant", "y")]


def test_share_gpt(spark):
    turns = [("Human", "a"), ("gpt", None), ("SYSTEM", "s"), ("USER", "b"), ("tool", "t")]
    df = spark.createDataFrame([(turns,)], "conversations array<struct<from:string,value:string>>")
    assert _messages(df, "SHARE_GPT") == [
        [("user", "a"), ("assistant", ""), ("system", "s"), ("user", "b"), ("assistant", "t")]
    ]


@pytest.mark.parametrize(
    "layout, columns",
    [("PROMPT_RESPONSE", "prompt string, response string"), ("QA", "question string, answer string"),
     ("QLA", "question string, long_answer string")],
)
def test_pairs(spark, layout, columns):
    df = spark.createDataFrame([("q", "a"), (None, None)], columns)
    assert _messages(df, layout) == [
        [("user", "q"), ("assistant", "a")], [("user", ""), ("assistant", "")]
    ]
    with pytest.raises(ValueError):
        to_messages(df, "DAPT")


def test_rendering(spark):
    df = from_records(spark, CHATS)
    assert [r.rendered for r in chat_text(df, "CHATML").collect()] == [
        "<bos><start_of_turn>user\nAnswer in the manner of a ship's cook.\n\n"
        "You and I live in Sydney<end_of_turn>\n<start_of_turn>model\n"
        "Then the harbour\n\nis close by...<end_of_turn>\n<eos>",
        "<bos><start_of_turn>user\nHi<end_of_turn>\n<start_of_turn>model\nHello<end_of_turn>\n<eos>",
    ]
    other = ChatTemplate(bos="", turn_open="<", turn_close=">", role_break="|", fold_system=False, trim=False)
    assert df.select(render_chat("messages", other)).collect()[0][0].startswith("<system|Answer")
    strict = ChatTemplate(check_turns=True)
    assert df.select(render_chat("messages", strict)).count() == 2
    wrong = from_records(spark, [{"messages": [{"role": "assistant", "content": "x"}]}])
    with pytest.raises(Exception, match="alternate"):
        wrong.select(render_chat("messages", strict)).collect()


def test_end_marker(spark):
    df = spark.createDataFrame([("a",), ("a<eos>",), ("",)], "t string")
    assert [r[0] for r in df.select(ensure_eos("t")).collect()] == ["a<eos>", "a<eos>", "<eos>"]


def test_token_pieces(spark):
    text = "<bos>Hi, wörld  x<y <eos>\n\n\nend\t."
    df = spark.createDataFrame([(text,)], "text string")
    pieces = df.select(F.expr(f"regexp_extract_all(text, r'{Codec().pattern}', 0)")).collect()[0][0]
    assert "".join(pieces) == text
    assert pieces == ["<bos>", "Hi", ",", " wörld", "  ", "x", "<", "y", " ", "<eos>", "\n\n", "\n", "end", "\t", "."]
    ids = df.select(tokenize("text")).collect()[0][0]
    assert ids[0] == 2 and ids[9] == 1 and ids[10:12] == [108, 107]
    assert all(i >= 256 for n, i in enumerate(ids) if n not in (0, 9, 10, 11))


def test_marker_ids_of_a_chat(spark):
    rows = prepare(spark, data=CHATS[1:], max_length=128)["train"].collect()
    ids = rows[0].input_ids
    assert ids[:3] == [2, 105, ids[2]] and ids[3] == 107 and ids[-3:] == [106, 107, 1]
    assert rows[0].attention_mask == [1] * len(ids)


def test_cut_chats_lose_their_end(spark):
    short = prepare(spark, data=CHATS, max_length=6)["train"].collect()
    assert [len(r.input_ids) for r in short] == [6, 6]
    assert all(1 not in r.input_ids for r in short)
    with pytest.raises(ValueError):
        truncate(spark.createDataFrame([([1],)], "input_ids array<int>"), 0)


def test_python_encoder(spark):
    def factory():
        return lambda texts: [[len(t)] for t in texts]

    df = spark.createDataFrame([("abc",), ("",)], "text string")
    assert [r[0] for r in df.select(tokenize_with("text", factory)).collect()] == [[3], [0]]
    rows = prepare(spark, data=CHATS, encoder=factory)["train"].collect()
    assert all(len(r.input_ids) == 1 and r.input_ids[0] > 50 for r in rows)


def _documents(spark, n):
    texts = [" ".join(f"w{i}_{j}" for j in range((i * 7) % 23)) for i in range(n)]
    texts[3] = "<bos>already framed<eos>"
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string"), texts


@pytest.mark.parametrize("length, overlap", [(16, 0.0), (16, 0.25), (10, 0.55), (5000, 0.0)])
@pytest.mark.parametrize("dense", [True, False])
def test_packing(spark, length, overlap, dense):
    df, texts = _documents(spark, 230)
    ids = {r.id: r.ids for r in frame_documents(in_batches(df, "id", 50, dense=True))
           .select("id", tokenize("text").alias("ids")).collect()}
    rows = frame_documents(in_batches(df, "id", 50, dense=dense)).withColumn("input_ids", tokenize("text"))
    packed = pack(rows, length, overlap).collect()
    got = {(r.batch, r.window): (r.input_ids, r.attention_mask) for r in packed}
    expected, tokens = {}, {}
    for batch in range(5):
        joined = [t for i in range(batch * 50, min(230, batch * 50 + 50)) for t in ids[i]]
        tokens[batch] = joined
        for n, w in enumerate(windows(joined, length, overlap)):
            expected[(batch, n)] = (w, [1] * len(w))
    assert got == expected
    left = {r.batch: (r.tokens, r.dropped) for r in dropped_tokens(rows, length, overlap).collect()}
    for batch, joined in tokens.items():
        cut = windows(joined, length, overlap)
        step = window_step(length, overlap)
        seen = min(len(joined), (len(cut) - 1) * step + length) if cut else 0
        assert left[batch] == (len(joined), len(joined) - seen)
    if not overlap:
        whole = pack(rows, length, keep_tail=True).collect()
        assert sum(len(r.input_ids) for r in whole) == sum(map(len, tokens.values()))


def test_document_tokens_equal_tokens_of_the_joined_text(spark):
    df, texts = _documents(spark, 60)
    joined = []
    for i, text in enumerate(texts):
        if i and not text.startswith("<bos>"):
            text = "<bos>" + text
        joined.append(text if text.endswith("<eos>") else text + "<eos>")
    one = spark.createDataFrame([("<bos>" + "\n".join(joined),)], "text string")
    expected = one.select(tokenize("text")).collect()[0][0]
    framed = frame_documents(in_batches(df, "id", 60, dense=True))
    parts = framed.select("in_batch", tokenize("text").alias("ids")).orderBy("in_batch").collect()
    assert [t for p in parts for t in p.ids] == expected


def test_overlap_limits():
    for overlap in (1.0, 1.5, -0.1):
        with pytest.raises(ValueError):
            window_step(16, overlap)
    assert window_step(16, 0.99) == 1


def test_split(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    parts = train_val_split(df, 0.2, "k")
    counts = {r["split"]: r["count"] for r in parts.groupBy("split").count().collect()}
    assert 850 < counts["validation"] < 1150 and sum(counts.values()) == 5000
    again = train_val_split(df.repartition(7), 0.2, "k")
    assert parts.exceptAll(again).count() == 0
    assert train_val_split(df, 0.2, "k", seed=1).exceptAll(parts).count() > 0
    for ratio in (0, 1, -0.5, 2):
        with pytest.raises(ValueError):
            train_val_split(df, ratio, "k")


@pytest.mark.parametrize("n, ratio", [(2, 0.5), (3, 0.5), (1000, 0.1), (999, 0.333), (70000, 0.5)])
def test_exact_split(spark, n, ratio):
    parts = train_val_split(spark.range(n), ratio, "id", exact=True)
    counts = {r["split"]: r["count"] for r in parts.groupBy("split").count().collect()}
    assert counts["validation"] == -(-n * ratio // 1) and sum(counts.values()) == n


def test_prepare_with_split(spark):
    parts = prepare(spark, data=CHATS, split=0.5, exact=True)
    assert {name: df.count() for name, df in parts.items()} == {"train": 1, "validation": 1}
    assert set(prepare(spark, data=CHATS)) == {"train"}
    for bad in (0, 1.0, 3):
        with pytest.raises(ValueError):
            prepare(spark, data=CHATS, split=bad)
    with pytest.raises(ValueError):
        prepare(spark)
    with pytest.raises(ValueError):
        prepare(spark, path="x.json", data=from_records(spark, CHATS))


def test_prepare_documents(spark):
    df, _ = _documents(spark, 120)
    upper = df.withColumnRenamed("text", "TEXT").union(spark.createDataFrame([(500, None)], df.schema))
    assert tuple(null_documents(upper, "TEXT").collect()[0]) == (121, 1)
    keyed = prepare(spark, data=upper, max_length=16, key="id")["train"]
    assert keyed.columns == ["input_ids", "attention_mask"]
    dense = prepare(spark, data=df, max_length=16, key="id", dense=True)["train"]
    assert sorted(r.input_ids for r in keyed.collect()) == sorted(r.input_ids for r in dense.collect())
    unkeyed = prepare(spark, data=df.select("text"), max_length=16)["train"]
    assert unkeyed.count() == dense.count()
    parts = prepare(spark, data=df, max_length=16, split=0.3, key="id")
    assert parts["train"].count() > parts["validation"].count() > 0


def test_positions(spark):
    df = spark.range(1000).selectExpr("id * 37 % 1000 as k", "id").repartition(6)
    placed = with_position(df, "k").collect()
    assert all(r.position == r.k for r in placed)
    numbered = with_file_order(df, "n").collect()
    assert sorted(r.n for r in numbered) == list(range(1000))
    totals = running_total(spark.range(1000).withColumnRenamed("id", "k").withColumn("v", F.col("k") * 2),
                           "k", "v", "t", group=64)
    assert all(r.t == r.k * (r.k + 1) for r in totals.collect())


def test_positions_of_ties_and_nulls(spark):
    df = spark.createDataFrame([(v,) for v in [3, None, 1, 3, None, 2, 3]], "k int")
    placed = sorted((r.position, r.k) for r in with_position(df, "k").collect())
    assert placed == list(enumerate([None, None, 1, 2, 3, 3, 3]))


def test_files_are_read_in_order(spark, tmp_path):
    """Whatever their sizes: Spark deals out the largest file first."""
    (tmp_path / "a.jsonl").write_text("".join('{"n": %d}\n' % i for i in range(3)))
    (tmp_path / "b.jsonl").write_text("".join('{"n": %d, "pad": "%s"}\n' % (i, "x" * 500) for i in range(3, 900)))
    rows = with_file_order(spark.read.json(str(tmp_path)), "place").select("n", "place").collect()
    assert all(r.n == r.place for r in rows) and len(rows) == 900


def test_accounting_and_batches(spark):
    sizes = [3, 1, 4, 1, 5, 2, 6]
    df = spark.createDataFrame([(i, [7] * n) for i, n in enumerate(sizes)], "p long, input_ids array<int>")
    steps = {r.step: (r.tokens, r.tokens_seen) for r in token_accounting(df, "p", 2, padded=False).collect()}
    assert steps == {1: (4, 4), 2: (5, 9), 3: (7, 16), 4: (6, 22)}
    logged = token_accounting(df, "p", 2, logging_steps=2, padded=False).collect()
    assert sorted((r.step, r.tokens_seen) for r in logged) == [(2, 9), (4, 22)]
    padded = {r.step: r.tokens for r in token_accounting(df, "p", 2).collect()}
    assert padded == {1: 6, 2: 8, 3: 10, 4: 6}
    gathered = {r.step: (r.tokens, r.tokens_seen) for r in token_accounting(df, "p", 2, accumulation=2).collect()}
    assert gathered == {1: (14, 14), 2: (16, 30)}
    stats = length_stats(df).collect()[0]
    assert tuple(stats) == (7, 22, 1, 6)
    rows = {r.p: r for r in collate(df, "p", 2).collect()}
    assert rows[1].input_ids == [7, 0, 0]
    assert rows[1].attention_mask == [1, 0, 0]
    assert rows[1].labels == [7, -100, -100]
    assert rows[6].input_ids == [7] * 6


def test_shuffled_order(spark):
    """A permutation that depends on keys and seed only, and not on the key's order."""
    df = spark.createDataFrame([(f"k{i:04d}", i) for i in range(3000)], "id string, n int")
    one = {r.id: r.position for r in shuffled(df.repartition(7), "id", 1).collect()}
    assert sorted(one.values()) == list(range(3000))
    assert one == {r.id: r.position for r in shuffled(df, "id", 1).collect()}
    two = {r.id: r.position for r in shuffled(df, "id", 2).collect()}
    assert sum(one[k] == two[k] for k in one) < 30
    near = sum(abs(one[f"k{i:04d}"] - one[f"k{i + 1:04d}"]) < 100 for i in range(2999))
    assert near < 400


def test_report_of_what_is_left_out(spark):
    docs = [(i, f"word{i} " * (i % 9)) for i in range(50)] + [(90, None), (91, None)]
    df = spark.createDataFrame(docs, "id int, text string")
    report = prepare_report(spark, data=df, max_length=16, key="id").collect()
    rows = prepare(spark, data=df, max_length=16, key="id")["train"].collect()
    assert len(report) == 1
    assert (report[0].records, report[0].left_out) == (52, 2)
    assert report[0].tokens - report[0].dropped == sum(len(r.input_ids) for r in rows)
    chats = spark.createDataFrame([(i, "hello " * i, "answer") for i in range(20)], "id int, prompt string, response string")
    parts = prepare(spark, data=chats, max_length=20, split=0.3, key="id")
    for r in prepare_report(spark, data=chats, max_length=20, split=0.3, key="id").collect():
        ids = [len(x.input_ids) for x in parts[r.split].collect()]
        assert r.records == len(ids) and r.tokens - r.dropped == sum(ids) and r.left_out == 0
