"""Longest match over a vocabulary, against a plain loop."""

import base64
import json
import random

import pyarrow as pa
import pytest

import public_tokenizers
from textveil.functions.batches import PIECE, lists, pieces
from textveil.operators.tokens import tokenize_with
from textveil.operators.vocabulary import Vocabulary, read_vocabulary, vocabulary_ids, vocabulary_text
from textveil.plans.prepare import prepare


def plain_ids(text, tokens, unknown=None):
    data, longest, out = text.encode(), max(map(len, tokens)), []
    while data:
        size = next((n for n in range(min(longest, len(data)), 0, -1) if data[:n] in tokens), 0)
        if not size:
            size = 1
            while size < len(data) and data[size] & 0xC0 == 0x80:
                size += 1
            out.append(unknown)
        else:
            out.append(tokens[data[:size]])
        data = data[size:]
    return out


def _texts(seed, count):
    draw = random.Random(seed)
    letters = ["a", "b", "ab", " ", "  ", "é", "語", "😀", "\n", "the ", "ing", "0", "-" * 20, "\0"]
    return ["".join(draw.choices(letters, k=draw.randint(0, 40))) for _ in range(count)] + ["", None, "x" * 3000]


def test_longest_match(spark, tmp_path):
    tokens = ["a", "b", "ab", "aba", "the", "the ", "é", "ing", " ", "-" * 7, "xx", "x", "xxxxx", "-"]
    path = tmp_path / "tokens.json"
    path.write_text(json.dumps({t: 3 * i + 1 for i, t in enumerate(tokens)}))
    texts = _texts(1, 300)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    vocabulary = Vocabulary(str(path), unknown=0)
    rows = df.select("id", vocabulary_ids("text", vocabulary).alias("ids"))
    known = read_vocabulary(str(path))
    for r in rows.select("id", "ids", vocabulary_text("ids", vocabulary).alias("back")).collect():
        text = texts[r.id]
        if text is None:
            assert r.ids is None and r.back is None
            continue
        assert r.ids == plain_ids(text, known, 0)
        assert r.back == "".join(c if c.encode() in known or c in "abthexing- é" else "�" for c in r.back)
    with pytest.raises(Exception, match="no token"):
        df.select(vocabulary_ids("text", Vocabulary(str(path)))).collect()


def test_files(tmp_path):
    (tmp_path / "a.tiktoken").write_bytes(base64.b64encode(b"\xff\x00") + b" 7\n" + base64.b64encode(b"a") + b" 2\n")
    assert read_vocabulary(str(tmp_path / "a.tiktoken")) == {b"\xff\x00": 7, b"a": 2}
    (tmp_path / "a.txt").write_text("a\n\nb\na\n")
    assert read_vocabulary(str(tmp_path / "a.txt")) == {b"a": 0, b"b": 2}
    (tmp_path / "none.txt").write_text("")
    ids, at = Vocabulary(str(tmp_path / "none.txt"), 5).ids(pa.array(["aé", None]))
    assert ids.tolist() == [5, 5] and at.tolist() == [0, 2, 2]


def test_public_vocabulary(spark):
    """Whole texts of a byte vocabulary: ids of the plain loop, and the text back."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    texts = [t for t in _texts(2, 200) if t is not None]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(30).collect()]
    vocabulary = Vocabulary(path)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = df.select("id", vocabulary_ids("text", vocabulary).alias("ids"))
    known = read_vocabulary(path)
    for r in rows.select("id", "ids", vocabulary_text("ids", vocabulary).alias("back")).collect():
        assert r.ids == plain_ids(texts[r.id], known) and r.back == texts[r.id]
    same = df.select("id", tokenize_with("text", vocabulary.encoder()).alias("ids"))
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, rows.collect()))
    parts = prepare(spark, data=df.select("text"), max_length=16, encoder=vocabulary.encoder())
    assert all(len(r.input_ids) == 16 for r in parts["train"].collect())


def test_an_encoder_gets_pieces_of_batches(spark):
    texts = [None, "x" * 100, "", "é" * (PIECE // 4), "y" * (2 * PIECE), None, *["z" * (PIECE // 5)] * 12]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)

    def factory():
        def encode(given):
            assert len(given) < 2 or sum(len(t.encode()) for t in given) <= PIECE
            return [[len(t), 7] for t in given]

        return encode

    got = dict(df.select("id", tokenize_with("text", factory)).collect())
    assert got == {i: None if t is None else [len(t), 7] for i, t in enumerate(texts)}


def test_pieces_and_lists():
    rows = [[1, 2], None, [], [3], [4, 5, 6, 7], [8]]
    column = pa.array([[0], *rows], pa.list_(pa.int32())).slice(1)
    assert [p.to_pylist() for p in pieces(column, 3)] == [[[1, 2], None, [], [3]], [[4, 5, 6, 7]], [[8]]]
    assert lists(column) == rows
    assert lists(column.slice(1, 1)) == [None] and list(pieces(column.slice(0, 0))) == []
