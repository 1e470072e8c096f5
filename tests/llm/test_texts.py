"""Quality rules, decontamination and tokenizers against brute force and the libraries."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from textveil.llm import bpe_codec, decontaminate, quality, token_counts
from textveil.llm.bpe_arrays import Remembered, merge, merge_long
from textveil.llm.shared import flat

public_tokenizers = pytest.importorskip("public_tokenizers")
PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def plain_measure(text, grams):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, lines, line_chars = set(), 0, 0
    for line in text.split("\n"):
        own = re.findall(r"[^\x20\x09-\x0D]+", line)
        if own:
            if line in seen:
                lines, line_chars = lines + 1, line_chars + sum(map(len, own))
            seen.add(line)
    out = {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": lines,
        "dup_line_chars": line_chars,
    }
    for n in {8, *grams}:
        counts = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        hit = [False] * len(words)
        for i in range(len(words) - n + 1):
            if counts[tuple(words[i : i + n])] > 1:
                hit[i : i + n] = [True] * n
        if n == 8:
            out["n_repeat_words"] = sum(hit)
        if n in grams:
            out[f"dup_chars_{n}"] = sum(len(w) for w, h in zip(words, hit, strict=True) if h)
    return out


def test_measures():
    draw = random.Random(3)
    pool = ["a ", "é ", "\n", "b# ", "c\t", "a\n", "\x0b", "\x85", "語 "]
    texts = [None, "", "\n", "a", "a\n", "\na\n\na", " \n \n"]
    texts += ["".join(draw.choice(pool) for _ in range(draw.randrange(150))) for _ in range(300)]
    found = quality.measure(*flat(pa.array(texts)), (5, 8, 10))
    for i, text in enumerate(texts):
        want = plain_measure(text, (5, 8, 10))
        assert {k: int(found[k][i]) for k in want} == want


def test_quality_verdicts(spark):
    good = " ".join(f"word{i}" for i in range(50))
    rows = [
        (1, good),
        (2, "too short"),
        (3, "the same eight words come again and again " * 10),
        (4, " ".join(f"w{i} ###" for i in range(50))),
        (None, None),
        (1, good),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 AS kept", "8 AS n_words")
    judged = quality.judge(docs.drop("kept")).select("doc_id", "base_failed", "kept")
    want = [(1, False, True), (1, False, True), (2, True, False), (3, True, False), (4, False, False), (None, True, False)]
    assert collected(judged) == sorted(want, key=repr)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and collected(kept) == [(1, good, 7, 8)] * 2
    assert quality.judge(docs.limit(0)).collect() == []


LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return LETTERS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")))


def plain_contamination(rows, items, window):
    tests, windows = [("null" if i is None else str(i), plain_words(t)) for i, t in items], {}
    for item, words in tests:
        for p in range(max(len(words) - window + 1, 1 if words else 0)):
            windows.setdefault(tuple(words[p : p + window]), set()).add(item)
    ranges = {tuple(w[a:b]) for _, w in tests for a in range(len(w)) for b in range(a + 1, len(w) + 1)}
    out = []
    for i, text in rows:
        words = plain_words(text)
        hit, found, longest = [False] * len(words), set(), 0
        for p in range(len(words)):
            for size in range(1, window + 1):
                owners = windows.get(tuple(words[p : p + size])) if p + size <= len(words) else None
                if owners:
                    found |= owners
                    hit[p : p + size] = [True] * size
                    longest = max(longest, size)
                    while size >= window and p + size <= len(words) and tuple(words[p : p + size]) in ranges:
                        longest = max(longest, size)
                        size += 1
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        bad = sum(hit) > 0 and 20 * sum(hit) >= len(words)
        out.append((i, len(words), sum(hit), len(found), digest, bad, longest))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [3, 13])
@pytest.mark.parametrize("letters", [["a", "B", "c"], [f"W{i}é" for i in range(30)]])
def test_contamination(spark, window, letters):
    draw = random.Random(window)
    items = [
        (i, draw.choice([" ", ", "]).join(draw.choice(letters) for _ in range(draw.randrange(3 * window))))
        for i in range(20)
    ]
    items += [(3, "a b"), (4, None), (5, "..."), (None, "a c c"), (30, "W1é " * 15), (30, "W1é " * 15)]
    rows = []
    for i in range(50):
        words = []
        for _ in range(draw.randrange(5)):
            own = (draw.choice(items)[1] or "").split(" ")
            first = draw.randrange(len(own))
            words += own[first : first + draw.randrange(3 * window)]
            words += [draw.choice("xyz") for _ in range(draw.randrange(40))]
        rows.append((i if i % 9 else 7, draw.choice([" ", "\n"]).join(words)))
    rows += [(None, None), (1, ""), (2, "W1é " * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS items", "'x' AS mark")
    tests = spark.createDataFrame(items, "item_id long, text string")
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match"]
    want = plain_contamination(rows, items, window)
    for block_bytes in (4 << 20, 300):  # one block of items, and many
        found = decontaminate.find_contamination(docs, tests, window=window, block_bytes=block_bytes)
        got = collected(found.select(*names))
        assert got == want
    clean = decontaminate.decontaminate(docs, tests, window=window)
    assert clean.columns == docs.columns and clean.count() == sum(not r[5] for r in want)


def test_long_matches(spark):
    """A copied article is measured whole, whatever its length and wherever items end."""
    draw = random.Random(3)
    article = [f"w{draw.randrange(900)}" for _ in range(20_000)]
    docs = [(1, " ".join(["x"] * 50 + article + ["y"] * 50)), (2, " ".join(article[5000:])), (3, " ".join(article[:14] + ["z"]))]
    items = [(1, " ".join(article)), (2, " ".join(article[100:5000])), (3, " ".join(article[2:14]))]
    docs, items = (spark.createDataFrame(x, f"{k} long, text string") for x, k in ((docs, "doc_id"), (items, "item_id")))
    for block_bytes in (4 << 20, 2000):
        found = decontaminate.find_contamination(docs, items, block_bytes=block_bytes)
        assert {r.doc_id: (r.longest_match, r.n_items) for r in found.collect()} == {1: (20_000, 3), 2: (15_000, 1), 3: (14, 2)}


def test_contamination_without_items_or_documents(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(docs, none).count() == 2
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert decontaminate.decontaminate(docs.limit(0), items).count() == 0


POOL = (
    ["a", "b", "the", " ", "  ", "▁", "\n", "\t", "é", "語", "😀", "\x00", "<s>", "</s>", "0", "12", "ing", "ﬁ"]
    + ["'s", "'", "'ll", "'re", "'d", "'S", "'ve", "'mx", "\x85", "\xa0", "\u2028", "\x1c", "\u200b", "٣", "²"]
    + ["<|endoftext|>", "<|endoftext", "|>", "==", "----", "A", "aa", "aaaa"]
)


def odd_texts(seed, count):
    draw = random.Random(seed)
    texts = ["", None, "a" * 5000, "ab" * 3000, " " * 1000, "-" * 2000, "<|endoftext|><|endoftext|>x"]
    texts.append("".join(draw.choice("abcdefghij") for _ in range(5000)))
    return texts + ["".join(draw.choice(POOL) for _ in range(draw.randrange(1, 60))) for _ in range(count)]


def test_token_counts():
    import sentencepiece

    library, texts = sentencepiece.SentencePieceProcessor(model_file=PIECES), odd_texts(1, 2000)
    found = token_counts.count_texts(pa.array(texts), token_counts.PieceModel(PIECES), Remembered())
    assert found.tolist() == [len(library.encode(t or "")) for t in texts]


def test_token_count_columns(spark):
    docs = spark.createDataFrame([(1, "é a"), (None, None), (2, "x " * 5000)], "doc_id long, text string")
    found = token_counts.count_tokens(docs.selectExpr("*", "5 AS n_tokens"), PIECES).select(
        "doc_id", "n_bytes", "n_tokens", "over_limit"
    )
    rows = {r[0]: tuple(r[1:]) for r in found.collect()}
    assert rows[None] == (0, 0, False) and rows[1] == (4, 2, False) and rows[2][0] == 10000 and rows[2][2]
    assert token_counts.count_tokens(docs.limit(0), PIECES).collect() == []


def test_encoding_and_decoding():
    from tokenizers import Tokenizer

    library, model = Tokenizer.from_file(BYTES), bpe_codec.ByteBpe(BYTES)
    draw = random.Random(2)
    texts = odd_texts(2, 3000) + ["".join(draw.choice("etaoinshr") for _ in range(draw.randrange(14))) for _ in range(3000)]
    ids, at = model.encode(pa.array(texts, pa.string()), Remembered())
    want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == want
    assert model.decode(ids, at) == [library.decode(x, skip_special_tokens=False) for x in want]


def test_character_kinds():
    from tokenizers import Tokenizer

    split, kinds = Tokenizer.from_file(BYTES).pre_tokenizer, bpe_codec.char_kinds(BYTES)
    for point in [*range(0x3100), *range(0x10000, 0x20000, 7)]:
        alone = [len(split.pre_tokenize_str(c + chr(point))) == 1 for c in "a1!"]
        assert kinds[point] == (alone.index(True) if any(alone) else bpe_codec.WHITE), hex(point)


def test_failing_words_are_merged_exactly():
    """Both ways of merging, and the guess with its test, agree."""
    model, draw = bpe_codec.ByteBpe(BYTES), random.Random(8)
    words = ["".join(draw.choice("abcdeé") for _ in range(draw.randrange(1, 40))).encode() for _ in range(2000)]
    data, at = flat(pa.array(words))
    ids, sizes, failed = model.encode_words(data, at)
    assert failed > 0
    symbols = model.byte_id[data]
    whole, _ = merge(symbols, np.repeat(np.arange(len(words)), np.diff(at)), model.pairs)
    assert ids.tolist() == whole.tolist()
    ends = np.cumsum(sizes)
    for i in range(200):
        assert merge_long(symbols[at[i] : at[i + 1]].tolist(), model.pairs) == ids[ends[i] - sizes[i] : ends[i]].tolist()


def test_codec_columns(spark):
    docs = spark.createDataFrame([(1, "héllo <|endoftext|>"), (None, None), (1, "x")], "doc_id long, text string")
    found = bpe_codec.encode_texts(docs.selectExpr("*", "1 AS ids"), BYTES, with_ids=True)
    back = bpe_codec.decode_ids(found.select("doc_id", "text", "ids", "decoded_sha256"), BYTES).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in back)
    assert all(hashlib.sha256(r["decoded"].encode()).hexdigest() == r["decoded_sha256"] for r in back)
    assert bpe_codec.encode_texts(docs.limit(0), BYTES).collect() == []
