"""Suffix and recompression dedup, and near-duplicate groups, against brute force."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from textveil.llm import near_dedup, prob_minhash, recompress_dedup, suffix_dedup
from textveil.llm.shared import PIECE, slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string"


def sha(data):
    return hashlib.sha256(data).hexdigest()


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def marks(items, width, counts):
    hit = [False] * len(items)
    for p in range(len(items) - width + 1):
        if counts[tuple(items[p : p + width])] > 1:
            hit[p : p + width] = [True] * width
    return hit


def repeated(rows, width):
    counts = Counter(tuple(r[p : p + width]) for r in rows for p in range(len(r) - width + 1))
    return [marks(r, width, counts) for r in rows]


def plain_bytes(rows, width):
    texts = [(t or "").encode() for _, t in rows]
    out = []
    for (i, _), data, hit in zip(rows, texts, repeated(texts, width), strict=True):
        spans = sum(1 for p, h in enumerate(hit) if h and (p == 0 or not hit[p - 1]))
        out.append((i, len(data), sum(hit), spans, sha(bytes(b for b, h in zip(data, hit, strict=True) if not h))))
    return sorted(out, key=repr)


def plain_words(rows, width):
    texts = [WORD.findall(t or "") for _, t in rows]
    out = []
    for (i, _), words, hit in zip(rows, texts, repeated(texts, width), strict=True):
        left = " ".join(w for w, h in zip(words, hit, strict=True) if not h)
        out.append((i, len(words), sum(hit), sha(left.encode())))
    return sorted(out, key=repr)


def odd_rows(rows, unit, width):
    """Nulls, repeated rows and ids, and runs of one unit that end at a window's edge."""
    return rows + [
        (None, unit * 5 * width),
        (None, None),
        (3, rows[5][1]),
        (5, rows[5][1]),
        (100, ""),
        (101, unit * width),
        (102, unit * (width + 1)),
        (103, unit.replace("a", "q") * width),
        (104, unit.replace("a", "q") * (width - 1) + "z"),
    ]


@pytest.mark.parametrize("width", [10, 200])
@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup(spark, width, seed):
    draw = random.Random(seed)
    base = ["".join(draw.choice("ab é") for _ in range(draw.randrange(6 * width))) for _ in range(12)]
    rows = []
    for i in range(50):
        parts = [
            draw.choice(base)[draw.randrange(3 * width) :][: draw.randrange(4 * width)]
            + "".join(draw.choice("xyz") for _ in range(draw.randrange(6)))
            for _ in range(draw.randrange(4))
        ]
        rows.append((i if i % 9 else 7, "".join(parts)))
    rows = odd_rows(rows, "a", width) + [(98, "ab" * width), (99, "abc" * width)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS lo", "'x' AS mark")
    assert collected(suffix_dedup.remove_repeats(docs, width=width)) == plain_bytes(rows, width)


def test_suffix_dedup_in_stretches(spark, monkeypatch):
    """Texts beyond one piece are worked on in overlapping stretches."""
    draw = random.Random(4)
    long = "".join(draw.choice("abcd") for _ in range(3000))
    rows = [(1, long), (2, "x" + long[700:1500] + "y"), (3, long[2990:] + "zz")]
    docs = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(suffix_dedup, "PIECE", 512)
    data, at = suffix_dedup.flat(suffix_dedup.pa.array([t for _, t in rows]))
    small = [x for b in suffix_dedup._blocks_of(data, at, 16, 50, None) for x in zip(*b, strict=True)]
    monkeypatch.undo()
    whole = [x for b in suffix_dedup._blocks_of(data, at, 16, 50, None) for x in zip(*b, strict=True)]
    windows = lambda blocks: {(r, p, int(k)) for r, lo, hi, k, _ in blocks for p in range(lo, hi + 1)}
    assert windows(small) == windows(whole)
    assert collected(suffix_dedup.remove_repeats(docs, width=50)) == plain_bytes(rows, 50)


def test_cut_repeats_keeps_columns(spark):
    rows = [(1, "é" * 30, "p"), (2, "é" * 30 + "end", None), (None, None, "q"), (4, "own", "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, los string")
    cut = suffix_dedup.cut_repeats(docs, width=10)
    assert cut.columns == docs.columns
    assert collected(cut) == sorted([(1, "", "p"), (2, "end", None), (None, "", "q"), (4, "own", "r")], key=repr)


@pytest.mark.parametrize("window", [4, 35])
@pytest.mark.parametrize("letters", [["a", "b"], ["a", "b", "c", "dé", "e"], [f"w{i}" for i in range(50)]])
def test_recompression_dedup(spark, window, letters):
    draw = random.Random(len(letters) + window)
    base = [[draw.choice(letters) for _ in range(draw.randrange(6 * window))] for _ in range(12)]
    rows = []
    for i in range(50):
        words = []
        for _ in range(draw.randrange(5)):
            words += draw.choice(base)[draw.randrange(3 * window) :][: draw.randrange(4 * window)]
            words += [draw.choice("xyz") for _ in range(draw.randrange(4))]
        rows.append((i if i % 9 else 7, draw.choice([" ", "\n", "  \t"]).join(words)))
    rows = odd_rows(rows, "a ", window) + [(98, "a b " * window), (99, "a b c " * window)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS lo", "'x' AS mark")
    assert collected(recompress_dedup.remove_repeats(docs, window=window)) == plain_words(rows, window)


def test_recompression_dedup_in_stretches(monkeypatch):
    """Windows choose the same symbols whether or not a text is parsed in one go."""
    draw = random.Random(3)
    text = " ".join(draw.choice("abcde") for _ in range(4000))
    data, at = recompress_dedup.flat(recompress_dedup.pa.array([text, text[500:3000]]))
    _, _, words, word_at = recompress_dedup._words(data, at)

    def windows():
        found = {}
        for row, lo, hi, key, _ in recompress_dedup._symbol_blocks(words, word_at, 35):
            for r, a, b, k in zip(row, lo, hi, key, strict=True):
                found |= {(r, p): int(k) for p in range(a, b + 1)}
        return found

    whole = windows()
    monkeypatch.setattr(recompress_dedup, "STRETCH", 300)
    assert windows() == whole
    assert len(whole) == sum(max(0, n - 34) for n in (word_at[1:] - word_at[:-1]))


def shingles(text):
    words = WORD.findall(text or "")
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1 if words else 0))}


def plain_groups(rows):
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if (rows[i][1] or "") == (rows[j][1] or "") or a and len(a & b) >= 0.8 * len(a | b) - 1e-9:
                parent[root(i)] = root(j)
    groups = {}
    for i, row in enumerate(rows):
        groups.setdefault(root(i), []).append(row[0])
    least = {k: min(v, key=lambda x: (x is None, x or 0)) for k, v in groups.items()}
    return sorted(((row[0], least[root(i)]) for i, row in enumerate(rows)), key=repr), len(groups)


@pytest.mark.parametrize("seed", [5, 6])
def test_near_duplicate_groups(spark, seed):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(30):
        base = [draw.choice(words) for _ in range(draw.choice([3, 8, 60, 200, 400]))]
        for _ in range(draw.choice([1, 1, 2, 3, 8, 25])):
            copy = list(base)
            for _ in range(draw.randrange(1 + len(copy) // 40)):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            rows.append((len(rows), " ".join(copy)))
    rows += [(None, None), (None, ""), (5, rows[5][1]), (7, "other text here"), (None, rows[3][1])]
    rows += [(900, "a"), (901, "a"), (902, "line x y z a b c " * 30)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS row", "'x' AS node")
    found = near_dedup.groups_of(docs)
    want, groups = plain_groups(rows)
    assert sorted(((r["doc_id"], r["group_id"]) for r in found.collect()), key=repr) == want
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == groups


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert suffix_dedup.remove_repeats(docs).collect() == []
    assert suffix_dedup.cut_repeats(docs).collect() == []
    assert recompress_dedup.remove_repeats(docs).collect() == []
    assert near_dedup.groups_of(docs).collect() == []
    assert near_dedup.keep_one(docs).collect() == []


def test_copies_around_an_original(spark):
    """All texts similar to an original are in its group, whatever they share among
    themselves; equal ones are counted; others stay apart."""
    draw = random.Random(12)
    words = [f"w{i}" for i in range(300)]
    original = [draw.choice(words) for _ in range(120)]
    rows = [(0, " ".join(original))]
    for i in range(1, 150):
        copy = list(original)
        for _ in range(draw.randrange(1, 5)):
            copy[draw.randrange(len(copy))] = draw.choice(words)
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, rows[1][1]) for i in range(40)]
    rows += [(2000 + i, " ".join(draw.choice(words) for _ in range(120))) for i in range(30)]
    first = shingles(rows[0][1])
    near = {i for i, t in rows if len(first & shingles(t)) >= 0.8 * len(first | shingles(t))}
    found = {r["doc_id"]: r for r in near_dedup.groups_of(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {i for i in near if found[i]["group_id"] == 0} == near and len(near) > 100
    assert all(found[i]["group_id"] == i and found[i]["kept"] for i, _ in rows if i >= 2000)
    assert found[1000]["n_copies"] == 41 and found[1000]["class_id"] == 1
    assert sum(r["kept"] for r in found.values() if r["group_id"] == 0) == 1


def test_near_copies_within_a_template(spark):
    """A near copy is found where all texts share a template just below the threshold, and
    other texts are the pivots of all buckets of the two."""
    draw = random.Random(17)
    words = [f"w{i}" for i in range(5000)]
    template = [draw.choice(words) for _ in range(200)]
    own = [[draw.choice(words) for _ in range(28)] for _ in range(30)]
    own[1][:5] = own[0][:5]
    rows = [(i, " ".join(template + part)) for i, part in enumerate(own)]
    want, groups = plain_groups(rows)
    assert groups == 29
    found = near_dedup.groups_of(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r["doc_id"], r["group_id"]) for r in found), key=repr) == want


def test_a_family_of_texts_around_a_template(spark):
    """5,000 texts share a template at about 0.75; some are near copies of one another, and
    nothing else is linked. No task meets all pairs of the family."""
    draw = random.Random(23)
    words = [f"w{i}" for i in range(20_000)]
    template = [draw.choice(words) for _ in range(60)]
    own = [[draw.choice(words) for _ in range(9)] for _ in range(5000)]
    for i in range(0, 400, 2):
        own[i + 1] = own[i][:8] + [draw.choice(words)]
    rows = [(i, " ".join(template + part)) for i, part in enumerate(own)]
    sets = [shingles(t) for _, t in rows[:2]]
    assert len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1])
    began = time.time()
    found = {r["doc_id"]: r["group_id"] for r in near_dedup.groups_of(spark.createDataFrame(rows, SCHEMA)).collect()}
    took = time.time() - began
    assert found == {i: i - 1 if i < 400 and i % 2 else i for i in range(5000)}
    assert took < 60, took


def test_weights_shape_the_sketch():
    """Registers agree as often as the probability Jaccard similarity of the weights says."""
    draw = random.Random(1)
    names = np.array([draw.randrange(1, 2**63) for _ in range(60)], np.uint64)
    one = np.array([draw.choice([1, 1, 2, 9, 40]) for _ in range(60)], float)
    two = np.array([draw.choice([1, 2, 3, 9, 80]) for _ in range(60)], float)
    n = np.concatenate([names[:50], names[10:]])
    text = np.repeat([0, 1], 50)
    order = np.lexsort((n, text))
    kept = prob_minhash.sketch(n[order], text[order], np.concatenate([one[:50], two[10:]])[order], 2, 8192)
    x = {int(k): w for k, w in zip(names[:50], one[:50], strict=True)}
    y = {int(k): w for k, w in zip(names[10:], two[10:], strict=True)}
    every = set(x) | set(y)
    expected = sum(
        1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in every) for i in set(x) & set(y)
    )
    assert abs((kept[0] == kept[1]).mean() - expected) < 0.02


def test_repeats_leave_a_bucket_in_common():
    """A copy with a line added 100 times, at similarity 0.8, shares a key with its original."""
    draw = random.Random(3)
    texts = []
    for i in range(20):
        base = " ".join(f"w{draw.randrange(10**6)}" for _ in range(164))
        line = " ".join(f"w{draw.randrange(10**6)}" for _ in range(36))
        texts += [base, base + f" {line}" * 100]
        one, two = shingles(texts[-2]), shingles(texts[-1])
        assert len(one & two) == 0.8 * len(one | two)
    batch = pa.RecordBatch.from_arrays([pa.array([bytes([i]) for i in range(40)]), pa.array(texts)], names=["node", "text"])
    made = near_dedup._sketch(near_dedup.SHINGLE, near_dedup.BANDS, near_dedup.ROWS)([batch])
    keys = {n: set(k) for part in made for n, k in zip(part["node"].to_pylist(), part["keys"].to_pylist(), strict=True)}
    assert all(keys[bytes([i])] & keys[bytes([i + 1])] for i in range(0, 40, 2))


def test_pairs_are_cut_by_both_texts():
    a, b = ["x" * (PIECE // 4)] * 40, ["y"] * 40
    batch = pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["text_a", "text_b"])
    parts = list(slices([batch], "text_a", "text_b"))
    assert sum(p.num_rows for p in parts) == 40 and max(p.num_rows for p in parts) <= 4


def test_short_texts_are_sketched_in_blocks(monkeypatch):
    texts = [f"word {i} of {i % 7} short ones {i % 90}" for i in range(2500)] + ["", "  "]
    batch = pa.RecordBatch.from_arrays([pa.array([b"%d" % i for i in range(len(texts))]), pa.array(texts)], names=["node", "text"])
    seen, real = [], near_dedup.sketch

    def watched(name, text, weight, n, registers):
        seen.append(n)
        return real(name, text, weight, n, registers)

    monkeypatch.setattr(near_dedup, "sketch", watched)
    parts = list(near_dedup._sketch(5, 32, 5)([batch]))
    assert max(seen) <= near_dedup.SKETCHED
    got = dict(zip(*(pa.concat_arrays([p.column(c) for p in parts]).to_pylist() for c in ("node", "keys")), strict=True))
    assert len(got) == 2500
    for i in (0, 999, 1000, 2499):
        (alone,) = near_dedup._sketch(5, 32, 5)([batch.slice(i, 1)])
        assert alone.column("keys").to_pylist() == [got[b"%d" % i]]
