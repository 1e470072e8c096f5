"""Vector codes, shards and importance resampling, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from textveil.llm import importance, queries, shard_packing, vector_codes


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# Vector codes


def plain_codes(rows, parts, entries, rounds):
    """All distances, no bounds."""
    kept = [
        (i, [math.floor(256 * x) for x in v], label)
        for i, v, label in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for c in cut:
                members[nearest(c[p], books[p])[1]].append(c[p])
            books[p] = [
                [sum(x) // len(members[k]) for x in zip(*members[k], strict=True)] if members[k] else e
                for k, e in enumerate(books[p])
            ]
    found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = Counter()
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] += e
    out = [
        (i, [k for _, k in f], e, by_label[label])
        for (i, _, label), f, e in zip(kept, found, errors, strict=True)
    ]
    return sorted(out, key=repr), [x for b in books for e in b for x in e]


def vectors(n, dims, seed, spread=0.3):
    draw = random.Random(seed)
    centres = [[draw.gauss(0, 1) for _ in range(dims)] for _ in range(9)]
    return [
        (i * 3 % n, [float(np.float32(c + draw.gauss(0, spread))) for c in centres[draw.randrange(9)]], draw.choice([None, 1, 2]))
        for i in range(n)
    ]


@pytest.mark.parametrize(("rounds", "entries"), [(0, 5), (2, 16), (5, 12)])
def test_codes_equal_all_distances(spark, rounds, entries):
    rows = vectors(300, 12, 4)
    rows += [rows[0], rows[1], (None, rows[2][1], 7), (-5, None, 1), (-4, [None] * 12, 1)]
    rows += [(-3, [math.nan] * 12, 1), (-2, [math.inf] + [0.0] * 11, None), (-1, [0.0] * 11, 1)]
    # The vector of the smallest id that is kept at all sets the length.
    rows[-1] = (900, [0.0] * 11, 1)
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>, label int").repartition(5)
    coded, books = vector_codes.compress(df, parts=4, entries=entries, rounds=rounds)
    found = vector_codes.with_label_error(coded)
    expected, flat = plain_codes([r for r in rows if r[0] != 900], 4, entries, rounds)
    assert collected(found.select("id", "codes", "error", "label_error")) == expected
    assert books.ravel().tolist() == flat


def test_bounds_skip_groups_and_use_net_moves():
    draw = np.random.default_rng(3)
    x = draw.integers(-900, 900, (500, 3, 4))
    books = x[:32].transpose(1, 0, 2).copy()
    history = np.stack([books, books + draw.integers(-40, 40, books.shape), books + 1])
    state = vector_codes.first_scan(x, history[0])
    calls = []
    plain = vector_codes.squared
    vector_codes.squared = lambda a, b: (calls.append(len(a)), plain(a, b))[1]
    try:
        middle = vector_codes.next_scan(x, history[:2], state)
        calls.clear()
        last = vector_codes.next_scan(x, history, middle)
    finally:
        vector_codes.squared = plain
    every = vector_codes.first_scan(x, history[2])
    assert (last.near == every.near).all() and (last.error == every.error).all()
    assert sum(calls) < 0.9 * 500 * 3 * vector_codes.GROUPS
    # Entries went forth and back: from round 0 on the net move is tiny, the moves are not.
    moves = vector_codes.net_moves(history)
    assert moves[0].max() < 3 < vector_codes.net_moves(history[1:])[0].min()
    # Bounds hold for all entries but the own one.
    for p in range(3):
        d = np.sqrt(plain(x[:, p], history[2][p]).astype(float))
        d[np.arange(500), last.near[:, p]] = np.inf
        for g, (a, b) in enumerate(vector_codes.grouped(32)):
            assert (d[:, a:b].min(1) >= last.bound[:, p, g] - moves[last.stamp[:, p, g], p, g] - 1e-3).all()


def test_codes_of_odd_tables(spark):
    schema = "vec_id long, embedding array<double>, label string, codes int, x string"
    coded, books = vector_codes.compress(spark.createDataFrame([(1, None, "a", 1, "b")], schema))
    assert coded.collect() == [] and books.size == 0
    one = spark.createDataFrame([(1, [0.5] * 32, "a", 1, "b")] * 3, schema)
    coded, books = vector_codes.compress(one)
    assert {tuple(r.codes) for r in coded.collect()} == {(0,) * 16} and books.shape == (16, 3, 2)
    back = vector_codes.reconstructed(coded, books).first()["vector"]
    assert back == pytest.approx([0.5] * 32, abs=1 / 256)
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress(spark.createDataFrame([(1, [0.5] * 30, "a", 1, "b")], schema))


def test_codes_of_the_given_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    expected, flat = plain_codes(rows, 16, 64, 2)
    digest = hashlib.sha256(",".join(map(str, flat)).encode()).hexdigest()
    found = [tuple(r) for r in queries.op11_vector_codes(spark, sf).collect()]
    assert sorted(found, key=repr) == sorted(
        ((i, bytes(c).hex(), e, label, digest) for i, c, e, label in expected), key=repr
    )


# Shards


def test_rooms_find_the_tightest():
    draw = random.Random(2)
    rooms, plain = shard_packing.Rooms(), []
    for step in range(3000):
        if draw.random() < 0.55:
            key = (draw.randrange(200), step)
            rooms.put(*key)
            plain.append(key)
        else:
            size = draw.randrange(220)
            fitting = [k for k in plain if k[0] >= size]
            best = min(fitting, default=None)
            assert rooms.take(size) == best
            if best:
                plain.remove(best)


def plain_best_fit(sizes, capacity):
    rooms, out = [], []
    for size in sizes:
        room, at = min(((r, k) for k, r in enumerate(rooms) if r >= size), default=(None, len(rooms)))
        if room is None:
            rooms.append(max(capacity, size))
        rooms[at] -= size
        out.append(at)
    return out


def test_best_fit_against_scan():
    draw = random.Random(8)
    for _ in range(30):
        sizes = sorted((draw.randint(1, 60) for _ in range(200)), reverse=True)
        assert shard_packing.best_fit(sizes, 70) == plain_best_fit(sizes, 70)


def test_even_shards():
    assert shard_packing.even([], 3) == []
    assert shard_packing.even([9, 1, 1, 1, 1], 3) == [0, 1, 1, 2, 2]
    assert shard_packing.even([5, 4, 3, 3, 3], 2) == [0, 0, 1, 1, 1]
    draw = random.Random(1)
    sizes = sorted((draw.randint(1, 50) for _ in range(2000)), reverse=True)
    loads = Counter()
    for size, shard in zip(sizes, shard_packing.even(sizes, 8), strict=True):
        loads[shard] += size
    assert max(loads.values()) - min(loads.values()) <= 8


def check_shards(texts, rows, shards):
    """Rows are (id, size, crc, shard, slot)."""
    assert sorted(repr(r[:3]) for r in rows) == sorted(
        repr((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))) for i, t in texts
    )
    slots, homes, of = defaultdict(list), defaultdict(set), defaultdict(list)
    for i, t in texts:
        of[i].append(t or "")
    for i, size, _, shard, slot in rows:
        assert 0 <= shard < shards
        slots[shard].append(slot)
        if len(of[i]) == 1:
            homes[of[i][0]].add(shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values())


def test_shards_of_odd_rows(spark):
    draw = random.Random(6)
    texts = [(i, "".join(draw.choices("abcé ", k=draw.randint(0, 90)))) for i in range(500)]
    texts += [(1000 + i, "the same text over and over " * 20) for i in range(300)]
    texts += [(None, None), (None, ""), (7000, None), (7001, ""), (7002, "x" * 100_000), (5, texts[5][1])]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    df = df.selectExpr("doc_id", "text", "'other' as shard", "1 as digest").repartition(7)
    rows = [tuple(r) for r in shard_packing.assign(df, shards=5).collect()]
    check_shards(texts, rows, 5)
    # Two groups hold more than their share; the others are even.
    loads = Counter()
    for _, size, _, shard, _ in rows:
        loads[shard] += size
    rest = sorted(loads.values())[:3]
    assert rest[2] - rest[0] <= 91
    kept = shard_packing.with_shard(df, shards=5)
    assert kept.columns == ["doc_id", "text", "digest", "shard"] and kept.count() == len(texts)
    own = {(r[0], r[1]): r[3] for r in rows}
    assert all(own[r.doc_id, len((r.text or "").encode()) + 1] == r.shard for r in kept.collect() if r.doc_id)


def test_shards_of_a_fixed_capacity(spark):
    draw = random.Random(9)
    texts = [(i, "".join(draw.choices("abc", k=draw.randint(1, 300)))) for i in range(400)]
    rows = shard_packing.assign(spark.createDataFrame(texts, "doc_id long, text string"), capacity=5000).collect()
    loads = Counter()
    for r in rows:
        loads[r["shard"]] += r["size"]
    total = sum(loads.values())
    assert max(loads.values()) <= 5000 and len(loads) <= -(-total // 5000) + 1


def test_shards_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert shard_packing.assign(empty).collect() == []
    assert shard_packing.assign(empty, capacity=10).collect() == []


def test_shards_on_disk(spark, tmp_path):
    df = spark.createDataFrame([(i, "t" * i) for i in range(40)], "doc_id long, text string")
    shard_packing.write_shards(df, str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    sizes = [r[0] for r in back.groupBy("shard").sum("doc_id").select("sum(doc_id)").collect()]
    assert back.count() == 40 and len(sizes) == 4 and max(sizes) - min(sizes) < 20


def test_shards_of_the_given_table(spark):
    sf = "/root/testdata/sf0.01"
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = queries.op12_sharding(spark, sf).collect()
    check_shards(texts, [(r.doc_id, r["size"], r.text_crc32, r["shard"], r["slot"]) for r in found], 8)
    loads = Counter()
    for r in found:
        loads[r["shard"]] += r["size"]
    assert len(loads) == 8 and max(loads.values()) - min(loads.values()) < 0.01 * max(loads.values())


# Importance resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_features(text):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10000


def plain_sample(docs, target):
    s, t = Counter(), Counter()
    for counts, texts in ((s, [t for _, t in docs]), (t, target)):
        for text in texts:
            counts.update(map(bucket, plain_features(text)[1]))
    S, T = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))

    out = []
    for i, text in docs:
        words, found = plain_features(text)
        weight = sum(gain(bucket(f)) for f in found)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(words), len(found), weight, score])
    good = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], -1 if r[0] is None else r[0]))
    rank = {id(r): k + 1 for k, r in enumerate(good[: len(good) * 5 // 100])}
    return [(r[0], *r[2:], rank.get(id(r))) for r in out]


def test_crc_of_joined_strings():
    draw = random.Random(4)
    pairs = [(draw.randbytes(draw.randint(0, 9)), draw.randbytes(draw.choice([0, 1, 7, 300, 70_000]))) for _ in range(300)]
    one, two = (np.array([zlib.crc32(p[k]) for p in pairs], np.uint32) for k in (0, 1))
    joined = importance.composed(one, two, np.array([len(p[1]) for p in pairs]))
    assert joined.tolist() == [zlib.crc32(a + b) for a, b in pairs]


def test_crc_at_the_length_of_the_tables():
    parts = [b"ab"] * 6, [b"x" * n for n in (0, 1, 62, 63, 64, 65)]
    one, two = (np.array([zlib.crc32(p) for p in side], np.uint32) for side in parts)
    joined = importance.composed(one, two, np.array([len(p) for p in parts[1]]))
    assert joined.tolist() == [zlib.crc32(a + b) for a, b in zip(*parts, strict=True)]


def test_resampling_equals_brute_force(spark):
    draw = random.Random(12)
    vocabulary = ["Ab", "ab", "b1", "Zürich", "naïve", "日本", "x", "long" * 30, "don't", "\x80\x85", "tab\there", "é"]

    def text(n):
        return "".join(draw.choice(vocabulary) + draw.choice([" ", "  ", "-", "\n", "\0", ". "]) for _ in range(n))

    docs = [(i, text(draw.randint(0, 60))) for i in range(900)]
    docs += [(None, text(30)), (5000, None), (5001, ""), (5002, " . "), (5003, "w" * 200_000), (5004, text(30_000))]
    docs += [(6000 + i, docs[8][1] + text(25)) for i in range(2)] + [(7000, docs[3][1])] * 2
    target = [text(20) for _ in range(9)] + [None, ""]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    df = df.selectExpr("*", "1 as score", "'x' as n_words", "2 as id")
    found = importance.resample(df, spark.createDataFrame([(t,) for t in target], "text string"))
    assert collected(found.select("id", "n_features", "weight", "score", "rank")) == sorted(plain_sample(docs, target), key=repr)
    drawn = importance.drawn_rows(df, found)
    assert drawn.columns == df.columns and drawn.count() == found.where("rank is not null").count()


def test_resampling_reads_texts_once(spark, tmp_path, monkeypatch):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    def stored(df, name):
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    monkeypatch.setattr(importance, "stored", stored)
    docs = [(i, f"word{i % 7} " * 30 + str(i)) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    target = ["word1 word2"]
    found = importance.resample(df.withColumn("text", seen("text")), spark.createDataFrame([(t,) for t in target], "text string"))
    assert collected(found.drop("n_words")) == sorted(plain_sample(docs, target), key=repr)
    assert read.value == len(docs)
    # What stands for the texts is gone once it has been weighed.
    assert not list(tmp_path.glob("buckets/*.parquet")) and list(tmp_path.glob("scores/*.parquet"))


@pytest.mark.parametrize(("longest", "buckets"), [(1, 1), (4, 65_536), (3, 65_537), (2, 1 << 20)])
def test_buckets_of_any_number(spark, longest, buckets):
    draw = random.Random(longest)
    texts = ["".join(draw.choice(["a", "É", "w" * 70, "x" * 63, "日本"]) + " " for _ in range(draw.randint(0, 9))) for _ in range(60)]
    expected, weights = Counter(), Counter()
    gains = np.arange(buckets) % 1000 - 400
    rows = [(i, t) for i, t in enumerate([*texts, None, ""])]
    for i, t in rows:
        words = plain_features(t)[0]
        for n in range(1, longest + 1):
            for k in range(len(words) - n + 1):
                at = zlib.crc32(" ".join(words[k : k + n]).encode()) % buckets
                expected[at] += 1
                weights[i] += int(gains[at])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    counts = importance.bucket_counts(importance.hashed(df, "text", longest, buckets), buckets)
    assert {int(b): int(counts[b]) for b in np.flatnonzero(counts)} == expected
    scored = importance.score_rows(df, importance.Model(gains, longest)).collect()
    assert {r.doc_id: r.weight for r in scored} == {i: weights[i] for i, _ in rows}
    assert sum(r.n_features for r in scored) == sum(expected.values())


def test_resampling_of_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert importance.resample(empty, some).collect() == []
    rows = importance.resample(some, empty).collect()
    assert [(r["id"], r.n_features, r["rank"]) for r in sorted(rows)] == [(1, 3, None), (2, 0, None)]


def test_resampling_of_the_given_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    found = queries.op13_importance(spark, sf)
    assert collected(found) == sorted(plain_sample(docs, target), key=repr)
