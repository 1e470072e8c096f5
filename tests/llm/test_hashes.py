"""Sequences that collide in sums modulo a power of two, whatever the base."""

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from textveil.llm import bpe_codec, decontaminate, hashes, near_dedup, quality, recompress_dedup, suffix_dedup, token_counts
from textveil.llm.queries import tokenizer


def mirrored(n, a, b):
    """A word in which each letter tells whether its place has an odd number of binary ones,
    and the same with both letters exchanged."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


def names(text, family):
    data = np.frombuffer(text.encode(), np.uint8)
    return family.ranges(family.sums(data), np.array([0]), np.array([len(data)]))[0]


@pytest.mark.parametrize("n", [64, 128, 200, 1024, 2048, 4096])
def test_names_differ(n):
    one, two = mirrored(n, "a", "b")
    for family in (hashes.ONE, hashes.TWO):
        assert names(one, family) != names(two, family)
        items = [np.array([ord(c) for c in w], np.uint64) for w in (one, two)]
        first, second = (family.grams(family.sums(x), n)[0] for x in items)
        assert first != second


def test_names_follow_their_bytes():
    """Equal ranges have equal names wherever they are, and all forms agree."""
    draw = np.random.default_rng(0)
    data = draw.integers(0, 3, 3000).astype(np.uint8)
    data = np.concatenate([data, data])
    for family in (hashes.ONE, hashes.TWO):
        sums = family.sums(data)
        grams = family.grams(sums, 40)
        assert (grams[:2900] == grams[3000:5900]).all()
        at = np.arange(2900)
        assert (family.grams_at(sums, at, 40) == grams[:2900]).all()
        assert (family.ranges(sums, at, at + 40) == family.ranges(sums, at + 3000, at + 3040)).all()
        known = {}
        for p in range(0, 2900, 7):
            assert known.setdefault(data[p : p + 5].tobytes(), family.grams_at(sums, np.array([p]), 5)[0]) == family.grams_at(
                sums, np.array([p]), 5
            )[0]
        assert len(set(known.values())) == len(known)


@pytest.fixture(scope="module")
def pair():
    return mirrored(2048, "a", "b")


def test_quality_lines(spark, pair):
    df = spark.createDataFrame([(1, "\n".join(pair)), (2, "\n".join([pair[0]] * 2))], "doc_id long, text string")
    assert {r.doc_id: r.n_dup_lines for r in quality.judge(df).collect()} == {1: 0, 2: 1}


def test_contamination(spark, pair):
    docs = spark.createDataFrame([(1, pair[0]), (2, pair[1])], "doc_id long, text string")
    items = spark.createDataFrame([(7, pair[1])], "item_id long, text string")
    found = decontaminate.find_contamination(docs, items)
    assert {r.doc_id: r.n_items for r in found.collect()} == {1: 0, 2: 1}


@pytest.mark.parametrize("letters", ["in", "ab"])
def test_token_counts(spark, letters):
    texts = [w for n in (64, 256, 1024, 2048) for w in mirrored(n, *letters)]
    path = tokenizer("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    found = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df, path).collect()}
    assert found == {i: len(model.encode(t)) for i, t in enumerate(texts)}


def test_codec(spark):
    texts = [w for n in (64, 256, 1024, 2048) for w in mirrored(n, "a", "b")]
    path = tokenizer("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for r in bpe_codec.encode_texts(df, path, with_ids=True).collect():
        assert list(r.ids) == library.encode(texts[r.doc_id], add_special_tokens=False).ids


def test_words_of_repeated_windows(spark, pair):
    plain = [f"w{i}" for i in range(34)]
    texts = [" ".join([pair[0], *plain]), " ".join([pair[1], *plain])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.n_removed for r in recompress_dedup.remove_repeats(df).collect()] == [0, 0]


@pytest.mark.parametrize("n", [200, 2048])
def test_repeated_bytes(spark, n):
    rows = list(enumerate(mirrored(n, "a", "b")))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = [w.encode() for _, w in rows]
    count = {}
    for t in texts:
        for p in range(len(t) - 199):
            count[t[p : p + 200]] = count.get(t[p : p + 200], 0) + 1
    expected = {}
    for i, t in enumerate(texts):
        hit = set()
        for p in range(len(t) - 199):
            if count[t[p : p + 200]] > 1:
                hit |= set(range(p, p + 200))
        expected[i] = len(hit)
    assert {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(df).collect()} == expected


def test_groups(spark, pair):
    """Texts of one long word each are no copies of one another."""
    df = spark.createDataFrame([(1, pair[0]), (2, pair[1]), (3, pair[1])], "doc_id long, text string")
    groups = {}
    for r in near_dedup.groups_of(df).collect():
        groups.setdefault(r[[c for c in r.asDict() if c not in ("doc_id", "id")][0]], set()).add(r[0])
    assert {frozenset(g) for g in groups.values()} == {frozenset({1}), frozenset({2, 3})}
