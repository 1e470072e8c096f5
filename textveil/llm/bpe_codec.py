"""BPE encoding and decoding: speculate and verify.

Each distinct pre-token is first cut greedily into the longest tokens, all pre-tokens of a
batch at once. Such a guess is what merging would give exactly if every token is what its
own bytes merge to, and no two neighbours would have merged across their border at any
time. The second is tested for all pairs of neighbours at once by walking back through the
merges that made the two tokens: while a piece lay at the border, the pair across it must
have had no earlier merge than the one that next changed either side. Only words that fail
are merged from their bytes, in rank order. Decoding looks up the bytes of the ids.

Pre-tokens follow the byte-level rule of the tokenizer file: endings after an apostrophe,
a run of letters, digits or other characters with a blank before it, and runs of white
space, of which the last one stays with what follows. Special strings in a text become
their token.

Texts are independent, so nothing is shuffled; about 1 MB is worked on at a time, and a
worker remembers a bounded number of words. Null text is empty and has no ids; texts of
any length are read whole; repeated rows get equal results; an empty table stays empty;
other columns are kept unless named like a result.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from textveil.llm.bpe_arrays import LONG, NEVER, PairTable, Remembered, merge, spread
from textveil.llm.hashes import ONE, U, row_of
from textveil.llm.shared import flat, slices

LETTER, DIGIT, OTHER, WHITE = range(4)
#: Endings that the pre-token rule of byte-level files cuts off (fixed values).
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def char_kinds(path: str) -> np.ndarray:
    """Letter, digit, white space or other, for each code point. Where two editions of
    Unicode disagree, the file's own library says which one it follows."""
    from tokenizers import Tokenizer

    points = np.arange(0x110000, dtype=np.uint32)
    points[0xD800:0xE000] = 0x20  # no characters
    everything = points.tobytes().decode("utf-32-le")
    kinds = np.full(0x110000, OTHER, np.uint8)
    for kind, name in ((LETTER, "L"), (DIGIT, "N"), (WHITE, "White_Space")):
        for run in regex.finditer(rf"\p{{{name}}}+", everything):
            kinds[run.start() : run.end()] = kind
    older = np.array([b"LN".find(unicodedata.category(c)[0].encode()) for c in everything])
    older = np.where(kinds == WHITE, WHITE, np.where(older < 0, OTHER, older))
    split = Tokenizer.from_file(path).pre_tokenizer
    for point in np.flatnonzero(older != kinds):
        alone = [len(split.pre_tokenize_str(c + chr(point))) == 1 for c in "a1!"]
        kinds[point] = alone.index(True) if any(alone) else WHITE
    return kinds


def byte_letters() -> dict[str, int]:
    """How byte-level files write each byte: printable ones as they are, the others as
    the letters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Tokens and merges of a byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, split = spec["model"], spec["pre_tokenizer"]
        if spec["normalizer"] or model["type"] != "BPE" or split["type"] != "ByteLevel":
            raise ValueError("a byte-level BPE file is needed")
        if split["add_prefix_space"] or not split["use_regex"] or model.get("ignore_merges"):
            raise ValueError("the file's pre-tokenizer is of another kind")
        flags = ("single_word", "lstrip", "rstrip", "normalized")
        if any(t[f] for t in spec["added_tokens"] for f in flags):
            raise ValueError("special tokens that take in white space are not handled")
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        letters = byte_letters()
        vocabulary = model["vocab"]
        size = 1 + max([*vocabulary.values(), *self.special.values()])
        raw = [b""] * size
        for token, i in vocabulary.items():
            raw[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            raw[i] = token
        self.byte_id = np.array([vocabulary[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int64)
        self.token_at = np.append(0, np.cumsum([len(x) for x in raw]))
        self.token_bytes = np.frombuffer(b"".join(raw), np.uint8)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        first = np.array([vocabulary[a] for a, _ in merges])
        second = np.array([vocabulary[b] for _, b in merges])
        result = np.array([vocabulary[a + b] for a, b in merges])
        rank = np.arange(len(merges))
        self.pairs = PairTable(first, second, rank, result)
        # The merge that made each token; bytes have none.
        self.made = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        self.made[result], self.left[result], self.right[result] = rank, first, second
        self.sound = self._sound(result, first, second, rank)
        self._index(raw, set(vocabulary.values()))
        self.kinds = char_kinds(path)

    def _sound(self, result, first, second, rank) -> np.ndarray:
        """Which tokens their own bytes merge to."""
        sound = self.made < 0
        alone = self.meet(first, second, rank)
        for token, a, b, ok in zip(result, first, second, alone, strict=True):
            sound[token] = ok and sound[a] and sound[b]
        return sound

    def _index(self, raw: list[bytes], ordinary: set[int]) -> None:
        """Names of the tokens of each length, the longest first."""
        by_size: dict[int, list[int]] = {}
        for i in ordinary:
            by_size.setdefault(len(raw[i]), []).append(i)
        self.by_size = []
        for size in sorted(by_size, reverse=True):
            ids = np.array(by_size[size])
            data = np.frombuffer(b"".join(raw[i] for i in ids), np.uint8)
            begins = np.arange(len(ids)) * size
            names = ONE.grams_at(ONE.sums(data), begins, size)
            order = np.argsort(names)
            self.by_size.append((size, names[order], ids[order]))

    def meet(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether tokens ``a`` and ``b`` stay apart side by side; with ``until``, whether
        they stay apart up to the merge of that rank, which joins the two whole tokens."""
        apart = np.ones(len(a), bool)
        x, y = a.copy(), b.copy()
        limit = np.full(len(a), NEVER) if until is None else until.astype(np.int64)
        go = np.arange(len(a))
        while len(go):
            crossing, _ = self.pairs.find(x[go], y[go])
            bad = crossing < limit[go]
            apart[go[bad]] = False
            go = go[~bad]
            undo_left = self.made[x[go]] > self.made[y[go]]
            later = np.maximum(self.made[x[go]], self.made[y[go]])
            # Of equal merges the left one comes first: a pair across the border comes
            # before an equal one on its right, and after an equal one on its left.
            limit[go] = np.where(undo_left, later, later + 1)
            x[go[undo_left]] = self.right[x[go[undo_left]]]
            y[go[~undo_left]] = self.left[y[go[~undo_left]]]
            go = go[later >= 0]
        return apart

    def guess(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest tokens from the left, for all words up to ``LONG`` bytes, which are
        all but unbroken runs: ids, and the word of each."""
        sums = ONE.sums(data)
        word = np.flatnonzero((np.diff(at) > 0) & (np.diff(at) <= LONG))
        place = at[word].copy()
        ids, words, steps = [], [], []
        step = 0
        while len(word):
            token = np.full(len(word), -1, np.int64)
            room = at[word + 1] - place
            most = int(room.max())
            for size, names, known in self.by_size:
                if size > most:
                    continue
                open_ = np.flatnonzero((token < 0) & (room >= size))
                if not len(open_):
                    continue
                name = ONE.grams_at(sums, place[open_], size)
                spot = np.minimum(np.searchsorted(names, name), len(names) - 1)
                hit = names[spot] == name
                token[open_[hit]] = known[spot[hit]]
            ids.append(token)
            words.append(word)
            steps.append(np.full(len(word), step))
            place += self.token_at[token + 1] - self.token_at[token]
            more = place < at[word + 1]
            word, place, step = word[more], place[more], step + 1
        if not ids:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ids, words, steps = map(np.concatenate, (ids, words, steps))
        order = np.lexsort((steps, words))
        return ids[order], words[order]

    def encode_words(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids of all words, how many each has, and how many words failed the test."""
        ids, word = self.guess(data, at)
        failed = np.diff(at) > LONG
        failed[word[~self.sound[ids]]] = True
        near = np.flatnonzero(word[1:] == word[:-1])
        pairs, back = np.unique(ids[near] << 24 | ids[near + 1], return_inverse=True)
        apart = self.meet(pairs >> 24, pairs & 0xFFFFFF)
        failed[word[near[~apart[back]]]] = True
        bad = np.flatnonzero(failed)
        if len(bad):
            sizes = np.diff(at)[bad]
            exact, owner = merge(
                self.byte_id[data[spread(at[bad], sizes)]], np.repeat(np.arange(len(bad)), sizes), self.pairs
            )
            good = ~failed[word]
            ids, word = np.concatenate([ids[good], exact]), np.concatenate([word[good], bad[owner]])
            order = np.argsort(word, kind="stable")
            ids, word = ids[order], word[order]
        return ids, np.bincount(word, minlength=len(at) - 1), len(bad)

    def pre_tokens(self, points: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """Whether a pre-token begins at each code point; ``edge`` begins a text."""
        n = len(points)
        kind = self.kinds[points]
        white = kind == WHITE
        last = np.append(edge[1:], True)  # of a text
        before_white, before_blank = np.append(False, white[:-1]), np.append(False, points[:-1] == 0x20)
        changed = np.append(True, kind[1:] != kind[:-1])
        next_white = np.append(white[1:], False)
        begin = np.where(
            white,
            ~before_white | (~last & ~next_white),
            np.where(before_white, ~before_blank, changed),
        )
        begin |= edge
        marks = np.flatnonzero((points == 0x27) & begin & ~last)
        # How many code points of the text are left from each apostrophe on.
        ends = np.append(np.flatnonzero(edge), n)
        room = ends[np.searchsorted(ends, marks, "right")] - marks
        open_ = np.ones(len(marks), bool)
        for ending in ENDINGS:
            fits = open_ & (room > len(ending))
            for k, c in enumerate(ending):
                fits &= points[np.minimum(marks + 1 + k, n - 1)] == ord(c)
            open_ &= ~fits
            begin[marks[fits] + 1] = False
            after = marks[fits] + 1 + len(ending)
            begin[after[after < n]] |= True
        return begin

    def encode(self, column: pa.Array, seen: Remembered) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's begin."""
        data, at = flat(column)
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
        raw = data.tobytes()
        starts, special = self._special(raw, at)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        edge = np.zeros(len(points), bool)
        edge[np.searchsorted(lead, starts[starts < len(data)])] = True
        begin = self.pre_tokens(points, edge)
        if len(special):
            # A special string is one piece, whatever the rule makes of it.
            first, stop = np.searchsorted(lead, special[:, 0]), np.searchsorted(lead, special[:, 1])
            begin[spread(first + 1, stop - first - 1)] = False
        begin = lead[begin]
        end = np.append(begin[1:], len(data))
        names = ONE.ranges(ONE.sums(data), begin, end)
        whole = np.full(len(begin), -1, np.int64)
        if len(special):
            spot = np.searchsorted(begin, special[:, 0])
            whole[spot] = special[:, 2]
            names[spot] = ~special[:, 2].astype(U)
        names, which, back = np.unique(names, return_index=True, return_inverse=True)

        def work(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            here = which[new]
            sizes = np.where(whole[here] < 0, end[here] - begin[here], 0)
            ids, counts, _ = self.encode_words(data[spread(begin[here], sizes)], np.append(0, np.cumsum(sizes)))
            alone = np.flatnonzero(whole[here] >= 0)
            ids = np.insert(ids, (np.cumsum(counts) - counts)[alone], whole[here[alone]])
            counts[alone] = 1
            return ids, counts

        spot = seen.get(names, work)[back]
        sizes = np.diff(seen.at)[spot]
        ids = seen.values[spread(seen.at[spot], sizes)]
        return ids, np.append(0, np.cumsum(sizes))[np.searchsorted(begin, at)]

    def _special(self, raw: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where texts and the parts around special strings begin; each special string."""
        found = []
        for token, i in self.special.items():
            place = raw.find(token)
            while place >= 0:
                if row_of(at, np.array([place]))[0] == row_of(at, np.array([place + len(token) - 1]))[0]:
                    found.append((place, place + len(token), i))
                    place = raw.find(token, place + len(token))
                else:
                    place = raw.find(token, place + 1)
        special = np.array(sorted(found), np.int64).reshape(-1, 3)
        return np.unique(np.concatenate([at, special[:, 0], special[:, 1]])), special

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """Text of each range of ids; bytes that are no UTF-8 read U+FFFD."""
        sizes = np.diff(self.token_at)[ids]
        data = self.token_bytes[spread(self.token_at[ids], sizes)].tobytes()
        byte_at = np.append(0, np.cumsum(sizes))[at]
        return [data[byte_at[i] : byte_at[i + 1]].decode("utf-8", "replace") for i in range(len(at) - 1)]


_MODELS: dict[str, tuple[ByteBpe, Remembered]] = {}


def _model(path: str) -> tuple[ByteBpe, Remembered]:
    if path not in _MODELS:
        _MODELS[path] = ByteBpe(path), Remembered()
    return _MODELS[path]


RESULTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _scan(path: str, text_col: str, keep: list[str], with_ids: bool, schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = _model(path)
        for batch in slices(batches, text_col):
            ids, at = model.encode(batch.column(text_col), seen)
            plain = ids.astype("<u4")
            texts = model.decode(ids, at)
            parts = [plain[at[i] : at[i + 1]].tobytes() for i in range(batch.num_rows)]
            columns = [batch.column(c) for c in keep] + [
                pa.array(np.diff(at)),
                pa.array([hashlib.sha256(x).hexdigest() for x in parts], pa.string()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in texts], pa.string()),
            ]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(at.astype(np.int32), ids.astype(np.int32)))
            columns = [c.cast(f.type) for c, f in zip(columns, schema, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def encode_texts(docs: DataFrame, path: str, text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``docs`` with ``n_tokens``, digests of the ids (little-endian, 32 bits) and of the
    text that they decode to, and the ``ids`` themselves if asked for."""
    names = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    keep = [c for c in docs.columns if c not in names or c == text_col]
    source = docs.select(*[f"`{c}`" for c in keep])
    added = StructType.fromDDL(RESULTS + (", ids array<int>" if with_ids else ""))
    schema = StructType(list(source.schema.fields) + list(added.fields))
    return source.mapInArrow(_scan(path, text_col, keep, with_ids, to_arrow_schema(schema)), schema)


def decode_ids(rows: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``rows`` with the text of their ids; a null list reads as empty."""
    keep = [c for c in rows.columns if c != text_col]
    source = rows.select(*[f"`{c}`" for c in keep])
    schema = StructType(list(source.schema.fields) + list(StructType.fromDDL(f"`{text_col}` string").fields))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, _ = _model(path)
        for batch in batches:
            lists = batch.column(ids_col)
            at = np.append(0, np.cumsum(np.asarray(lists.value_lengths().fill_null(0))))
            ids = np.asarray(lists.flatten()).astype(np.int64)
            columns = [batch.column(c) for c in keep] + [pa.array(model.decode(ids, at), pa.string())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return source.mapInArrow(run, schema)
