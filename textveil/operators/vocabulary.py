"""Token ids of a given vocabulary by longest match, and texts back from ids.

A vocabulary file is read, never made: ``.tiktoken`` (a token in base64 and its id on each
line), ``.json`` (an object from tokens to ids) or any other name (a token on each line, its
line number is its id). Tokens are byte strings; a text is cut from the left into the longest
tokens that fit. Where none fits, one character is unknown.

The vocabulary is a double-array trie: the child of a state by a byte lies at the state's base
plus that byte, and is one only if it names the state as its parent. All places of the texts of
an Arrow batch walk down the trie at once, a byte further each step, and those that have left it
drop out; following the matches from each text's start is all that is done one by one.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from textveil.functions.batches import lists, pieces
from textveil.functions.sqltext import ident
from textveil.functions.workers import once_per_worker

#: Bytes of text that walk down the trie at a time, or ids that are read back; a longer text
#: walks alone.
PIECE = 1 << 18
#: Slots of the trie that are tried at a time.
WINDOW = 256


def read_vocabulary(path: str) -> dict[bytes, int]:
    """Tokens and ids of a file, by its extension."""
    with open(path, "rb") as file:
        data = file.read()
    if path.endswith(".tiktoken"):
        pairs = (line.split() for line in data.splitlines() if line.strip())
        return {base64.b64decode(token): int(i) for token, i in pairs}
    if path.endswith(".json"):
        return {token.encode(): int(i) for token, i in json.loads(data).items()}
    lines = data.removesuffix(b"\n").split(b"\n") if data else []
    return {token: i for i, token in reversed(list(enumerate(lines))) if token}


class Trie:
    """A double-array trie; state 0 is none and state 1 the root."""

    def __init__(self, tokens: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        ids: list[int] = [-1]
        for token, i in tokens.items():
            node = 0
            for byte in token:
                if (child := children[node].get(byte)) is None:
                    child = children[node][byte] = len(children)
                    children.append({})
                    ids.append(-1)
                node = child
            if node:
                ids[node] = i
        size = 2 * len(children) + 1024
        self.base, self.parent = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.token = np.full(size, -1, np.int64)
        taken = np.zeros(size, bool)
        taken[:2] = True
        state = np.ones(len(children), np.int64)
        first_free = 2
        # Parents come before children; nodes were numbered that way.
        for node, below in enumerate(children):
            self.token[state[node]] = ids[node]
            if not below:
                continue
            bytes_ = np.fromiter(below, np.int64, len(below))
            first_free += int(taken[first_free:].argmin()) if taken[first_free] else 0
            window, least = first_free, int(bytes_.min())
            while True:
                if window + WINDOW + 256 >= len(taken):
                    taken = self._grown(taken)
                # Free slots for the first child, and whether all others are free as well.
                slots = np.flatnonzero(~taken[window : window + WINDOW]) + window
                bases = slots[slots > least] - least
                fits = bases if len(below) == 1 else bases[~taken[bases[:, None] + bytes_].any(1)]
                if len(fits):
                    at = int(fits[0])
                    break
                window += WINDOW
            self.base[state[node]] = at
            taken[at + bytes_] = True
            self.parent[at + bytes_] = state[node]
            state[np.fromiter(below.values(), np.int64, len(below))] = at + bytes_

    def _grown(self, taken: np.ndarray) -> np.ndarray:
        more = len(taken)
        self.base, self.parent = (np.append(x, np.zeros(more, np.int64)) for x in (self.base, self.parent))
        self.token = np.append(self.token, np.full(more, -1, np.int64))
        return np.append(taken, np.zeros(more, bool))

    def longest(self, data: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length and id of the longest token at each place, with ``room`` bytes left in its
        text; 0 and -1 where there is none."""
        length, found = np.zeros(len(data), np.int64), np.full(len(data), -1, np.int64)
        place, state, depth = np.flatnonzero(room > 0), np.ones(len(data), np.int64), 0
        state = state[: len(place)]
        while len(place):
            child = self.base[state] + data[place + depth]
            inside = (self.parent[child] == state) & (self.base[state] > 0)
            place, state, depth = place[inside], child[inside], depth + 1
            token = self.token[state]
            ends = token >= 0
            length[place[ends]], found[place[ends]] = depth, token[ends]
            on = room[place] > depth
            place, state = place[on], state[on]
        return length, found


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of some texts, and where each begins and the last one ends."""
    rows = [t.encode() if t is not None else b"" for t in texts.to_pylist()]
    at = np.array(list(accumulate(map(len, rows), initial=0)), np.int64)
    return np.frombuffer(b"".join(rows), np.uint8), at


@dataclass(frozen=True)
class Vocabulary:
    """A vocabulary file that lies at ``path`` on every machine; ``unknown`` is the id of a
    character that no token begins with, which is an error without one."""

    path: str
    unknown: int | None = None

    def _loaded(self) -> tuple[Trie, dict[int, bytes]]:
        def load():
            tokens = read_vocabulary(self.path)
            return Trie(tokens), {i: token for token, i in tokens.items()}

        return once_per_worker(f"vocabulary {self.path}", load)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's begin."""
        data, at = _flat(texts)
        trie, _ = self._loaded()
        room = np.repeat(at[1:], np.diff(at)) - np.arange(len(data))
        length, found = trie.longest(data, room)
        none = np.flatnonzero(found < 0)
        if len(none):
            # The bytes of one character.
            lead = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
            length[none] = np.minimum(lead[np.searchsorted(lead, none, "right")] - none, room[none])
        steps, kept, counts = length.tolist(), [], [0]
        for first, end in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            while first < end:
                kept.append(first)
                first += steps[first]
            counts.append(len(kept))
        ids = found[np.array(kept, np.int64)]
        if (ids < 0).any():
            if self.unknown is None:
                raise ValueError(f"{self.path} has no token for a character, and no id for unknown ones is given.")
            ids = np.where(ids < 0, self.unknown, ids)
        return ids, np.array(counts, np.int64)

    def encoder(self) -> Callable[[], Callable[[list[str]], list[list[int]]]]:
        """For ``tokenize_with`` and ``prepare``."""

        def factory():
            def encode(texts: list[str]) -> list[list[int]]:
                ids, at = self.ids(pa.array(texts, pa.string()))
                return [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]

            return encode

        return factory


def vocabulary_ids(text: str, vocabulary: Vocabulary) -> Column:
    """``array<int>`` of a string column. A null text has null ids, an empty one none."""

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for piece in pieces(batch, PIECE):
                ids, at = vocabulary.ids(piece)
                starts = pa.array(at.astype(np.int32), mask=np.append(np.asarray(piece.is_null()), False))
                yield pa.ListArray.from_arrays(starts, pa.array(ids.astype(np.int32)))

    return encode(F.col(ident(text)))


def vocabulary_text(ids: str, vocabulary: Vocabulary) -> Column:
    """The string that ``ids`` stand for. Ids of no token, the unknown one among them, and
    bytes that are no character read U+FFFD."""
    lost = "�".encode()

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            _, tokens = vocabulary._loaded()
            for piece in pieces(batch, PIECE):
                rows = [
                    None if row is None else b"".join(tokens.get(i, lost) for i in row).decode(errors="replace")
                    for row in lists(piece)
                ]
                yield pa.array(rows, pa.string())

    return decode(F.col(ident(ids)))
