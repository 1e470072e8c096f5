"""Byte-pair merging over ragged arrays, and a store of words already done."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np

from textveil.llm.hashes import U

NEVER = np.int64(1 << 40)
#: Symbols of a word beyond which a heap finds the lowest pair instead of a round of all.
LONG = 512
#: Distinct words a worker remembers before it begins anew.
REMEMBERED = 400_000


class PairTable:
    """Rank and result of each pair of symbols that merges.

    ``eager`` results may hold a pair that merges before the result's own rank; their
    occurrences in a word must be merged one at a time, from the left.
    """

    def __init__(self, first: np.ndarray, second: np.ndarray, rank: np.ndarray, result: np.ndarray):
        key = first.astype(np.int64) << 24 | second.astype(np.int64)
        order = np.argsort(key)
        self.key, self.rank, self.result = key[order], rank[order].astype(np.int64), result[order].astype(np.int64)
        self.table: dict[int, tuple[int, int]] | None = None
        size = int(max(result.max(), first.max(), second.max())) + 1
        made = np.full(size, -1, np.int64)
        made[result] = rank
        self.eager = np.zeros(size, bool)
        self.eager[first[made[first] > rank]] = True
        self.eager[second[made[second] > rank]] = True

    def lookup(self) -> dict[int, tuple[int, int]]:
        if self.table is None:
            self.table = dict(zip(self.key.tolist(), zip(self.rank.tolist(), self.result.tolist()), strict=True))
        return self.table

    def find(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (``NEVER`` without a merge) and result of each pair."""
        key = first << 24 | second
        spot = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        hit = self.key[spot] == key
        return np.where(hit, self.rank[spot], NEVER), self.result[spot]


def merge_long(symbols: list[int], pairs: PairTable) -> list[int]:
    """Merge one long word: always its lowest pair, of equal ones the first."""
    table, n = pairs.lookup(), len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < n:
            found = table.get(symbols[i] << 24 | symbols[after[i]])
            if found:
                heapq.heappush(heap, (found[0], i, symbols[i], symbols[after[i]]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != a or j >= n or symbols[j] != b:
            continue  # one of the two has merged since
        symbols[i], symbols[j] = table[a << 24 | b][1], -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(before[i])
        offer(i)
    return [s for s in symbols if s >= 0]


def merge(symbols: np.ndarray, word: np.ndarray, pairs: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Merge every word to its end: in each round all words at once merge their pair of
    the lowest rank. ``word`` is the number of each symbol's word, in order. Returns the
    symbols left and their words."""
    symbols, done_symbols, done_words = symbols.astype(np.int64), [], []
    long = np.bincount(word, minlength=1)[word] > LONG
    for number in np.unique(word[long]):
        left = merge_long(symbols[word == number].tolist(), pairs)
        done_symbols.append(np.array(left, np.int64))
        done_words.append(np.full(len(left), number))
    symbols, word = symbols[~long], word[~long]
    while len(symbols):
        near = word[1:] == word[:-1]
        rank = np.full(len(symbols), NEVER)
        result = np.zeros(len(symbols), np.int64)
        at = np.flatnonzero(near)
        rank[at], result[at] = pairs.find(symbols[at], symbols[at + 1])
        begins = np.flatnonzero(np.append(True, ~near))
        best = np.repeat(np.minimum.reduceat(rank, begins), np.diff(np.append(begins, len(symbols))))
        over = best == NEVER
        if over.any():
            done_symbols.append(symbols[over])
            done_words.append(word[over])
            go = ~over
            symbols, word, rank, result, best = symbols[go], word[go], rank[go], result[go], best[go]
            if not len(symbols):
                break
        hit = np.flatnonzero(rank == best)
        # Of overlapping hits (a, a, a) every second one, from the left, is taken.
        run = np.append(True, np.diff(hit) != 1)
        place = np.arange(len(hit)) - np.flatnonzero(run)[np.cumsum(run) - 1]
        first = np.append(True, word[hit][1:] != word[hit][:-1])
        hit = hit[np.where(pairs.eager[result[hit]], first, place % 2 == 0)]
        symbols[hit] = result[hit]
        stay = np.ones(len(symbols), bool)
        stay[hit + 1] = False
        symbols, word = symbols[stay], word[stay]
    if not done_symbols:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
    order = np.argsort(word, kind="stable")
    return symbols[order], word[order]


class Remembered:
    """Results of distinct words, as ragged arrays by the words' names."""

    def __init__(self):
        self.names = np.zeros(0, U)
        self.at = np.zeros(1, np.int64)
        self.values = np.zeros(0, np.int64)

    def get(self, names: np.ndarray, work: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]):
        """Place of each of the sorted, distinct ``names`` in ``at``. ``work`` gets the
        numbers of those that are new and returns values and how many each has."""
        if len(self.names) > REMEMBERED:
            self.__init__()
        spot = np.searchsorted(self.names, names)
        known = spot < len(self.names)
        known[known] = self.names[spot[known]] == names[known]
        new = np.flatnonzero(~known)
        if len(new):
            values, sizes = work(new)
            old_sizes = np.diff(self.at)
            all_names = np.concatenate([self.names, names[new]])
            order = np.argsort(all_names)
            all_sizes = np.concatenate([old_sizes, sizes])
            begins = np.concatenate([self.at[:-1], self.at[-1] + np.cumsum(sizes) - sizes])
            everything = np.concatenate([self.values, values])
            self.names = all_names[order]
            self.at = np.append(0, np.cumsum(all_sizes[order]))
            self.values = everything[spread(begins[order], all_sizes[order])]
            spot = np.searchsorted(self.names, names)
        return spot


def spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of ranges, one range after the other."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(begins - before, sizes)
