"""Rolling hashes, window minima and word bounds over whole arrays."""

from __future__ import annotations

import numpy as np

U = np.uint64
_MIX = (U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all bits."""
    x = (x ^ (x >> U(30))) * _MIX[0]
    x = (x ^ (x >> U(27))) * _MIX[1]
    return x ^ (x >> U(31))


PRIME = U((1 << 31) - 1)
_HALF = U(32)
_LOW = U((1 << 32) - 1)
_BOTH = U(int(PRIME) << 32 | int(PRIME))
#: Items worked on at a time, so that what is in between stays in the processor's cache.
BLOCK = 1 << 14


class Rolling:
    """Hashes of all ranges of a sequence, from running sums modulo a prime.

    A hash is a polynomial in a drawn base, and two bases make one name of 62 bits: of two
    different sequences of ``n`` items, a base gives equal values with a chance of ``n`` in
    2^31 at most, whatever the sequences are. (Sums modulo a power of two have no such bound:
    there are sequences that collide for each base.) Two instances with different seeds are
    independent of one another.
    """

    def __init__(self, seed: int):
        draw = np.random.default_rng(seed)
        self.bases = [int(b) for b in draw.integers(1 << 20, int(PRIME) - 1, 2)]
        self.letters = draw.integers(1, int(PRIME), (2, 256)).astype(U)
        # Powers of each base and of its inverse, as far as a sequence has reached.
        self.up = [np.ones(1, np.uint32) for _ in self.bases]
        self.down = [np.ones(1, np.uint32) for _ in self.bases]

    def _reach(self, n: int) -> None:
        for k, base in enumerate(self.bases):
            for powers, step in ((self.up, base), (self.down, pow(base, -1, int(PRIME)))):
                while len(powers[k]) <= n:
                    known = powers[k].astype(U)
                    more = known * U(pow(step, len(known), int(PRIME))) % PRIME
                    powers[k] = np.concatenate([powers[k], more.astype(np.uint32)])

    def sums(self, items: np.ndarray) -> np.ndarray:
        """Running sums of bytes, or of 64-bit names; one number holds those of both bases."""
        n = len(items)
        self._reach(n)
        out = np.zeros(n + 1, U)
        carried = [U(0), U(0)]
        for first in range(0, n, BLOCK):
            block = slice(first, min(first + BLOCK, n))
            if items.dtype == np.uint8:
                values = [letters[items[block]] for letters in self.letters]
            else:
                spread = mix(items[block])
                values = [spread & PRIME, spread >> U(33)]
            totals = []
            for k, value in enumerate(values):
                total = np.cumsum(value * self.up[k][block] % PRIME)
                total += carried[k]
                total %= PRIME
                carried[k] = total[-1]
                totals.append(total)
            out[first + 1 : block.stop + 1] = totals[0] << _HALF | totals[1]
        return out

    def _names(self, low: np.ndarray, high: np.ndarray, down: list[np.ndarray], more: np.ndarray | None = None) -> np.ndarray:
        """Hash of ranges from the running sums at their ends: both values, moved to the start of
        the sequence; ``more`` is added to them."""
        out = np.empty(len(low), U)
        for first in range(0, len(low), BLOCK):
            block = slice(first, first + BLOCK)
            gap = high[block] + _BOTH - low[block]  # no half borrows from the other
            one = (gap >> _HALF) * down[0][block] % PRIME
            both = one << _HALF | (gap & _LOW) * down[1][block] % PRIME
            out[block] = mix(both if more is None else both + more[block])
        return out

    def grams(self, sums: np.ndarray, k: int) -> np.ndarray:
        """Hash of the ``k`` items from each position on."""
        n = max(0, len(sums) - k)
        return self._names(sums[:n], sums[k:], [d[:n] for d in self.down])

    def grams_at(self, sums: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
        """Those of ``grams`` at the given positions."""
        return self._names(sums[first], sums[first + k], [d[first] for d in self.down])

    def ranges(self, sums: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each range, its length included."""
        size = (end - first).astype(U) * _MIX[1]
        return self._names(sums[first], sums[end], [d[first] for d in self.down], size)


#: Two independent families: the first names groups, the second confirms them.
ONE, TWO = Rolling(11), Rolling(23)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each ``w`` consecutive values."""
    n = len(x)
    if n < w:
        return x[:0]
    rows = -(-n // w)
    table = np.full(rows * w, U(0xFFFFFFFFFFFFFFFF))
    table[:n] = x
    table = table.reshape(rows, w)
    before = np.minimum.accumulate(table, 1).ravel()
    after = np.minimum.accumulate(table[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(after[: n - w + 1], before[w - 1 : n])


def word_bounds(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of bytes for which the table ``inside`` holds;
    no run goes beyond its row."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = inside[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    begin = word.copy()
    begin[1:] &= ~word[:-1] | edge[1:n]
    end = word.copy()
    end[:-1] &= ~word[1:] | edge[1:n]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def byte_table(inside) -> np.ndarray:
    return np.array([bool(inside(b)) for b in range(256)])


#: Bytes of words ``[^\x20\x09-\x0D]+``.
PLAIN = byte_table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)


def row_of(at: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The row that holds each place; empty rows hold none."""
    return np.searchsorted(at, places, "right") - 1


def covered(n: int, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of ``n`` places lie in one of the ranges."""
    steps = np.bincount(first, minlength=n + 1) - np.bincount(end, minlength=n + 1)
    return np.cumsum(steps)[:n] > 0
