"""ProbMinHash sketches of weighted shingles, all texts of a batch at once.

Every shingle sends arrivals of a Poisson process whose rate is its weight; each arrival
falls on one of the sketch's registers, and a register keeps the shingle that came first.
Two texts agree in a register with the probability Jaccard similarity of their weights.
A shingle stops as soon as its next arrival is later than all registers of its text: long
texts need little more than one arrival per shingle.

Times are sums of whole numbers divided by the weight, so equal shingles with equal
weights get equal times wherever they occur.
"""

from __future__ import annotations

import numpy as np

from textveil.llm.hashes import ONE, PLAIN, U, mix, row_of, word_bounds

SHINGLE = 5
_STEP, _SLOT = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)


def shingles(data: np.ndarray, at: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Name, text and count of the distinct shingles of each text, by text and name. A
    text with fewer words than a shingle is one shingle; without words it has none."""
    begin, end = word_bounds(data, at, PLAIN)
    sums = ONE.sums(ONE.ranges(ONE.sums(data), begin, end))
    word_at = np.searchsorted(begin, at)
    words = np.diff(word_at)
    count = np.where(words >= size, words - size + 1, (words > 0).astype(np.int64))
    text = np.repeat(np.arange(len(words)), count)
    first = word_at[text] + np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    name = ONE.ranges(sums, first, first + np.minimum(words[text], size))
    order = np.lexsort((name, text))
    name, text = name[order], text[order]
    new = np.append(True, (name[1:] != name[:-1]) | (text[1:] != text[:-1]))[: len(name)]
    places = np.flatnonzero(new)
    return name[places], text[places], np.diff(np.append(places, len(name)))


def _arrivals(name: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Waiting time before the arrival numbered ``step``, in units of 2^-32 and for weight
    one, and a number that chooses its register."""
    key = name + (step.astype(U) + U(1)) * _STEP
    even = ((mix(key) >> U(11)).astype(np.float64) + 0.5) * 2.0**-53
    return (-np.log(even) * 2.0**32).astype(np.int64), mix(key ^ _SLOT)


def sketch(name: np.ndarray, text: np.ndarray, weight: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """Name of the shingle that each register of each text keeps; 0 without shingles."""
    time = np.full((texts, registers), np.inf)
    kept = np.zeros((texts, registers), U)
    flat_time, flat_kept = time.ravel(), kept.ravel()
    of_text = np.maximum(np.bincount(text, minlength=texts), 1)
    # So many arrivals of all shingles of a text fill its registers almost always.
    block = np.ceil(registers * (np.log(registers) + 1) / of_text).astype(np.int64)[text]
    active = np.arange(len(name))
    clock = np.zeros(len(name), np.int64)
    step = np.zeros(len(name), np.int64)
    while len(active):
        sizes = block[active]
        who = np.repeat(active, sizes)
        inside = np.arange(len(who)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        wait, draw = _arrivals(name[who], step[who] + inside)
        total = np.cumsum(wait)
        begin = np.cumsum(sizes) - sizes
        total = total - np.repeat(total[begin] - wait[begin], sizes) + clock[who]
        when = total / weight[who]
        slot = text[who] * registers + (draw % U(registers)).astype(np.int64)
        hit = np.flatnonzero(when < flat_time[slot])
        np.minimum.at(flat_time, slot[hit], when[hit])
        won = hit[when[hit] == flat_time[slot[hit]]]
        flat_kept[slot[won]] = name[who[won]]
        clock[active] = total[begin + sizes - 1]
        step[active] += sizes
        latest = time.max(axis=1)[text[active]]
        active = active[clock[active] / weight[active] < latest]
        block[active] = np.maximum(1, block[active] // 4)
    return kept


def band_keys(kept: np.ndarray, rows: int) -> np.ndarray:
    """One key per band of ``rows`` registers, different for each band."""
    bands = kept.shape[1] // rows
    out = np.zeros((kept.shape[0], bands), U)
    for r in range(rows):
        out = mix(out + kept[:, r : bands * rows : rows]) * _STEP
    return mix(out + np.arange(bands, dtype=U))
