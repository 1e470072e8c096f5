"""Brute-force versions in plain Python, for comparison on small inputs."""

import re

from textveil.functions.rules import CATALOGUE

COMPILED = [(rule, re.compile(rule.regex)) for rule in CATALOGUE]


def rule_hits(text):
    """(start, end, rule position, match) of every rule."""
    return [
        (m.start(), m.end(), rule.order, m.group())
        for rule, regex in COMPILED
        for m in regex.finditer(text)
    ]


def overlap_free(spans, score=lambda s: 1.0):
    """Scan all kept spans for every new one."""
    kept = []
    for new in sorted(spans, key=lambda s: (s[0], s[0] - s[1], s[2])):
        rival = next((k for k in kept if new[0] < k[1] and k[0] < new[1]), None)
        if rival is None:
            kept.append(new)
            continue
        gain = (new[1] - new[0]) - (rival[1] - rival[0])
        if gain > 0 or (gain == 0 and score(new) > score(rival)):
            kept[kept.index(rival)] = new
    return sorted(kept)


def replaced(text, spans, new):
    for span in sorted(spans, reverse=True):
        text = text[: span[0]] + new(span) + text[span[1] :]
    return text


def windows(tokens, length, overlap):
    whole = len(tokens) // length * length
    return [tokens[i : i + length] for i in range(0, whole, length - int(length * overlap))]
