"""What happens to a detected span: redact, mask or pseudonymise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textveil.functions.sqltext import BLOCK, ident, let
from textveil.operators.pseudonym import cleaned_sql, replacement_sql

REDACTED = "[REDACTED]"
ACTIONS = ("redact", "mask", "pseudonymize")


def check_action(action: str) -> None:
    if action not in ACTIONS:
        raise ValueError(f"Not a valid action: {action!r}. Choose from {list(ACTIONS)}.")


def check_salt(action: str, salt: str) -> None:
    """Digests of short values without a salt can be found by trying all values."""
    if action == "pseudonymize" and not salt:
        raise ValueError("Pseudonyms need a secret `salt`.")


def placeholder_sql(pattern: str) -> str:
    return f"concat('[', upper({pattern}), ']')"


def action_sql(action: str, span: str, salt: str) -> str:
    """SQL for the text that takes the place of ``span``."""
    check_action(action)
    if action == "redact":
        return f"'{REDACTED}'"
    if action == "mask":
        return placeholder_sql(f"{span}.pattern")
    return replacement_sql(f"{span}.pattern", f"{span}.match", salt)


def spliced_sql(text: str, spans: str, action: str, salt: str = "") -> str:
    """SQL for ``text`` with its disjoint, sorted ``spans`` replaced.

    Cutting by code point reads from the front of a string, so a text is cut into
    one chunk per block of spans first.
    """
    new = action_sql(action, "s", salt)
    piece = (
        "concat(substring(chunk, 1 + CASE WHEN i = 0 THEN 0 ELSE part[i - 1].end - base END, "
        "s.start - CASE WHEN i = 0 THEN base ELSE part[i - 1].end END), "
        f"{new})"
    )
    chunk = "substring(t, base + 1, element_at(part, -1).end - base)"
    body = let("chunk", chunk, f"array_join(transform(part, (s, i) -> {piece}), '')")
    part = let("part", f"slice(z, b * {BLOCK} + 1, {BLOCK})", body)
    base = let("base", f"CASE WHEN b = 0 THEN 0 ELSE z[b * {BLOCK} - 1].end END", part)
    pieces = f"transform(sequence(0, (size(z) - 1) div {BLOCK}), b -> {base})"
    rest = "substring(t, element_at(z, -1).end + 1, length(t))"
    return let(
        "t",
        text,
        let(
            "z",
            spans,
            f"CASE WHEN size(z) = 0 THEN t ELSE concat(array_join({pieces}, ''), {rest}) END",
        ),
    )


def clean_control_whitespace(column: str) -> Column:
    """Control whitespace and runs of blanks become one blank; ends are trimmed."""
    return F.expr(cleaned_sql(ident(column)))
