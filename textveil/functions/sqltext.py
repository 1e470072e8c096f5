"""Small helpers that write Spark SQL expression text.

The rule set is a few hundred calls; as SQL text it reaches the JVM in one call,
while the same tree of Python ``Column`` objects takes seconds on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Running folds over an array copy their result on every step. Working in blocks
# of this many elements keeps the cost linear for texts with very many hits.
BLOCK = 64


# Blanks as Python has them; Java's own class lacks some.
BLANKS = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BLANK_CHARACTERS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def lit(value: str) -> str:
    """A SQL string literal."""
    text = value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return "'" + text.replace("\0", "\\0") + "'"


def ident(name: str) -> str:
    """A quoted column or field name."""
    return "`" + name.replace("`", "``") + "`"


def let(name: str, value: str, body: str) -> str:
    """Evaluate ``value`` once and use it as ``name`` inside ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def stripped(text: str) -> str:
    """A string without blanks at its ends."""
    return f"trim(BOTH {lit(BLANK_CHARACTERS)} FROM {text})"


def running_sum(values: str) -> str:
    """Inclusive running sum of an ``array<int>``."""
    none = "cast(array() as array<int>)"
    before = "coalesce(try_element_at(c, -1), try_element_at(try_element_at(a, -1), -1), 0)"
    block = (
        f"aggregate(slice(v, b * {BLOCK} + 1, {BLOCK}), {none}, "
        f"(c, x) -> concat(c, array(x + {before})))"
    )
    folded = (
        f"flatten(aggregate(sequence(0, (size(v) - 1) div {BLOCK}), "
        f"cast(array() as array<array<int>>), (a, b) -> concat(a, array({block}))))"
    )
    return let("v", values, f"CASE WHEN size(v) = 0 THEN {none} ELSE {folded} END")


def held(df: DataFrame, name: str, value: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """Add the SQL expression ``value`` as column ``name`` and keep it computed.

    A one-element generator stops the optimiser from pasting the expression into
    later projections, where it would run many times.
    """
    others = [F.col(ident(c)) for c in df.columns if c not in drop]
    return df.select(*others, F.expr(f"explode(array({value}))").alias(name))
