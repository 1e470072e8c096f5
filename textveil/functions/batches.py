"""Arrow batches, cut by what they hold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text, or numbers of a list, that a task works on at a time. An Arrow batch has as
#: many rows however long they are, and Python needs some dozen times their size for them.
PIECE = 1 << 20


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[pa.Array]:
    """Slices of a column of texts or lists with about ``limit`` bytes or numbers together; a
    longer row is alone."""
    measure = pc.list_value_length if pa.types.is_list(column.type) else pc.binary_length
    first = size = 0
    for row, n in enumerate(measure(column).fill_null(0).to_pylist()):
        if row > first and size + n > limit:
            yield column.slice(first, row - first)
            first, size = row, 0
        size += n
    if len(column) > first:
        yield column.slice(first)


def lists(column: pa.ListArray) -> list[list | None]:
    """The rows of a column of numbers. ``to_pylist`` makes an Arrow object of each number."""
    sizes = column.value_lengths()
    ends = np.cumsum(np.asarray(sizes.fill_null(0))).tolist()
    values = column.flatten().to_numpy(zero_copy_only=False).tolist()
    return [None if n is None else values[end - n : end] for n, end in zip(sizes.to_pylist(), ends, strict=True)]
