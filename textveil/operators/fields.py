"""String fields of arbitrarily nested records.

Both directions follow the DataFrame schema: reading lists every string leaf in
schema order, writing puts new strings back at the same positions. Neither needs a
shuffle, because a record stays in its row. Values from another table are joined by key;
only records that get one ever move (``joined_by_key``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textveil.functions.sqltext import held, ident, let, lit, running_sum
from textveil.sources.scratch import may_broadcast, written


def holds_strings(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StringType):
        return True
    if isinstance(dtype, T.StructType):
        return any(holds_strings(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return holds_strings(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return isinstance(dtype.keyType, T.StringType) and holds_strings(dtype.valueType)
    return False


def text_columns(df: DataFrame, key: str | None = None, columns: list[str] | None = None) -> list[str]:
    """Top-level columns to search, in schema order. The key is left alone."""
    if columns is not None:
        missing = [c for c in columns if c not in df.columns]
        if missing:
            raise ValueError(f"No such columns: {missing}")
    return [
        f.name
        for f in df.schema.fields
        if holds_strings(f.dataType)
        and (f.name in columns if columns is not None else f.name != key)
    ]


def _fixed_count(dtype: T.DataType) -> int | None:
    """Leaves of a value of this type, or None where it depends on the value."""
    if not holds_strings(dtype):
        return 0
    if isinstance(dtype, T.StringType):
        return 1
    if isinstance(dtype, T.StructType):
        counts = [_fixed_count(f.dataType) for f in dtype.fields]
        return None if None in counts else sum(counts)
    return None


def _items(dtype: T.DataType) -> T.DataType:
    return dtype.elementType if isinstance(dtype, T.ArrayType) else dtype.valueType


def _count(expr: str, dtype: T.DataType, depth: int) -> str:
    """SQL for the number of leaves of a value. Names of lambda variables start with
    two underscores throughout, so that they hide no column."""
    fixed = _fixed_count(dtype)
    if fixed is not None:
        return str(fixed)
    if isinstance(dtype, T.StructType):
        parts = [_count(f"{expr}.{ident(f.name)}", f.dataType, depth) for f in dtype.fields]
        return f"({' + '.join(parts)})"
    each = _fixed_count(_items(dtype))
    if each is not None:
        total = f"size({expr}) * {each}"
    else:
        x, total_so_far = f"__n{depth}", f"__t{depth}"
        values = expr if isinstance(dtype, T.ArrayType) else f"map_values({expr})"
        inner = _count(x, _items(dtype), depth + 1)
        total = f"aggregate({values}, 0, ({total_so_far}, {x}) -> {total_so_far} + {inner})"
    return f"CASE WHEN {expr} IS NULL THEN 0 ELSE {total} END"


def _leaves(expr: str, dtype: T.DataType, path: str | None, depth: int = 0) -> str:
    """SQL for the leaves of a value: strings, or with ``path`` structs of both."""
    if isinstance(dtype, T.StringType):
        return f"array({expr if path is None else leaf(path, expr)})"
    if isinstance(dtype, T.StructType):
        parts = [
            _leaves(
                f"{expr}.{ident(f.name)}",
                f.dataType,
                path and f"concat({path}, {lit('.' + f.name)})",
                depth,
            )
            for f in dtype.fields
            if holds_strings(f.dataType)
        ]
        return f"concat({', '.join(parts)})"
    x, i = f"__x{depth}", f"__i{depth}"
    if isinstance(dtype, T.ArrayType):
        inner = _leaves(x, dtype.elementType, path and f"concat({path}, '[', {i}, ']')", depth + 1)
        listed = f"transform({expr}, ({x}, {i}) -> {inner})"
    else:
        inner = _leaves(
            f"{x}.value", dtype.valueType, path and f"concat({path}, '.', {x}.key)", depth + 1
        )
        listed = f"transform(map_entries({expr}), {x} -> {inner})"
    kind = "string" if path is None else "struct<path:string,text:string>"
    return f"coalesce(flatten({listed}), cast(array() as array<{kind}>))"


def leaf(path: str, text: str) -> str:
    return f"named_struct('path', {path}, 'text', {text})"


def texts_sql(df: DataFrame, columns: list[str]) -> str:
    """``array<string>`` of every string leaf of a row, null and empty ones too."""
    parts = [_leaves(ident(c), df.schema[c].dataType, None) for c in columns]
    return f"concat({', '.join(parts)})" if parts else "cast(array() as array<string>)"


def leaves_sql(df: DataFrame, columns: list[str]) -> str:
    """``array<struct<path, text>>`` of the same leaves in the same order."""
    parts = [_leaves(ident(c), df.schema[c].dataType, lit(c)) for c in columns]
    kind = "array<struct<path:string,text:string>>"
    return f"concat({', '.join(parts)})" if parts else f"cast(array() as {kind})"


def _rebuilt(expr: str, dtype: T.DataType, place: str, changed: str, depth: int = 0) -> str:
    """SQL for a value whose leaves start at position ``place`` of ``changed``."""
    if not holds_strings(dtype):
        return expr
    if isinstance(dtype, T.StringType):
        return f"coalesce({changed}[{place}], {expr})"
    if isinstance(dtype, T.StructType):
        parts = []
        for f in dtype.fields:
            value = f"{expr}.{ident(f.name)}"
            parts.append(f"{lit(f.name)}, {_rebuilt(value, f.dataType, place, changed, depth)}")
            place = f"{place} + {_count(value, f.dataType, depth)}"
        return f"CASE WHEN {expr} IS NOT NULL THEN named_struct({', '.join(parts)}) END"
    x, i, starts = f"__x{depth}", f"__i{depth}", f"__s{depth}"
    is_array = isinstance(dtype, T.ArrayType)
    each = _fixed_count(_items(dtype))
    first = f"{place} + {i} * {each}" if each is not None else f"{place} + {starts}[{i}]"
    item = _rebuilt(x if is_array else f"{x}.value", _items(dtype), first, changed, depth + 1)
    if is_array:
        built = f"transform({expr}, ({x}, {i}) -> {item})"
    else:
        entry = f"named_struct('key', {x}.key, 'value', {item})"
        built = f"map_from_entries(transform(map_entries({expr}), ({x}, {i}) -> {entry}))"
    if each is None:
        values = expr if is_array else f"map_values({expr})"
        counts = f"transform({values}, {x} -> {_count(x, _items(dtype), depth + 1)})"
        built = let(starts, f"concat(array(0), {running_sum(counts)})", built)
    return f"CASE WHEN {expr} IS NOT NULL THEN {built} END"


def write_back(df: DataFrame, columns: list[str], changed: str) -> DataFrame:
    """Put new strings into ``columns``.

    ``changed`` names an ``array<string>`` column that lies alongside
    ``texts_sql`` with null where a leaf stays; rows without any new string keep
    their values untouched. The column is dropped.
    """
    source = ident(changed)
    place, out = "0", {}
    for name in columns:
        dtype = df.schema[name].dataType
        new = _rebuilt(ident(name), dtype, place, source)
        out[name] = F.expr(
            f"CASE WHEN exists({source}, __c -> __c IS NOT NULL) THEN {new} ELSE {ident(name)} END"
        ).alias(name)
        place = f"{place} + {_count(ident(name), dtype, 0)}"
    return df.select(*[out.get(c, F.col(ident(c))) for c in df.columns if c != changed])


def extract_text_fields(
    df: DataFrame, key: str, columns: list[str] | None = None
) -> DataFrame:
    """One row per non-empty string leaf: ``record_id, field_ord, field_path, text``."""
    chosen = text_columns(df, key, columns)
    leaves = df.select(
        F.col(ident(key)).alias("record_id"),
        F.expr(f"filter({leaves_sql(df, chosen)}, leaf -> leaf.text != '')").alias("leaves"),
    )
    return leaves.select(
        "record_id", F.expr("posexplode(leaves)").alias("field_ord", "leaf")
    ).select("record_id", "field_ord", F.col("leaf.path").alias("field_path"), "leaf.text")


#: Into so many slots the keys of records to be joined are folded.
SLOTS = 1 << 20


def rows_with(df: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``df`` in two parts: rows whose key may be in the only column of ``keys``, and rows
    whose key is surely not there. Neither is shuffled: keys are folded into ``SLOTS``
    numbers, which is as many as are broadcast at most."""
    kind = df.schema[key].dataType
    slot = F.pmod(F.xxhash64(F.col(keys.columns[0]).cast(kind)), F.lit(SLOTS)).alias("__slot")
    taken = F.broadcast(written(keys.select(slot).distinct(), "slots"))
    mine = F.pmod(F.xxhash64(F.col(ident(key))), F.lit(SLOTS)) == F.col("__slot")
    return df.join(taken, mine, "left_semi"), df.join(taken, mine, "left_anti")


def joined_by_key(df: DataFrame, key: str, records: DataFrame) -> DataFrame:
    """``df`` with the columns of ``records``, which has one row per key in ``__record``.

    ``records`` is written first, as large as it then is. As long as it is small enough for
    the session to broadcast, no row of ``df`` moves. Beyond that rows whose key has no
    record still stay where they are, and only the others are shuffled by key.

    A null key is a key like others. Adds ``__rows``, how many rows share a key that has a
    record: of records that share one, nobody can say whose detections are whose
    (``unique_sql``). They are counted on keys alone.
    """
    own = F.col(ident(key))
    records = written(records, "detected")
    keys = df.select(own.alias("__key"))
    same = F.col("__key").eqNullSafe(F.col("__record"))
    counted = keys.join(records.select("__record"), same, "left_semi").groupBy("__key")
    counted = counted.agg(F.count(F.lit(1)).alias("__rows"))
    known = written(records.join(counted, same, "left").drop("__key"), "records")
    mine = own.eqNullSafe(F.col("__record"))
    if may_broadcast(known):
        return df.join(F.broadcast(known), mine, "left").drop("__record")
    near, far = rows_with(df, key, known.select("__record"))
    near = near.join(known, mine, "left").drop("__record")
    more = [F.lit(None).cast(f.dataType).alias(f.name) for f in known.schema.fields if f.name != "__record"]
    return near.unionByName(far.select(*[F.col(ident(c)) for c in df.columns], *more))


def unique_sql(key: str, value: str) -> str:
    """SQL for ``value``, or an error where a key stands for several rows."""
    message = lit(f"The key {key!r} is not unique: changes can't be told apart.")
    return f"CASE WHEN __rows > 1 THEN raise_error({message}) ELSE {value} END"


def set_text_fields(
    df: DataFrame,
    key: str,
    new_texts: DataFrame,
    columns: list[str] | None = None,
) -> DataFrame:
    """Write ``new_texts(record_id, field_path, text)`` back into the records.

    Only changed fields need a row, and each at most one. A record without any
    keeps its values and its place. A group is never larger than the record itself. A changed
    key that stands for several rows is an error.
    """
    chosen = text_columns(df, key, columns)
    grouped = new_texts.groupBy(F.col("record_id").alias("__record")).agg(
        F.map_from_entries(F.collect_list(F.struct("field_path", "text"))).alias("__given")
    )
    joined = joined_by_key(df, key, grouped)
    changed = unique_sql(
        key,
        "CASE WHEN __given IS NULL THEN cast(array() as array<string>) "
        f"ELSE transform({leaves_sql(df, chosen)}, leaf -> try_element_at(__given, leaf.path)) END",
    )
    staged = held(joined, "__changed", changed, drop=("__given", "__rows"))
    return write_back(staged, chosen, "__changed")
