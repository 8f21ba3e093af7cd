"""Schema-driven rewriting of nested columns.

``rewrite`` walks a Spark type and rebuilds the column around changed leaves.  The walk
happens once on the driver over the *schema*; what runs on the data is one expression
per column (struct, transform and map functions), so there is no UDF and no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from paneltide.functions import dates
from paneltide.functions.binding import let

Leaf = Callable[[Column, T.DataType], Column]
_TIMES = (T.TimestampType, T.TimestampNTZType)


def rewrite(c: Column, dtype: T.DataType, leaf: Leaf, key: Leaf | None = None) -> Column:
    """Apply ``leaf`` to every scalar at any depth, and ``key`` to map keys."""
    if isinstance(dtype, T.StructType):
        fields = [rewrite(c[f.name], f.dataType, leaf, key).alias(f.name) for f in dtype]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: rewrite(x, dtype.elementType, leaf, key))
    if isinstance(dtype, T.MapType):
        out = F.transform_values(c, lambda _, v: rewrite(v, dtype.valueType, leaf, key))
        return F.transform_keys(out, lambda k, _: key(k, dtype.keyType)) if key else out
    return leaf(c, dtype)


def _over(df: DataFrame, columns: list[str] | None, leaf: Leaf, key: Leaf | None = None) -> DataFrame:
    chosen = set(columns if columns is not None else df.columns)
    return df.select(
        *[
            rewrite(F.col(f.name), f.dataType, leaf, key).alias(f.name) if f.name in chosen else F.col(f.name)
            for f in df.schema
        ]
    )


def normalize_iso(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Times and time-like strings at any depth become ISO text; other strings stay."""

    def leaf(c, dtype):
        if isinstance(dtype, _TIMES):
            return dates.to_iso(c)
        if isinstance(dtype, T.DateType):
            return c.cast("string")
        if isinstance(dtype, T.StringType):
            return F.coalesce(dates.to_iso(dates.parse_datetime(c)), c)
        return c

    return _over(df, columns, leaf)


def normalize_datetimes(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Times at any depth are floored to milliseconds.

    A string column may mix times and other text, so each string becomes a struct
    ``(value timestamp, text string)`` of which one field is set.
    """

    def leaf(c, dtype):
        if isinstance(dtype, _TIMES):
            return dates.to_milli(c)
        if isinstance(dtype, T.StringType):
            at = dates.to_milli(dates.parse_datetime(c))
            return let(at, lambda x: F.struct(x.alias("value"), F.when(x.isNull(), c).alias("text")))
        return c

    return _over(df, columns, leaf)


def to_epoch_seconds(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Times at any depth become seconds; strings a struct ``(value double, text)``."""

    def leaf(c, dtype):
        if isinstance(dtype, _TIMES):
            return dates.to_epoch_seconds(c)
        if isinstance(dtype, T.StringType):
            at = let(dates.parse_datetime(c), lambda x: dates.to_epoch_seconds(x))
            return let(at, lambda x: F.struct(x.alias("value"), F.when(x.isNull(), c).alias("text")))
        return c

    return _over(df, columns, leaf)


def string_keys(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Map keys at any depth become strings."""

    def key(k, dtype):
        text = k.cast("string")
        return F.initcap(text) if isinstance(dtype, T.BooleanType) else text

    return _over(df, columns, lambda c, _: c, key)


def plain_document(
    df: DataFrame, ignore: list[str] | None = None, references: list[str] | None = None
) -> DataFrame:
    """Nested documents as plain records.

    Fields named in ``ignore`` vanish at every depth, object ids (structs with one
    ``$oid`` field) and ``references`` (structs with an ``id``) become their text.
    """
    dropped, linked = set(ignore or ()), set(references or ())

    def walk(c, dtype, name=None):
        if isinstance(dtype, T.StructType):
            names = dtype.fieldNames()
            if names == ["$oid"]:
                return c["$oid"].cast("string")
            if name in linked:
                return walk(c["id"], dtype["id"].dataType).cast("string")
            kept = [f for f in dtype if f.name not in dropped]
            fields = [walk(c[f.name], f.dataType, f.name).alias(f.name) for f in kept]
            return F.when(c.isNotNull(), F.struct(*fields)) if fields else F.lit(None).cast("string")
        if isinstance(dtype, T.ArrayType):
            return F.transform(c, lambda x: walk(x, dtype.elementType, name))
        if isinstance(dtype, T.MapType):
            return F.transform_values(c, lambda _, v: walk(v, dtype.valueType, name))
        return c

    kept = [f for f in df.schema if f.name not in dropped]
    return df.select(*[walk(F.col(f.name), f.dataType, f.name).alias(f.name) for f in kept])


def json_text(c: Column) -> Column:
    """A scalar as JSON text (quoted and escaped when it is a string)."""
    inside = F.to_json(F.array(c), {"ignoreNullFields": "false"})
    return F.when(c.isNull(), F.lit("null")).otherwise(F.substr(inside, F.lit(2), F.char_length(inside) - 2))


def to_readable(c: Column, dtype: T.DataType, indent: int = 2, level: int = 0) -> Column:
    """Indented JSON of any value; missing values read ``null``, numbers stay numbers."""
    pad, close = " " * (indent * (level + 1)), " " * (indent * level)

    def block(opening, body, closing):
        return F.concat(F.lit(opening + "\n" + pad), body, F.lit("\n" + close + closing))

    def null_safe(out):
        return F.when(c.isNull(), F.lit("null")).otherwise(out)

    if isinstance(dtype, T.StructType):
        pairs = []
        for at, f in enumerate(dtype):
            head = ("" if at == 0 else ",\n" + pad) + f'"{f.name}": '
            pairs += [F.lit(head), to_readable(c[f.name], f.dataType, indent, level + 1)]
        return null_safe(block("{", F.concat(*pairs), "}") if pairs else F.lit("{}"))
    if isinstance(dtype, T.ArrayType):
        items = F.transform(c, lambda x: to_readable(x, dtype.elementType, indent, level + 1))
        return null_safe(
            F.when(F.size(c) == 0, F.lit("[]")).otherwise(
                block("[", F.array_join(items, ",\n" + pad), "]")
            )
        )
    if isinstance(dtype, T.MapType):
        items = F.transform(
            F.map_entries(c),
            lambda e: F.concat(
                json_text(e["key"].cast("string")),
                F.lit(": "),
                to_readable(e["value"], dtype.valueType, indent, level + 1),
            ),
        )
        return null_safe(
            F.when(F.size(c) == 0, F.lit("{}")).otherwise(
                block("{", F.array_join(items, ",\n" + pad), "}")
            )
        )
    if isinstance(dtype, (*_TIMES, T.DateType, T.BinaryType)):
        return json_text(c.cast("string"))
    return json_text(c)
