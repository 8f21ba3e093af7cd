"""Tagged JSON envelopes: ``{"__kind__": ..., "data": ...}`` around every value."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from paneltide.functions import dates
from paneltide.functions.nested import json_text


def _tag(kind: str, data: Column) -> Column:
    return F.concat(F.lit('{"__kind__": "' + kind + '", "data": '), data, F.lit("}"))


def _none() -> Column:
    return F.lit('{"__kind__": "NoneType", "data": null}')


def pack_value(c: Column, dtype: T.DataType) -> Column:
    """A value of any Spark type as an envelope text."""
    if isinstance(dtype, T.StructType):
        pairs = []
        for at, f in enumerate(dtype):
            name = '{"__kind__": "str", "data": ' + json.dumps(f.name, ensure_ascii=False) + "}"
            pairs += [F.lit((", " if at else "") + "[" + name + ", "), pack_value(c[f.name], f.dataType), F.lit("]")]
        out = _tag("dict", F.concat(F.lit("["), *pairs, F.lit("]")))
    elif isinstance(dtype, T.MapType):
        pair = lambda e: F.concat(
            F.lit("["), pack_value(e["key"], dtype.keyType), F.lit(", "),
            pack_value(e["value"], dtype.valueType), F.lit("]"),
        )
        out = _tag("dict", F.concat(F.lit("["), F.array_join(F.transform(F.map_entries(c), pair), ", "), F.lit("]")))
    elif isinstance(dtype, T.ArrayType):
        items = F.transform(c, lambda x: pack_value(x, dtype.elementType))
        out = _tag("list", F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]")))
    elif isinstance(dtype, T.BooleanType):
        out = _tag("bool", c.cast("string"))
    elif isinstance(dtype, T.IntegralType):
        out = _tag("int", c.cast("string"))
    elif isinstance(dtype, (T.FractionalType, T.DecimalType)):
        out = _tag("float", json_text(c.cast("double")))
    elif isinstance(dtype, T.BinaryType):
        out = _tag("bytes", F.concat(F.lit('"'), F.base64(c), F.lit('"')))
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        out = _tag("datetime", F.concat(F.lit('"'), dates.to_iso(c), F.lit('"')))
    elif isinstance(dtype, T.DateType):
        out = _tag("date", F.concat(F.lit('"'), c.cast("string"), F.lit('"')))
    elif isinstance(dtype, T.NullType):
        return _none()
    else:
        out = _tag("str", json_text(c.cast("string")))
    return F.when(c.isNull(), _none()).otherwise(out)


def kind(text: Column) -> Column:
    return F.try_variant_get(F.try_parse_json(text), "$.__kind__", "string")


def unpack_error(text: Column) -> Column:
    """Why an envelope cannot be read; NULL for a readable one."""
    return F.when(
        text.isNotNull() & F.try_parse_json(text).isNull(),
        F.concat(F.lit("Deserialize failed: "), text),
    )


#: Kinds that open as a Spark type; a text also holds what is written as one.
_KINDS = {
    "struct": ("dict",), "map": ("dict",), "array": ("list", "tuple", "ndarray"), "binary": ("bytes",), "boolean": ("bool",),
    "timestamp": ("datetime", "Timestamp"), "timestamp_ntz": ("datetime", "Timestamp"), "date": ("date",), "integral": ("int",),
    "number": ("float", "int"), "string": ("str", "ObjectId", "GCSPath", "Period", "time", "complex"),
}


def _accepted(dtype: T.DataType) -> tuple[str, ...]:
    if isinstance(dtype, T.IntegralType):
        return _KINDS["integral"]
    return _KINDS["number"] if isinstance(dtype, T.NumericType) else _KINDS.get(dtype.typeName(), ())


def unpack_value(text: Column, dtype: T.DataType) -> Column:
    """The value inside an envelope; NULL when its kind is not one of the asked type.

    A whole number opens as a fractional type as well; no other kind is converted.
    """
    return _open(F.try_parse_json(text), dtype)


def _open(v: Column, dtype: T.DataType) -> Column:
    return F.when(F.try_variant_get(v, "$.__kind__", "string").isin(*_accepted(dtype)), _opened(v, dtype))


def _opened(v: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StructType):
        pairs = F.try_variant_get(v, "$.data", "array<array<variant>>")

        def field(f):
            found = F.filter(
                pairs, lambda p: F.try_variant_get(F.get(p, F.lit(0)), "$.data", "string") == f.name
            )
            return _open(F.get(F.get(found, F.lit(0)), F.lit(1)), f.dataType).alias(f.name)

        return F.when(pairs.isNotNull(), F.struct(*[field(f) for f in dtype]))
    if isinstance(dtype, T.MapType):
        pairs = F.try_variant_get(v, "$.data", "array<array<variant>>")
        return F.map_from_entries(
            F.transform(
                pairs,
                lambda p: F.struct(
                    _open(F.get(p, F.lit(0)), dtype.keyType).alias("key"),
                    _open(F.get(p, F.lit(1)), dtype.valueType).alias("value"),
                ),
            )
        )
    if isinstance(dtype, T.ArrayType):
        items = F.try_variant_get(v, "$.data", "array<variant>")
        return F.transform(items, lambda x: _open(x, dtype.elementType))
    if isinstance(dtype, T.BinaryType):
        return F.unbase64(F.try_variant_get(v, "$.data", "string"))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return dates.to_milli(dates.parse_datetime(F.try_variant_get(v, "$.data", "string"))).cast(dtype)
    if isinstance(dtype, T.DateType):
        return F.try_variant_get(v, "$.data", "string").try_cast("date")
    return F.try_variant_get(v, "$.data", dtype.simpleString())


def _listed(kind: str, items: Column, **more: Column) -> Column:
    """An envelope over JSON texts, with further JSON fields."""
    extra = [x for k, c in more.items() for x in (F.lit(f', "{k}": '), c)]
    return F.concat(F.lit('{"__kind__": "' + kind + '", "data": ['), F.array_join(items, ", "), F.lit("]"), *extra, F.lit("}"))


def pack_array(c: Column, dtype: T.ArrayType, number_type: str) -> Column:
    """An array of any depth as a shaped array, e.g. of ``float64``; its rows have equal lengths."""
    shape, level, inner = [F.size(c)], c, dtype.elementType
    while isinstance(inner, T.ArrayType):
        level, inner = F.coalesce(F.get(level, F.lit(0)), F.array().cast(T.ArrayType(inner.elementType))), inner.elementType
        shape.append(F.size(level))
    items = F.transform(c, lambda x: pack_value(x, dtype.elementType))
    sizes = F.concat(F.lit("["), F.array_join(F.array(*[s.cast("string") for s in shape]), ", "), F.lit("]"))
    return F.when(c.isNull(), _none()).otherwise(_listed("ndarray", items, dtype=F.lit(json.dumps(number_type)), shape=sizes))


def pack_tuple(items: list[tuple[Column, T.DataType]]) -> Column:
    """Columns of any types as a tuple."""
    return _listed("tuple", F.array(*[pack_value(c, dtype) for c, dtype in items]))


def pack_series(index: Column, index_type: T.DataType, values: Column, value_type: T.DataType) -> Column:
    """Two arrays of equal length as a labelled series."""
    pair = lambda i, v: F.concat(F.lit('{"index": '), pack_value(i, index_type), F.lit(', "value": '), pack_value(v, value_type), F.lit("}"))
    return F.when(index.isNull() | values.isNull(), _none()).otherwise(_listed("Series", F.zip_with(index, values, pair)))


def pack_index(values: Column, value_type: T.DataType) -> Column:
    """An array of labels; labels are written plainly."""
    text = lambda x: F.coalesce(json_text(x), F.lit("null"))
    return F.when(values.isNull(), _none()).otherwise(_listed("Index", F.transform(values, text)))


# Frequency codes and the text of a period.
PERIOD_TEXTS = {"Y": "yyyy", "M": "yyyy-MM", "D": "yyyy-MM-dd", "h": "yyyy-MM-dd HH:00", "min": "yyyy-MM-dd HH:mm", "s": "yyyy-MM-dd HH:mm:ss"}


def period_text(c: Column, frequency: str) -> Column:
    """A time as the text of the period it lies in; quarters read 2023Q1."""
    if frequency == "Q":
        return F.concat(F.year(c).cast("string"), F.lit("Q"), F.quarter(c).cast("string"))
    return F.date_format(c, PERIOD_TEXTS[frequency])


def pack_period(c: Column, frequency: str) -> Column:
    text = F.concat(F.lit('{"__kind__": "Period", "data": "'), period_text(c, frequency), F.lit('", "freq": ' + json.dumps(frequency) + "}"))
    return F.when(c.isNull(), _none()).otherwise(text)


def pack_periods(times: Column, frequency: str) -> Column:
    """An array of times as an index of periods."""
    quoted = F.transform(times, lambda x: F.concat(F.lit('"'), period_text(x, frequency), F.lit('"')))
    return F.when(times.isNull(), _none()).otherwise(_listed("PeriodIndex", quoted, freq=F.lit(json.dumps(frequency))))


def pack_as(kind: str, c: Column) -> Column:
    """A text under one of the kinds written as a text: Timestamp, time, ObjectId, GCSPath, complex."""
    return F.when(c.isNull(), _none()).otherwise(_tag(kind, json_text(c.cast("string"))))


def pack_frame_row(index: Column, index_type: T.DataType, c: Column, dtype: T.StructType) -> Column:
    """One row of a table value: its index and its columns, each enveloped.

    A table value stays one row per table row, so a large table never has to fit one
    cell.
    """
    pieces = []
    for at, f in enumerate(dtype):
        pieces += [F.lit((", " if at else "") + json.dumps(f.name, ensure_ascii=False) + ": "),
                   pack_value(c[f.name], f.dataType)]
    return F.concat(
        F.lit('{"index": '), pack_value(index, index_type), F.lit(', "columns": {'), *pieces, F.lit("}}")
    )


def unpack_frame(df: DataFrame, column: str, index_type: T.DataType, schema: T.StructType) -> DataFrame:
    """Explode table envelopes: one output row per table row."""
    rows = F.try_variant_get(F.try_parse_json(F.col(column)), "$.data", "array<variant>")
    others = [c for c in df.columns if c != column]
    opened = df.select(*others, F.explode(rows).alias("__row"))
    # Names are looked up in a map, as a path would read dots and quotes in them as its own.
    row = opened.select(
        *others, F.try_variant_get("__row", "$.index", "variant").alias("__index"),
        F.try_variant_get("__row", "$.columns", "map<string,variant>").alias("__columns"),
    )
    return row.select(
        *others,
        _open(F.col("__index"), index_type).alias("index"),
        *[_open(F.try_element_at("__columns", F.lit(f.name)), f.dataType).alias(f.name) for f in schema],
    )
