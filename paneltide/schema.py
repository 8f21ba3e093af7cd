"""Block schema, key columns, result row shapes and type strings."""

from __future__ import annotations

import re

from pyspark.sql import types as T

# Columns that identify a value, without its version.
CELL = ["full_name", "attribute_name", "clone_num", "tr_start", "tr_end"]
SERIES = ["full_name", "attribute_name", "clone_num"]
RANGE = ["tr_start", "tr_end"]

# Open-ended time bounds and their numeric twins.
DATETIME_MIN = "0001-01-01 00:00:00"
DATETIME_MAX = "9999-12-31 23:59:59.999"
MIN_SECONDS = -1e18
MAX_SECONDS = 1e18

# Fixed value: the largest value piece that may be stored, in bytes.
MAX_CHUNK_BYTES = 500_000_000


def block_schema(value: T.DataType = T.DoubleType(), time: T.DataType = T.TimestampType()):
    """The block table for values of one Spark type."""
    return T.StructType(
        [
            T.StructField("full_name", T.StringType(), False),
            T.StructField("attribute_name", T.StringType(), False),
            T.StructField("clone_num", T.IntegerType(), False),
            T.StructField("tr_start", time, False),
            T.StructField("tr_end", time, False),
            T.StructField("chunk_num", T.IntegerType(), False),
            T.StructField("version", time, False),
            T.StructField("value", value, True),
            T.StructField("lock_value", T.BooleanType(), True),
        ]
    )


def _time_range_type() -> T.StructType:
    return T.StructType(
        [T.StructField("tr_start", T.TimestampType()), T.StructField("tr_end", T.TimestampType())]
    )


def iterator_schema(value: T.DataType) -> T.StructType:
    """Rows of a slice read: the full context key, then the value."""
    key = T.StructType(
        [
            T.StructField("clone_num", T.IntegerType()),
            T.StructField("time_range", _time_range_type()),
            T.StructField("full_name", T.StringType()),
            T.StructField("attribute_name", T.StringType()),
        ]
    )
    return T.StructType([T.StructField("key", key), T.StructField("value", value)])


def clones_schema(value: T.DataType) -> T.StructType:
    """Rows of a prior-scenario read: scenario number and value."""
    return T.StructType(
        [T.StructField("clone_num", T.IntegerType()), T.StructField("value", value)]
    )


def time_series_schema(value: T.DataType) -> T.StructType:
    """Rows of a time-series read: time range and value."""
    return T.StructType(
        [T.StructField("time_range", _time_range_type()), T.StructField("value", value)]
    )


# Scalar type names and the Spark types that hold them.
SCALAR_TYPES = {
    "int": T.LongType(),
    "float": T.DoubleType(),
    "bool": T.BooleanType(),
    "str": T.StringType(),
    "Text": T.StringType(),
    "bytes": T.BinaryType(),
    "NoneType": T.NullType(),
    "None": T.NullType(),
    "datetime.datetime": T.TimestampType(),
    "datetime.date": T.DateType(),
    "int8": T.ByteType(),
    "int16": T.ShortType(),
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "uint8": T.ShortType(),
    "uint16": T.IntegerType(),
    "uint32": T.LongType(),
    "uint64": T.DecimalType(20, 0),
    "float16": T.FloatType(),
    "float32": T.FloatType(),
    "float64": T.DoubleType(),
    "complex": T.StructType([T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())]),
    "complex64": T.StructType([T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())]),
    "complex128": T.StructType([T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())]),
    "object": T.StringType(),
}

_HINT = re.compile(r"^([A-Za-z_][\w.]*)(?:\[(.*)\])?$", re.S)


def _arguments(text: str) -> list[str]:
    """Split ``a, b[c, d]`` at its outer commas."""
    parts, depth, start = [], 0, 0
    for at, char in enumerate(text):
        depth += (char == "[") - (char == "]")
        if char == "," and depth == 0:
            parts.append(text[start:at].strip())
            start = at + 1
    return [p for p in parts + [text[start:].strip()] if p]


def parse_type(hint: str) -> T.DataType:
    """A declared type such as ``Dict[str, List[int]]`` as a Spark type.

    Only names listed above and the containers below are known: nothing is evaluated.
    """
    if not isinstance(hint, str):
        raise TypeError(f"Expected a string, got {type(hint).__name__}: {hint}")
    text = hint.strip()
    found = _HINT.match(text)
    if not found:
        raise ValueError(f"Cannot read type hint from: {hint}")
    name, inner = found.groups()
    name = re.sub(r"^(typing|np|numpy|builtins)\.", "", name)
    args = _arguments(inner) if inner else []
    if name in SCALAR_TYPES and not args:
        return SCALAR_TYPES[name]
    if name in ("List", "list", "Iterable", "Sequence", "set", "Set"):
        return T.ArrayType(parse_type(args[0]) if args else T.StringType())
    if name in ("Dict", "dict", "Mapping"):
        key, value = (args + ["str", "str"])[:2] if len(args) != 1 else (args[0], "str")
        return T.MapType(parse_type(key), parse_type(value))
    if name in ("Tuple", "tuple") and args:
        if len(args) == 2 and args[1] == "...":
            return T.ArrayType(parse_type(args[0]))
        return T.StructType(
            [T.StructField(f"_{i}", parse_type(a)) for i, a in enumerate(args, start=1)]
        )
    if name == "Optional" and len(args) == 1:
        return parse_type(args[0])
    if name == "TimeRange":
        return _time_range_type()
    if name == "TimeRanges":
        return T.ArrayType(_time_range_type())
    raise ValueError(f"Cannot read type hint from: {hint}")


def type_hint(dtype: T.DataType) -> str:
    """The type string of a Spark type, the inverse of :func:`parse_type`."""
    if isinstance(dtype, T.ArrayType):
        return f"List[{type_hint(dtype.elementType)}]"
    if isinstance(dtype, T.MapType):
        return f"Dict[{type_hint(dtype.keyType)}, {type_hint(dtype.valueType)}]"
    if isinstance(dtype, T.StructType):
        if [f.name for f in dtype] == ["tr_start", "tr_end"]:
            return "TimeRange"
        return f"Tuple[{', '.join(type_hint(f.dataType) for f in dtype)}]"
    if isinstance(dtype, T.TimestampNTZType):
        return "datetime.datetime"
    if isinstance(dtype, T.IntegerType):
        return "int32"
    for name, known in SCALAR_TYPES.items():
        if known == dtype:
            return name
    raise ValueError(f"No type hint for {dtype.simpleString()}")
