"""Schema descriptors of values, with sub-schemas named by their hash.

The descriptor of a typed value depends on the type and on lengths and NULLs only, so
it is one expression per column.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

# Lists from this length on name their item schema once if all items have the
# same.  As ``limit`` it gives the reference's form, which describes them by the first item.
MAX_LISTED = 32

# Descriptors of scalars.
INTEGER = {"type": "integer"}
NUMBER = {"type": "number"}
STRING = {"type": "string"}
BOOLEAN = {"type": "boolean"}
NULL = {"type": "null"}
BYTES = {"x-type": "bytes", "type": "string"}
DATETIME = {"x-type": "datetime", "type": "object"}
UNKNOWN = {"type": "unknown"}


def canonical(schema) -> str:
    return json.dumps(schema, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def schema_hash_of(schema) -> str:
    return hashlib.sha256(canonical(schema).encode("utf-8")).hexdigest()[:8]


def schema_hash(canonical_json: Column) -> Column:
    """First eight hex digits of the SHA-256 of canonical JSON text."""
    return F.substring(F.sha2(canonical_json, 256), 1, 8)


def _scalar(dtype: T.DataType) -> dict:
    if isinstance(dtype, T.BooleanType):
        return BOOLEAN
    if isinstance(dtype, T.IntegralType):
        return INTEGER
    if isinstance(dtype, (T.FractionalType, T.DecimalType)):
        return NUMBER
    if isinstance(dtype, T.StringType):
        return STRING
    if isinstance(dtype, T.BinaryType):
        return BYTES
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return DATETIME
    if isinstance(dtype, T.NullType):
        return NULL
    return UNKNOWN


def _pair_json(value_hash: Column) -> Column:
    head = '{"properties":{"key":"' + schema_hash_of(STRING) + '","value":"'
    return F.concat(
        F.lit(head), value_hash,
        F.lit('"},"required":["key","value"],"type":"object","x-type":"key-value-pair"}'),
    )


def descriptor(c: Column, dtype: T.DataType, limit: int | None = None) -> Column:
    """Canonical JSON descriptor of a value; nested values appear as their hashes.

    All items are described.  With a ``limit``, collections from that length on are described
    by their first item alone; ``MAX_LISTED`` matches the reference.
    """
    null = F.lit(canonical(NULL))
    if isinstance(dtype, T.StructType):
        names = dtype.fieldNames()
        hashes = {f.name: schema_hash(_pair_json(schema_hash(descriptor(c[f.name], f.dataType, limit)))) for f in dtype}
        if limit is None or len(names) < limit:
            pieces = [F.lit('{"properties":{')]
            for at, name in enumerate(sorted(names)):
                pieces += [F.lit(("," if at else "") + json.dumps(name) + ':"'), hashes[name], F.lit('"')]
            required = json.dumps(names, separators=(",", ":"))
            tail = f'}},"required":{required},"type":"object","x-length":{len(names)},"x-type":"dict"}}'
            out = F.concat(*pieces, F.lit(tail))
        else:
            first = dtype[0]
            out = F.concat(
                F.lit('{"properties":{"key_schema":"' + schema_hash_of(STRING) + '","value_schema":"'),
                schema_hash(descriptor(c[first.name], first.dataType, limit)),
                F.lit(f'"}},"required":["key_schema","value_schema"],"type":"object","x-length":{len(names)},"x-type":"dict"}}'),
            )
        return F.when(c.isNull(), null).otherwise(out)
    if isinstance(dtype, T.MapType):
        entries = F.map_entries(c)
        size = F.size(c)
        text = lambda e: e["key"].cast("string")
        quoted = lambda e: F.to_json(F.array(text(e)))
        strip = lambda j: F.substr(j, F.lit(2), F.char_length(j) - 2)
        prop = lambda e: F.concat(
            strip(quoted(e)), F.lit(':"'),
            schema_hash(_pair_json(schema_hash(descriptor(e["value"], dtype.valueType, limit)))), F.lit('"'),
        )
        by_name = F.array_sort(F.transform(entries, lambda e: F.struct(text(e).alias("k"), prop(e).alias("p"))))
        listed = F.concat(
            F.lit('{"properties":{'), F.array_join(F.transform(by_name, lambda e: e["p"]), ","),
            F.lit('},"required":['), F.array_join(F.transform(entries, lambda e: strip(quoted(e))), ","),
            F.lit('],"type":"object","x-length":'), size.cast("string"), F.lit(',"x-type":"dict"}'),
        )
        if limit is None:
            return F.when(c.isNull(), null).otherwise(listed)
        brief = F.concat(
            F.lit('{"properties":{"key_schema":"'), schema_hash(descriptor(entries[0]["key"], dtype.keyType, limit)),
            F.lit('","value_schema":"'), schema_hash(descriptor(entries[0]["value"], dtype.valueType, limit)),
            F.lit('"},"required":["key_schema","value_schema"],"type":"object","x-length":'),
            size.cast("string"), F.lit(',"x-type":"dict"}'),
        )
        return F.when(c.isNull(), null).when(size < limit, listed).otherwise(brief)
    if isinstance(dtype, T.ArrayType):
        size = F.size(c)
        one = lambda x: F.concat(F.lit('"'), schema_hash(descriptor(x, dtype.elementType, limit)), F.lit('"'))
        if limit is None:
            same = lambda h: (F.size(h) >= MAX_LISTED) & (F.size(F.array_distinct(h)) == 1)
            every = lambda h: F.when(same(h), F.get(h, F.lit(0))).otherwise(F.concat(F.lit("["), F.array_join(h, ","), F.lit("]")))
            # A lambda names the hashes, so that they are computed once.
            items = F.get(F.transform(F.array(F.transform(c, one)), every), F.lit(0))
        else:
            items = F.when(
                size < limit,
                F.concat(F.lit("["), F.array_join(F.transform(c, one), ","), F.lit("]")),
            ).otherwise(one(F.try_element_at(c, F.lit(1))))
        length = size.cast("string")
        out = F.concat(
            F.lit('{"items":'), items, F.lit(',"maxItems":'), length, F.lit(',"minItems":'), length,
            F.lit(',"type":"array","x-type":"list"}'),
        )
        return F.when(c.isNull(), null).otherwise(out)
    return F.when(c.isNull(), null).otherwise(F.lit(canonical(_scalar(dtype))))


def definitions(c: Column, dtype: T.DataType, limit: int | None = None) -> Column:
    """Canonical JSON of a value's descriptor and of all descriptors inside it, at any depth."""
    own = F.array(descriptor(c, dtype, limit))
    text = F.array(F.lit(canonical(STRING)))

    def pair(value: Column, kind: T.DataType) -> Column:
        return F.concat(F.array(_pair_json(schema_hash(descriptor(value, kind, limit)))), definitions(value, kind, limit))

    if isinstance(dtype, T.StructType):
        out = F.concat(own, *([text] if len(dtype) else []), *[pair(c[f.name], f.dataType) for f in dtype])
    elif isinstance(dtype, T.MapType):
        # Keys are texts in a listed form; a brief form names the descriptor of the key itself.
        inside = lambda e: F.concat(text, definitions(e["key"], dtype.keyType, limit), pair(e["value"], dtype.valueType))
        out = F.concat(own, F.flatten(F.transform(F.map_entries(c), lambda e: F.array_distinct(inside(e)))))
    elif isinstance(dtype, T.ArrayType):
        out = F.concat(own, F.flatten(F.transform(c, lambda x: F.array_distinct(definitions(x, dtype.elementType, limit)))))
    else:
        return own
    return F.when(c.isNull(), own).otherwise(F.array_distinct(out))


def schema_definitions(df: DataFrame, columns: list[str], limit: int | None = None) -> DataFrame:
    """``schema_hash, definition``: every descriptor met in the columns, once.

    Equal descriptors are one row, whatever holds them, and are combined before the shuffle:
    a table that opens every hash of ``descriptor``.
    """
    met = F.array_distinct(F.concat(*[definitions(F.col(c), df.schema[c].dataType, limit) for c in columns]))
    distinct = df.select(F.explode(met).alias("definition")).distinct()
    return distinct.select(schema_hash(F.col("definition")).alias("schema_hash"), "definition")


def references(definition: Column) -> Column:
    """The distinct hashes a descriptor names: of its properties' and of its items' descriptors."""
    parsed = F.from_json(definition, "properties map<string,string>, items string")
    named = F.coalesce(F.map_values(parsed["properties"]), F.array().cast("array<string>"))
    items = F.coalesce(F.regexp_extract_all(parsed["items"], F.lit("[0-9a-f]{8}"), F.lit(0)), F.array().cast("array<string>"))
    return F.array_distinct(F.concat(named, items))


def describe_schema(df: DataFrame) -> DataFrame:
    """One row per path of the table's own schema: path, type and descriptor hash.

    Only the schema is read, never the rows.
    """
    rows: list[tuple[str, str, str]] = []

    def walk(path: str, dtype: T.DataType) -> str:
        if isinstance(dtype, T.StructType):
            pairs = {}
            for f in dtype:
                value = walk(f"{path}.{f.name}" if path else f.name, f.dataType)
                pairs[f.name] = schema_hash_of(
                    {
                        "type": "object",
                        "x-type": "key-value-pair",
                        "properties": {"key": schema_hash_of(STRING), "value": value},
                        "required": ["key", "value"],
                    }
                )
            named = schema_hash_of(
                {"x-type": "dict", "type": "object", "properties": pairs,
                 "x-length": len(pairs), "required": list(pairs)}
            )
        elif isinstance(dtype, T.ArrayType):
            named = schema_hash_of({"x-type": "list", "type": "array", "items": walk(path + "[]", dtype.elementType)})
        elif isinstance(dtype, T.MapType):
            key, value = walk(path + "{key}", dtype.keyType), walk(path + "{value}", dtype.valueType)
            named = schema_hash_of(
                {"x-type": "dict", "type": "object", "properties": {"key_schema": key, "value_schema": value}}
            )
        else:
            named = schema_hash_of(_scalar(dtype))
        rows.append((path or "$", dtype.simpleString(), named))
        return named

    walk("", df.schema)
    return df.sparkSession.createDataFrame(rows, "path string, type string, schema_hash string")


def describe_json(df: DataFrame, column: str) -> DataFrame:
    """The merged schema of a JSON text column over the whole table, as one row.

    A mergeable aggregate: partial schemas are combined before the shuffle.
    """
    parsed = F.try_parse_json(F.col(column))
    return df.agg(
        F.schema_of_variant_agg(parsed).alias("schema"),
        F.count(F.when(parsed.isNotNull(), 1)).alias("n_valid"),
        F.count(F.when(parsed.isNull() & F.col(column).isNotNull(), 1)).alias("n_invalid"),
    )
