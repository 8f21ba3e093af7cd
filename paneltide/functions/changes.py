"""Fields of change messages (JSON text)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Where a change message keeps its fields.
GRAPH_ID = "$.fullDocument.calc_graph_ref"
DOCUMENT_ID = "$.documentKey._id"
COLLECTION = "$.collection"
OPERATION = "$.operationType"
DOCUMENT = "$.fullDocument"
IS_DELETED = "$.fullDocument.is_deleted"


def change_field(data: Column, path: str, dtype: str = "string") -> Column:
    """Any field of a message; NULL when the field or the JSON is missing."""
    return F.try_variant_get(F.try_parse_json(data), path, dtype)


def _id(data: Column, path: str) -> Column:
    # An id is plain, or wrapped as {"$oid": ...}.
    return F.coalesce(change_field(data, f"{path}['$oid']"), change_field(data, path))


def graph_id(data: Column) -> Column:
    return _id(data, GRAPH_ID)


def document_id(data: Column) -> Column:
    return _id(data, DOCUMENT_ID)


def collection(data: Column) -> Column:
    return change_field(data, COLLECTION)


def operation(data: Column) -> Column:
    return change_field(data, OPERATION)


def document(data: Column) -> Column:
    """The document after the change, as JSON text."""
    return change_field(data, DOCUMENT)


def is_deleted(data: Column) -> Column:
    return change_field(data, IS_DELETED, "boolean")


def change_error(data: Column) -> Column:
    """Which required field a message lacks; NULL for a complete message."""
    checks = [("collection", COLLECTION), ("operationType", OPERATION), ("documentKey", "$.documentKey"),
              ("fullDocument", DOCUMENT)]
    out = F.when(F.try_parse_json(data).isNull(), F.lit("not JSON"))
    for name, path in checks:
        out = out.when(change_field(data, path, "variant").isNull(), F.lit(f"missing {name}"))
    return out
