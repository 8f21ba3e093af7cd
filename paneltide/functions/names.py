"""Name checks and cleaning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Patterns of valid names, cells and object addresses.
COMPONENT = r"^[a-zA-Z0-9_]+$"
NOT_NAME_CHARS = r"(?U)[^\w\u00A0-\uFFFF]"
QUOTE_LIKE = r"['\"\\`“”‘’´.]"
QUOTE_OR_SPACE_ENDS = r"(?U)^['\"\\`“”‘’´.\s]+|['\"\\`“”‘’´.\s]+\z"
CELL_CODE = r"^[A-Z]+[0-9]+$"
OBJECT_URI = r"(?s)^gs://([^/]*)(?:/(.*))?$"

BAD_NAME = "Node names cannot contain, periods, quotes or escape \ncharacters. Got: "
_ENDS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"


def is_component_name(c: Column) -> Column:
    return c.rlike(COMPONENT)


def clean_name(c: Column) -> Column:
    """Drop every character that cannot stand in a name; never empty, no leading digit.

    Spaces vanish like any other unusable character.
    """
    kept = F.regexp_replace(c, NOT_NAME_CHARS, "")
    return (
        F.when(kept == "", F.lit("_"))
        .when(kept.rlike(r"(?U)^\d"), F.concat(F.lit("_"), kept))
        .otherwise(kept)
    )


def is_valid_name(c: Column) -> Column:
    return ~c.rlike(QUOTE_LIKE)


def strip_characters(c: Column) -> Column:
    """Trim blanks, quote-like characters, backslashes and periods at both ends."""
    return F.regexp_replace(c, QUOTE_OR_SPACE_ENDS, "")


def _name_parts(c: Column) -> Column:
    return F.split(c, r"\.", -1)


def clean_full_names(c: Column) -> Column:
    """Dotted path with every part trimmed; NULL when a part is not a valid name."""
    parts = _name_parts(c)
    trimmed = F.transform(parts, lambda p: F.regexp_replace(p, _ENDS, ""))
    return F.when(F.forall(parts, is_valid_name), F.array_join(trimmed, "."))


def full_name_error(c: Column) -> Column:
    """The message for paths :func:`clean_full_names` refuses, else NULL."""
    return F.when(~F.forall(_name_parts(c), is_valid_name), F.concat(F.lit(BAD_NAME), c))


def is_cell_code(c: Column) -> Column:
    """Spreadsheet cells such as ``AB12``."""
    return c.rlike(CELL_CODE)


def parse_object_uri(c: Column) -> Column:
    """``gs://bucket/path`` as a struct of bucket and path; NULL for other text."""
    return F.when(
        c.rlike(OBJECT_URI),
        F.struct(
            F.regexp_extract(c, OBJECT_URI, 1).alias("bucket"),
            F.regexp_extract(c, OBJECT_URI, 2).alias("path"),
        ),
    )
