"""Array element type names and casts by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from paneltide.schema import parse_type

# One-letter prefixes of sized text and object types.
PREFIX_NAMES = [("U", "unicode_"), ("S", "string_"), ("O", "object")]


def dtype_name(c: Column) -> Column:
    """Readable name of an element type code such as ``<U12`` or ``int64``."""
    text = F.replace(c, F.lit("<"), F.lit(""))
    bare = F.regexp_replace(text, r"^\|+", "")
    out = text
    for prefix, name in reversed(PREFIX_NAMES):
        out = F.when(F.startswith(bare, F.lit(prefix)), F.lit(name)).otherwise(out)
    return out


def cast_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Cast columns to element types given by name (``{"x": "uint8"}``)."""
    return df.withColumns({c: F.col(c).cast(parse_type(n)) for c, n in names.items()})
