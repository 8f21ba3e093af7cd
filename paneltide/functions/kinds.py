"""Opening envelopes of mixed kinds by what they say they are."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column, functions as F

_OPENED = "kind string, value string, labels string, dtype string, shape array<long>, freq string, error string"


def _plain(x):
    """The plain value of an envelope, as JSON can hold it."""
    if isinstance(x, list):
        return [_plain(v) for v in x]
    if isinstance(x, float) and not math.isfinite(x):
        return str(x)
    if not isinstance(x, dict):
        return x
    kind, data = x.get("__kind__"), x.get("data")
    if kind == "dict":
        pairs = [(_plain(k), _plain(v)) for k, v in data]
        return {k if isinstance(k, str) else json.dumps(k): v for k, v in pairs}
    if kind == "DataFrame":
        return [{"index": _plain(r["index"]), "columns": _plain(r["columns"])} for r in data]
    if kind == "Series":
        return [_plain(r["value"]) for r in data]
    if kind == "ndarray":
        return _shaped(_plain(data), x["shape"])
    if kind in ("int", "bool", "float"):
        return {"int": int, "bool": bool, "float": lambda v: _plain(float(v))}[kind](data)
    if kind == "complex":
        number = complex(data)
        return {"re": number.real, "im": number.imag}
    if kind in ("str", "ObjectId", "GCSPath", "Period", "Timestamp", "datetime", "date", "time", "bytes"):
        return str(data)
    if kind in ("list", "tuple", "PeriodIndex", "Index"):
        return [_plain(v) for v in data]
    return None if kind == "NoneType" else {k: _plain(v) for k, v in x.items()}


def _shaped(items: list, shape: list[int]) -> list:
    """Items in nested lists of the given sizes; items that are nested are laid out flat first."""
    while items and isinstance(items[0], list):
        items = [v for row in items for v in row]
    if math.prod(shape) != len(items):
        raise ValueError(f"{len(items)} items do not fill the shape {shape}")
    for size in reversed(shape[1:]):
        items = [items[i : i + size] for i in range(0, len(items), size)] if size else [[]] * math.prod(shape[:1])
    return items


def _one(text: str | None) -> tuple:
    if text is None:
        return (None,) * 7
    try:
        x = json.loads(text)
        about = x if isinstance(x, dict) else {}
        kind = about.get("__kind__")
        labels = json.dumps([_plain(r["index"]) for r in about["data"]], ensure_ascii=False) if kind in ("Series", "DataFrame") else None
        return kind, json.dumps(_plain(x), ensure_ascii=False), labels, about.get("dtype"), about.get("shape"), about.get("freq"), None
    except (ValueError, TypeError, KeyError, RecursionError) as error:
        return (None,) * 6 + (f"Deserialize failed: {error}",)


def _open_all(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_one(t) for t in texts], columns=[x.split()[0] for x in _OPENED.split(", ")], dtype=object)


def open_any(text: Column) -> Column:
    """``kind, value, labels, dtype, shape, freq, error`` of an envelope of any kind.

    ``value`` and ``labels`` (of series and tables) are VARIANT: dictionaries as objects (other
    keys than texts by their JSON), sequences and shaped arrays as nested arrays, times and
    bytes as their text, complex numbers as ``re`` and ``im``, NaN and infinities as text.  What
    cannot be read has an ``error``; NULL stays NULL.  Envelopes nest to any depth, which
    column expressions cannot follow, so one Arrow batch after the other goes through Python.
    """
    found = F.pandas_udf(_open_all, _OPENED)(text)
    parsed = [F.parse_json(found[c]).alias(c) for c in ("value", "labels")]
    return F.struct(found["kind"].alias("kind"), *parsed, *[found[c].alias(c) for c in ("dtype", "shape", "freq", "error")])
