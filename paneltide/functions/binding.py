"""Naming an intermediate value inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often it is used.

    Spark inlines repeated sub-expressions in conditional branches; for costly ones (a
    regular expression, a line split) a one-element transform binds the result instead.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def let_sql(value: Column, name: str, body: str) -> Column:
    """The same with the body as SQL text over ``name``: long bodies build faster."""
    return F.get(F.call_function("transform", F.array(value), F.expr(f"{name} -> {body}")), F.lit(0))
