"""Set differences and intersections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from paneltide.operators.grid import clone_list


def diff_elements(new: DataFrame | None, old: DataFrame | None, side: str = "both") -> DataFrame:
    """Distinct rows found in one table only, sorted; a missing table is empty.

    NULLs compare equal and nested structs compare by content.
    """
    if side not in ("new", "old", "both"):
        raise ValueError(f"Invalid side: {side}")
    if new is None and old is None:
        raise ValueError("one of the two tables is needed for the columns")
    if new is None:
        new = old.where(F.lit(False))
    if old is None:
        old = new.where(F.lit(False))
    # One read and one shuffle: sides are tagged, repeated rows are combined map-side, and a
    # row of both sides ends with both tags.
    cells = [F.col(c) for c in new.columns]
    tagged = new.select(*cells, F.lit(1).alias("__side")).unionAll(old.select(*cells, F.lit(2).alias("__side")))
    wanted = {"new": [1], "old": [2], "both": [1, 2]}[side]
    out = tagged.groupBy(*cells).agg(F.bit_or("__side").alias("__side")).where(F.col("__side").isin(wanted)).drop("__side")
    return out.orderBy(*[F.col(c).asc_nulls_first() for c in out.columns])


def intersect_clones(requested: Column | list[int], valid: Column | list[int]) -> Column:
    """Scenario numbers both asked for and valid, sorted."""
    return F.array_sort(F.array_intersect(clone_list(requested), clone_list(valid)))


def dedup_sets(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct tuples of the given columns."""
    return df.select(*columns).distinct()
