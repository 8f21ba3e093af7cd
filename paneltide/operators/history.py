"""Looking back: earlier ranges of a series, earlier scenarios of a range.

A lookback that pairs every cell with every earlier block grows with the square of the
series.  Here both sides are laid on one time line instead (blocks at their end, cells
at their start), and running aggregates over that line answer all cells in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from paneltide.operators.ordered import Measure, in_slices, running, time_slice
from paneltide.schema import SERIES

MONTH_SECONDS = 30 * 86_400


def _time_line(
    cells: DataFrame, blocks: DataFrame | None, keys: list[str], value: str, since: Column | None, exact: Column | None
) -> DataFrame:
    """Blocks at their end (kind 0) and cells at their start (kind 1), as one table."""
    amount = F.col(value) if exact is None else exact
    if blocks is None:
        ends = F.array(
            F.struct(F.col("tr_end").alias("__t"), F.lit(0).alias("__kind")),
            F.struct(F.col("tr_start").alias("__t"), F.lit(1).alias("__kind")),
        )
        line = cells.select(*cells.columns, F.inline(ends))
        is_block = F.col("__kind") == 0
        if since is not None:
            line = line.where(~is_block | (F.col("tr_start") >= since))
        return line.withColumns(
            {"__start": F.col("tr_start"), "__value": F.when(is_block, F.col(value)), "__sum": F.when(is_block, amount)}
        )
    past = blocks if since is None else blocks.where(F.col("tr_start") >= since)
    past = past.select(
        *keys,
        F.col("tr_end").alias("__t"),
        F.lit(0).alias("__kind"),
        F.col("tr_start").alias("__start"),
        F.col(value).alias("__value"),
        amount.alias("__sum"),
    )
    ask = cells.select(
        *cells.columns, F.col("tr_start").alias("__t"), F.lit(1).alias("__kind"), F.col("tr_start").alias("__start")
    )
    return past.unionByName(ask, allowMissingColumns=True)


def history_asof(
    cells: DataFrame,
    blocks: DataFrame | None = None,
    keys: list[str] | None = None,
    value: str = "value",
    since: Column | None = None,
    slice_seconds: int | None = MONTH_SECONDS,
    exact: Column | None = None,
) -> DataFrame:
    """Per cell, a summary of all blocks *completed* before it starts.

    Only blocks with ``tr_end <= cell.tr_start`` count.  Adds n_history, sum_history,
    min_history, max_history and last_value (of the latest range with a value).
    ``exact`` replaces the summed value, for instance by a decimal.  Without ``blocks``
    the cells look back at each other, which reads them once.

    Cells and blocks of a panel are unique per range, so a fixed width bounds a slice.
    For raw rows, of which any number may share a span, pass ``slice_seconds=None``: the
    slices are then cut evenly from the data.
    """
    keys = SERIES if keys is None else keys
    line = _time_line(cells, blocks, keys, value, since, exact)
    seen = F.when(F.col("__value").isNotNull(), F.struct("__t", "__start", F.col("__value").alias("v")))
    measures = [
        Measure("n_history", "count", F.when(F.col("__kind") == 0, F.lit(1))),
        Measure("sum_history", "sum", F.col("__sum")),
        Measure("min_history", "min", F.col("__value")),
        Measure("max_history", "max", F.col("__value")),
        Measure("__last", "max", seen),
    ]
    order = ["__t", "__kind", "__start"]
    if slice_seconds is None:
        line, cut = in_slices(line, keys, order), F.col("__slice_part")
    else:
        cut = time_slice(F.col("__t"), slice_seconds)
    out = running(line, keys, [F.col(c) for c in order], measures, cut).where(F.col("__kind") == 1)
    return out.select(
        *cells.columns, "n_history", "sum_history", "min_history", "max_history", F.col("__last.v").alias("last_value")
    )


def time_series(
    aligned: DataFrame,
    ranges: DataFrame,
    as_of: Column | None = None,
    mode: str = "full",
    valid_range: tuple[Column, Column] | None = None,
    drop_sentinels: bool = True,
) -> DataFrame:
    """Series rows up to a point in time, NULL rows kept.

    ``aligned`` is a grid with values.  The first and the last range of the run are
    sentinels and left out; "valid" keeps only ranges inside the attribute's window.
    """
    if mode not in ("full", "valid"):
        raise ValueError(f"Invalid mode: {mode}")
    out = aligned
    if drop_sentinels:
        ends = ranges.agg(
            F.min(F.struct("tr_start", "tr_end")).alias("first"), F.max(F.struct("tr_start", "tr_end")).alias("last")
        )
        first, last = ends.select("first").scalar(), ends.select("last").scalar()
        at = F.struct("tr_start", "tr_end")
        out = out.where((at > first) & (at < last))
    if mode == "valid" and valid_range is not None:
        out = out.where((F.col("tr_start") >= valid_range[0]) & (F.col("tr_end") <= valid_range[1]))
    return out if as_of is None else out.where(F.col("tr_end") <= as_of)


def prior_clones(
    cells: DataFrame, blocks: DataFrame, value: str = "value", clones_per_slice: int = 64, exact: Column | None = None
) -> DataFrame:
    """Per cell, a summary of the values all smaller scenario numbers have at its range."""
    keys = ["full_name", "attribute_name", "tr_start", "tr_end"]
    past = blocks.select(
        *keys, "clone_num", F.lit(1).alias("__kind"), F.col(value).alias("__value"),
        (F.col(value) if exact is None else exact).alias("__sum"),
    )
    # At equal numbers the asking cell (kind 0) sorts before the block: strictly smaller.
    line = past.unionByName(cells.withColumn("__kind", F.lit(0)), allowMissingColumns=True)
    measures = [
        Measure("n_prior", "count", F.when(F.col("__kind") == 1, F.lit(1))),
        Measure("sum_prior", "sum", F.col("__sum")),
        Measure("max_prior", "max", F.col("__value")),
        Measure("__last", "max", F.when(F.col("__kind") == 1, F.struct("clone_num", F.col("__value").alias("v")))),
    ]
    out = running(
        line, keys, [F.col("clone_num"), F.col("__kind")], measures,
        F.floor(F.col("clone_num") / clones_per_slice),
    ).where(F.col("__kind") == 0)
    return out.select(
        *cells.columns, "n_prior", "sum_prior", "max_prior", F.col("__last.v").alias("last_prior"),
    )


def clones(blocks: DataFrame, clone_num: int, time_range: tuple[Column, Column]) -> DataFrame:
    """Values of every scenario before ``clone_num`` inside a range: a pushed-down filter."""
    return blocks.where(
        (F.col("clone_num") < clone_num) & (F.col("tr_start") >= time_range[0]) & (F.col("tr_end") <= time_range[1])
    )


def running_fold(
    cells: DataFrame,
    measures: list[Measure],
    keys: list[str] | None = None,
    slice_seconds: int = MONTH_SECONDS,
) -> DataFrame:
    """Aggregates over the earlier ranges of the same series, for closed-form functions."""
    keys = SERIES if keys is None else keys
    return running(
        cells, keys, [F.col("tr_start"), F.col("tr_end")], measures, time_slice(F.col("tr_start"), slice_seconds)
    )


def _range() -> Column:
    return F.struct("tr_start", "tr_end").alias("time_range")


def iterator_rows(slice_: DataFrame, value: str = "value") -> DataFrame:
    """A slice as rows of context key and value (``schema.iterator_schema``)."""
    key = F.struct("clone_num", _range(), "full_name", "attribute_name").alias("key")
    return slice_.select(key, F.col(value).alias("value"))


def clone_rows(slice_: DataFrame, value: str = "value") -> DataFrame:
    """A scenario read as rows of number and value (``schema.clones_schema``)."""
    return slice_.select("clone_num", F.col(value).alias("value"))


def time_series_rows(slice_: DataFrame, value: str = "value") -> DataFrame:
    """A series as rows of time range and value (``schema.time_series_schema``)."""
    return slice_.select(_range(), F.col(value).alias("value"))
