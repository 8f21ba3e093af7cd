"""Time ranges, context grids and run keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from paneltide.functions import dates
from paneltide.functions.binding import let

# Period names and the messages of refused input.
PERIODS = ("daily", "weekly", "monthly", "yearly")
BAD_ORDER = "start must be before end"
BAD_PERIOD = "period must be one of: daily, weekly, monthly, yearly"
DAY_MICROS = 86_400_000_000

# Months of 30 days; months until the next such month, from month 1 to 12.
TO_NEXT_SHORT_MONTH = [3, 2, 1, 2, 1, 3, 2, 1, 2, 1, 5, 4]


def _as_time(c: Column, like: T.DataType | None) -> Column:
    return c.cast("timestamp_ntz") if isinstance(like, T.TimestampNTZType) else c


def _day_range(start: Column, end: Column, days: int, k: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(start) + k * F.lit(days * DAY_MICROS))


def _month_boundary(start: Column, k: Column) -> Column:
    """The k-th monthly boundary when month ends clamp and stay clamped.

    A start on day 29 to 31 loses days at the first shorter month it meets and never
    regains them: 30-day months cap it at 30, the first February at its own length, and
    the February after that (never a leap one too) at 28.
    """
    month, day = F.month(start), F.dayofmonth(start)
    first = F.trunc(start, "month")
    to_february = F.pmod(F.lit(2) - month - 1, F.lit(12)) + 1
    february = F.dayofmonth(F.last_day(F.add_months(first, to_february)))
    to_short = F.element_at(F.array(*[F.lit(x) for x in TO_NEXT_SHORT_MONTH]), month)
    kept = F.least(
        day,
        F.when(k >= to_short, F.lit(30)),
        F.when(k >= to_february, february),
        F.when(k >= to_february + 12, F.lit(28)),
    )
    date = F.date_add(F.add_months(first, k), kept - 1)
    clock = F.unix_micros(start) - F.unix_date(start.cast("date")).cast("long") * DAY_MICROS
    return F.timestamp_micros(F.unix_date(date).cast("long") * DAY_MICROS + clock)


def _year_boundary(start: Column, k: Column) -> Column:
    """29 February becomes 28 February for good; other days keep their date."""
    date = start.cast("date")
    leap_day = (F.month(start) == 2) & (F.dayofmonth(start) == 29) & (k > 0)
    moved = F.add_months(F.when(leap_day, F.date_sub(date, 1)).otherwise(date), (k * 12).cast("int"))
    clock = F.unix_micros(start) - F.unix_date(date).cast("long") * DAY_MICROS
    return F.timestamp_micros(F.unix_date(moved).cast("long") * DAY_MICROS + clock)


def time_ranges(start: Column, end: Column, period: str) -> Column:
    """Consecutive ranges from ``start`` to ``end`` as ``array<struct<tr_start, tr_end>>``.

    The last range is cut at ``end``; equal bounds give an empty array and a start after
    the end raises.  A pure expression per row: exploding it needs no join or shuffle.
    """
    period = period.lower()
    if period not in PERIODS:
        raise ValueError(BAD_PERIOD)
    start, end = dates.ensure_utc(start), dates.ensure_utc(end)
    span = F.unix_micros(end) - F.unix_micros(start)
    months = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    if period in ("daily", "weekly"):
        days = 1 if period == "daily" else 7
        last = F.greatest(F.ceil(span / (days * DAY_MICROS)) - 1, F.lit(0))
        boundary = lambda k: _day_range(start, end, days, k)
    elif period == "monthly":
        last, boundary = months.cast("long"), lambda k: _month_boundary(start, k.cast("int"))
    else:
        last, boundary = F.ceil(months / 12), lambda k: _year_boundary(start, k)
    # One boundary more than ranges; each range lies between two neighbours.
    count = F.greatest(last.cast("long"), F.lit(0).cast("long")) + 2
    bounds = F.filter(
        F.transform(F.sequence(F.lit(0).cast("long"), count - 1), boundary), lambda at: at < end
    )

    def pairs(starts):
        return F.transform(
            starts,
            lambda at, i: F.struct(
                dates.to_milli(at).alias("tr_start"),
                dates.to_milli(F.coalesce(F.get(starts, i + 1), end)).alias("tr_end"),
            ),
        )

    out = let(bounds, pairs)
    empty = F.array().cast("array<struct<tr_start:timestamp,tr_end:timestamp>>")
    bad = F.raise_error(F.lit(BAD_ORDER)).cast(
        "array<struct<tr_start:timestamp,tr_end:timestamp>>"
    )
    return F.when(start > end, bad).when(start == end, empty).otherwise(out)


def spread(df: DataFrame) -> DataFrame:
    """Deal a small table out over all tasks before an operator that multiplies its rows."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def explode_ranges(df: DataFrame, start: str, end: str, period: str) -> DataFrame:
    """Replace the bound columns of every row by one row per range."""
    others = [c for c in df.columns if c not in (start, end)]
    opened = df.select(*others, F.explode(time_ranges(F.col(start), F.col(end), period)).alias("__r"))
    return opened.select(*others, "__r.tr_start", "__r.tr_end")


def clone_list(clones: list[int] | range | Column) -> Column:
    """Scenario numbers as one array column."""
    if isinstance(clones, Column):
        return clones.cast("array<int>")
    if isinstance(clones, range) and clones.step == 1 and len(clones):
        return F.sequence(F.lit(clones.start), F.lit(clones.stop - 1))
    numbers = sorted(set(clones))
    return F.array(*[F.lit(n) for n in numbers]) if numbers else F.array().cast("array<int>")


def context_grid(ranges: DataFrame, clones: list[int] | range | Column) -> DataFrame:
    """Every scenario at every range: each range row is exploded, nothing is joined.

    ``clones`` is the scenario list of the run (or an array column, such as a scalar
    subquery).  The grid is unsorted; sort it with ``order_blocks`` where order matters.
    """
    numbered = ranges.select("*", F.explode(clone_list(clones)).alias("clone_num"))
    return numbered.select("clone_num", *ranges.columns)


def run_keys(
    attributes: DataFrame,
    ranges: Column,
    clones: list[int] | range | Column,
    clone_filter: list[int] | None = None,
) -> DataFrame:
    """Contexts x documents x their attributes.

    ``attributes`` holds one row per (full_name, attribute_name).  ``ranges`` is an array
    column: the run's range list as a scalar subquery (computed once), or
    ``time_ranges(...)`` of the row's own bounds.  Both lists explode in place; the
    attribute table, small next to the keys, is spread first.
    """
    attributes = spread(attributes)
    chosen = clone_list(clones)
    if clone_filter:
        chosen = F.array_intersect(chosen, clone_list(clone_filter))
    opened = attributes.select("*", F.explode(ranges).alias("__r"))
    opened = opened.select(*attributes.columns, "__r.tr_start", "__r.tr_end", chosen.alias("__c"))
    return opened.select(
        *attributes.columns, F.explode("__c").alias("clone_num"), "tr_start", "tr_end"
    )


def valid_cells(keys: DataFrame) -> DataFrame:
    """Keep keys inside their attribute's valid range and scenarios.

    ``keys`` carries ``valid_start``, ``valid_end`` and ``valid_clones`` from the
    attribute table (``run_keys`` hands its columns on), so this is a filter.
    """
    return keys.where(
        (F.col("tr_start") >= F.col("valid_start"))
        & (F.col("tr_end") <= F.col("valid_end"))
        & F.array_contains("valid_clones", F.col("clone_num"))
    ).drop("valid_start", "valid_end", "valid_clones")


def expand_dependencies(docs: DataFrame, edges: DataFrame, attributes: DataFrame) -> DataFrame:
    """Runnable attributes of ``docs`` with every runnable attribute of their inputs.

    ``docs(doc_id)``; ``edges(doc_id, attribute_name, var_name, input_doc_id)``;
    ``attributes(doc_id, full_name, attribute_name, runnable, empty_body, new_version,
    old_version)``.  Equi-joins only; attributes without inputs keep one row.
    """
    own = (
        attributes.where(F.col("runnable") & ~F.col("empty_body"))
        .join(docs.select("doc_id"), "doc_id", "left_semi")
        .select("doc_id", "full_name", "attribute_name", "new_version", "old_version")
    )
    given = attributes.where("runnable").select(
        F.col("doc_id").alias("input_doc_id"),
        F.col("full_name").alias("input_full_name"),
        F.col("attribute_name").alias("input_attribute_name"),
        F.col("new_version").alias("input_new_version"),
        F.col("old_version").alias("input_old_version"),
    )
    linked = edges.join(given, "input_doc_id")
    return own.join(linked, ["doc_id", "attribute_name"], "left")


def block_key(*, with_chunk: bool = True) -> Column:
    """Text key ``clone_start_end_chunk_version``; the group key leaves out the last two."""
    parts = [F.col("clone_num").cast("string"), dates.to_iso(F.col("tr_start")), dates.to_iso(F.col("tr_end"))]
    if not with_chunk:
        return F.concat(F.concat_ws("_", *parts), F.lit("_"))
    return F.concat_ws("_", *parts, F.col("chunk_num").cast("string"), dates.to_iso(F.col("version")))
