"""Ordered computations that do not need a whole group in one task.

A plain window puts every row of a key into one task, so a key that holds a third of
the table stalls the job.  The helpers here cut each key into *slices* along its order
column, work inside the slices, and carry one small row per slice across:

* ``running``          prefix aggregates (everything before a row);
* ``rank_in_group``    row numbers per key;
* ``global_position``  row numbers over a whole table.

Results equal those of the plain window; only the parallelism differs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from paneltide.session import cut_lineage


@dataclass(frozen=True)
class Measure:
    """A running aggregate: ``kind`` is sum, count, min or max of ``value``."""

    name: str
    kind: str
    value: Column

    def input(self) -> Column:
        """What a row adds; counts become sums of ones, so that totals add up too."""
        return F.when(self.value.isNotNull(), F.lit(1).cast("long")) if self.kind == "count" else self.value

    def fold(self, c: Column) -> Column:
        return {"min": F.min, "max": F.max}.get(self.kind, F.sum)(c)

    def result(self, c: Column) -> Column:
        return F.coalesce(c, F.lit(0).cast("long")) if self.kind == "count" else c


def time_slice(c: Column, seconds: int) -> Column:
    """Slice of a time column by fixed width; needs no look at the data."""
    return F.floor(F.unix_micros(c.cast("timestamp")) / (seconds * 1_000_000))


#: Rows of a key that one task orders; a key with more is cut.
ROWS_A_SLICE = 1_000_000
#: Rows drawn per slice to place its bounds.
DRAWN = 64


def in_slices(
    df: DataFrame, keys: list[str], order_by: list[str], name: str = "__slice_part", rows_a_slice: int = ROWS_A_SLICE
) -> DataFrame:
    """``df`` with a slice number that grows with the order and cuts keys of many rows evenly.

    Rows per key are counted (combined before the shuffle).  Only of keys with more than
    ``rows_a_slice`` rows, order tuples are drawn, and every 64th becomes a bound; a row's slice is
    the number of its key's bounds below it.  Counts and bounds read the keys and order columns
    alone, nothing but the bounds is written (some order tuples per hot key), and rows are
    not moved.  Bounds are tuples, so a key whose leading column never changes is cut as well.
    """
    kept = df.select(*keys, F.struct(*order_by).alias("__order"))
    counted = kept.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > rows_a_slice)
    hot = cut_lineage(counted.select(*[F.col(k).alias(f"__hot_{k}") for k in keys]))
    if hot.isEmpty():
        return df.withColumn(name, F.lit(0))
    same = [F.col(k).eqNullSafe(F.col(f"__hot_{k}")) for k in keys]
    drawn = kept.where(F.rand(7) < DRAWN / rows_a_slice).join(hot, same, "left_semi")
    ranked = drawn.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy("__order")))
    bounds = ranked.where(F.col("__rank") % DRAWN == 0).groupBy(*[F.col(k).alias(f"__hot_{k}") for k in keys]).agg(
        F.sort_array(F.collect_set("__order")).alias("__bounds")
    )
    joined = df.join(cut_lineage(bounds), same, "left")
    below = F.size(F.filter("__bounds", lambda b: b < F.struct(*order_by)))
    return joined.select(*df.columns, F.coalesce(below, F.lit(0)).alias(name))


def running(
    df: DataFrame,
    keys: list[str],
    order_by: list[Column],
    measures: list[Measure],
    slice_by: Column,
    inclusive: bool = False,
) -> DataFrame:
    """Aggregate, per row, all rows of its group that sort before it.

    ``slice_by`` has to grow with the order.  Slice totals are combined map-side and
    carried by a window over slices; each carry joins its slice as one more row that
    sorts first.  So the rows are shuffled once, by key and slice, and never joined.
    """
    rows = df.withColumn("__slice", slice_by).withColumns({f"__m_{m.name}": m.input() for m in measures})
    totals = rows.groupBy(*keys, "__slice").agg(*[m.fold(F.col(f"__m_{m.name}")).alias(f"__t_{m.name}") for m in measures])
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys, "__slice", F.lit(0).alias("__row"),
        *[m.fold(F.col(f"__t_{m.name}")).over(before).alias(f"__m_{m.name}") for m in measures],
    )
    line = rows.withColumn("__row", F.lit(1)).unionByName(carry, allowMissingColumns=True)
    last = Window.currentRow if inclusive else -1
    local = (
        Window.partitionBy(*keys, "__slice")
        .orderBy("__row", *order_by)
        .rowsBetween(Window.unboundedPreceding, last)
    )
    folded = {m.name: m.result(m.fold(F.col(f"__m_{m.name}")).over(local)) for m in measures}
    out = line.select(*df.columns, "__row", *[c.alias(f"__o_{n}") for n, c in folded.items()]).where("__row = 1")
    return out.select(*df.columns, *[F.col(f"__o_{m.name}").alias(m.name) for m in measures])


def global_position(df: DataFrame, order_by: list[Column], name: str = "position") -> DataFrame:
    """Number all rows from 0 in the given (total) order.

    A range sort spreads the rows evenly, even when one value repeats a lot.  The
    sorted rows are written once to the shared folder; after that a row's number is its
    index inside its part plus the sizes of the parts before, one tiny row per part.
    """
    marked = cut_lineage(df.orderBy(*order_by).withColumn("__id", F.monotonically_increasing_id()))
    part, index = F.shiftright(F.col("__id"), 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = marked.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    return (
        marked.withColumn("__part", part)
        .join(offsets, "__part")
        .select(*df.columns, (F.col("__off") + index).alias(name))
    )


def rank_in_group(
    df: DataFrame, keys: list[str], order_by: list[str], name: str = "rn", slice_by: Column | None = None, rows_a_slice: int = ROWS_A_SLICE
) -> DataFrame:
    """Row number per key from 1, with hot keys cut into slices.

    ``order_by`` has to end in a tie-break, as for any repeatable row number.
    """
    one = Measure(name, "count", F.lit(1))
    order = [F.col(c) for c in order_by]
    if slice_by is not None:
        return running(df, keys, order, [one], slice_by, inclusive=True)
    sliced = in_slices(df, keys, order_by, rows_a_slice=rows_a_slice)
    return running(sliced, keys, order, [one], F.col("__slice_part"), inclusive=True).drop("__slice_part")
