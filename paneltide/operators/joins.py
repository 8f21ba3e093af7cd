"""Aligning, overlaying and merging keyed tables.

All joins are equi-joins without hints: Spark broadcasts a side only when its measured
size is below the session threshold, and the adaptive planner splits skewed keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from paneltide.operators.ordered import global_position, rank_in_group
from paneltide.schema import CELL

# Fixed value: message of a positional pairing that runs out on one side.
UNEQUAL = "Iterables have different lengths. Did all the upstream nodes get run?"


def align_to_grid(blocks: DataFrame, grid: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Every grid cell once, with its value or NULL.  ``blocks`` is unique per key."""
    keys = [k for k in (CELL if keys is None else keys) if k in grid.columns]
    values = [c for c in blocks.columns if c not in grid.columns]
    return grid.join(blocks.select(*keys, *values), keys, "left")


def overlay(primary: DataFrame, fallback: DataFrame, keys: list[str], full: bool = True) -> DataFrame:
    """Prefer rows of ``primary``, even NULL ones, else those of ``fallback``."""
    values = [c for c in primary.columns if c not in keys]
    left = primary.select(*keys, F.struct(*values).alias("__p"))
    right = fallback.select(*keys, F.struct(*values).alias("__f"))
    joined = left.join(right, keys, "full" if full else "left")
    pick = F.when(F.col("__p").isNotNull(), F.col("__p")).otherwise(F.col("__f"))
    return joined.select(*keys, pick.alias("__v")).select(*keys, *[F.col("__v")[v].alias(v) for v in values])


def gather_inputs(run_keys: DataFrame, deps: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per run key a map ``input name.attribute -> latest value`` at the same context.

    ``deps(full_name, attribute_name, input_full_name, input_attribute_name)``.  A group
    holds the inputs one attribute declares, never its history; keys of attributes without
    inputs get an empty map.
    """
    context = ["clone_num", "tr_start", "tr_end"]
    stored = blocks.select(
        F.col("full_name").alias("input_full_name"),
        F.col("attribute_name").alias("input_attribute_name"),
        *context,
        F.struct("value").alias("__hit"),
    )
    wanted = run_keys.join(deps, ["full_name", "attribute_name"], "left")
    found = wanted.join(stored, ["input_full_name", "input_attribute_name", *context], "left")
    name = F.concat_ws(".", "input_full_name", "input_attribute_name")
    # NULL for a key without inputs: the list then stays empty.
    entry = F.when(F.col("input_full_name").isNotNull(), F.struct(name.alias("key"), F.col("__hit.value").alias("value")))
    return found.groupBy(*CELL).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("inputs"))


def merge_keyed(
    tables: list[DataFrame], keys: list[str], order_by: list[str], value: str = "value"
) -> DataFrame:
    """Merge keyed tables into one row per key with n values, NULL where absent.

    A key that repeats pairs its i-th row with the i-th of the others (``occurrence``).
    Occurrences are numbered slice by slice, so a hot key is not one task's work, and the
    number is part of the join key, which spreads a hot key over the joining tasks too.
    """
    numbered = [
        rank_in_group(t, keys, order_by, "occurrence").select(
            *keys, "occurrence", F.col(value).alias(f"value_{i}")
        )
        for i, t in enumerate(tables)
    ]
    return reduce(lambda a, b: a.join(b, [*keys, "occurrence"], "full"), numbered)


def merge_with_groups(
    keys: DataFrame, data: DataFrame, groups: DataFrame, on: list[str], id_column: str = "id", value: str = "value"
) -> DataFrame:
    """Each (key, group) once, with the key's values for that group's ids.

    ``keys`` carries ``group_idx``; ``groups(group_idx, ids)``; ``data`` has one row per
    key and id.  Ids without a value map to NULL.  A map is as long as its group's list.
    """
    listed = groups.select("group_idx", F.explode_outer("ids").alias("__id"))
    held = data.select(*on, F.col(id_column).alias("__id"), F.struct(F.col(value).alias("v")).alias("__hit"))
    found = keys.join(listed, "group_idx").join(held, [*on, "__id"], "left")
    entry = F.when(F.col("__id").isNotNull(), F.struct(F.col("__id").alias("key"), F.col("__hit.v").alias("value")))
    return found.groupBy(*on, "group_idx").agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("values")
    )


def zip_strict(tables: list[DataFrame], order_by: list[list[str]]) -> DataFrame:
    """Pair rows by position; an error when the tables differ in length."""
    placed = []
    for i, (t, order) in enumerate(zip(tables, order_by)):
        at = global_position(t, [F.col(c) for c in order])
        placed.append(at.select("position", F.struct(*t.columns).alias(f"item_{i}")))
    joined = reduce(lambda a, b: a.join(b, "position", "full"), placed)
    items = [F.col(f"item_{i}") for i in range(len(tables))]
    missing = reduce(lambda a, b: a | b, [c.isNull() for c in items])
    return joined.select(
        F.when(missing, F.raise_error(F.lit(UNEQUAL)).cast("bigint")).otherwise(F.col("position")).alias("position"),
        *items,
    )


def range_cells(start: Column, end: Column, finest: int, levels: int) -> Column:
    """The dyadic cells that together are the whole numbers from ``start`` to ``end``: level and number.

    Level ``l`` has cells of ``2**l`` numbers.  From the finest level up, an odd start and an even
    end are cells of their own and the rest goes to the level above, so there are at most two
    cells a level.
    """
    cells = "array<struct<level:int,cell:bigint>>"
    one = lambda keep, level, c: F.when(keep, F.array(F.struct(level.alias("level"), c.alias("cell")))).otherwise(F.array().cast(cells))

    def step(s: Column, level: Column) -> Column:
        a, b = s["a"], s["b"]
        odd, even = (a <= b) & (F.pmod(a, F.lit(2)) == 1), (a <= b) & (F.pmod(b, F.lit(2)) == 0)
        up = lambda c: F.shiftright(c, 1)
        some = a <= b
        # What is left between a start moved up and an end moved down may be empty, and stays so.
        return F.struct(
            F.when(some, up(F.when(odd, a + 1).otherwise(a))).otherwise(a).alias("a"),
            F.when(some, up(F.when(even, b - 1).otherwise(b))).otherwise(b).alias("b"),
            F.concat(s["cells"], one(odd, level, a), one(even, level, b)).alias("cells"),
        )

    begin = F.struct(start.cast("long").alias("a"), end.cast("long").alias("b"), F.array().cast(cells).alias("cells"))
    return F.aggregate(F.sequence(F.lit(finest), F.lit(finest + levels)), begin, step, lambda s: s["cells"])


#: Levels of dyadic cells above a microsecond; cells of the finest are about a second wide.
_FINEST, _TOP = 20, 62


def within_range(left: DataFrame, ranges: DataFrame, keys: list[str], lo: str = "lo", hi: str = "hi", many: bool = False) -> DataFrame:
    """Rows whose range lies inside a range of the same key.

    With one range per key (an attribute's valid range) this is an equi-join and a filter.
    With ``many``, a range becomes its dyadic cells, at most two a level however long it is, and
    a row looks up the cells its start lies in, one for each level that occurs: rows meet only
    ranges that hold their start.  Ranges are clipped to the times of ``left``, so an open one
    is a range like others, and no width has to be chosen.
    """
    if not many:
        return left.join(ranges, keys).where((F.col("tr_start") >= F.col(lo)) & (F.col("tr_end") <= F.col(hi)))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    first, last = (left.agg(f(micros("tr_start"))).scalar() for f in (F.min, F.max))
    # Without rows on the left the bounds are NULL, and no range is listed.
    clipped = ranges.withColumns({"__from": F.greatest(micros(lo), first), "__to": F.least(micros(hi), last)})
    kept = clipped.where((F.col(lo) <= F.col(hi)) & (F.col("__from") <= F.col("__to")) & first.isNotNull())
    cells = range_cells(F.shiftright("__from", _FINEST), F.shiftright("__to", _FINEST), _FINEST, _TOP - _FINEST)
    listed = kept.select(*ranges.columns, F.inline(cells).alias("__level", "__cell"))
    used = listed.agg(F.bit_or(F.expr("shiftleft(1L, __level)"))).scalar()
    levels = F.filter(F.sequence(F.lit(_FINEST), F.lit(_TOP)), lambda l: F.getbit("__used", l) == 1)
    placed = left.withColumn("__used", F.coalesce(used, F.lit(0).cast("long"))).withColumn("__level", F.explode(levels)).drop("__used").withColumn(
        "__cell", F.expr("shiftright(unix_micros(CAST(tr_start AS TIMESTAMP)), __level)")
    )
    joined = placed.join(listed, [*keys, "__level", "__cell"])
    # The finest cells are rounded, so bounds are compared all the same.
    return joined.where((F.col("tr_start") >= F.col(lo)) & (F.col("tr_end") <= F.col(hi))).drop("__level", "__cell")


def needed_inputs(blocks: DataFrame, deps: DataFrame, docs_to_run: DataFrame) -> DataFrame:
    """Blocks that are inputs of the run and are not computed by it."""
    wanted = deps.select(
        F.col("input_full_name").alias("full_name"), F.col("input_attribute_name").alias("attribute_name")
    ).distinct()
    return blocks.join(wanted, ["full_name", "attribute_name"], "left_semi").join(
        docs_to_run.select("full_name"), "full_name", "left_anti"
    )


def apply_locks(
    computed: DataFrame, locks: DataFrame, stored: DataFrame, new_version: Column, keys: list[str] | None = None
) -> DataFrame:
    """Locked keys keep their stored locked value, restamped; others the computed one.

    A locked key without a stored value becomes NULL.  ``stored`` is unique per key.
    """
    keys = CELL if keys is None else keys
    on_lock = [k for k in keys if k in locks.columns]
    flagged = computed.join(locks.select(*on_lock).distinct().withColumn("__lock", F.lit(True)), on_lock, "left")
    held = stored.where("lock_value").select(*keys, F.col("value").alias("__held"))
    joined = flagged.join(held, keys, "left")
    locked = F.coalesce(F.col("__lock"), F.lit(False))
    return joined.select(
        *keys,
        F.when(locked, F.col("__held")).otherwise(F.col("value")).alias("value"),
        new_version.alias("version"),
        locked.alias("lock_value"),
    )


def unlocked(run_keys: DataFrame, locks: DataFrame) -> DataFrame:
    """Keys a function still has to run for."""
    on = [k for k in CELL if k in locks.columns]
    return run_keys.join(locks.select(*on).distinct(), on, "left_anti")
