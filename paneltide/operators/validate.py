"""Checks of types and of declared outputs, with a message per rejected row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from paneltide.functions.names import is_cell_code
from paneltide.schema import parse_type

_REFUSED = (T.DayTimeIntervalType, T.YearMonthIntervalType, T.CalendarIntervalType)

# The keys of an export entry, and the messages of rejected values.
EXPORT_KEYS = ["start_cell", "value_type"]
NOT_DICT = " is not an instance of dict"
NOT_LIST = " is not an instance of list"
NOT_RANGES = " is not an iterable of time ranges"
NOT_HASHABLE = " is not hashable"
NOT_CELL = " is not proper cell name"
NOT_RANGE = "expected a 2-tuple of datetime objects, got: "
WRONG_KEYS = "must contain keys: 'value_type', 'start_cell' and no others, Got "


def check_allowed(df: DataFrame) -> DataFrame:
    """Per column of the table: is its type, at every depth, an allowed value type?"""

    def problem(dtype: T.DataType) -> str:
        if isinstance(dtype, T.StructType):
            return next((p for p in (problem(f.dataType) for f in dtype) if p), "")
        if isinstance(dtype, T.ArrayType):
            return problem(dtype.elementType)
        if isinstance(dtype, T.MapType):
            return problem(dtype.keyType) or problem(dtype.valueType)
        return dtype.simpleString() if isinstance(dtype, _REFUSED) else ""

    rows = []
    for f in df.schema:
        bad = problem(f.dataType)
        rows.append((f.name, f.dataType.simpleString(), not bad, f"{f.name} of type: {bad} is not of allowed type" if bad else ""))
    return df.sparkSession.createDataFrame(rows, "name string, type string, valid boolean, message string")


def _verdict(problem: Column) -> Column:
    """``problem`` is NULL for a valid row."""
    return F.struct(problem.isNull().alias("valid"), F.coalesce(problem, F.lit("")).alias("message"))


def check_allowed_value(c: Column, dtype: T.DataType) -> Column:
    """Is a value, at every depth, of an allowed type?  A missing value always is."""

    def problem(c: Column, dtype: T.DataType) -> Column | None:
        """The first refused type found in a value; None where the type cannot hold one."""
        if isinstance(dtype, _REFUSED):
            return F.when(c.isNotNull(), F.lit(dtype.simpleString()))
        if isinstance(dtype, T.StructType):
            found = [p for f in dtype if (p := problem(c[f.name], f.dataType)) is not None]
            return F.coalesce(*found) if found else None
        if isinstance(dtype, T.MapType):
            found = [problem(F.map_keys(c), T.ArrayType(dtype.keyType)), problem(F.map_values(c), T.ArrayType(dtype.valueType))]
            found = [p for p in found if p is not None]
            return F.coalesce(*found) if found else None
        if isinstance(dtype, T.ArrayType) and problem(F.lit(None), dtype.elementType) is not None:
            return F.get(F.filter(F.transform(c, lambda x: problem(x, dtype.elementType)), lambda p: p.isNotNull()), F.lit(0))
        return None

    bad = problem(c, dtype)
    return _verdict(F.lit(None).cast("string") if bad is None else F.concat(F.lit("value of type: "), bad, F.lit(" is not of allowed type")))


def check_typed(text: Column, hint: str) -> Column:
    """Does a text hold a value of the declared type?"""
    dtype = parse_type(hint)
    bad = text.isNotNull() & text.try_cast(dtype).isNull()
    return _verdict(F.when(bad, F.concat(F.lit("value '"), text, F.lit(f"' is not of allowed type {hint}"))))


def _is_object(text: Column) -> Column:
    return F.coalesce(F.json_object_keys(text).isNotNull(), F.lit(False))


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def sim_params_problem(v: Column) -> Column:
    """A variant must be an object whose values are plain (hashable) scalars."""
    values = F.try_variant_get(v, "$", "map<string, variant>")
    held = F.filter(F.map_values(values), lambda x: _kind(x).rlike("^(ARRAY|OBJECT)"))
    return F.when(v.isNull() | values.isNull(), F.concat(F.coalesce(F.to_json(v), F.lit("null")), F.lit(NOT_DICT))).when(
        F.size(held) > 0, F.concat(F.to_json(F.get(held, F.lit(0))), F.lit(NOT_HASHABLE))
    )


def check_sim_params(text: Column) -> Column:
    """Simulation parameters: an object of plain values, as JSON text."""
    return _verdict(sim_params_problem(F.try_parse_json(text)))


def check_all_sim_params(text: Column) -> Column:
    """A list of simulation parameters, as JSON text."""
    items = F.try_variant_get(F.try_parse_json(text), "$", "array<variant>")
    found = F.filter(F.transform(items, sim_params_problem), lambda p: p.isNotNull())
    return _verdict(
        F.when(items.isNull(), F.concat(F.coalesce(text, F.lit("null")), F.lit(NOT_LIST)))
        .when(F.size(found) > 0, F.get(found, F.lit(0)))
    )


def export_spec_problem(text: Column) -> Column:
    keys = F.json_object_keys(text)
    cell = F.get_json_object(text, "$.start_cell")
    named = F.array_sort(keys) == F.array(*[F.lit(k) for k in EXPORT_KEYS])
    return (
        F.when(keys.isNull(), F.concat(F.coalesce(text, F.lit("null")), F.lit(NOT_DICT)))
        .when(~named, F.concat(F.lit(WRONG_KEYS), F.array_join(keys, ", ")))
        .when(~is_cell_code(F.coalesce(cell, F.lit(""))), F.concat(F.coalesce(cell, F.lit("null")), F.lit(NOT_CELL)))
    )


def check_export_spec(text: Column) -> Column:
    """One export entry: exactly a value type and a start cell."""
    return _verdict(export_spec_problem(text))


def check_export_config(text: Column) -> Column:
    """Export entries by sheet, as a JSON object of entries."""
    entries = F.map_values(F.try_variant_get(F.try_parse_json(text), "$", "map<string, variant>"))
    found = F.filter(F.transform(entries, lambda v: export_spec_problem(F.to_json(v))), lambda p: p.isNotNull())
    return _verdict(
        F.when(entries.isNull(), F.concat(F.coalesce(text, F.lit("null")), F.lit(NOT_DICT)))
        .when(F.size(found) > 0, F.get(found, F.lit(0)))
    )


def _range_problem(r: Column) -> Column:
    return F.when(
        r.isNull() | r["tr_start"].isNull() | r["tr_end"].isNull(),
        F.concat(F.lit(NOT_RANGE), F.coalesce(F.to_json(r), F.lit("null"))),
    )


def check_time_range(r: Column) -> Column:
    """A pair of times, both present."""
    return _verdict(_range_problem(r))


def check_time_ranges(ranges: Column) -> Column:
    found = F.filter(F.transform(ranges, _range_problem), lambda p: p.isNotNull())
    return _verdict(
        F.when(ranges.isNull(), F.lit("null" + NOT_RANGES))
        .when(F.size(found) > 0, F.get(found, F.lit(0)))
    )


def check_all_time_ranges(named: Column) -> Column:
    """Named lists of time ranges."""
    every = F.flatten(F.map_values(named))
    found = F.filter(F.transform(every, _range_problem), lambda p: p.isNotNull())
    return _verdict(
        F.when(named.isNull(), F.lit("null" + NOT_DICT))
        .when(F.size(found) > 0, F.get(found, F.lit(0)))
    )


def quarantine(df: DataFrame, verdict: Column) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rejected rows with their message."""
    judged = df.withColumn("__v", verdict)
    return (
        judged.where("__v.valid").drop("__v"),
        judged.where(~F.col("__v.valid")).withColumn("message", F.col("__v.message")).drop("__v"),
    )
