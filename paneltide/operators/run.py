"""User functions over cells: per key, per chunk, over history, with captured output.

Prefer plain columns (``train_predict_switch``, ``running_fold``): they stay in the JVM.
Python functions run in Arrow batches inside ``mapInArrow``, which streams a partition
and never gathers a group.
"""

from __future__ import annotations

import contextlib
import io
import pickle
import traceback
from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from paneltide.schema import CELL
from paneltide.session import cut_lineage

BATCH_ROWS = 10_000

# Marks of captured lines, message of a result of the wrong type.
STDOUT, STDERR = "[stdout] ", "[stderr] "
WRONG_OUTPUT = "Expected output of {0}, but output validation failed:\n{1} of type: {2} is not of allowed type"


def output_fields(value: T.DataType) -> list[T.StructField]:
    """Columns of a run's output; ``value`` is NULL for a failed run."""
    return [
        T.StructField("value", value),
        T.StructField("failed", T.BooleanType(), False),
        T.StructField("stdout_output", T.StringType(), False),
        T.StructField("stderr_output", T.StringType(), False),
        T.StructField("combined_output", T.StringType(), False),
    ]


def _combined(stdout: str, stderr: str) -> str:
    """Both streams, every line marked with the stream it came from."""
    marked = [
        "\n".join(mark + line for line in text.split("\n")) for mark, text in ((STDOUT, stdout), (STDERR, stderr)) if text
    ]
    return "".join(marked)


# Python classes a declared result type accepts.
_ACCEPTS = {
    T.LongType: (int,), T.IntegerType: (int,), T.ShortType: (int,), T.ByteType: (int,),
    T.DoubleType: (float, int), T.FloatType: (float, int), T.StringType: (str,),
    T.BooleanType: (bool,), T.BinaryType: (bytes, bytearray), T.ArrayType: (list, tuple),
    T.MapType: (dict,), T.StructType: (dict, tuple),
}


def _mismatch(value, dtype: T.DataType) -> str:
    accepted = _ACCEPTS.get(type(dtype))
    if value is None or accepted is None or isinstance(value, accepted):
        return ""
    return WRONG_OUTPUT.format(dtype.simpleString(), value, type(value))


def captured(fn: Callable, dtype: T.DataType) -> Callable[..., dict]:
    """Wrap ``fn`` so that it never raises: prints and tracebacks become columns."""

    def call(*args, **kwargs) -> dict:
        stdout, stderr = io.StringIO(), io.StringIO()
        value, failed = None, False
        with contextlib.redirect_stdout(stdout), contextlib.redirect_stderr(stderr):
            try:
                value = fn(*args, **kwargs)
            except Exception as error:
                failed = True
                frames = traceback.extract_tb(error.__traceback__)[1:]
                lines = traceback.format_list(frames) + traceback.format_exception_only(error)
                stderr.write("".join(lines))
        out, err = stdout.getvalue().strip(), stderr.getvalue().strip()
        combined = _combined(out, err)
        problem = "" if failed else _mismatch(value, dtype)
        if problem:
            value, failed, err, combined = None, True, err + problem, combined + problem
        return {"value": value, "failed": failed, "stdout_output": out, "stderr_output": err,
                "combined_output": combined}

    return call


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows as Python values: integers stay integers beside a NULL, NULL and NaN stay apart.

    Times come without a zone, in UTC.
    """
    for row in batch.to_pylist(maps_as_pydicts="strict"):
        yield {
            k: v.replace(tzinfo=None) if isinstance(v, datetime) and v.tzinfo is not None else v for k, v in row.items()
        }


def _plain(value, dtype: T.DataType):
    """A value as Arrow takes it for a declared type."""
    if value is None:
        return None
    if isinstance(dtype, T.MapType):
        return [(_plain(k, dtype.keyType), _plain(v, dtype.valueType)) for k, v in dict(value).items()]
    if isinstance(dtype, T.ArrayType):
        return [_plain(v, dtype.elementType) for v in value]
    if isinstance(dtype, T.StructType):
        items = value if isinstance(value, dict) else dict(zip(dtype.fieldNames(), value))
        return {f.name: _plain(items.get(f.name), f.dataType) for f in dtype}
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return float(value)
    return value.item() if hasattr(value, "item") else value


def _batches(schema: T.StructType) -> Callable[[list[dict]], pa.RecordBatch]:
    """Rows to an Arrow batch of exactly the declared types."""
    arrow = to_arrow_schema(schema)
    fields = [(f.name, f.dataType, arrow.field(f.name).type) for f in schema]

    def batch(rows: list[dict]) -> pa.RecordBatch:
        arrays = [pa.array([_plain(r[name], dtype) for r in rows], kind) for name, dtype, kind in fields]
        return pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return batch


def _arguments(row: dict, inputs: list[str]) -> dict:
    args = {"clone_num": row["clone_num"]} if "clone_num" in row else {}
    # Only the main attribute of a node is told its time range.
    if row.get("attribute_name") == "data" and "tr_start" in row:
        args["time_range"] = (row["tr_start"], row["tr_end"])
    return args | {name: row[name] for name in inputs}


def map_cells(keys: DataFrame, fn: Callable, value: T.DataType, inputs: list[str]) -> DataFrame:
    """Call ``fn(clone_num, time_range, <inputs>)`` per key, capturing its output."""
    kept = [f for f in keys.schema if f.name not in inputs]
    schema = T.StructType(kept + output_fields(value))
    names = [f.name for f in kept]
    safe, to_batch = captured(fn, value), _batches(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield to_batch([{**{n: row[n] for n in names}, **safe(**_arguments(row, inputs))} for row in _rows(batch)])

    return keys.mapInArrow(run, schema)


def map_cells_vectorized(keys: DataFrame, fn: Callable[[pd.DataFrame], pd.Series], value: T.DataType) -> DataFrame:
    """Call ``fn`` once per Arrow batch of keys with their inputs.

    The function gets Arrow-backed columns, in which integers stay integers beside NULLs; the
    columns of ``keys`` come back from the batch itself.
    """
    schema = T.StructType([*keys.schema.fields, T.StructField("value", value)])
    kind = to_arrow_schema(schema).field("value").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array(fn(batch.to_pandas(types_mapper=pd.ArrowDtype)), from_pandas=True)
            made = made.combine_chunks() if isinstance(made, pa.ChunkedArray) else made
            yield pa.RecordBatch.from_arrays([*batch.columns, made.cast(kind)], names=schema.names)

    return keys.mapInArrow(run, schema)


def _pieces(fn: Callable[..., Iterator], value: T.DataType, inputs: list[str], key_columns: list[str]) -> Callable[[dict], Iterator[tuple]]:
    """A function from a row to its chunk rows: keys, number and output."""

    def pieces(row: dict) -> Iterator[tuple]:
        head = tuple(row[c] for c in key_columns)
        chunk = 0
        try:
            for piece in fn(**_arguments(row, inputs)):
                problem = _mismatch(piece, value)
                if problem:
                    yield (*head, chunk, None, True, "", problem, problem)
                    return
                yield (*head, chunk, piece, False, "", "", "")
                chunk += 1
        except Exception:
            text = traceback.format_exc().strip()
            yield (*head, chunk, None, True, "", text, _combined("", text))

    return pieces


def register_chunks(
    spark: SparkSession, name: str, fn: Callable[..., Iterator], value: T.DataType, inputs: list[str], key_columns: list[str]
) -> None:
    """Make a generator function callable from SQL: ``SELECT * FROM name(TABLE(cells))``.

    The result has the key columns, with their types in the table given, and the columns of
    ``map_chunks``.  Rows of a key go to one call's partition, in the order of the keys, so the
    SQL text needs no ``PARTITION BY``.
    """
    pieces = _pieces(fn, value, inputs, key_columns)
    output = [T.StructField("chunk_num", T.IntegerType()), *output_fields(value)]

    class Chunks:
        @staticmethod
        def analyze(table: AnalyzeArgument) -> AnalyzeResult:
            kept = [table.dataType[k] for k in key_columns]
            by = [PartitioningColumn(k) for k in key_columns]
            return AnalyzeResult(T.StructType([*kept, *output]), partitionBy=by, orderBy=[OrderingColumn(k) for k in key_columns])

        def eval(self, table: Row) -> Iterator[tuple]:
            yield from pieces(table.asDict())

    spark.udtf.register(name, F.udtf(Chunks))


def map_chunks(
    keys: DataFrame, fn: Callable[..., Iterator], value: T.DataType, inputs: list[str], key_columns: list[str]
) -> DataFrame:
    """Generator functions: every yield is one chunk row, in the order yielded.

    Pieces leave the task as they come, so a value may be larger than memory.  A key
    that fails gets one failed row; ``drop_failed`` then removes its earlier pieces.
    """
    names = [f.name for f in output_fields(value)]
    kept = [f for f in keys.schema if f.name in key_columns]
    schema = T.StructType(kept + [T.StructField("chunk_num", T.IntegerType())] + output_fields(value))
    pieces = _pieces(fn, value, inputs, key_columns)
    ordered = T.StructType([f for c in key_columns for f in kept if f.name == c] + schema.fields[len(kept):])
    columns, to_batch = [*key_columns, "chunk_num", *names], _batches(ordered)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in _rows(batch):
                for piece in pieces(row):
                    held.append(dict(zip(columns, piece)))
                    if len(held) >= BATCH_ROWS:
                        yield to_batch(held)
                        held = []
        if held:
            yield to_batch(held)

    return keys.mapInArrow(run, ordered)


def drop_failed(outputs: DataFrame, key_columns: list[str]) -> DataFrame:
    """Rows of keys without any failure.

    The outputs are written once to the shared folder first: they are read twice, and the
    function that made them should not run twice.
    """
    outputs = cut_lineage(outputs)
    return outputs.join(outputs.where("failed").select(*key_columns).distinct(), key_columns, "left_anti")


def carry_forward(outputs: DataFrame, stored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Failed keys fall back to their last stored value, if any."""
    keys = CELL if keys is None else keys
    old = stored.select(*keys, F.col("value").alias("__old"))
    joined = outputs.join(old, keys, "left")
    return joined.withColumn("value", F.when(F.col("failed"), F.col("__old")).otherwise(F.col("value"))).drop("__old")


def _fold(
    rows: DataFrame, by: list[str], order_by: list[str], step: Callable, start: Callable[[dict], object],
    emit: str, schema: T.StructType,
) -> DataFrame:
    """Stream each sorted partition through ``step``, carrying one state per key."""
    sorted_rows = rows.repartition(*by).sortWithinPartitions(*by, *order_by)
    to_batch = _batches(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, last = None, None, None
        for batch in batches:
            held = []
            for row in _rows(batch):
                key = tuple(row[c] for c in by)
                if key != current:
                    if emit == "states" and last is not None:
                        held.append({**last, "__state": pickle.dumps(state)})
                    current, state = key, start(row)
                state, value = step(state, row)
                last = row
                if emit == "values":
                    held.append({**row, "value": value})
                elif emit == "before":
                    held.append({**row, "__before": value})
            if held:
                yield to_batch(held)
        if emit == "states" and last is not None:
            yield to_batch([{**last, "__state": pickle.dumps(state)}])

    return sorted_rows.mapInArrow(run, schema)


def fold_history(
    cells: DataFrame,
    step: Callable[[object, dict], tuple],
    initial: Callable[[], object],
    value: T.DataType,
    keys: list[str],
    order_by: list[str],
    merge: Callable[[object, object], object] | None = None,
    slice_by: Column | None = None,
) -> DataFrame:
    """Functions of a series' own past: ``step(state, row) -> (state, value)``.

    Cells are unique per range, so a series has at most as many rows as the run has time
    ranges; they stream through the task in order and only the state is held.  When two
    states can be merged (``merge(earlier, later)``), pass it with ``slice_by``: slices
    of one series then run in parallel, with two small passes over slice states.
    """
    inputs = [f for f in cells.schema if f.name != "value"]
    out = T.StructType([*inputs, T.StructField("value", value)])
    if merge is None or slice_by is None:
        return _fold(cells, keys, order_by, step, lambda _: initial(), "values", out)

    sliced = cells.withColumn("__slice", slice_by.cast("long"))
    by = [*keys, "__slice"]
    key_fields = [f for c in by for f in sliced.schema if f.name == c]
    state_schema = T.StructType([*key_fields, T.StructField("__state", T.BinaryType())])
    states = _fold(sliced, by, order_by, step, lambda _: initial(), "states", state_schema)

    def carry(before, row):
        return merge(before, pickle.loads(row["__state"])), pickle.dumps(before)

    before_schema = T.StructType([*key_fields, T.StructField("__before", T.BinaryType())])
    before = _fold(states, keys, ["__slice"], carry, lambda _: initial(), "before", before_schema)
    joined = sliced.join(before, by)
    sliced_out = T.StructType([*inputs, T.StructField("__slice", T.LongType()),
                               T.StructField("__before", T.BinaryType()), T.StructField("value", value)])
    folded = _fold(joined, by, order_by, step, lambda row: pickle.loads(row["__before"]), "values", sliced_out)
    return folded.drop("__slice", "__before")


def train_predict_switch(predict_from: Column, normal: Column, predicted: Column) -> Column:
    """``normal`` for ranges starting before ``predict_from``, else ``predicted``."""
    return F.when(F.coalesce(F.col("tr_start") >= predict_from, F.lit(False)), predicted).otherwise(normal)


def switch_tables(
    df: DataFrame, predict_from: Column, normal: Callable[[DataFrame], DataFrame], predicted: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """The same switch for table functions: each side sees only its own rows."""
    late = F.coalesce(F.col("tr_start") >= predict_from, F.lit(False))
    return normal(df.where(~late)).unionByName(predicted(df.where(late)))


def register_functions(spark: SparkSession, functions: dict[str, tuple[Callable | None, T.DataType]]) -> list[str]:
    """Make named functions of pandas Series callable from SQL; None is a no-op."""
    names = []
    for name, (fn, dtype) in functions.items():
        if fn is not None:
            spark.udf.register(name, F.pandas_udf(fn, dtype))
            names.append(name)
    return names
