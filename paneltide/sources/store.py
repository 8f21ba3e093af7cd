"""A folder of blocks whose partitions are replaced as a whole, all at once.

``attribute_name=<name>/gen=<id>/`` holds what one write put into a partition, ``_states/<n>.json``
names the generations that count.  The highest ``n`` is the present state.  A write adds files of a
new generation, which nobody reads, and then one state file, by a rename that fails where
the number is taken: readers see the state before or the one after, a job that fails changes
nothing, and of two writers one has to try again.  The file system's rename has to be atomic.

A state is as long as there are partitions, whatever they hold.  Files that no longer count stay
for those who still read them, until ``remove_unused``.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from paneltide.operators import blocks as B

PARTITION, GENERATION, STATES = "attribute_name", "gen", "_states"


class StoreChanged(RuntimeError):
    """Another writer committed first."""


@dataclass
class State:
    number: int = 0
    schema: T.StructType | None = None
    #: Folder of a partition -> its generations that count.
    parts: dict[str, list[str]] = field(default_factory=dict)


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _folder(spark: SparkSession, value: str | None) -> str:
    """The folder Spark writes a partition to; NULL and the empty name share one."""
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString(PARTITION, value)


def current_state(spark: SparkSession, path: str) -> State:
    """The newest committed state; an empty one where nothing was written."""
    fs, where = _fs(spark, f"{path}/{STATES}")
    if not fs.exists(where):
        return State()
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    numbers = [int(n[: -len(".json")]) for n in names if n.endswith(".json") and not n.startswith(".")]
    if not numbers:
        return State()
    newest = max(numbers)
    held = json.loads(spark.read.text(f"{path}/{STATES}/{newest:012d}.json", wholetext=True).first()[0])
    return State(newest, T.StructType.fromJson(held["schema"]), held["parts"])


def _commit(spark: SparkSession, path: str, state: State) -> None:
    jvm = spark._jvm
    fs, draft = _fs(spark, f"{path}/{STATES}/.{uuid.uuid4().hex}.draft")
    _, target = _fs(spark, f"{path}/{STATES}/{state.number:012d}.json")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps({"schema": state.schema.jsonValue(), "parts": state.parts}).encode()))
    out.close()
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(draft, target, none)
    except Exception as error:
        fs.delete(draft, False)
        if fs.exists(target):
            raise StoreChanged(f"state {state.number} of {path} was written meanwhile") from error
        raise


def _read(spark: SparkSession, path: str, state: State, parts: dict[str, list[str]] | None = None) -> DataFrame:
    parts = state.parts if parts is None else parts
    folders = [f"{path}/{part}/{GENERATION}={g}" for part, found in parts.items() for g in found]
    if not folders:
        return spark.createDataFrame([], state.schema)
    # The name column keeps its text ('001' stays so), as its type is given.
    return spark.read.option("basePath", path).schema(state.schema).parquet(*folders).select(*state.schema.names)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of the present state; filters and columns reach the files as in ``read_blocks``."""
    state = current_state(spark, path)
    if state.schema is None:
        raise ValueError(f"nothing was written to {path}")
    return _read(spark, path, state)


def _add(rows: DataFrame, path: str) -> dict[str, list[str]]:
    """Write a generation; the folders it went to."""
    spark, generation = rows.sparkSession, uuid.uuid4().hex
    B.write_blocks(rows.withColumn(GENERATION, F.lit(generation)), path, partition_by=(PARTITION, GENERATION))
    fs, _ = _fs(spark, path)
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{PARTITION}=*/{GENERATION}={generation}"))
    return {s.getPath().getParent().getName(): [generation] for s in found}


def append(rows: DataFrame, path: str) -> None:
    """Add blocks; the first write settles the columns."""
    spark = rows.sparkSession
    state = current_state(spark, path)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema]) if state.schema is None else state.schema
    if {(f.name, f.dataType) for f in rows.schema} != {(f.name, f.dataType) for f in schema}:
        raise ValueError(f"the store holds {schema.simpleString()}, not {rows.schema.simpleString()}")
    added = _add(rows.select(*schema.names), path)
    parts = {k: state.parts.get(k, []) + added.get(k, []) for k in {**state.parts, **added}}
    _commit(spark, path, State(state.number + 1, schema, parts))


def _rewrite(spark: SparkSession, path: str, state: State, touches: Column, change) -> None:
    """Replace the partitions with a row that ``touches`` by ``change`` of all their rows.

    Only these are read for the change; the search for them reads the columns it asks for.
    """
    names = [r[0] for r in _read(spark, path, state).where(touches).select(PARTITION).distinct().collect()]
    touched = {k: state.parts[k] for k in sorted({_folder(spark, n) for n in names})}
    if not touched:
        return
    added = _add(change(_read(spark, path, state, touched)), path)
    parts = {k: v for k, v in state.parts.items() if k not in touched} | added
    _commit(spark, path, State(state.number + 1, state.schema, parts))


def drop_version(spark: SparkSession, path: str, version: Column | None = None) -> None:
    """Delete the blocks of one version, or all blocks; the columns stay settled."""
    state = current_state(spark, path)
    if state.schema is None:
        return
    if version is None:
        _commit(spark, path, State(state.number + 1, state.schema, {}))
    else:
        _rewrite(spark, path, state, F.col("version").eqNullSafe(version), lambda rows: B.drop_version(rows, version))


def compact(
    spark: SparkSession,
    path: str,
    new_version: Column,
    valid_clones: list[int] | None = None,
    valid_range: tuple[Column, Column] | None = None,
) -> None:
    """``operators.blocks.compact`` in place; partitions that are compact already stay as they are."""
    state = current_state(spark, path)
    if state.schema is None:
        return
    kept = ~F.col("version").eqNullSafe(new_version)
    if valid_clones is not None:
        kept = kept | ~F.coalesce(F.col("clone_num").isin(sorted(set(valid_clones))), F.lit(False))
    if valid_range is not None:
        inside = (F.col("tr_start") >= valid_range[0]) & (F.col("tr_end") <= valid_range[1])
        kept = kept | ~F.coalesce(inside, F.lit(False))
    _rewrite(spark, path, state, kept, lambda rows: B.compact(rows, new_version, valid_clones, valid_range).select(*state.schema.names))


def remove_unused(spark: SparkSession, path: str, older_than_seconds: float) -> int:
    """Delete generations that the present state does not name and that are older; how many.

    The age has to exceed the longest read or write, since a running one may need them.
    """
    import time

    state = current_state(spark, path)
    fs, _ = _fs(spark, path)
    before = (time.time() - older_than_seconds) * 1000
    gone = 0
    for found in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{PARTITION}=*/{GENERATION}=*")):
        where = found.getPath()
        named = state.parts.get(where.getParent().getName(), [])
        if where.getName().split("=", 1)[1] not in named and found.getModificationTime() <= before:
            fs.delete(where, True)
            gone += 1
    return gone
