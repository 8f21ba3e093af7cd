"""One attribute's run over all its cells, from stored inputs to new blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from paneltide.operators.blocks import latest_version
from paneltide.operators.graph import UPSTREAM
from paneltide.operators.joins import gather_inputs, unlocked
from paneltide.operators.run import map_cells
from paneltide.schema import CELL
from paneltide.session import cut_lineage


def run_attribute(
    keys: DataFrame,
    deps: DataFrame,
    inputs: DataFrame,
    stored: DataFrame,
    fn: Callable,
    value: T.DataType,
    new_version: Column,
    locks: DataFrame | None = None,
    failed_inputs: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Call ``fn(clone_num, time_range, inputs)`` for every key; return (blocks, outputs).

    ``inputs`` holds the latest blocks of the attributes in ``deps``; the function gets
    them as a map by ``name.attribute``.  Locked keys are not run and keep their locked
    value.  Attributes listed in ``failed_inputs(full_name, attribute_name,
    input_full_name)`` are not run either and report their upstream.  A failed key keeps
    its last stored value.  All blocks carry ``new_version``; outputs hold the captured
    logs.  Documents run by calling this in dependency order.
    """
    ready = keys.select(*CELL) if locks is None else unlocked(keys.select(*CELL), locks)
    blocked = None
    if failed_inputs is not None:
        causes = failed_inputs.groupBy("full_name", "attribute_name").agg(F.min("input_full_name").alias("__cause"))
        message = F.concat(F.lit(UPSTREAM), F.col("__cause"))
        blocked = ready.join(causes, ["full_name", "attribute_name"]).select(
            *CELL, F.lit(None).cast(value).alias("value"), F.lit(True).alias("failed"),
            message.alias("stdout_output"), message.alias("stderr_output"), message.alias("combined_output"),
        )
        ready = ready.join(causes, ["full_name", "attribute_name"], "left_anti")
    full = gather_inputs(ready, deps, inputs)
    # Blocks and report both read the outputs; the function runs once.
    outputs = cut_lineage(map_cells(full, fn, value, ["inputs"]))
    outputs = outputs if blocked is None else outputs.unionByName(blocked)

    kept = latest_version(stored.where(~F.coalesce("lock_value", F.lit(False))).select(*CELL, "version", "value"))
    old = kept.select(*CELL, F.struct("value").alias("__old"))
    done = outputs.join(old, CELL, "left").where(~F.col("failed") | F.col("__old").isNotNull())
    blocks = done.select(
        *CELL, F.when(F.col("failed"), F.col("__old.value")).otherwise(F.col("value")).alias("value"),
        F.lit(False).alias("lock_value"),
    )
    if locks is not None:
        on = [c for c in CELL if c in locks.columns]
        held = latest_version(stored.where("lock_value").select(*CELL, "version", "value"))
        locked = keys.select(*CELL).join(locks.select(*on).distinct(), on, "left_semi")
        blocks = blocks.unionByName(
            locked.join(held.select(*CELL, "value"), CELL, "left").withColumn("lock_value", F.lit(True))
        )
    return blocks.withColumns({"version": new_version, "chunk_num": F.lit(0)}), outputs
