"""Change streams: parsed messages, current state, newest version per key.

State per key is one row.  Spark combines the rows of a batch before the shuffle and
keeps the maximum in its state store, so a key that receives most messages costs one
row per task and batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from paneltide.operators.blocks import latest_version
from paneltide.schema import CELL
from paneltide.sources.changes import parse_changes

# Fixed value: the operation that removes a document.
DELETE = "delete"


def stream_changes(messages: DataFrame, data: str = "data") -> DataFrame:
    """Parse each message as it arrives (stateless)."""
    return parse_changes(messages, data)


def newest(stream: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The newest row per key so far; older arrivals change nothing."""
    rest = [c for c in stream.columns if c not in keys]
    best = stream.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return best.select(*keys, "__row.*")


def latest_stream(blocks: DataFrame, tie_break: Column | None = None, keys: list[str] | None = None) -> DataFrame:
    """Streaming twin of ``latest_version`` (update mode)."""
    keys = CELL if keys is None else keys
    if tie_break is None:
        return newest(blocks, keys, [F.col("version")])
    kind = blocks.select(tie_break).schema[0].dataType
    if not isinstance(kind, T.NumericType):
        raise ValueError(f"a stream needs a numeric tie-break, not {kind.simpleString()}")
    return newest(blocks, keys, [F.col("version"), -tie_break])


def apply_changes(changes: DataFrame, sequence: Column) -> DataFrame:
    """Newest change per document; deletions stay as marked rows."""
    return newest(changes.where(F.col("id").isNotNull()), ["id"], [sequence])


def current_state(log: DataFrame, keys: list[str], newest_by: str = "batch_id") -> DataFrame:
    """Read an update log: the newest batch per key."""
    return latest_version(log, keys, version=newest_by).drop(newest_by)


def live(state: DataFrame) -> DataFrame:
    """Documents that still exist."""
    gone = (F.col("operation") == DELETE) | F.coalesce("is_deleted", F.lit(False))
    return state.where(~gone)
