"""What several operators need: free names, Arrow batches, state of a worker process."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from paneltide.session import cut_lineage, fresh_path, prepare, shared_dir, written

__all__ = ["arrow_session", "cut_lineage", "free_name", "free_worker_state", "fresh_path", "shared_dir", "slices", "word_count", "worker_state", "written"]

#: Texts one Arrow batch may hold; batches of wide rows stay small.
ARROW_ROWS = 512
#: Words of a text, as everywhere in this package: runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def arrow_session(spark: SparkSession) -> SparkSession:
    """UTC, and small Arrow batches, so that Python workers hold few texts at a time."""
    prepare(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores in front until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_of(c: Column) -> Column:
    """A text column; NULL counts as empty."""
    return F.coalesce(c.cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words; none for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def worker_state() -> types.ModuleType:
    """A place that lives as long as the Python process, across tasks.

    Functions of this package travel by value, so their own globals are new in each
    task; costly read-only things (a loaded tokenizer, its word cache) are kept here.
    """
    return sys.modules.setdefault("_paneltide_worker_state", types.ModuleType("_paneltide_worker_state"))


def free_worker_state() -> None:
    """Give up what an earlier operator kept in this process, as another one needs the memory."""
    worker_state().__dict__.clear()


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that ``column`` has about ``limit`` bytes in each cut, one row at least."""
    sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(column)]
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)
