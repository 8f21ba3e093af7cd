"""Reading, writing, ranking and compacting blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

from paneltide.operators.joins import align_to_grid
from paneltide.operators.ordered import rank_in_group
from paneltide.schema import CELL, MAX_CHUNK_BYTES

# Message of a piece that is too large.
TOO_LARGE = ("Chunk size ", " exceeds max batch size ")


def write_blocks(
    df: DataFrame, path: str, partition_by: tuple[str, ...] = ("attribute_name",), mode: str = "append"
) -> None:
    """Append blocks as Parquet.

    Files are clustered by node, scenario and time with a range shuffle: a node with
    many blocks spreads over files, and file statistics let reads skip the others.
    Writing the same key and version again is an upsert, resolved by ``latest_version``.
    """
    order = [c for c in (*partition_by, "full_name", "clone_num", "tr_start", "chunk_num", "version") if c in df.columns]
    clustered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    clustered.write.mode(mode).partitionBy(*partition_by).parquet(path)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of a folder; folder names keep the text they were written with.

    Spark would read a name such as '001' as a number: the key columns get their types from
    the block schema, all others from the files.
    """
    found = spark.read.parquet(path).schema
    texts = {"full_name", "attribute_name"}
    kept = [T.StructField(f.name, T.StringType()) if f.name in texts else f for f in found]
    return spark.read.schema(T.StructType(kept)).parquet(path)


def read_blocks(
    source: SparkSession | DataFrame,
    path: str | None = None,
    clone_nums: list[int] | None = None,
    time_range: tuple[Column, Column] | None = None,
    lock_value: bool | None = None,
    version: Column | None = None,
) -> DataFrame:
    """Filtered scan of stored blocks; every filter reaches the Parquet reader.

    Any number of scenarios may be asked for.  Rows come unsorted: see ``order_blocks``.
    """
    blocks = _stored(source, path) if isinstance(source, SparkSession) else source
    if clone_nums is not None:
        blocks = blocks.where(F.col("clone_num").isin(sorted(set(clone_nums))))
    if time_range is not None:
        blocks = blocks.where((F.col("tr_start") >= time_range[0]) & (F.col("tr_end") <= time_range[1]))
    if version is not None:
        blocks = blocks.where(F.col("version") == version)
    if lock_value is not None:
        blocks = blocks.where(F.col("lock_value") == F.lit(lock_value))
    return blocks


def order_blocks(blocks: DataFrame, within_partitions: bool = False) -> DataFrame:
    """Order by scenario, range start, range end and chunk."""
    order = ["clone_num", "tr_start", "tr_end", "chunk_num"]
    return blocks.sortWithinPartitions(*order) if within_partitions else blocks.orderBy(*order)


def drop_version(blocks: DataFrame, version: Column | None = None) -> DataFrame:
    """Blocks without one version, or none at all; ``sources.store`` replaces stored ones."""
    return blocks.where(F.lit(False)) if version is None else blocks.where(~F.col("version").eqNullSafe(version))


def latest_version(
    blocks: DataFrame, keys: list[str] | None = None, tie_break: Column | None = None, version: str = "version"
) -> DataFrame:
    """The row with the highest version per key; on a tie the smallest ``tie_break``.

    Spark turns the first-row filter into a group limit below the shuffle: each task
    keeps one row per key, so a key with any number of versions sends at most one row
    per task.  Columns nobody reads are pruned from the scan.
    """
    keys = CELL if keys is None else keys
    order = [F.col(version).desc_nulls_last()] + ([] if tie_break is None else [tie_break.asc()])
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return blocks.withColumn("__rank", rank).where(F.col("__rank") == 1).drop("__rank")


def keep_top_version(blocks: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """All rows (chunks) of the highest version per key.

    The top version per key is found from two narrow columns with map-side combine and
    joined back; a key with very many chunks is split by the adaptive skew join.  NULL is a
    key like any other, and the version of a key that has no other.
    """
    top = blocks.groupBy(*keys).agg(F.max(version).alias(version))
    top = top.select(*[F.col(c).alias(f"__top_{c}") for c in top.columns])
    return blocks.join(top, [F.col(c).eqNullSafe(F.col(f"__top_{c}")) for c in (*keys, version)], "left_semi")


def compact(
    blocks: DataFrame,
    new_version: Column,
    valid_clones: list[int] | None = None,
    valid_range: tuple[Column, Column] | None = None,
) -> DataFrame:
    """Drop invalid scenarios and ranges, keep the highest version per key, restamp it."""
    kept = read_blocks(blocks, clone_nums=valid_clones, time_range=valid_range)
    return keep_top_version(kept, CELL).withColumn("version", new_version)


def first_value(
    blocks: DataFrame,
    by: list[str],
    clone_nums: list[int] | None = None,
    time_range: tuple[Column, Column] | None = None,
    latest: bool = False,
) -> DataFrame:
    """First value of a slice in (scenario, time) order, or the last with ``latest``."""
    rows = read_blocks(blocks, clone_nums=clone_nums, time_range=time_range)
    order = F.struct("clone_num", "tr_start", "tr_end")
    pick = F.max_by if latest else F.min_by
    return rows.groupBy(*by).agg(pick(F.struct("value"), order)["value"].alias("value"))


def slice_values(
    blocks: DataFrame,
    grid: DataFrame,
    clone_nums: list[int],
    time_range: tuple[Column, Column],
    tie_break: Column | None = None,
) -> DataFrame:
    """All grid cells of a slice with their latest values, NULL where there is none.

    The slice filters go into both scans before anything is ranked or joined.
    """
    inside = read_blocks(blocks, clone_nums=clone_nums, time_range=time_range)
    cells = read_blocks(grid, clone_nums=clone_nums, time_range=time_range)
    return align_to_grid(latest_version(inside, tie_break=tie_break), cells)


def assemble_chunks(
    blocks: DataFrame, keys: list[str], piece: str = "value", chunk: str = "chunk_num", segment_size: int = 1024
) -> DataFrame:
    """Pieces of each key in chunk order, ``segment_size`` pieces to a row.

    Chunks count 0, 1, 2 ... within a key, so the segment of a piece is a division: a
    value with few pieces is one row, a huge one is many rows and never one task's list.
    """
    segment = F.floor(F.col(chunk) / segment_size).cast("long")
    grouped = blocks.groupBy(*keys, segment.alias("segment")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(chunk).alias("n"), F.col(piece).alias("v")))).alias("__p")
    )
    return grouped.select(*keys, "segment", F.transform("__p", lambda p: p["v"]).alias("pieces"))


def split_chunks(
    df: DataFrame,
    keys: list[str],
    order_by: list[str],
    n: int = 1,
    piece: str | None = None,
    max_bytes: int = MAX_CHUNK_BYTES,
) -> DataFrame:
    """Number the pieces of each key 0, 1, 2 ... (``n`` rows to a chunk).

    A piece over ``max_bytes`` is an error.
    """
    out = rank_in_group(df, keys, order_by, "__rn").select(
        *df.columns, F.floor((F.col("__rn") - 1) / n).cast("int").alias("chunk_num")
    )
    if piece is None:
        return out
    size = F.octet_length(F.col(piece))
    message = F.concat(
        F.lit(TOO_LARGE[0]), size.cast("string"), F.lit(f"{TOO_LARGE[1]}{max_bytes}")
    )
    checked = F.when(size > max_bytes, F.raise_error(message).cast(df.schema[piece].dataType)).otherwise(F.col(piece))
    return out.withColumn(piece, checked)
