"""Rendezvous hashing of record keys over weighted shards (operator 5).

Every (key, shard) pair has a uniform hash u; a key goes to the shard with the smallest
-ln(u)/weight.  A shard that is added can only win keys for itself, and a shard that is
taken away hands on only its own: nothing else moves.  All of it is one projection.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from paneltide.llm.common import text_of

SHARDS = 16
#: Parts a shard's rows are numbered in; a part is the unit of work of the numbering.
BLOCKS = 4096


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Shard of a key: equal keys go together, NULL is a key like any other."""
    scores = []
    for shard, weight in enumerate(weights):
        if weight <= 0:
            raise ValueError("weights have to be positive")
        # 53 bits of the hash, moved off zero, as a number between 0 and 1.
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) / float(1 << 53)
        scores.append(F.struct((-F.log(u) / float(weight)).alias("score"), F.lit(shard).alias("shard")))
    return scores[0]["shard"] if len(scores) == 1 else F.least(*scores)["shard"]


def assign_shards(
    docs: DataFrame,
    weights: Sequence[float] = (1.0,) * SHARDS,
    grown_weight: float = 1.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    blocks: int = BLOCKS,
) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row.

    ``size`` is the UTF-8 length of the text plus 1 (NULL: none), ``grown_shard`` the
    shard if one more of ``grown_weight`` is added.  ``slot`` numbers a shard's rows from
    0 without gaps: rows are numbered inside ``blocks`` hashed parts of each shard and the
    parts' sizes are added up (at most shards*blocks numbers, so they may be broadcast).
    Rows that repeat an id get the same shard and slots of their own; an empty table
    gives no rows; further columns are ignored.
    """
    if not weights:
        raise ValueError("no shards")
    key, text = F.col(id_col), text_of(F.col(text_col))

    # The hash covers the text as well, so the rows of one repeated or NULL id spread over blocks.
    block = F.pmod(F.xxhash64(key, text, F.lit("block")), F.lit(blocks)).cast("int")
    sizes = docs.select(rendezvous(key, weights).alias("shard"), block.alias("block")).groupBy("shard", "block").agg(
        F.count("*").alias("n")
    )
    earlier = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    rows = docs.select(
        key.alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(key, weights).alias("shard"),
        rendezvous(key, [*weights, grown_weight]).alias("grown_shard"),
        block.alias("block"),
    )
    inside = Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("rank", F.row_number().over(inside))
        .join(F.broadcast(starts), ["shard", "block"])
        .select(
            "doc_id", "size", "text_crc32", "law", "shard",
            (F.col("start") + F.col("rank") - 1).cast("long").alias("slot"), "grown_shard",
        )
    )
