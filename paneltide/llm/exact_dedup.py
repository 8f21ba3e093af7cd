"""Exact duplicates with heavy hitters removed before the shuffle (operator 7).

1. Every row becomes (id, SHA-256 of the whole text); this narrow table is written once.
2. A Misra-Gries sketch runs in every task and the sketches are added up: each digest
   that holds at least ``share`` of all rows is among the candidates, of which there are
   at most ``2 / share`` whatever the input.
3. Candidates are counted exactly and their winners chosen (map-side combined), then
   broadcast: rows of frequent digests get their answer where they are.
4. All other digests hold less than ``share`` of the rows each and are shuffled as usual.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from paneltide.llm.common import cut_lineage, free_name, text_of

#: A digest with at least this part of all rows counts as frequent.
SHARE = 0.001


def _misra_gries(counters: int):
    """Per task: at most ``counters`` digests; an absent one occurs at most rows/(counters+1) times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for batch in batches:
            for counted in batch.column(0).value_counts():
                digest, n = counted["values"].as_py(), counted["counts"].as_py()
                held[digest] = held.get(digest, 0) + n
            if len(held) > counters:
                # Lowering all by the (counters+1)-th largest count keeps the bound of the
                # one-by-one sketch: every unit taken off is taken off that many digests.
                cut = sorted(held.values(), reverse=True)[counters]
                held = {k: v - cut for k, v in held.items() if v > cut}
        if held:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["digest", "n"]
            )

    return run


def frequent(digests: DataFrame, column: str = "digest", share: float = SHARE) -> DataFrame:
    """At most ``2 / share`` digests, among them all that hold ``share`` of the rows or more."""
    counters = int(2 / share)
    sketches = digests.select(F.col(column).alias("digest")).mapInArrow(_misra_gries(counters), "digest binary, n long")
    added = sketches.groupBy("digest").agg(F.sum("n").alias("n"))
    total = digests.count()
    # A digest with share*total rows loses at most total/(counters+1) of them in the sketches.
    return added.where(F.col("n") >= F.lit(total * share - total / (counters + 1))).select("digest")


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text_of(F.col(text_col)), 256)).alias("digest")
    )


def winners(digests: DataFrame, share: float = SHARE) -> DataFrame:
    """Exact size and largest id of every frequent digest; at most ``2 / share`` rows."""
    candidates = F.broadcast(frequent(digests, share=share))
    return (
        digests.join(candidates, "digest", "left_semi")
        .groupBy("digest")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """Every row with its group: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical; NULL counts as empty.  The largest id of a
    group stays, NULL ids come last (a group of NULL ids has ``keep_id`` NULL and keeps
    all its rows, which cannot be told apart); rows that repeat both id and text are one
    document and get the same answer.  An empty table gives no rows; further columns,
    whatever their names, are ignored.
    """
    digests = cut_lineage(_digests(docs, id_col, text_col))
    heavy = F.broadcast(cut_lineage(winners(digests, share)))
    marked = digests.join(heavy, "digest", "left")
    known = marked.where(F.col("group_size").isNotNull())
    group = Window.partitionBy("digest")
    rest = (
        marked.where(F.col("group_size").isNull())
        .select("digest", "doc_id")
        .withColumns({"keep_id": F.max("doc_id").over(group), "group_size": F.count("*").over(group)})
    )
    return known.unionByName(rest).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """The documents without copies: of equal texts one row, that with the largest id.

    Rows of frequent digests that lose are dropped before the shuffle; what is left of
    every digest is then reduced to its first row, most of it on the map side too.
    """
    digest, keep, rank = (free_name(docs, n) for n in ("digest_", "keep_id_", "rank_"))
    narrow = cut_lineage(_digests(docs, id_col, text_col))
    heavy = cut_lineage(winners(narrow, share)).select(
        F.col("digest").alias(digest), F.col("keep_id").alias(keep), F.lit(True).alias(rank)
    )
    marked = docs.withColumn(digest, F.unhex(F.sha2(text_of(F.col(text_col)), 256))).join(F.broadcast(heavy), digest, "left")
    left = marked.where(F.col(rank).isNull() | F.col(id_col).eqNullSafe(F.col(keep))).drop(rank, keep)
    order = Window.partitionBy(digest).orderBy(F.col(id_col).desc_nulls_last())
    return left.withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).select(*docs.columns)
