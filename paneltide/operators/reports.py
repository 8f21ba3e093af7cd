"""Reports over run outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from paneltide.functions.text import strip
from paneltide.operators.ordered import rank_in_group

# Fixed value: heading of a context's log.
HEADING = "While running "


def run_report(
    outputs: DataFrame,
    by: list[str],
    context: list[str],
    seq: str,
    version: Column,
    context_text: Column | None = None,
    logs: tuple[str, ...] = ("combined_output",),
    lines_per_segment: int = 1000,
    first_order: str | None = None,
) -> DataFrame:
    """Logs per ``by`` group, each context under its heading, and whether any run failed.

    All ``logs`` go through one pass, each numbered and cut into segments by itself.
    Entries are stripped; blank ones at a context's ends vanish, inner ones stay blank
    lines.  A log longer than ``lines_per_segment`` entries continues in the next
    ``segment`` row, so no task holds the log of a whole attribute.  Concatenating the
    segments with newlines gives the full log.
    """
    kinds = F.array(*[F.struct(F.lit(log).alias("__log"), strip(F.col(log)).alias("__text")) for log in logs])
    rows = outputs.select(*by, *context, seq, F.inline(kinds))
    key = [*by, *context, "__log"]
    filled = F.when(F.col("__text") != "", F.col(seq))
    ends = rows.groupBy(*key).agg(F.min(filled).alias("__first"), F.max(filled).alias("__last"))
    named = F.concat_ws(", ", *[F.col(c).cast("string") for c in context]) if context_text is None else context_text
    heading = F.concat(F.lit(HEADING), named, F.lit(":\n"))
    entries = (
        rows.join(ends, key)
        .where(F.col(seq).between(F.col("__first"), F.col("__last")))
        .withColumn("__line", F.concat(F.when(F.col(seq) == F.col("__first"), heading).otherwise(F.lit("")), F.col("__text")))
    )
    order = [first_order or context[0], *[c for c in context if c != (first_order or context[0])], seq]
    placed = rank_in_group(entries, [*by, "__log"], order, "__at")
    segment = F.floor((F.col("__at") - 1) / lines_per_segment).cast("long")

    def joined(log: str) -> Column:
        own = F.collect_list(F.when(F.col("__log") == log, F.struct("__at", "__line")))
        return F.array_join(F.transform(F.array_sort(own), lambda e: e["__line"]), "\n").alias(log)

    text = placed.groupBy(*by, segment.alias("segment")).agg(*[joined(log) for log in logs])
    failed = outputs.groupBy(*by).agg(F.bool_or("failed").alias("failed"))
    return failed.join(text, by, "left").select(
        *by, F.coalesce("segment", F.lit(0)).alias("segment"), "failed",
        *[F.coalesce(log, F.lit("")).alias(log) for log in logs], version.alias("version"),
    )


def failed_attributes(outputs: DataFrame, doc: str = "full_name", attribute: str = "attribute_name") -> DataFrame:
    """Failing attributes of each document, sorted.

    Distinct pairs are formed map-side first; a list is as long as a document has
    attributes.
    """
    pairs = outputs.where("failed").select(doc, attribute).distinct()
    return pairs.groupBy(doc).agg(F.sort_array(F.collect_list(attribute)).alias("failed_attributes"))
