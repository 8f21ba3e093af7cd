"""Change messages from files: a batch reader and its streaming twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from paneltide.functions import changes

MESSAGE = "data string"


def parse_changes(messages: DataFrame, data: str = "data") -> DataFrame:
    """Message text as columns; incomplete messages carry an error."""
    c = F.col(data)
    return messages.select(
        *[x for x in messages.columns if x != data],
        changes.graph_id(c).alias("graph_id"),
        changes.document_id(c).alias("id"),
        changes.collection(c).alias("collection"),
        changes.operation(c).alias("operation"),
        changes.document(c).alias("document"),
        changes.is_deleted(c).alias("is_deleted"),
        changes.change_error(c).alias("error"),
    )


def read_change_feed(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Messages ``{"data": "<json>"}``, one per line."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(MESSAGE).json(path)
