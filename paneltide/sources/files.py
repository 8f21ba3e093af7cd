"""File sources and the JSON object sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T


def read_files(spark: SparkSession, path: str | list[str], pattern: str | None = None) -> DataFrame:
    """Files as rows: path, modificationTime, length, content (read only when used)."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path)


def read_by_type(
    spark: SparkSession, path: str | list[str], kind: str, schema: T.StructType | str | None = None, row_tag: str = "row",
    multi_line: bool = False,
) -> DataFrame:
    """Parse csv, tsv, json, text, xml or image files.

    With a ``schema`` the files are read once; without one Spark first infers it.  A large
    csv or tsv file is read by many tasks; only if quoted fields may hold line ends give
    ``multi_line``, which makes every file one task.
    """
    kind = kind.lower()
    if kind in ("csv", "tsv"):
        reader = spark.read.option("header", "true").option("sep", "," if kind == "csv" else "\t")
        reader = reader.option("multiLine", str(multi_line).lower()).option("escape", '"')
        return (reader.schema(schema) if schema else reader.option("inferSchema", "true")).csv(path)
    if kind in ("json", "jsonl"):
        reader = spark.read.option("multiLine", str(kind == "json").lower())
        return (reader.schema(schema) if schema else reader).json(path)
    if kind in ("txt", "md", "log"):
        return spark.read.text(path)
    if kind == "xml":
        reader = spark.read.option("rowTag", row_tag)
        return (reader.schema(schema) if schema else reader).xml(path)
    if kind in ("png", "jpg", "jpeg", "gif", "bmp", "image"):
        return spark.read.format("image").load(path)
    raise ValueError(f"Unsupported file type: {kind}")


def read_text_objects(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Whole text objects, one row each, from any file system Spark can reach."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def write_json_objects(df: DataFrame, path: str, user_column: str = "user_id", mode: str = "append") -> None:
    """Rows as JSON objects in one folder per user.

    Rows are rebalanced by user: small users share a task, and the adaptive planner
    splits a user with very many objects over several.
    """
    df.hint("rebalance", F.col(user_column)).write.mode(mode).partitionBy(user_column).json(path)
