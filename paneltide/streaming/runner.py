"""Starting streams and reading their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from paneltide.session import fresh_path


def stream_table(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """A stream over a Parquet table kept as one file or as a folder of files.

    The last character goes into a pattern: a path that is a pattern may name either.
    """
    path = path.rstrip("/")
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def append_to(stream: DataFrame, path: str, checkpoint: str, partition_by: list[str] | None = None) -> None:
    """Run an append stream over all available data into Parquet files."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.option("path", path).trigger(availableNow=True).start().awaitTermination()


def update_log(stream: DataFrame, path: str, checkpoint: str, before_write: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Run an update stream; each micro-batch's changed rows become one log folder.

    A batch that is replayed after a failure overwrites its own folder, so the log holds
    every batch exactly once.  Readers keep the newest batch per key (merge on read).
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = before_write(batch) if before_write else batch
        rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    (
        stream.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def keep_state_on_disk(spark: SparkSession) -> None:
    """Hold stream state in RocksDB instead of executor memory, unless the user chose.

    State then grows with the number of keys on local disk, and only its changes are
    uploaded to the checkpoint folder.
    """
    chosen = {
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    }
    if "RocksDB" in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        return
    for name, value in chosen.items():
        spark.conf.set(name, value)


def scratch(spark: SparkSession, label: str) -> tuple[str, str]:
    """Fresh result and checkpoint paths below the shared folder."""
    root = fresh_path(spark, label)
    return f"{root}/data", f"{root}/checkpoint"
