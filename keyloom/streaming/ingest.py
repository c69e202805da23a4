"""Change-log ingest with Structured Streaming: each micro-batch is merged into versions by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.versions import latest


def append_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").parquet(path)


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, key: str, seq: str, files_per_batch: int = 1000):
    """Stream the Parquet change log at source into target (one folder a batch, the last entry of each key in it).

    A batch that is run again overwrites its own folder, so a lost driver repeats none; `current` folds the batches."""
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def merge(batch: DataFrame, number: int) -> None:
        latest(batch, key, seq).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str, key: str, seq: str) -> DataFrame:
    return latest(spark.read.parquet(target).drop("batch"), key, seq)
