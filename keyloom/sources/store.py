"""Stores as Parquet folders: mount, write range-partitioned and sorted by key, clear, compact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.keys import KeySpec
from ..operators.statistics import sizes


def mount(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Read a store and register it as a view."""
    store = spark.read.parquet(path)
    store.createOrReplaceTempView(name)
    return store


def write(store: DataFrame, path: str, key: KeySpec, mode: str = "errorifexists") -> None:
    """Range-partitioned and sorted by key, so that row-group statistics prune range reads."""
    store.repartitionByRange(*key.order()).sortWithinPartitions(*key.order()).write.mode(mode).option("compression", "zstd").parquet(path)


def clear(spark: SparkSession, path: str) -> None:
    """Leave the store empty, with its schema."""
    spark.createDataFrame([], spark.read.parquet(path).schema).write.mode("overwrite").parquet(path)


def close(spark: SparkSession, path: str, name: str, key: str, value: str) -> None:
    """Write the store's statistics beside it and drop its view; `reopened` reads them."""
    sizes(spark.read.parquet(path), key, value).write.mode("overwrite").json(f"{path}.statistics")
    spark.catalog.dropTempView(name)


def reopened(spark: SparkSession, path: str) -> DataFrame:
    """The statistics that `close` wrote: entries, key_bytes, value_bytes."""
    return spark.read.schema("entries long, key_bytes long, value_bytes long").json(f"{path}.statistics")


def compact(spark: SparkSession, path: str, to: str, key: KeySpec) -> None:
    write(spark.read.parquet(path), to, key)
