"""Range buckets by explicit bounds: the same rows are in the same bucket however a plan is laid out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Rows of a bucket, and the most buckets (larger tables get larger ones).
BUCKET_ROWS, MAX_BUCKETS = 250_000, 20_000


def edges(keys: DataFrame, key: str, rows: int = BUCKET_ROWS) -> list:
    """Bounds of buckets of about `rows` rows: approximate quantiles of a numeric key, without repeats."""
    parts = max(1, min(MAX_BUCKETS, -(-keys.count() // rows)))
    return sorted(set(keys.approxQuantile(key, [i / parts for i in range(1, parts)], 0.25 / parts))) if parts > 1 else []


def bucket(key: Column, bounds: list, kind: str) -> Column:
    """The number of bounds at or below key, by bisection of a constant array."""
    if not bounds:
        return F.lit(0)
    held = F.split(F.lit(",".join(map(repr, bounds))), ",").cast("array<double>").cast(f"array<{kind}>")
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    further = lambda at, step: (at + step <= len(bounds)) & (F.get(held, at + step - 1) <= key)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(further(at, step), at + step).otherwise(at))


def numbered(store: DataFrame, key: str, descending: bool = False, rows: int = BUCKET_ROWS) -> DataFrame:
    """store with pos, its rows' places (from 1) in the order of a numeric key, without one task for all rows.

    Rows are ranked within buckets of fixed bounds; a table of one row a bucket has what lies before each.
    Equal keys are placed in any order. Null keys come last."""
    kind = store.schema[key].dataType.simpleString()
    placed = store.withColumn("__b", F.when(F.col(key).isNotNull(), bucket(F.col(key), edges(store.select(key), key, rows), kind)).otherwise(MAX_BUCKETS + 1))
    order = F.when(F.col("__b") > MAX_BUCKETS, -1).otherwise(F.col("__b")).desc() if descending else F.col("__b")
    sizes = placed.groupBy("__b").agg(F.count("*").alias("__n"))
    before = sizes.select("__b", (F.sum("__n").over(W.orderBy(order)) - F.col("__n")).alias("__before"))  # a row a bucket
    rank = F.row_number().over(W.partitionBy("__b").orderBy(F.col(key).desc() if descending else F.col(key)))
    return placed.withColumn("pos", rank).join(F.broadcast(before), "__b").withColumn("pos", F.col("pos") + F.col("__before")).drop("__b", "__before")
