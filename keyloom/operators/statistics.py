"""Key-space statistics: prefix cardinality, ranges, segments and fragmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .ranges import numbered


def cardinality(store: DataFrame, parts: list[str]) -> DataFrame:
    """(part, entries): entries whose first key part that differs from the predecessor's is this one.

    With D_p distinct prefixes of p parts this is D_(p+1) - D_p; duplicates of a whole key count nowhere."""
    held = store.select(parts).distinct()
    for n in range(len(parts) - 1, -1, -1):
        # To prefixes of n parts: how many of n + 1 parts there are (d<n>), and sums of what longer ones counted.
        sums = [F.count("*").alias(f"d{n}"), *(F.sum(f"d{m}").alias(f"d{m}") for m in range(n + 1, len(parts)))]
        held = (held.groupBy(*parts[:n]) if n else held).agg(*sums)
    of = lambda p: F.coalesce(F.col(f"d{p}"), F.lit(0))
    rows = F.explode(F.array(*(F.struct(F.lit(p).alias("part"), (of(p) - (of(p - 1) if p else 0)).alias("entries")) for p in range(len(parts)))))
    return held.select(rows.alias("r")).select("r.*")


def segments(store: DataFrame, key: str, size: int) -> DataFrame:
    """The zone map of a store whose keys are dense integers: (seg, first_key, last_key, n), a combinable aggregate."""
    return store.groupBy(F.floor(F.col(key) / size).alias("seg")).agg(F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.count("*").alias("n"))


def range_estimate(zones: DataFrame, low, high) -> DataFrame:
    """Entries of all segments that overlap low .. high."""
    return zones.filter((F.col("last_key") >= low) & (F.col("first_key") <= high)).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("estimate"))


def top_per_group(df: DataFrame, group: str, order: list, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= k)


def split_segments(store: DataFrame, key: str, most: int = 1500) -> DataFrame:
    """The segments of a store in key order, split at `most` keys each: (seg, first_key, last_key, n)."""
    placed = numbered(store.select(key), key).withColumn("seg", F.floor((F.col("pos") - 1) / most))
    return placed.groupBy("seg").agg(F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.count("*").alias("n"))


def merged_segments(zones: DataFrame, most: int = 1500) -> DataFrame:
    """Neighbouring small segments as one: those that begin within the same `most` entries, in key order.

    zones has a row a segment (first_key, last_key, n); what lies before each is summed up over these."""
    before = F.sum("n").over(W.orderBy("first_key").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")
    placed = zones.withColumn("seg", F.floor(before / most))
    return placed.groupBy("seg").agg(F.min("first_key").alias("first_key"), F.max("last_key").alias("last_key"), F.sum("n").alias("n"), F.count("*").alias("merged"))


def live_segments(last: DataFrame, segment, deleted: str) -> DataFrame:
    """One row (total, active, purged): segments with a live row, and without any; last has each key's last entry."""
    live = last.groupBy(segment.alias("seg")).agg(F.count_if(~F.col(deleted)).alias("live"))
    return live.agg(F.count("*").alias("total"), F.count_if(F.col("live") > 0).alias("active"), F.count_if(F.col("live") == 0).alias("purged"))


def range_refined(store: DataFrame, key: str, size: int, low: int, high: int) -> DataFrame:
    """Entries (n) of low .. high: segments that lie within count as a whole, the keys of the first and last one are looked at."""
    seg = F.floor(F.col(key) / size)
    inner = store.filter((seg > low // size) & (seg < high // size))
    ends = store.filter(F.col(key).between(low, high) & ((seg == low // size) | (seg == high // size)))
    whole = segments(inner, key, size).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return whole.union(ends.agg(F.count("*").alias("n"))).agg(F.sum("n").alias("n"))


def sizes(store: DataFrame, key: str, value: str) -> DataFrame:
    """One row (entries, key_bytes, value_bytes): what a store writes down about itself when it is closed."""
    size = lambda c: F.coalesce(F.sum(F.octet_length(F.col(c).cast("string"))), F.lit(0)).cast("long")
    return store.agg(F.count("*").alias("entries"), size(key).alias("key_bytes"), size(value).alias("value_bytes"))
