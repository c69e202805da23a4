"""Batches of exact and neighbour lookups in an ordered store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import ranges

OPTIONS = ("next", "previous", "exact_or_next", "exact_or_previous")


def exact(probe: DataFrame, store: DataFrame, key: str, store_key: str) -> DataFrame:
    return probe.join(store, probe[key] == store[store_key], "left")


def neighbour(probe: DataFrame, store: DataFrame, key: str, store_key: str, option: str, carry: tuple[str, ...] = (), rows: int = ranges.BUCKET_ROWS) -> DataFrame:
    """probe with found, the store's key by option (null where there is none), and the columns in carry of that row.

    Keys are numeric. next and previous are strict; exact_or_next and exact_or_previous take an equal key too.

    The distinct probed keys and the store's keys go into one union, dealt to range buckets by approximate
    quantiles of all of them. Within a bucket a window carries the last store key to the probes; one
    that finds none there takes the nearest of the next bucket with any, from a table of one row a
    bucket. The answers are joined to the probes, so a key that very many of them ask is looked up once.
    """
    forward = option in ("next", "exact_or_next")
    strict = option in ("next", "previous")
    if option not in OPTIONS:
        raise ValueError(option)
    kind = store.schema[store_key].dataType.simpleString()
    row = F.struct(F.col(store_key).alias("found"), *carry)
    keys = store.filter(F.col(store_key).isNotNull()).select(F.col(store_key).alias("x"), F.lit(0).alias("tag"), row.alias("r"))
    asked = probe.select(F.col(key).cast(kind).alias("x")).filter("x is not null").distinct()
    bounds = ranges.edges(keys.select("x").union(asked), "x", rows)
    at = ranges.bucket(F.col("x"), bounds, kind)
    both = keys.union(asked.select("x", F.lit(1), F.lit(None).cast(keys.schema["r"].dataType))).withColumn("b", at)
    # On equal keys a strict lookup has the probe before the store's row, any other after it.
    order = [F.col("x").desc() if forward else F.col("x").asc(), F.col("tag").desc() if strict else F.col("tag").asc()]
    seen = F.last("r", ignorenulls=True).over(W.partitionBy("b").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    inner = both.withColumn("r", seen).filter("tag = 1").select("x", "b", "r")
    if bounds:
        ends = keys.withColumn("b", at).groupBy("b").agg((F.min_by("r", "x") if forward else F.max_by("r", "x")).alias("end"))
        every = store.sparkSession.range(len(bounds) + 1).select(F.col("id").cast("int").alias("b")).join(F.broadcast(ends), "b", "left")
        far = F.first("end", ignorenulls=True).over(W.orderBy(F.col("b") if forward else F.col("b").desc()).rowsBetween(1, W.unboundedFollowing))
        every = every.select("b", far.alias("far"))  # a row a bucket
        inner = inner.join(F.broadcast(every), "b", "left").withColumn("r", F.coalesce("r", "far"))
    found = inner.select(F.col("x").alias("__x"), F.col("r.found").alias("found"), *(F.col("r")[c].alias(c) for c in carry))
    return probe.join(found, F.col(key).cast(kind) == F.col("__x"), "left").drop("__x")


def next_match(index: DataFrame, secondary: str, primary: str) -> DataFrame:
    """For each entry of a non-unique index the next primary key under the same secondary key."""
    return index.withColumn("next_key", F.lead(primary).over(W.partitionBy(secondary).orderBy(primary)))


def by_secondary(probe: DataFrame, index: DataFrame, key: str, secondary: str, primary: str, option: str) -> DataFrame:
    """probe with found (the secondary key by option) and the primary key of its first entry, going backwards of its last."""
    first = F.min(primary) if option in ("next", "exact_or_next") else F.max(primary)
    entries = index.groupBy(secondary).agg(first.alias(primary))
    return neighbour(probe, entries, key, secondary, option, (primary,))
