"""Key specifications: ordering and range filters for plain, composite and length-first byte keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits of a key: parts, and bytes of all parts.
MAX_PARTS, MAX_BYTES = 32, 767


@dataclass(frozen=True)
class KeySpec:
    """Key columns in order of significance; bytes_first orders byte keys by length, then by bytes."""

    parts: tuple[str, ...]
    length_first: bool = False

    def __post_init__(self) -> None:
        if not 1 <= len(self.parts) <= MAX_PARTS:
            raise ValueError(f"a key has 1 to {MAX_PARTS} parts")

    def order(self, descending: bool = False) -> list[Column]:
        columns = [c for p in self.parts for c in ([F.octet_length(p), F.col(p)] if self.length_first else [F.col(p)])]
        return [c.desc() for c in columns] if descending else columns


def walk(store: DataFrame, key: KeySpec, descending: bool = False) -> DataFrame:
    """All rows in key order: a range-partitioned sort."""
    return store.orderBy(*key.order(descending))


def between(store: DataFrame, key: str, low=None, high=None) -> DataFrame:
    """Rows with low <= key <= high; either bound may be open. Reaches the Parquet scan as a pushed filter."""
    out = store if low is None else store.filter(F.col(key) >= F.lit(low))
    return out if high is None else out.filter(F.col(key) <= F.lit(high))


def conditional(store: DataFrame, key: str, accept: Column, stop: Column | None = None, start=None) -> DataFrame:
    """Rows from start on that accept holds for, up to the first key in order that stop holds for (exclusive)."""
    out = between(store, key, start)
    if stop is not None:
        bound = out.filter(stop).agg(F.min(key).alias("__stop"))
        out = out.crossJoin(F.broadcast(bound)).filter(F.col("__stop").isNull() | (F.col(key) < F.col("__stop"))).drop("__stop")  # one row
    return out.filter(accept)


def start_key(store: DataFrame, key: str, option: str, probe=None) -> DataFrame:
    """One row (start): the key at which a cursor begins by a read option; null where there is none."""
    k = F.col(key)
    fits = {"exact": k == F.lit(probe), "next": k > F.lit(probe), "exact_or_next": k >= F.lit(probe), "previous": k < F.lit(probe), "exact_or_previous": k <= F.lit(probe)}
    if option in ("first", "last"):
        return store.agg((F.min(key) if option == "first" else F.max(key)).alias("start"))
    found = store.filter(fits[option])
    return found.agg((F.max(key) if "previous" in option else F.min(key)).alias("start"))


def cursor(store: DataFrame, key: str, option: str, probe=None, descending: bool = False) -> DataFrame:
    """The rows that a cursor placed by a read option passes, in either direction; none where its start isn't found."""
    start = start_key(store, key, option, probe)
    beyond = F.col(key) <= F.col("start") if descending else F.col(key) >= F.col("start")
    return store.join(F.broadcast(start), beyond).drop("start")  # one row
