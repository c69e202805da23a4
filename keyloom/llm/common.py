"""Shared helpers: table reading, membership filters; lineage cuts of `keyloom.sources.shared`."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import cut, scratch, shared_dir

__all__ = ["Words", "bitmap", "cut", "free", "in_bitmap", "lower_ascii", "may_hold", "read_table", "row_key", "scratch", "shared_dir", "small_batches", "without"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bits of a bitmap for each value in it, and the least and most bits that one has (as powers of two; the most is 16 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 32, 16, 27
#: Bytes of rows after which an Arrow batch goes to a Python worker, and Spark's setting for it.
BATCH_BYTES, _BATCH = 2 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is executed inside hands rows to Python workers in Arrow batches of about BATCH_BYTES.

    By default a batch is 10,000 rows, whatever their length, and executor and worker each hold some copies of it. A
    session that sets its own bound keeps it."""
    own = spark.conf.get(_BATCH, None) is not None
    if not own:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        if not own:
            spark.conf.unset(_BATCH)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def bitmap(df: DataFrame, column: str, bits: int | None = None) -> np.ndarray:
    """A bitmap of 2**bits bits with bit (value mod 2**bits) set for each value of a long column.

    Without bits, their number follows the number of rows up to MOST_BITS, so its size is bounded and it
    may be shipped with a task whatever the table's size; it only saves work (no value of df is
    ever missed), an equality join still decides.
    """
    if bits is None:
        bits = min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * df.count()).bit_length()))
    at = F.pmod(F.col(column), F.lit(1 << bits))
    word = F.shiftright(at, 5).cast("int")
    mark = F.expr(f"shiftleft(1L, cast(pmod(`{column}`, 32L) as int))")
    held = df.filter(F.col(column).isNotNull()).groupBy(word.alias("w")).agg(F.bit_or(mark).alias("b")).toArrow()
    out = np.zeros(1 << (bits - 5), np.uint32)
    out[held.column("w").to_numpy()] = held.column("b").to_numpy() & 0xFFFFFFFF
    return out


def in_bitmap(marks: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values.astype(np.uint64) & np.uint64(len(marks) * 32 - 1)
    return (marks[(at >> np.uint64(5)).astype(np.int64)] >> (at & np.uint64(31)).astype(np.uint32)) & np.uint32(1) != 0


def may_hold(keys: DataFrame, column: str):
    """A function of a long column: false where its value is certainly not among keys (false for null).

    Only the tested column goes to the Python workers, never the rows' texts."""
    spark = keys.sparkSession
    marks = spark.sparkContext.broadcast(bitmap(keys, column))

    @F.arrow_udf("boolean")
    def held(value: pa.Array) -> pa.Array:
        known = value.is_valid().to_numpy(zero_copy_only=False)
        return pa.array(in_bitmap(marks.value, value.fill_null(0).to_numpy()) & known)

    return held


def free(df: DataFrame) -> str:
    """A prefix that no column of df has, for columns of our own beside them."""
    made = "__"
    while any(c.startswith(made) for c in df.columns):
        made += "_"
    return made


def row_key(*columns: str) -> Column:
    """A 64-bit hash that tells rows apart by these columns."""
    return F.xxhash64(*(c for column in columns for c in (F.col(column).isNull(), F.col(column))))


def without(rows: DataFrame, gone: DataFrame, *columns: str) -> DataFrame:
    """rows whose `row_key` of columns is not in gone (__key long).

    Most rows never move: a bitmap of the keys tells those that can't be in gone, only the others are joined."""
    key = f"{free(rows)}key"
    keyed, gone = rows.withColumn(key, row_key(*columns)), gone.select(F.col("__key").alias(key))
    held = may_hold(gone, key)
    some = keyed.filter(held(key)).join(gone.hint("merge"), key, "left_anti")
    return keyed.filter(~held(key)).unionByName(some).drop(key)


class Words(dict):
    """Word (bytes) to 64-bit hash, remembered up to a bound."""

    BOUND = 100_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.BOUND:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def hashes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
