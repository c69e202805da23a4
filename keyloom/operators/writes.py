"""Outcomes of batches of writes, transactions, savepoints and reserved key ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SUCCESS, NOT_FOUND, DUPLICATE = 0, 2, 3


#: Operations that `outcomes` knows.
OPS = ("STANDARD", "EXISTING", "OVERRIDE", "RESERVED", "UNIQUE", "REMOVE")
#: Sequence numbers of a block, within which a key's history is walked by one task.
BLOCK = 1 << 20


def carried(rows: DataFrame, keys: list[str], seq: str, value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """rows with name: the last value that isn't null before each row, by seq within keys.

    A key's history is cut into blocks of sequence numbers: the last value of each is a combinable
    aggregate, which the next blocks start from, so the history of a hot key is no single task."""
    held = rows.withColumn("__v", value).withColumn("__block", F.floor(F.col(seq) / block))
    last = held.filter("__v is not null").groupBy(*keys, "__block").agg(F.max_by("__v", seq).alias("__last"))
    blocks = held.select(*keys, "__block").distinct().join(last, [*keys, "__block"], "left")
    before = F.last("__last", ignorenulls=True).over(W.partitionBy(*keys).orderBy("__block").rowsBetween(W.unboundedPreceding, -1))
    starts = blocks.select(*keys, "__block", before.alias("__start"))
    inner = F.last("__v", ignorenulls=True).over(W.partitionBy(*keys, "__block").orderBy(seq).rowsBetween(W.unboundedPreceding, -1))
    out = held.withColumn(name, inner).join(starts, [*keys, "__block"])
    return out.withColumn(name, F.coalesce(name, "__start")).drop("__v", "__block", "__start").select(*rows.columns, name)


def outcomes(ops: DataFrame, key: str, seq: str, op: str, tx: str | None = None, block: int = BLOCK) -> DataFrame:
    """ops with ex (a live row exists before it), ok and error_code.

    op: STANDARD and OVERRIDE always succeed, EXISTING needs a live row, UNIQUE none, REMOVE one; RESERVED
    needs that its transaction (tx) holds no live row of the key. Any other operation is an error.
    Whether a key is live after an operation depends on the last one that can change it. Keys aren't null."""
    code = F.when(F.col(op).isin(*OPS), F.col(op)).otherwise(F.raise_error(F.concat(F.lit("unknown operation "), F.coalesce(F.col(op), F.lit("null")))))
    ops = ops.withColumn(op, code)
    makes = F.when(F.col(op).isin("STANDARD", "OVERRIDE", "UNIQUE", "RESERVED"), True).when(F.col(op) == "REMOVE", False)
    out = carried(ops, [key], seq, makes, "ex", block).withColumn("ex", F.coalesce("ex", F.lit(False)))
    ok = F.when(F.col(op).isin("EXISTING", "REMOVE"), F.col("ex")).when(F.col(op) == "UNIQUE", ~F.col("ex")).otherwise(True)
    out = out.withColumn("ok", ok)
    if tx:
        own = F.when(F.col("ok"), F.col(op) != "REMOVE")
        out = carried(out, [key, tx], seq, own, "__own", block)
        out = out.withColumn("ok", F.when(F.col(op) == "RESERVED", ~F.coalesce("__own", F.lit(False))).otherwise(F.col("ok"))).drop("__own")
    else:
        out = out.withColumn("ok", F.when(F.col(op) == "RESERVED", F.raise_error(F.lit("RESERVED needs tx"))).otherwise(F.col("ok")))
    return out.withColumn("error_code", F.when(F.col("ok"), SUCCESS).when(F.col(op).isin("UNIQUE", "RESERVED"), DUPLICATE).otherwise(NOT_FOUND))


def removed_values(ops: DataFrame, key: str, seq: str, op: str, value: str, option: str = "RETURN") -> DataFrame:
    """The removals that succeed: with RETURN the value they remove (removed), with IGNORE without one, with
    POPULATED the one that the caller gave (the removal's own value), so that none is looked up."""
    out = outcomes(ops, key, seq, op)
    if option != "RETURN":
        out = out.filter((F.col(op) == "REMOVE") & F.col("ok"))
        return out.withColumn("removed", F.col(value)) if option == "POPULATED" else out
    wrote = F.when(F.col("ok") & (F.col(op) != "REMOVE"), F.col(value))
    return carried(out, [key], seq, wrote, "removed").filter((F.col(op) == "REMOVE") & F.col("ok"))


def transaction_stats(ops: DataFrame, tx: str, op: str) -> DataFrame:
    """Creates, updates and deletes of each transaction; ops as `outcomes` returns them."""
    put = (F.col(op) != "REMOVE") & F.col("ok")
    return ops.groupBy(tx).agg(F.count_if(put & ~F.col("ex")).alias("creates"), F.count_if(put & F.col("ex")).alias("updates"), F.count_if((F.col(op) == "REMOVE") & F.col("ok")).alias("deletes"))


def survivors(ops: DataFrame, path: str, rolled_back: Column) -> DataFrame:
    """Operations none of whose enclosing scopes (path: array of scope ids) was rolled back."""
    return ops.filter(~F.arrays_overlap(F.col(path), rolled_back))


def reserve(requests: DataFrame, group: str, seq: str, offset: str, block: str, most: int | None = None, segment: int = 1500) -> DataFrame:
    """requests with first and last reserved key: each takes the block after the highest key so far, at offset at least.

    A block below 1 means `segment` keys. Beyond the key `most` a request is cut short, or gets none (first_key
    and last_key null, ok false). A max-plus prefix scan: with S the sum of blocks, the highest key is S + max(offset - 1 - (S before))."""
    requests = requests.withColumn(block, F.when(F.col(block) < 1, segment).otherwise(F.col(block)))
    upto = W.partitionBy(group).orderBy(seq).rowsBetween(W.unboundedPreceding, 0)
    s = F.sum(block).over(upto)
    out = requests.withColumn("__s", s).withColumn("__lag", F.col(offset) - 1 - (F.col("__s") - F.col(block)))
    last = F.greatest(F.lit(-1), F.max("__lag").over(upto)) + F.col("__s")
    out = out.withColumn("last_key", last).withColumn("first_key", F.col("last_key") - F.col(block) + 1).drop("__s", "__lag")
    if most is None:
        return out
    ok = F.col("first_key") <= most
    return out.withColumn("ok", ok).withColumn("last_key", F.when(ok, F.least("last_key", F.lit(most)))).withColumn("first_key", F.when(ok, F.col("first_key")))


def byte_deltas(ops: DataFrame, key: str, seq: str, op: str, size: str, tx: str) -> DataFrame:
    """(tx, user_bytes): by how many bytes of values each transaction makes the store grow; size is that of an operation's value."""
    out = outcomes(ops, key, seq, op)
    put = F.col("ok") & (F.col(op) != "REMOVE")
    out = carried(out, [key], seq, F.when(put, F.col(size)), "__old").withColumn("__old", F.coalesce("__old", F.lit(0)))
    delta = F.when(~F.col("ok"), 0).when(F.col(op) == "REMOVE", -F.col("__old")).otherwise(F.col(size) - F.when(F.col("ex"), F.col("__old")).otherwise(0))
    return out.groupBy(tx).agg(F.sum(delta).cast("long").alias("user_bytes"))
