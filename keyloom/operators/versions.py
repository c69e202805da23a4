"""Versioned rows: validity intervals, reads under isolation levels, replay, checkpoints, clean-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .neighbour import neighbour
from .ranges import numbered

OPEN = 2**63 - 1


def latest(log: DataFrame, key: str, seq: str) -> DataFrame:
    """The last entry of each key: one combinable aggregate, so a hot key is no hot task."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(key, *(F.col("r")[c].alias(c) for c in rest))


def intervals(log: DataFrame, key: str, commit: str, seq: str, deleted: str) -> DataFrame:
    """log's puts with lo and hi: the viewpoints lo <= v <= hi see them. Deletions only close an interval."""
    after = F.lead(commit).over(W.partitionBy(key).orderBy(commit, seq))
    out = log.withColumn("lo", F.col(commit)).withColumn("hi", F.coalesce(after - 1, F.lit(OPEN)))
    return out.filter(~F.col(deleted))


def as_of(versions: DataFrame, viewpoint: int) -> DataFrame:
    return versions.filter((F.col("lo") <= viewpoint) & (F.col("hi") >= viewpoint))


def visible(log: DataFrame, key: str, seq: str, deleted: str, committed: str, isolation: str, viewpoint=None, commit: str | None = None, tx: str | None = None, own=None) -> DataFrame:
    """The rows that a transaction sees: COMMITTED and SERIALIZABLE the last committed, REPEATABLE those as of its
    viewpoint, UNCOMMITTED the last of any; its own writes always (tx = own). Deleted rows are dropped after ranking."""
    if isolation == "UNCOMMITTED":
        seen = log
    else:
        ok = F.col(committed) if isolation != "REPEATABLE" else F.col(committed) & (F.col(commit) <= viewpoint)
        seen = log.filter(ok if own is None else ok | (F.col(tx) == own))
    return latest(seen, key, seq).filter(~F.col(deleted))


def vacuum(versions: DataFrame, oldest_view: int) -> DataFrame:
    """Versions that the oldest active viewpoint or a later one can still see."""
    return versions.filter((F.col("hi") >= oldest_view) & (F.col("lo") <= F.col("hi")))


def newest_valid(checkpoints: DataFrame, index: str, viewpoint: str, valid: str) -> DataFrame:
    """Of each index the newest checkpoint that is valid (not aborted): (index, viewpoint)."""
    return checkpoints.filter(F.col(valid)).groupBy(index).agg(F.max(viewpoint).alias(viewpoint))


def begin_views(spans: DataFrame, tx: str, begin: str, end: str) -> DataFrame:
    """(tx, view_vp) of transactions (tx, begin, end): the viewpoint of each is the number of commits before it began."""
    commits = numbered(spans.select(F.col(end).alias("at")), "at").select("at", "pos")
    commits = commits.groupBy("at").agg(F.max("pos").alias("pos"))
    asked = spans.select(tx, F.col(begin).alias("__at"))
    return neighbour(asked, commits, "__at", "at", "previous", ("pos",)).select(tx, F.coalesce("pos", F.lit(0).cast("bigint")).alias("view_vp"))


def serializable(log: DataFrame, key: str, seq: str, deleted: str, committed: str, viewpoint: int, commit: str) -> DataFrame:
    """What a transaction of the viewpoint reads as the last committed row of each key, with valid: whether no
    later commit has changed the row since, so that the transaction may commit."""
    seen = latest(log.filter(committed), key, seq).filter(~F.col(deleted))
    return seen.withColumn("valid", F.col(commit) <= viewpoint)


def write_conflicts(writes: DataFrame, key: str, tx: str, begin: str, end: str, span: int = 64) -> DataFrame:
    """Pairs of transactions that wrote one key while both were open.

    Each is posted under the key and the spans of time that it was open in; a pair counts in the span in which the
    later one began, so a key written very often makes pairs of neighbours in time only."""
    open_ = writes.select(key, tx, F.col(begin).alias("b"), F.col(end).alias("e")).distinct()
    spans = F.explode(F.sequence(F.floor(F.col("b") / span), F.floor(F.col("e") / span))).alias("__span")
    posted = open_.select(key, tx, "b", "e", spans)
    a, b = (posted.select(key, "__span", F.col(tx).alias(f"tx_{p}"), F.col("b").alias(f"__b{p}"), F.col("e").alias(f"__e{p}")) for p in "ab")
    meet = (F.col("tx_a") < F.col("tx_b")) & (F.col("__ba") <= F.col("__eb")) & (F.col("__bb") <= F.col("__ea"))
    once = F.col("__span") == F.floor(F.greatest("__ba", "__bb") / span)
    return a.join(b, [key, "__span"]).filter(meet & once).select(key, "tx_a", "tx_b")
