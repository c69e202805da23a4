"""Shards by a consistent-hash ring with virtual nodes and bounded loads (native)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, free

#: Positions of the ring, and parts of each position among which its rows are spread by their id.
SLOTS, PARTS = 8192, 32
VNODES = 64


def ring(spark, shards: int, vnodes: int = VNODES) -> DataFrame:
    """The virtual nodes in clockwise order: idx (from 0), at (slot of the ring), shard."""
    nodes = spark.range(shards * vnodes).select((F.col("id") % shards).cast("int").alias("shard"), (F.col("id") / shards).cast("int").alias("v"))
    place = F.xxhash64(F.lit("shard"), "shard", "v")
    nodes = nodes.select("shard", F.pmod(place, F.lit(SLOTS)).cast("int").alias("at"), place.alias("place"))
    return nodes.select("shard", "at", (F.row_number().over(W.orderBy("at", "place")) - 1).alias("idx"))


def open_from(nodes: DataFrame, full: list[int]) -> DataFrame:
    """For each node (idx): the first node from it on, clockwise, whose shard isn't full: (idx, to, shard)."""
    n = nodes.count()
    twice = nodes.select("idx", "shard").union(nodes.select(F.col("idx") + n, "shard"))
    free = F.when(~F.col("shard").isin(full), F.struct(F.col("idx").alias("i"), "shard")) if full else F.struct(F.col("idx").alias("i"), "shard")
    to = F.first(free, ignorenulls=True).over(W.orderBy("idx").rowsBetween(0, W.unboundedFollowing))
    return twice.select("idx", to.alias("t")).filter(F.col("idx") < n).select("idx", (F.col("t.i") % n).cast("int").alias("to"), F.col("t.shard").alias("shard"))


def assign(docs: DataFrame, shards: int, key: str = "text", vnodes: int = VNODES, slack: float = 0.001) -> DataFrame:
    """docs with size, shard, slot (columns of these names are replaced).

    size: UTF-8 bytes of the key column (null: none) plus 8. A row's place on the ring is the
    hash of its key value, so equal texts are neighbours; each goes to the next virtual node.
    A shard is full at (1 + slack) times the mean load; what overflows continues clockwise to
    the next virtual node of a shard with room. Hence no shard gets more than that bound and one row.

    Rows are placed by cells (SLOTS x PARTS): one combinable aggregate finds the cells' sizes; the
    rounds of overflow (one shard or more fills in each, so fewer rounds than shards) run on that
    table; the cells' shards are broadcast to the rows. A cell over slack / 2 of a mean load is
    placed by its rows of equal size, of which a shard takes as many as it has room for (a range of
    ranks); so copies of one text are split anywhere, whatever their ids. PARTS spreads their ranking.
    slot numbers a shard's rows without gap from 0: its ranges' offsets plus the rank in the range.
    What is broadcast are the ring and the ranges: some 100 bytes each for VNODES nodes a shard, and at most
    SLOTS x PARTS cells and as many units again as heavy cells have sizes, below 100 MB whatever the table's size.

    Null texts count as empty, null ids are a value; repeated rows are each placed; an empty
    table gives an empty one.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(key), F.lit(""))
    own = free(docs)
    slot, part, placed_at = f"{own}slot", f"{own}part", f"{own}rank"
    rows = docs.withColumn(slot, F.pmod(F.xxhash64(text), F.lit(SLOTS)).cast("int")).withColumn(part, F.pmod(F.xxhash64(F.lit(7), F.coalesce("doc_id", F.lit(-1))), F.lit(PARTS)).cast("int"))
    rows = rows.withColumn("size", (F.octet_length(text) + 8).cast("long")).drop("shard", "slot")
    small = rows.select(F.col(slot).alias("__slot"), F.col(part).alias("__part"), "size")
    sizes = cut(small.groupBy("__slot", "__part", "size").agg(F.count("*").alias("n")), "shard-sizes")
    total = sizes.agg(F.coalesce(F.sum(F.col("n") * F.col("size")), F.lit(0)).alias("b")).first().b
    # Units: rows of equal size in a heavy cell, a light cell as a whole. What ends a shard's filling is one of them.
    bound, heavy = total / shards * (1 + slack / 2), total / shards * slack / 2
    cell = W.partitionBy("__slot", "__part")
    below = F.coalesce(F.sum("n").over(cell.orderBy("size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("whole", F.sum(F.col("n") * F.col("size")).over(cell)).withColumn("from", below)
    whole = sizes.filter(F.col("whole") <= heavy).groupBy("__slot", "__part").agg(F.lit(0).cast("long").alias("from"), F.min("whole").alias("unit"), F.lit(1).cast("long").alias("units"), F.sum("n").alias("each"))
    split = sizes.filter(F.col("whole") > heavy).select("__slot", "__part", "from", F.col("size").alias("unit"), F.col("n").alias("units"), F.lit(1).cast("long").alias("each"))
    cells = cut(split.union(whole), "shard-cells")
    nodes = cut(ring(spark, shards, vnodes).coalesce(1), "shard-ring")
    first = nodes.groupBy("at").agg(F.min("idx").alias("idx"))
    slots = spark.range(SLOTS).select(F.col("id").cast("int").alias("__slot")).join(F.broadcast(first), F.col("__slot") == F.col("at"), "left")
    after = F.first("idx", ignorenulls=True).over(W.orderBy("__slot").rowsBetween(0, W.unboundedFollowing))
    slots = slots.select("__slot", F.coalesce(after, F.lit(0)).alias("idx"))
    waiting = cells.join(F.broadcast(slots), "__slot").withColumn("hop", F.lit(0))
    loads: dict[int, int] = {}
    full: list[int] = []
    placed = None
    for hop in range(shards + 1):
        to = open_from(nodes, full)
        had = spark.createDataFrame([(s, loads.get(s, 0)) for s in range(shards)], "shard int, had long")
        asked = waiting.join(F.broadcast(to), "idx").drop("idx").withColumnRenamed("to", "idx").join(F.broadcast(had), "shard")
        # Large units first: what ends a shard's filling is then small.
        order = W.partitionBy("shard").orderBy(F.desc("unit"), "__slot", "__part", "from").rowsBetween(W.unboundedPreceding, -1)
        before = F.coalesce(F.sum(F.col("unit") * F.col("units")).over(order), F.lit(0))
        room = F.ceil((F.lit(bound) - F.col("had") - before) / F.col("unit"))
        asked = asked.withColumn("taken", F.least("units", F.greatest(room, F.lit(0)))).drop("had").withColumn("hop", F.lit(hop))
        asked = cut(asked, "shard-round")
        won = asked.filter("taken > 0").withColumn("n", F.col("taken") * F.col("each")).withColumn("bytes", F.col("taken") * F.col("unit"))
        placed = won if placed is None else placed.unionByName(won)
        for r in won.groupBy("shard").agg(F.sum("bytes").alias("b")).collect():
            loads[r.shard] = loads.get(r.shard, 0) + r.b
        shut = [r.shard for r in asked.filter("taken < units").select("shard").distinct().collect()]
        if not shut:
            break
        full = sorted({*full, *shut})
        moved = (F.col("from") + F.col("taken") * F.col("each")).alias("from")
        waiting = asked.filter("taken < units").select("__slot", "__part", moved, "unit", (F.col("units") - F.col("taken")).alias("units"), "each", "idx", "hop")
    start = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("__slot", "__part", "from").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    begin, low, high, at, of = (own + x for x in ("begin", "from", "to", "s", "p"))
    where = placed.select("shard", F.col("__slot").alias(at), F.col("__part").alias(of), start.alias(begin), F.col("from").alias(low), (F.col("from") + F.col("n")).alias(high))
    order = [c for c in ("doc_id", "text_crc32") if c in rows.columns]
    rank = F.row_number().over(W.partitionBy(slot, part).orderBy("size", *order)) - 1
    inside = (F.col(slot) == F.col(at)) & (F.col(part) == F.col(of)) & (F.col(placed_at) >= F.col(low)) & (F.col(placed_at) < F.col(high))
    out = rows.withColumn(placed_at, rank).join(F.broadcast(where), inside).withColumn("slot", F.col(begin) + F.col(placed_at) - F.col(low))
    return out.drop(slot, part, placed_at, at, of, begin, low, high)
