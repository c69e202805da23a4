import random

import duckdb
import pytest
from pyspark.sql import functions as F

from keyloom.functions import scalars
from keyloom.operators import neighbour, ranges, statistics, versions, waits, writes
from keyloom.plans import extended as queries
from keyloom.sources import store
from keyloom.streaming import ingest

DATA = "/root/testdata/sf0.001"
TABLES = ("orders", "events", "customer", "supplier", "lineitem", "documents", "conversations", "pages", "embeddings")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows(columns, found):
    return sorted(repr([round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for _, v in sorted(zip(columns, r, strict=True))]) for r in found)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA)
    want = duck.sql(queries.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("option", ["next", "previous", "exact_or_next", "exact_or_previous"])
def test_neighbour_over_many_buckets_and_gaps(spark, option):
    rng = random.Random(3)
    keys = sorted({rng.choice([rng.randint(0, 100), rng.randint(5000, 5100)]) for _ in range(90)})
    asked = [rng.randint(-5, 5200) for _ in range(150)] + keys + [40] * 300 + [9000] * 50
    pick = {"next": lambda p: min((k for k in keys if k > p), default=None), "previous": lambda p: max((k for k in keys if k < p), default=None), "exact_or_next": lambda p: min((k for k in keys if k >= p), default=None), "exact_or_previous": lambda p: max((k for k in keys if k <= p), default=None)}[option]
    stored = spark.createDataFrame([(k, f"v{k}") for k in keys] + [(None, "null")], "k long, v string")
    want = sorted((p, pick(p), pick(p) if pick(p) is None else f"v{pick(p)}") for p in asked)
    for rows in (20, 1000):
        got = neighbour.neighbour(spark.createDataFrame([(p,) for p in asked] + [(None,)], "p long"), stored, "p", "k", option, ("v",), rows).collect()
        assert (None, None, None) in [tuple(r) for r in got]
        assert sorted((tuple(r) for r in got if r.p is not None), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("descending", [False, True])
def test_numbers_don_t_depend_on_the_plan(spark, descending):
    rng = random.Random(5)
    keys = rng.sample(range(100_000), 5000)
    want = {k: i for i, k in enumerate(sorted(keys, reverse=descending), 1)}
    coalesced = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        for parts in (1, 8, 200):
            for on in ("true", "false"):
                spark.conf.set("spark.sql.shuffle.partitions", str(parts))
                spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", on)
                got = ranges.numbered(spark.createDataFrame([(k,) for k in keys], "k long"), "k", descending, rows=300).collect()
                assert {r.k: r.pos for r in got} == want and len(got) == len(keys)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)


@pytest.mark.parametrize("block", [7, 1 << 20])
def test_outcomes_equal_a_sequential_fold(spark, block):
    rng = random.Random(4)
    names = ["STANDARD", "EXISTING", "OVERRIDE", "UNIQUE", "RESERVED", "REMOVE"]
    log = [(rng.choice([0, 0, 0, rng.randint(1, 9)]), i, i // 20, rng.choice(names)) for i in range(400)]
    live, own, want = set(), set(), {}
    for k, i, tx, op in log:
        ok = {"EXISTING": k in live, "REMOVE": k in live, "UNIQUE": k not in live, "RESERVED": (k, tx) not in own}.get(op, True)
        want[i] = (ok, 0 if ok else 3 if op in ("UNIQUE", "RESERVED") else 2)
        if ok and op == "REMOVE":
            live.discard(k), own.discard((k, tx))
        elif ok:
            live.add(k), own.add((k, tx))
    got = writes.outcomes(spark.createDataFrame(log, "k long, i long, t long, op string"), "k", "i", "op", "t", block).collect()
    assert {r.i: (r.ok, r.error_code) for r in got} == want


def test_unknown_operations_are_errors(spark):
    for op, tx in (("PUT", None), (None, None), ("RESERVED", None)):
        with pytest.raises(Exception, match="operation|RESERVED"):
            writes.outcomes(spark.createDataFrame([(1, 1, op)], "k long, i long, op string"), "k", "i", "op", tx).collect()


def test_write_conflicts_of_a_hot_key(spark):
    rng = random.Random(6)
    rows = [(0, tx, b := rng.randint(0, 5000), b + rng.randint(0, 150)) for tx in range(150)]
    got = {(r.tx_a, r.tx_b) for r in versions.write_conflicts(spark.createDataFrame(rows, "k long, tx long, b long, e long"), "k", "tx", "b", "e").collect()}
    assert got == {(x[1], y[1]) for x in rows for y in rows if x[1] < y[1] and x[2] <= y[3] and y[2] <= x[3]}


def test_checksum_of_the_known_text(spark):
    row = spark.createDataFrame([("123456789",), ("",)], "s string").select(scalars.crc32_msb(F.col("s").cast("binary")).alias("c")).collect()
    assert [r.c for r in row] == [0xFC891918, 0]


def test_isolation_matrix(spark):
    log = spark.createDataFrame([(1, 1, 1, 1, False, True), (1, 2, 2, 2, True, False)], "k long, seq long, vp long, tx long, deleted boolean, committed boolean")
    sees = lambda log, level, **x: versions.visible(log, "k", "seq", "deleted", "committed", level, commit="vp", tx="tx", **x).count() == 1
    assert not sees(log, "UNCOMMITTED")
    assert sees(log, "COMMITTED") and not sees(log, "COMMITTED", own=2)
    done = log.withColumn("committed", F.lit(True))
    assert not sees(done, "COMMITTED")
    assert sees(done, "REPEATABLE", viewpoint=1) and not sees(done, "REPEATABLE", viewpoint=2)


def test_cycles_equal_a_search_from_each_node(spark):
    rng = random.Random(7)
    rings = [(r * 100 + i, r * 100 + (i + 1) % n) for r, n in enumerate((1, 2, 3, 16, 31, 32, 33, 63, 64, 65, 80)) for i in range(n)]
    chain = [(5000 + i, 5001 + i) for i in range(90)] + [(5090, 1064), (700, 5200)]
    edges = rings + chain + [(9000 + rng.randrange(60), 9000 + rng.randrange(60)) for _ in range(90)] + [(None, 3), (3, None)]
    for hops in (1, 8, 64):
        want = {}
        for start in {a for a, _ in edges if a is not None}:
            reached = {start}
            for n in range(1, hops + 1):
                reached = {b for a, b in edges if a is not None and a in reached and b is not None}
                if start in reached:
                    want[start] = n
                    break
        got = waits.cycles(spark.createDataFrame(edges + edges[:50], "a long, b long"), hops).collect()
        assert {r.waiter: r.hops for r in got} == want and len(got) == len(want)


def test_deadlocks_among_very_many_waiters(spark, tmp_path):
    # Of 20,000 waiters, ways of 64 hops are over a million, where Spark stops a recursion.
    spark.range(20_000).select(F.col("id").alias("o_custkey")).write.parquet(f"{tmp_path}/orders.parquet")
    want = {}
    for s in range(1000):
        x, n = (s * 7 + 3) % 1000, 1
        while x != s and n < 64:
            x, n = (x * 7 + 3) % 1000, n + 1
        want |= {s: n} if x == s else {}
    assert {r.waiter: r.hops for r in queries.QUERIES["deadlock_cycles"](spark, str(tmp_path)).collect()} == want


def test_exact_counts_carry_no_sketches(spark):
    # Exact and approximate counts in one aggregate expand the rows and keep a sketch for each distinct key.
    assert "Expand" not in queries.QUERIES["cardinality_within_error"](spark, DATA)._jdf.queryExecution().toString()


def test_cardinality_of_composite_keys(spark):
    keys = spark.range(42).select((F.col("id") % 7).alias("a"), (F.col("id") % 3).alias("b"), F.col("id").alias("c"))
    assert {r.part: r.entries for r in statistics.cardinality(keys, ["a", "b", "c"]).collect()} == {0: 7, 1: 14, 2: 21}


def test_strings(spark):
    row = spark.createDataFrame([("abcabc",), ("",)], "s string").select(
        scalars.last_index_of(F.col("s"), "bc").alias("l"), scalars.replace_last(F.col("s"), "bc", "-").alias("r"), scalars.replace_first(F.col("s"), "bc", "-").alias("f"), scalars.bytes_hash(F.col("s")).alias("h")
    ).collect()
    assert tuple(row[0])[:3] == (4, "abca-", "a-abc") and tuple(row[1]) == (-1, "", "", 0)


def test_store_and_stream(spark, tmp_path):
    from keyloom.operators.keys import KeySpec

    log = spark.range(100).select((F.col("id") % 10).alias("k"), F.col("id").alias("seq"))
    ingest.append_log(log, f"{tmp_path}/log")
    ingest.append_log(log.withColumn("seq", F.col("seq") + 100), f"{tmp_path}/log")
    ingest.ingest(spark, f"{tmp_path}/log", f"{tmp_path}/to", f"{tmp_path}/cp", "k", "seq", 3).awaitTermination()
    assert {r.k: r.seq for r in ingest.current(spark, f"{tmp_path}/to", "k", "seq").collect()} == {k: 190 + k for k in range(10)}
    store.write(log, f"{tmp_path}/s", KeySpec(("k", "seq")))
    assert store.mount(spark, f"{tmp_path}/s", "s").count() == 100
    store.compact(spark, f"{tmp_path}/s", f"{tmp_path}/compact", KeySpec(("seq",)))
    assert [r.seq for r in spark.read.parquet(f"{tmp_path}/compact").collect()] == list(range(100))
    store.close(spark, f"{tmp_path}/s", "s", "seq", "k")
    assert tuple(store.reopened(spark, f"{tmp_path}/s").first()) == (100, 190, 100) and not spark.catalog.tableExists("s")
    store.clear(spark, f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s").count() == 0
