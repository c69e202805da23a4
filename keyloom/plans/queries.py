"""Queries over the test tables, one for each operator, with equivalent SQL.

The primary store is orders with its keys spread threefold (so that neighbour lookups meet gaps);
probes are events; events are also the operation log (key user_id, order event_id).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalars
from ..operators import keys, neighbour, ranges, statistics, versions, waits, writes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
OPEN = versions.OPEN
_CODES = (("signup", "UNIQUE"), ("purchase", "EXISTING"), ("view", "STANDARD"), ("click", "OVERRIDE"), ("error", "REMOVE"))
_STORE = "store as (select o_orderkey * 3 as o_orderkey, o_totalprice from orders), probe as (select event_id, event_id * 2 + 1 as p from events)"
_OP = "case event_type " + " ".join(f"when '{a}' then '{b}'" for a, b in _CODES) + " end"
_OPS = f"ops as (select user_id, event_id, value, ts, {_OP} as op, event_id // 10 as tx from events)"
_MAKES = "case when op in ('STANDARD', 'OVERRIDE', 'UNIQUE') then true when op = 'REMOVE' then false end"
_OUT = f"""ex as (select *, coalesce(last_value({_MAKES} ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), false) as ex from ops),
outc as (select *, case when op in ('EXISTING', 'REMOVE') then ex when op = 'UNIQUE' then not ex else true end as ok from ex)"""
_LOG = "log as (select user_id, event_id, value, event_id // 10 as commit_vp, event_id // 10 as tx, event_type = 'error' as deleted, (event_id // 10) % 7 <> 0 as committed from events)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[..., DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: table(spark, sf_dir, name))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def store(t) -> DataFrame:
    return t("orders").select((F.col("o_orderkey") * 3).alias("o_orderkey"), "o_totalprice")


def probe(t) -> DataFrame:
    return t("events").select("event_id", (F.col("event_id") * 2 + 1).alias("p"))


def ops(t) -> DataFrame:
    op = F.create_map(*(F.lit(x) for pair in _CODES for x in pair))
    return t("events").select("user_id", "event_id", "value", "ts", op[F.col("event_type")].alias("op"), F.floor(F.col("event_id") / 10).alias("tx"))


def log(t) -> DataFrame:
    tx = F.floor(F.col("event_id") / 10)
    return t("events").select("user_id", "event_id", "value", tx.alias("commit_vp"), tx.alias("tx"), (F.col("event_type") == "error").alias("deleted"), (tx % 7 != 0).alias("committed"))


# Scans


@query("select o_orderkey, o_totalprice, row_number() over (order by o_orderkey) as pos from orders")
def walk_forward(t):
    return ranges.numbered(t("orders").select("o_orderkey", "o_totalprice"), "o_orderkey")


@query("select o_orderkey, o_totalprice, row_number() over (order by o_orderkey desc) as pos from orders")
def walk_backward(t):
    return ranges.numbered(t("orders").select("o_orderkey", "o_totalprice"), "o_orderkey", descending=True)


@query("select o_orderkey from orders")
def walk_keys(t):
    return t("orders").select("o_orderkey")


@query(f"with {_STORE} select o_orderkey, o_totalprice from store where o_orderkey >= (select min(o_orderkey) from store where o_orderkey >= 1000)")
def cursor_scan(t):
    return keys.between(store(t), "o_orderkey", 1000).select("o_orderkey", "o_totalprice")


@query("select o_orderkey from orders where o_orderstatus = 'F' and o_orderkey >= 100")
def scan_condition(t):
    return keys.conditional(t("orders"), "o_orderkey", F.col("o_orderstatus") == "F", start=100).select("o_orderkey")


@query("select o_orderkey from orders where o_orderstatus = 'F' and o_orderkey >= 100 and o_orderkey < (select min(o_orderkey) from orders where o_orderkey >= 100 and o_totalprice > 450000)")
def scan_condition_stop(t):
    return keys.conditional(t("orders"), "o_orderkey", F.col("o_orderstatus") == "F", F.col("o_totalprice") > 450000, 100).select("o_orderkey")


@query("select o_orderkey, o_custkey from orders where o_orderkey between 100 and 900")
def sub_map(t):
    return keys.between(t("orders"), "o_orderkey", 100, 900).select("o_orderkey", "o_custkey")


@query("select o_orderkey from orders where o_orderkey <= 900")
def head_map(t):
    return keys.between(t("orders"), "o_orderkey", high=900).select("o_orderkey")


@query("select o_orderkey from orders where o_orderkey >= 900")
def tail_map(t):
    return keys.between(t("orders"), "o_orderkey", 900).select("o_orderkey")


# Lookups


@query(f"with {_STORE} select event_id, p, o_orderkey as found, o_totalprice from probe left join store on p = o_orderkey")
def get_exact(t):
    return neighbour.exact(probe(t), store(t), "p", "o_orderkey").select("event_id", "p", F.col("o_orderkey").alias("found"), "o_totalprice")


def _neighbour(option: str, compare: str, pick: str) -> None:
    def run(t):
        return neighbour.neighbour(probe(t), store(t), "p", "o_orderkey", option)

    run.__name__ = f"get_{option}"
    query(f"with {_STORE} select event_id, p, o_orderkey as found from probe asof left join store on p {compare} o_orderkey")(run)


for _option, _compare, _pick in (("next", "<", "min"), ("previous", ">", "max"), ("exact_or_next", "<=", "min"), ("exact_or_previous", ">=", "max")):
    _neighbour(_option, _compare, _pick)


@query(f"with {_STORE} select event_id, p, o_orderkey as found, o_totalprice from probe asof left join store on p >= o_orderkey")
def asof_events(t):
    return neighbour.neighbour(probe(t), store(t), "p", "o_orderkey", "exact_or_previous", ("o_totalprice",))


@query("select o_custkey, o_orderkey, lead(o_orderkey) over (partition by o_custkey order by o_orderkey) as next_key from orders")
def get_next_match(t):
    return neighbour.next_match(t("orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@query(f"with {_STORE} select min(o_orderkey) as o_orderkey, arg_min(o_totalprice, o_orderkey) as o_totalprice from store")
def get_first(t):
    return store(t).agg(F.min("o_orderkey").alias("o_orderkey"), F.min_by("o_totalprice", "o_orderkey").alias("o_totalprice"))


@query(f"with {_STORE} select max(o_orderkey) as o_orderkey, arg_max(o_totalprice, o_orderkey) as o_totalprice from store")
def get_last(t):
    return store(t).agg(F.max("o_orderkey").alias("o_orderkey"), F.max_by("o_totalprice", "o_orderkey").alias("o_totalprice"))


@query(f"with {_STORE} select event_id, p from probe where p in (select o_orderkey from store)")
def contains(t):
    return probe(t).join(store(t), F.col("p") == F.col("o_orderkey"), "left_semi")


@query(f"with {_STORE} select event_id, p from probe where p not in (select o_orderkey from store)")
def contains_not(t):
    return probe(t).join(store(t), F.col("p") == F.col("o_orderkey"), "left_anti")


@query("select c_custkey from customer where c_nationkey in (select s_nationkey from supplier where s_acctbal < 0)")
def contains_value(t):
    return t("customer").join(t("supplier").filter("s_acctbal < 0"), F.col("c_nationkey") == F.col("s_nationkey"), "left_semi").select("c_custkey")


# Writes


@query(f"with {_OPS}, {_OUT} select event_id, user_id, op, ex, ok, case when ok then 0 when op = 'UNIQUE' then 3 else 2 end as error_code from outc")
def put_outcome(t):
    return writes.outcomes(ops(t), "user_id", "event_id", "op").select("event_id", "user_id", "op", "ex", "ok", "error_code")


@query(f"""with {_OPS}, {_OUT}, r as (select *, last_value(case when ok and op <> 'REMOVE' then value end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as removed from outc)
select event_id, user_id, removed from r where op = 'REMOVE' and ok""")
def remove_return(t):
    return writes.removed_values(ops(t), "user_id", "event_id", "op", "value").select("event_id", "user_id", "removed")


@query(f"""with {_OPS}, {_OUT} select tx, count(*) filter (where ok and op <> 'REMOVE' and not ex) as creates, count(*) filter (where ok and op <> 'REMOVE' and ex) as updates,
count(*) filter (where ok and op = 'REMOVE') as deletes from outc group by tx""")
def tx_stats(t):
    return writes.transaction_stats(writes.outcomes(ops(t), "user_id", "event_id", "op"), "tx", "op")


@query("""with recursive r as (select user_id, event_id, event_id as off, 1 + event_id % 5 as blk, row_number() over (partition by user_id order by event_id) as i from events),
s as (select user_id, event_id, i, greatest(0, off) as first_key, greatest(0, off) + blk - 1 as last_key from r where i = 1
union all select r.user_id, r.event_id, r.i, greatest(s.last_key + 1, r.off), greatest(s.last_key + 1, r.off) + r.blk - 1 from s join r on r.user_id = s.user_id and r.i = s.i + 1)
select user_id, event_id, first_key, last_key from s""")
def reserve_keys(t):
    asked = t("events").select("user_id", "event_id", F.col("event_id").alias("off"), (1 + F.col("event_id") % 5).alias("blk"))
    return writes.reserve(asked, "user_id", "event_id", "off", "blk").select("user_id", "event_id", "first_key", "last_key")


@query("select max(o_orderkey) as max_key from orders")
def max_key(t):
    return t("orders").agg(F.max("o_orderkey").alias("max_key"))


# Versions


@query(f"with {_LOG}, w as (select *, row_number() over (partition by user_id order by event_id desc) as r from log where committed) select user_id, event_id, value from w where r = 1 and not deleted")
def read_committed(t):
    return versions.visible(log(t), "user_id", "event_id", "deleted", "committed", "COMMITTED").select("user_id", "event_id", "value")


@query(SQL["read_committed"])
def read_serializable(t):
    return versions.visible(log(t), "user_id", "event_id", "deleted", "committed", "SERIALIZABLE").select("user_id", "event_id", "value")


@query(f"with {_LOG}, w as (select *, row_number() over (partition by user_id order by event_id desc) as r from log where committed and commit_vp <= 50) select user_id, event_id, value from w where r = 1 and not deleted")
def read_repeatable(t):
    return versions.visible(log(t), "user_id", "event_id", "deleted", "committed", "REPEATABLE", 50, "commit_vp").select("user_id", "event_id", "value")


@query(f"with {_LOG}, w as (select *, row_number() over (partition by user_id order by event_id desc) as r from log) select user_id, event_id, value from w where r = 1 and not deleted")
def read_uncommitted(t):
    return versions.visible(log(t), "user_id", "event_id", "deleted", "committed", "UNCOMMITTED").select("user_id", "event_id", "value")


_VER = f"{_LOG}, ver as (select * from (select *, commit_vp as lo, coalesce(lead(commit_vp) over (partition by user_id order by commit_vp, event_id) - 1, {OPEN}) as hi from log where committed) where not deleted)"


def _versions(t) -> DataFrame:
    return versions.intervals(log(t).filter("committed"), "user_id", "commit_vp", "event_id", "deleted")


@query(f"with {_VER} select user_id, event_id, lo, hi from ver")
def version_intervals(t):
    return _versions(t).select("user_id", "event_id", "lo", "hi")


@query(f"with {_VER} select user_id, event_id, value from ver where 60 between lo and hi")
def checkpoint_view(t):
    return versions.as_of(_versions(t), 60).select("user_id", "event_id", "value")


@query(f"with {_VER} select user_id, event_id, lo, hi from ver where hi >= 60 and lo <= hi")
def vacuum_versions(t):
    return versions.vacuum(_versions(t), 60).select("user_id", "event_id", "lo", "hi")


@query(f"with {_LOG} select user_id, count(*) as depth from log group by user_id having count(*) > 10")
def deep_storylines(t):
    return log(t).groupBy("user_id").agg(F.count("*").alias("depth")).filter("depth > 10")


@query(f"""with {_LOG}, w as (select distinct user_id, tx, tx as b, tx + 20 as e from log)
select x.user_id, x.tx as tx_a, y.tx as tx_b from w x join w y on x.user_id = y.user_id and x.tx < y.tx and x.b <= y.e and y.b <= x.e""")
def write_conflicts(t):
    return versions.write_conflicts(log(t).withColumn("e", F.col("tx") + 20), "user_id", "tx", "tx", "e")


@query("""with s as (select event_id, user_id, value, event_id // 10 as a, event_id // 5 as b from events) select event_id, user_id, value from s where a % 7 <> 0 and b % 11 <> 0""")
def nested_rollback(t):
    at = lambda n: F.floor(F.col("event_id") / n)
    scoped = t("events").select("event_id", "user_id", "value", F.array(F.concat(F.lit("a"), (at(10) % 7).cast("string")), F.concat(F.lit("b"), (at(5) % 11).cast("string"))).alias("path"))
    return writes.survivors(scoped, "path", F.array(F.lit("a0"), F.lit("b0"))).select("event_id", "user_id", "value")


@query("""with s as (select event_id, user_id, value, row_number() over (partition by user_id order by event_id desc) as r from events where (event_id // 10) % 7 <> 0 and (event_id // 5) % 11 <> 0) select user_id, event_id, value from s where r = 1""")
def nested_commit(t):
    return versions.latest(nested_rollback(t), "user_id", "event_id").select("user_id", "event_id", "value")


@query(f"with {_LOG}, l as (select tx from log group by tx having count(*) = 10), w as (select *, row_number() over (partition by user_id order by event_id desc) as r from log where tx in (select tx from l)) select user_id, event_id, value from w where r = 1 and not deleted")
def recover_incomplete_tx(t):
    closed = log(t).groupBy("tx").agg(F.count("*").alias("n")).filter("n = 10").select("tx")
    return versions.latest(log(t).join(closed, "tx", "left_semi"), "user_id", "event_id").filter("not deleted").select("user_id", "event_id", "value")


@query(SQL["read_committed"])
def atomic_commit_replay(t):
    ledger = log(t).filter("committed").select("tx").distinct()
    return versions.latest(log(t).join(ledger, "tx", "left_semi"), "user_id", "event_id").filter("not deleted").select("user_id", "event_id", "value")


@query(SQL["read_uncommitted"])
def recover_from_log(t):
    return versions.latest(log(t), "user_id", "event_id").filter("not deleted").select("user_id", "event_id", "value")


@query(SQL["read_uncommitted"])
def recover_partial(t):
    point = versions.latest(log(t).filter("commit_vp <= 60"), "user_id", "event_id")
    tail = log(t).filter("commit_vp > 60")
    return versions.latest(point.unionByName(tail), "user_id", "event_id").filter("not deleted").select("user_id", "event_id", "value")


@query("with recursive w(a, b) as (select distinct o_custkey, (o_custkey * 7 + 3) % 1000 from orders), r(s, x, n) as (select a, b, 1 from w union select r.s, w.b, r.n + 1 from r join w on w.a = r.x where r.n < 64) select s as waiter, min(n) as hops from r where s = x group by s")
def deadlock_cycles(t):
    graph = t("orders").select(F.col("o_custkey").alias("a"), ((F.col("o_custkey") * 7 + 3) % 1000).alias("b"))
    return waits.cycles(graph)


# Secondary indexes


@query("select o_custkey as sec, o_orderkey as pk from orders")
def build_secondary(t):
    return t("orders").select(F.col("o_custkey").alias("sec"), F.col("o_orderkey").alias("pk"))


@query("select event_id, o_orderkey, o_totalprice from events join orders on user_id = o_custkey")
def get_by_secondary(t):
    index = t("orders").select(F.col("o_custkey").alias("sec"), "o_orderkey", "o_totalprice")  # covers the value, so no fetch follows
    return t("events").select("event_id", "user_id").join(index, F.col("user_id") == F.col("sec")).select("event_id", "o_orderkey", "o_totalprice")


@query("select o_custkey as sec, o_orderkey, o_totalprice from orders where o_custkey between 10 and 40")
def secondary_range(t):
    index = keys.between(build_secondary(t), "sec", 10, 40)
    return index.join(t("orders").select("o_orderkey", "o_totalprice"), F.col("pk") == F.col("o_orderkey")).select("sec", "o_orderkey", "o_totalprice")


@query("select o_custkey as sec, o_orderkey as pk, '-' as change from orders where o_orderkey % 5 = 0 union all select o_custkey + 1, o_orderkey, '+' from orders where o_orderkey % 5 = 0")
def secondary_delta(t):
    old = build_secondary(t)
    new = old.withColumn("sec", F.when(F.col("pk") % 5 == 0, F.col("sec") + 1).otherwise(F.col("sec")))
    return old.exceptAll(new).withColumn("change", F.lit("-")).union(new.exceptAll(old).withColumn("change", F.lit("+")))


@query("select o_custkey as sec, count(*) as n from orders group by o_custkey having count(*) > 1")
def unique_violations(t):
    return build_secondary(t).groupBy("sec").agg(F.count("*").alias("n")).filter("n > 1")


@query(f"with {_VER} select cast(floor(value) as bigint) as sec, user_id as pk from ver where 60 between lo and hi")
def secondary_as_of(t):
    return versions.as_of(_versions(t), 60).select(F.floor("value").cast("long").alias("sec"), F.col("user_id").alias("pk"))


@query("""with idx as (select o_custkey as sec, o_orderkey as pk from orders where o_custkey is not null)
select (select count(*) from orders) as store_size, (select count(*) from idx) as index_size,
(select count(*) from orders where not exists (select 1 from idx where pk = o_orderkey and sec = o_custkey)) as lost, (select count(*) from idx where not exists (select 1 from orders where pk = o_orderkey and sec = o_custkey)) as stray""")
def secondary_consistency(t):
    index = build_secondary(t).filter("sec is not null").withColumn("side", F.lit(1))
    both = t("orders").select(F.col("o_custkey").alias("sec"), F.col("o_orderkey").alias("pk"), F.lit(0).alias("side")).union(index.select("sec", "pk", "side"))
    met = both.groupBy("pk", "sec").agg(F.count_if(F.col("side") == 0).alias("s"), F.count_if(F.col("side") == 1).alias("i"))
    return met.agg(F.sum("s").alias("store_size"), F.sum("i").alias("index_size"), F.sum(F.greatest(F.col("s") - F.col("i"), F.lit(0))).alias("lost"), F.sum(F.greatest(F.col("i") - F.col("s"), F.lit(0))).alias("stray"))


# Statistics


@query("select count(*) as size from orders")
def size(t):
    return t("orders").agg(F.count("*").alias("size"))


@query(f"with {_OPS}, {_OUT} select 1 as k, coalesce(sum(case when ok and op <> 'REMOVE' and not ex then 1 when ok and op = 'REMOVE' then -1 else 0 end), 0)::bigint as live from outc")
def size_in_tx(t):
    stats = writes.transaction_stats(writes.outcomes(ops(t), "user_id", "event_id", "op"), "tx", "op")
    return stats.agg(F.lit(1).alias("k"), F.coalesce(F.sum(F.col("creates") - F.col("deletes")), F.lit(0)).alias("live"))


@query("select count(*) as n from orders where o_orderkey between 100 and 1000")
def range_exact(t):
    return keys.between(t("orders"), "o_orderkey", 100, 1000).agg(F.count("*").alias("n"))


_ZONES = "zones as (select o_orderkey // 150 as seg, min(o_orderkey) as first_key, max(o_orderkey) as last_key, count(*) as n from orders group by 1)"


@query(f"with {_ZONES} select coalesce(sum(n), 0)::bigint as estimate from zones where last_key >= 100 and first_key <= 1000")
def range_estimate(t):
    return statistics.range_estimate(statistics.segments(t("orders"), "o_orderkey", 150), 100, 1000)


@query(f"with {_ZONES} select * from zones")
def segments(t):
    return statistics.segments(t("orders"), "o_orderkey", 150)


@query(f"with {_ZONES} select seg // 10 as block, min(first_key) as first_key, max(last_key) as last_key, sum(n)::bigint as n, count(*) as segs from zones group by 1")
def summary_zone_map(t):
    zones = statistics.segments(t("orders"), "o_orderkey", 150)
    return zones.groupBy(F.floor(F.col("seg") / 10).alias("block")).agg(F.min("first_key").alias("first_key"), F.max("last_key").alias("last_key"), F.sum("n").alias("n"), F.count("*").alias("segs"))


@query("""with d as (select count(distinct l_returnflag) as a, count(distinct (l_returnflag, l_linestatus)) as b, count(distinct (l_returnflag, l_linestatus, l_shipdate)) as c from lineitem)
select 0 as part, a as entries from d union all select 1, b - a from d union all select 2, c - b from d""")
def cardinality(t):
    return statistics.cardinality(t("lineitem"), ["l_returnflag", "l_linestatus", "l_shipdate"])


@query()
def cardinality_approx(t):
    return t("lineitem").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"), F.approx_count_distinct("l_suppkey", 0.02).alias("suppliers"))


@query("select sum(octet_length(encode(text)))::bigint as value_bytes, (count(*) * 8)::bigint as key_bytes from documents")
def length_bytes(t):
    return t("documents").agg(F.sum(F.octet_length("text")).alias("value_bytes"), (F.count("*") * 8).alias("key_bytes"))


@query("select event_id // 1000 as file, count(*) as segs from (select distinct event_id // 1000 * 1000 + event_id % 1000 // 100 as s, event_id // 1000 * 1000 as event_id from events) group by 1")
def paging_stats(t):
    segs = t("events").select(F.floor(F.col("event_id") / 1000).alias("file"), F.floor(F.col("event_id") % 1000 / 100).alias("s")).distinct()
    return segs.groupBy("file").agg(F.count("*").alias("segs"))


@query("with s as (select user_id as seg, count(*) as n, count(distinct event_type) as files from events group by 1), f as (select distinct user_id as seg, event_type as file from events) select file, sum(n // files)::bigint as entries from s join f using (seg) group by file")
def stream_stats(t):
    segs = t("events").groupBy(F.col("user_id").alias("seg")).agg(F.count("*").alias("n"), F.collect_set("event_type").alias("files"))
    return segs.select(F.explode("files").alias("file"), F.expr("n div size(files)").alias("n")).groupBy("file").agg(F.sum("n").alias("entries"))


@query(f"with {_LOG}, m as (select *, event_id < max(event_id) over (partition by user_id) as dead from log) select event_id // 1000 as file, round(100.0 * count(*) filter (where dead) / count(*), 6)::double as dead_percent from m group by 1")
def fragmentation(t):
    last = log(t).groupBy("user_id").agg(F.max("event_id").alias("last"))
    return log(t).join(last, "user_id").groupBy(F.floor(F.col("event_id") / 1000).alias("file")).agg(F.round(100.0 * F.count_if(F.col("event_id") < F.col("last")) / F.count("*"), 6).alias("dead_percent"))


@query("select round(avg(octet_length(encode(text))), 6) as mean_bytes, max(octet_length(encode(text)))::bigint as max_bytes from documents")
def value_average(t):
    return t("documents").agg(F.round(F.avg(F.octet_length("text")), 6).alias("mean_bytes"), F.max(F.octet_length("text")).cast("long").alias("max_bytes"))


@query(f"with {_ZONES} select count(*) as total, count(*) filter (where n = 150) as full_segments from zones")
def segment_counts(t):
    return statistics.segments(t("orders"), "o_orderkey", 150).agg(F.count("*").alias("total"), F.count_if(F.col("n") == 150).alias("full_segments"))


# Order and collections


@query("select cast(o_orderkey as varchar) as k, row_number() over (partition by o_orderstatus order by length(cast(o_orderkey as varchar)), cast(o_orderkey as varchar)) as pos, o_orderstatus from orders")
def order_nbyte(t):
    k = t("orders").select(F.col("o_orderkey").cast("string").alias("k"), "o_orderstatus")
    return k.withColumn("pos", F.row_number().over(W.partitionBy("o_orderstatus").orderBy(*keys.KeySpec(("k",), length_first=True).order())))


@query("select conv_id, turn, role, row_number() over (partition by conv_id order by turn, role, text) as pos from conversations")
def order_composite(t):
    return t("conversations").select("conv_id", "turn", "role", F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")).alias("pos"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20")
def topk(t):
    return t("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("select o_custkey, o_orderkey, rank from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders) where rank <= 3")
def topk_per_group(t):
    return statistics.top_per_group(t("orders"), "o_custkey", [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@query("select user_id, min(event_id) as seq from events group by user_id")
def queue_set(t):
    return t("events").groupBy("user_id").agg(F.min("event_id").alias("seq"))


@query("select k, arg_max(v, o) as v from (select c_custkey as k, c_acctbal as v, 0 as o from customer union all select s_suppkey, s_acctbal, 1 from supplier) group by k")
def map_put_all(t):
    both = t("customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.lit(0).alias("o")).union(t("supplier").select("s_suppkey", "s_acctbal", F.lit(1)))
    return versions.latest(both, "k", "o").select("k", "v")


@query("select c_custkey as k from customer where c_custkey not in (select s_suppkey from supplier)")
def map_remove(t):
    return t("customer").select(F.col("c_custkey").alias("k")).join(t("supplier"), F.col("k") == F.col("s_suppkey"), "left_anti")


@query("select c_nationkey as k from customer union select s_nationkey from supplier")
def set_union(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).union(t("supplier").select("s_nationkey")).distinct()


@query("select l_suppkey as k from lineitem except select s_suppkey from supplier where s_acctbal > 0")
def set_except(t):
    return t("lineitem").select(F.col("l_suppkey").alias("k")).subtract(t("supplier").filter("s_acctbal > 0").select("s_suppkey"))


@query("select c_nationkey as k from customer intersect select s_nationkey from supplier")
def set_intersect(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).intersect(t("supplier").select("s_nationkey"))


@query("select not exists (select 1 from supplier where s_nationkey not in (select c_nationkey from customer)) as all_held")
def set_contains_all(t):
    missing = t("supplier").join(t("customer"), F.col("s_nationkey") == F.col("c_nationkey"), "left_anti")
    return missing.agg((F.count("*") == 0).alias("all_held"))


@query("select c_nationkey as k from customer except all select s_nationkey from supplier")
def list_except_all(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).exceptAll(t("supplier").select("s_nationkey"))


@query("select c_nationkey as k from customer where c_nationkey in (select s_nationkey from supplier)")
def list_retain(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).join(t("supplier"), F.col("k") == F.col("s_nationkey"), "left_semi")


@query("select doc_id, list_sort(string_split(lang || ' ' || source || ' x', ' '))[1] as least, list_reverse(string_split(source || ' b', ' '))[1] as last_item, list_position(string_split(source || ' b', ' '), 'b') - 1 as place from documents")
def list_ops(t):
    items = F.split(F.concat("source", F.lit(" b")), " ")
    return t("documents").select("doc_id", F.get(F.sort_array(F.split(F.concat("lang", F.lit(" "), "source", F.lit(" x")), " ")), F.lit(0)).alias("least"), F.get(F.reverse(items), F.lit(0)).alias("last_item"), (F.array_position(items, "b") - 1).alias("place"))


@query("with h as (select max(vec_id) as hi from embeddings) select hi, bit_or(1::bigint << (hi - 1 - vec_id)::int)::bigint as below from embeddings, h where vec_id < hi and vec_id >= hi - 60 group by hi")
def number_range_set(t):
    top = t("embeddings").agg(F.max("vec_id").alias("hi"))
    near = t("embeddings").crossJoin(F.broadcast(top)).filter("vec_id < hi and vec_id >= hi - 60")  # one row
    return near.groupBy("hi").agg(F.bit_or(F.expr("shiftleft(1L, cast(hi - 1 - vec_id as int))")).alias("below"))


@query("select nav.k as k, (select max(s_suppkey) from supplier where s_suppkey < nav.k) as lower, (select min(s_suppkey) from supplier where s_suppkey > nav.k) as higher from (select c_custkey as k from customer) nav")
def nav_keys(t):
    lower = neighbour.neighbour(t("customer").select(F.col("c_custkey").alias("k")), t("supplier"), "k", "s_suppkey", "previous").withColumnRenamed("found", "lower")
    return neighbour.neighbour(lower, t("supplier"), "k", "s_suppkey", "next").withColumnRenamed("found", "higher")


# Scalars


@query("""select page_id, strpos(url, 'example') - 1 as first_at, case when strpos(reverse(url), '/') = 0 then -1 else length(url) - strpos(reverse(url), '/') end as last_at,
starts_with(url, 'https') as https, ends_with(url, '.html') as page, contains(url, 'www') as www, substr(url, 9, 5) as part, octet_length(encode(url)) as n from pages""")
def string_search(t):
    u = F.col("url")
    return t("pages").select("page_id", scalars.index_of(u, "example").alias("first_at"), scalars.last_index_of(u, "/").alias("last_at"), u.startswith("https").alias("https"), u.endswith(".html").alias("page"), u.contains("www").alias("www"), scalars.part(u, 8, 5).alias("part"), F.octet_length(u).alias("n"))


@query("""select page_id, regexp_replace(url, 'th', 'T') as first_one, replace(url, 'th', 'T') as every_one,
case when strpos(url, 'th') = 0 then url else reverse(regexp_replace(reverse(url), 'ht', 'T')) end as last_one from pages""")
def string_replace(t):
    u = F.col("url")
    return t("pages").select("page_id", scalars.replace_first(u, "th", "T").alias("first_one"), F.replace(u, F.lit("th"), F.lit("T")).alias("every_one"), scalars.replace_last(u, "th", "T").alias("last_one"))


@query("select page_id, regexp_matches(url, 'example\\.(com|net)') as hit, regexp_extract(url, 'example\\.(com|net)', 1) as zone from pages")
def regex_groups(t):
    return t("pages").select("page_id", F.col("url").rlike(r"example\.(com|net)").alias("hit"), F.regexp_extract("url", r"example\.(com|net)", 1).alias("zone"))


@query("""with recursive b as (select page_id, url as u, 0 as i, 0::hugeint as h from pages
union all select page_id, u, i + 1, (h * 31 + ascii(u[i + 1])) % 18446744073709551616::hugeint from b where i < length(u))
select page_id, (case when h >= 9223372036854775808::hugeint then h - 18446744073709551616::hugeint else h end)::bigint as code from b where i = length(u)""")
def bytes_hash(t):
    return t("pages").select("page_id", scalars.bytes_hash(F.col("url")).alias("code"))


@query("select o_orderkey, least(o_orderkey, o_custkey) as low, greatest(o_orderkey, o_custkey) as high, cast(o_orderkey as varchar) as text from orders")
def math_and_text(t):
    return t("orders").select("o_orderkey", F.least("o_orderkey", "o_custkey").alias("low"), F.greatest("o_orderkey", "o_custkey").alias("high"), F.col("o_orderkey").cast("string").alias("text"))


@query("select s_suppkey, s_name as name from supplier")
def xml_xpath(t):
    doc = F.concat(F.lit("<s><n>"), F.col("s_name"), F.lit("</n></s>"))
    return t("supplier").select("s_suppkey", F.xpath_string(doc, F.lit("s/n")).alias("name"))
