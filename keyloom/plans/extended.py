"""More queries over the test tables: cursors, reads inside transactions, secondary navigation, recovery, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import keys, neighbour, ranges, statistics, versions, writes
from .queries import _LOG, _MAKES, _STORE, QUERIES, SQL, build_secondary, log, ops, probe, query, store

__all__ = ["QUERIES", "SQL"]

_STARTS = {
    "exact": "max(o_orderkey) filter (where o_orderkey = 1000)", "next": "min(o_orderkey) filter (where o_orderkey > 1000)", "exact_or_next": "min(o_orderkey) filter (where o_orderkey >= 1000)",
    "previous": "max(o_orderkey) filter (where o_orderkey < 1000)", "exact_or_previous": "max(o_orderkey) filter (where o_orderkey <= 1000)", "first": "min(o_orderkey)", "last": "max(o_orderkey)",
}


@query(f"with {_STORE}, s as ({' union all '.join(f"select '{o}' as option, {x} as start from store" for o, x in _STARTS.items())}) select option, o_orderkey, o_totalprice from s join store on o_orderkey >= start where o_orderkey <= 2000 or option = 'last'")
def cursor_options(t):
    passed = (keys.cursor(store(t), "o_orderkey", o, 1000).withColumn("option", F.lit(o)) for o in _STARTS)
    out = reduce(lambda a, b: a.unionByName(b), passed)
    return out.filter("o_orderkey <= 2000 or option = 'last'").select("option", "o_orderkey", "o_totalprice")


@query(f"with {_STORE} select o_orderkey, o_totalprice from store where o_orderkey <= (select max(o_orderkey) from store where o_orderkey < 1000)")
def cursor_backward(t):
    return keys.cursor(store(t), "o_orderkey", "previous", 1000, descending=True)


_SEEN = f"{_LOG}, w as (select *, row_number() over (partition by user_id order by event_id desc) as r from log where (committed and commit_vp <= 50) or tx = 60), seen as (select user_id, event_id, value from w where r = 1 and not deleted)"


def _seen(t):
    return versions.visible(log(t), "user_id", "event_id", "deleted", "committed", "REPEATABLE", 50, "commit_vp", "tx", 60).select("user_id", "event_id", "value")


def _in_tx(option: str, compare: str) -> None:
    def run(t):
        asked = t("customer").select(F.col("c_custkey").alias("p"))
        return neighbour.neighbour(asked, _seen(t), "p", "user_id", option, ("value",))

    run.__name__ = f"{option}_in_tx"
    query(f"with {_SEEN} select p, user_id as found, value from (select c_custkey as p from customer) asof left join seen on p {compare} user_id")(run)


for _option, _compare in (("next", "<"), ("previous", ">"), ("exact_or_next", "<="), ("exact_or_previous", ">=")):
    _in_tx(_option, _compare)


def _by_secondary(option: str, compare: str, pick: str) -> None:
    def run(t):
        return neighbour.by_secondary(probe(t), build_secondary(t), "p", "sec", "pk", option)

    run.__name__ = f"secondary_{option}"
    query(f"with idx as (select o_custkey as sec, {pick}(o_orderkey) as pk from orders group by 1), probe as (select event_id, event_id * 2 + 1 as p from events) select event_id, p, sec as found, pk from probe asof left join idx on p {compare} sec")(run)


for _option, _compare, _pick in (("next", "<", "min"), ("previous", ">", "max"), ("exact_or_next", "<=", "min"), ("exact_or_previous", ">=", "max")):
    _by_secondary(_option, _compare, _pick)


@query("""with f as (select o_custkey as sec, o_orderkey as pk from orders) select 'first' as option, (select min(sec) from f) as sec, (select min(pk) from f where sec = (select min(sec) from f)) as pk
union all select 'last', (select max(sec) from f), (select max(pk) from f where sec = (select max(sec) from f))""")
def secondary_ends(t):
    at = build_secondary(t).agg(F.min(F.struct("sec", "pk")).alias("a"), F.max(F.struct("sec", "pk")).alias("z"))
    ends = F.explode(F.array(F.struct(F.lit("first").alias("option"), F.col("a.sec"), F.col("a.pk")), F.struct(F.lit("last").alias("option"), F.col("z.sec"), F.col("z.pk"))))
    return at.select(ends.alias("e")).select("e.*")


_RES = _MAKES.replace("'UNIQUE')", "'UNIQUE', 'RESERVED')")
_RESERVED = f"""ops as (select user_id, event_id, event_id // 50 as tx, case event_type when 'signup' then 'UNIQUE' when 'purchase' then 'EXISTING' when 'view' then 'RESERVED' when 'click' then 'OVERRIDE' else 'REMOVE' end as op from events),
ex as (select *, coalesce(last_value({_RES} ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), false) as ex from ops),
o as (select *, case when op in ('EXISTING', 'REMOVE') then ex when op = 'UNIQUE' then not ex else true end as ok0 from ex),
own as (select *, coalesce(last_value(case when ok0 then op <> 'REMOVE' end ignore nulls) over (partition by user_id, tx order by event_id rows between unbounded preceding and 1 preceding), false) as own from o)"""


@query(f"with {_RESERVED}, r as (select *, case when op = 'RESERVED' then not own else ok0 end as ok from own) select event_id, user_id, tx, op, ok, case when ok then 0 when op in ('UNIQUE', 'RESERVED') then 3 else 2 end as error_code from r")
def put_reserved(t):
    names = F.create_map(*(F.lit(x) for pair in (("signup", "UNIQUE"), ("purchase", "EXISTING"), ("view", "RESERVED"), ("click", "OVERRIDE"), ("error", "REMOVE")) for x in pair))
    asked = t("events").select("user_id", "event_id", F.floor(F.col("event_id") / 50).alias("tx"), names[F.col("event_type")].alias("op"))
    return writes.outcomes(asked, "user_id", "event_id", "op", "tx").select("event_id", "user_id", "tx", "op", "ok", "error_code")


_OPS_EX = f"ops as (select user_id, event_id, value, case event_type when 'signup' then 'UNIQUE' when 'purchase' then 'EXISTING' when 'view' then 'STANDARD' when 'click' then 'OVERRIDE' else 'REMOVE' end as op from events), ex as (select *, coalesce(last_value({_MAKES} ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), false) as ex from ops)"


@query(f"with {_OPS_EX} select event_id, user_id from ex where op = 'REMOVE' and ex")
def remove_ignore(t):
    return writes.removed_values(ops(t), "user_id", "event_id", "op", "value", "IGNORE").select("event_id", "user_id")


@query(f"with {_OPS_EX} select event_id, user_id, value as removed from ex where op = 'REMOVE' and ex")
def remove_populated(t):
    return writes.removed_values(ops(t), "user_id", "event_id", "op", "value", "POPULATED").select("event_id", "user_id", "removed")


@query("""with recursive r as (select user_id, event_id, event_id as off, case when event_id % 5 < 1 then 1500 else event_id % 5 end as blk, row_number() over (partition by user_id order by event_id) as i from events),
s as (select user_id, event_id, i, greatest(0, off) as a, greatest(0, off) + blk - 1 as z from r where i = 1
union all select r.user_id, r.event_id, r.i, greatest(s.z + 1, r.off), greatest(s.z + 1, r.off) + r.blk - 1 from s join r on r.user_id = s.user_id and r.i = s.i + 1)
select user_id, event_id, case when a <= 5000 then a end as first_key, case when a <= 5000 then least(z, 5000) end as last_key, a <= 5000 as ok from s""")
def reserve_exhausted(t):
    asked = t("events").select("user_id", "event_id", F.col("event_id").alias("off"), (F.col("event_id") % 5).alias("blk"))
    return writes.reserve(asked, "user_id", "event_id", "off", "blk", most=5000).select("user_id", "event_id", "first_key", "last_key", "ok")


_SPANS = "spans as (select event_id // 10 as tx, min(event_id) as b, max(event_id) + (event_id // 10) % 3 * 10 as e from events group by event_id // 10)"


def _spans(t):
    tx = F.floor(F.col("event_id") / 10)
    return t("events").groupBy(tx.alias("tx")).agg(F.min("event_id").alias("b"), (F.max("event_id") + F.max(tx) % 3 * 10).alias("e"))


@query(f"with {_SPANS} select x.tx, (select count(*) from spans y where y.e < x.b) as view_vp from spans x")
def begin_viewpoints(t):
    return versions.begin_views(_spans(t), "tx", "b", "e")


@query(f"with {_LOG}, w as (select *, row_number() over (partition by user_id order by event_id desc) as r from log where committed) select user_id, event_id, value, commit_vp <= 50 as valid from w where r = 1 and not deleted")
def read_serializable_validated(t):
    return versions.serializable(log(t), "user_id", "event_id", "deleted", "committed", 50, "commit_vp").select("user_id", "event_id", "value", "valid")


_POINTS = "points as (select event_type as idx, event_id // 100 * 10 as vp, count(*) % 4 <> 0 as valid from events group by 1, 2)"


def _points(t):
    return t("events").groupBy(F.col("event_type").alias("idx"), (F.floor(F.col("event_id") / 100) * 10).alias("vp")).agg((F.count("*") % 4 != 0).alias("valid"))


@query(f"with {_POINTS} select idx, max(vp) as vp from points where valid group by idx")
def newest_valid_checkpoint(t):
    return versions.newest_valid(_points(t), "idx", "vp", "valid")


@query(f"with {_LOG}, {_POINTS}, bound as (select min(vp) as vp from (select max(vp) as vp from points where valid group by idx)), w as (select *, row_number() over (partition by user_id order by event_id desc) as r from log) select user_id, event_id, value, event_id // 10 > bound.vp as replayed from w, bound where r = 1 and not deleted")
def recover_from_boundary(t):
    bound = versions.newest_valid(_points(t), "idx", "vp", "valid").agg(F.min("vp").alias("bound"))
    held = log(t).join(F.broadcast(bound), F.lit(True))  # one row
    point = versions.latest(held.filter("commit_vp <= bound"), "user_id", "event_id")
    whole = versions.latest(point.unionByName(held.filter("commit_vp > bound")), "user_id", "event_id").filter("not deleted")
    return whole.select("user_id", "event_id", "value", (F.col("commit_vp") > F.col("bound")).alias("replayed"))


@query(f"with {_POINTS} select idx, vp, valid, valid and vp = max(vp) filter (where valid) over (partition by idx) as newest from points")
def checkpoint_validity(t):
    best = versions.newest_valid(_points(t), "idx", "vp", "valid").withColumnRenamed("vp", "best")
    return _points(t).join(best, "idx", "left").select("idx", "vp", "valid", (F.col("valid") & (F.col("vp") == F.col("best"))).alias("newest"))


@query("with p as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as i from orders) select i // 1500 as seg, min(o_orderkey) as first_key, max(o_orderkey) as last_key, count(*) as n from p group by 1")
def segment_split(t):
    return statistics.split_segments(t("orders"), "o_orderkey", 1500)


_SMALL = "small as (select o_orderkey // 70 as s, min(o_orderkey) as first_key, max(o_orderkey) as last_key, count(*) as n from orders where o_orderkey % 3 <> 0 group by 1)"


@query(f"with {_SMALL}, c as (select *, sum(n) over (order by first_key) - n as before from small) select (before // 1500)::bigint as seg, min(first_key) as first_key, max(last_key) as last_key, sum(n)::bigint as n, count(*) as merged from c group by 1")
def segment_merge(t):
    return statistics.merged_segments(statistics.segments(t("orders").filter("o_orderkey % 3 <> 0"), "o_orderkey", 70), 1500)


@query("select o_orderkey, o_custkey, row_number() over (order by o_orderkey) as pos from orders where o_orderstatus = 'F'")
def order_by_key(t):
    return ranges.numbered(t("orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey"), "o_orderkey")


@query("with d as (select o_custkey as sec, o_orderkey as pk from orders where o_orderkey % 2 = 0) select sec, count(*) as entries, min(pk) as first_pk, max(pk) as last_pk from d group by sec")
def associate(t):
    attached = build_secondary(t).filter("pk % 2 = 0")
    return attached.groupBy("sec").agg(F.count("*").alias("entries"), F.min("pk").alias("first_pk"), F.max("pk").alias("last_pk"))


@query("select o_custkey as sec, o_orderkey as pk from orders where o_orderkey % 2 <> 0")
def disassociate(t):
    return build_secondary(t).join(t("orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("pk")), "pk", "left_anti").select("sec", "pk")


@query("select page_id, case when octet_length(encode(url)) >= 12 then (256 * (256 * (256 * ascii(url[9]) + ascii(url[10])) + ascii(url[11])) + ascii(url[12]))::bigint end as sec from pages where regexp_full_match(url, '[ -~]*')")
def derive_secondary_key(t):
    return t("pages").filter(F.col("url").rlike("^[ -~]*$")).select("page_id", scalars.derived_key(F.col("url").cast("binary"), 8, 4).alias("sec"))


_BITS = "list_reduce(list_prepend(xor(c, b << 24), range(8)), lambda x, i: case when x & 2147483648 > 0 then xor((x << 1) & 4294967295, 79764919) else (x << 1) & 4294967295 end)"


@query(f"select page_id, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(url) + 1), lambda i: ascii(url[i])::bigint)), lambda c, b: {_BITS}), 4294967295)::bigint as checksum from pages where regexp_full_match(url, '[ -~]*')")
def checksum_msb(t):
    return t("pages").filter(F.col("url").rlike("^[ -~]*$")).select("page_id", scalars.crc32_msb(F.col("url").cast("binary")).alias("checksum"))


@query("select page_id, substr(url, 5, 1) as fifth, regexp_full_match(substr(url, 5, 1), '[0-9]') as digit, regexp_full_match(substr(text, 4, 1), '[ \\t\\n\\x0B\\f\\r]') as space from (select page_id, url, 'a b ' || url as text from pages)")
def char_tests(t):
    at = scalars.char_at(F.col("url"), 4)
    return t("pages").select("page_id", at.alias("fifth"), scalars.is_digit(at).alias("digit"), scalars.is_space_char(scalars.char_at(F.concat(F.lit("a b "), "url"), 3)).alias("space"))


@query("select page_id, greatest(octet_length(encode(url)), 40) as extended, url = 'x' || substr(url, 2) as same from pages")
def bytes_ops(t):
    b = F.col("url").cast("binary")
    return t("pages").select("page_id", F.octet_length(scalars.bytes_extend(b, 40)).alias("extended"), (b == F.concat(F.lit("x"), F.expr("substr(url, 2)")).cast("binary")).alias("same"))


@query("select doc_id, string_split(lang || ' ' || source, ' ') < string_split(source || ' ' || lang, ' ') as less from documents")
def compare_lists(t):
    words = lambda a, b: F.split(F.concat(a, F.lit(" "), b), " ")
    return t("documents").select("doc_id", (words("lang", "source") < words("source", "lang")).alias("less"))


@query("select doc_id, list_filter(string_split(source || ' b c', ' '), lambda x, i: i <> 2) as removed, list_concat(['first'], string_split(source || ' b', ' ')) as added from documents")
def list_insert_remove(t):
    items = lambda tail: F.split(F.concat("source", F.lit(tail)), " ")
    return t("documents").select("doc_id", F.filter(items(" b c"), lambda x, i: i != 1).alias("removed"), F.array_insert(items(" b"), 1, F.lit("first")).alias("added"))


@query("select 'orders' as store, count(*) as n from orders union all select 'customer', count(*) from customer union all select 'supplier', count(*) from supplier")
def mount_catalog(t):
    spark = t("orders").sparkSession
    names = ("orders", "customer", "supplier")
    counts = (spark.sql(f"select '{n}' as store, count(*) as n from {{table}}", table=t(n)) for n in names)
    return reduce(lambda a, b: a.unionByName(b), counts)


@query("select arg_max(octet_length(encode(text)), doc_id)::bigint as last_bytes, round(avg(octet_length(encode(text))), 6) as mean_bytes from documents where text is not null")
def value_average_seed(t):
    n = F.octet_length("text")
    return t("documents").filter("text is not null").agg(F.max_by(n, "doc_id").cast("long").alias("last_bytes"), F.round(F.avg(n), 6).alias("mean_bytes"))


@query(f"with {_LOG}, l as (select user_id, arg_max(deleted, event_id) as gone from log group by 1) select count(*) as total, count(*) filter (where live > 0) as active, count(*) filter (where live = 0) as purged from (select user_id // 20 as seg, count(*) filter (where not gone) as live from l group by 1)")
def segments_active(t):
    last = versions.latest(log(t), "user_id", "event_id")
    return statistics.live_segments(last, F.floor(F.col("user_id") / 20), "deleted")


@query("select 130 as low, 1370 as high, count(*) as n from orders where o_orderkey between 130 and 1370")
def range_refined(t):
    return statistics.range_refined(t("orders"), "o_orderkey", 150, 130, 1370).select(F.lit(130).alias("low"), F.lit(1370).alias("high"), "n")


@query("""select 'orders' as store, count(*) as entries, sum(length(o_orderkey::varchar))::bigint as key_bytes, sum(length(o_orderpriority))::bigint as value_bytes from orders
union all select 'customer', count(*), sum(length(c_custkey::varchar))::bigint, sum(length(c_name))::bigint from customer""")
def store_statistics(t):
    orders = statistics.sizes(t("orders"), "o_orderkey", "o_orderpriority").withColumn("store", F.lit("orders"))
    return orders.unionByName(statistics.sizes(t("customer"), "c_custkey", "c_name").withColumn("store", F.lit("customer")))


_OK = f"{_OPS_EX}, o as (select *, event_id // 10 as tx, case when op in ('EXISTING', 'REMOVE') then ex when op = 'UNIQUE' then not ex else true end as ok from ex), p as (select e.event_id, octet_length(encode(e.props)) as n from events e), w as (select o.*, case when ok and op <> 'REMOVE' then n end as size from o join p using (event_id)), z as (select *, coalesce(last_value(size ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) as old from w)"


@query(f"with {_OK} select tx, sum(case when not ok then 0 when op = 'REMOVE' then -old else size - case when ex then old else 0 end end)::bigint as user_bytes from z group by tx")
def tx_bytes(t):
    sized = ops(t).join(t("events").select("event_id", F.octet_length("props").alias("n")), "event_id")
    return writes.byte_deltas(sized, "user_id", "event_id", "op", "n", "tx")


@query("select s_suppkey, s_name as name, s_nationkey as nation from supplier")
def xml_round_trip(t):
    doc = F.to_xml(F.struct(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")))
    read = F.from_xml(doc, "name string, nation int")
    return t("supplier").select("s_suppkey", read["name"].alias("name"), read["nation"].alias("nation"))


@query("select count(*) as n, true as in_range, true as spread from orders")
def random_values(t):
    x = F.rand(7)
    drawn = t("orders").select(x.alias("x"))
    return drawn.agg(F.count("*").alias("n"), F.every((F.col("x") >= 0) & (F.col("x") < 1)).alias("in_range"), (F.abs(F.avg("x") - 0.5) < 0.1).alias("spread"))


@query("select true as parts_close, true as suppliers_close")
def cardinality_within_error(t):
    held = t("lineitem")
    counts = held.agg(F.approx_count_distinct("l_partkey", 0.02).alias("p"), F.approx_count_distinct("l_suppkey", 0.02).alias("s"))
    # Exact counts apart: beside them, in one aggregate, each distinct key would carry sketches of its own.
    for key, exact in (("l_partkey", "pe"), ("l_suppkey", "se")):
        counts = counts.crossJoin(F.broadcast(held.select(key).distinct().agg(F.count(key).alias(exact))))  # one row
    # Within four standard errors.
    close = lambda a, e: F.abs(F.col(a) - F.col(e)) <= 4 * 0.02 * F.col(e)
    return counts.select(close("p", "pe").alias("parts_close"), close("s", "se").alias("suppliers_close"))
