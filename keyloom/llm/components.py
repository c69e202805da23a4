"""Connected components and links of nodes that share buckets, without pairs inside a component."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


#: Edges for each task of a round.
EDGES = 100_000


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of links (a, b): component is the least node reachable.

    Rounds of large-star and small-star (each node's neighbours move to their least one), whose
    number grows with the logarithm of the longest chain; links that are stars already need none. Least neighbours come from a combinable
    min; they are cut before the join back, so a node with very many neighbours can be split.
    """
    edges = cut(links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-edges")
    while tasks := _left(edges):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "cc-least", tasks=tasks)
        large = cut(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct(), "cc-large", tasks=tasks)
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")), "cc-least", tasks=tasks)
        moved = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = cut(moved.filter("u != v").distinct(), "cc-small", tasks=tasks)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _left(edges: DataFrame) -> int:
    """0 where edges (u to v) are stars: every u has one and no v has one of its own. Else the tasks that so many edges take."""
    n, nodes = edges.agg(F.count("*"), F.count_distinct("u")).first()
    stars = n == nodes and edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()
    return 0 if stars else -(-n // EDGES)


def merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """comp (node, component) after more links (a, b) of its nodes or others: only the components that they link are gone through again."""
    side = lambda k: comp.select(F.col("node").alias(k), F.col("component").alias(f"c{k}"))
    ends = links.select("a", "b").join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    moved = components(ends).select(F.col("node").alias("component"), F.col("component").alias("to"))
    kept = comp.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return kept.union(moved.select(F.col("component").alias("node"), F.col("to").alias("component")).join(comp.select("node"), "node", "left_anti"))


#: Nodes of a bucket from which on `linked` looks for a finer one.
LARGE = 200
#: Most rounds of stars, the pairs across components for each node that end them, and the share of a round's pairs that must be links for one more.
ROUNDS, EACH, LEAST = 5, 4, 0.02


def linked(postings: DataFrame, facts: DataFrame, may: Callable[[str, str], Column], verify: Callable[[DataFrame], DataFrame], finer: Callable[[DataFrame], DataFrame] | None = None, hub: str = "node", rounds: int = ROUNDS, once: bool = False) -> DataFrame:
    """Components (node, component) of the verified links among nodes that share a bucket.

    postings: bucket, node (buckets of two nodes or more). facts: node and what `may` compares
    (a necessary condition on columns of sides named by prefixes). verify: pairs (a, b) to those that are linked.

    Every bucket first links its nodes to one of them (the one of the least column hub of facts), which is
    linear in its size; where that leaves very many pairs in different components, to another one, up to so many
    rounds, as long as that finds links. What is then left in different components is compared across components only: pairs inside a
    component can't change the result. So all links count, and a large group of copies costs
    about one pair a copy. For that comparison the nodes of buckets of more than LARGE nodes are
    dealt anew by finer (rows of facts to narrower buckets that a pair worth verifying still shares).
    once: pairs share many buckets, so each is to come out of the least one alone (a node carries its lesser buckets, whose number is bounded).
    """
    hubs = postings.join(facts.select("node", F.struct(hub, "node").alias("h")), "node") if hub != "node" else postings.withColumn("h", F.struct("node"))
    least = cut(hubs.groupBy("bucket").agg(F.min("h")["node"].alias("a")), "bucket-least")
    pairs = cut(postings.join(least, "bucket").filter("node != a").select("a", F.col("node").alias("b")).distinct(), "links-pairs")
    comp = cut(components(verify(_possible(pairs, facts, may))), "links-components")
    for n in range(1, rounds):
        tagged = cut(postings.join(comp, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("c")), "links-tagged")
        by = tagged.groupBy("bucket", "c").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"))
        heavy = cut(by.withColumn("across", (F.col("s") * F.col("s") - F.col("q")) / 2).filter(F.col("across") > EACH * F.col("s")).select("bucket"), "links-heavy")
        if heavy.isEmpty():
            break
        some = tagged.join(heavy, "bucket")
        other = cut(some.groupBy("bucket").agg(F.min(F.struct(F.xxhash64(F.lit(n), "node").alias("x"), F.col("node").alias("a"), F.col("c").alias("ac"))).alias("h")).select("bucket", "h.a", "h.ac"), "bucket-least")
        asked = some.join(other, "bucket").filter("c != ac").select("a", F.col("node").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
        asked = cut(asked, "links-pairs")
        more = cut(verify(_possible(asked, facts, may)), "links-star")
        pairs, n_more = pairs.union(asked), more.count()
        if n_more:
            comp = cut(merged(comp, more), "links-components")
        if n_more < LEAST * asked.count():
            break
    tagged = cut(postings.join(comp, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("c")), "links-tagged")
    sizes = _mixed(tagged)
    if finer:
        large = cut(tagged.join(sizes.filter(F.col("size") > LARGE).select("bucket"), "bucket").select("node", "c").distinct(), "links-large")
        dealt = finer(large.join(facts, "node")).join(large, "node")
        some = cut(dealt.select("bucket", "node", "c").union(tagged.join(sizes.filter(F.col("size") <= LARGE).select("bucket"), "bucket").select("bucket", "node", "c")), "links-dealt")
        sizes = _mixed(some)
        tagged = some
    left = tagged.join(sizes.select("bucket"), "bucket")
    if once:
        left = left.withColumn("lesser", F.collect_list("bucket").over(Window.partitionBy("node").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    left = cut(left.join(facts, "node"), "links-left")
    one, two = (left.select(*(F.col(c).alias(f"{p}_{c}") for c in left.columns)) for p in "ab")
    across = one.join(two, (F.col("a_bucket") == F.col("b_bucket")) & (F.col("a_node") < F.col("b_node")) & (F.col("a_c") != F.col("b_c")) & may("a_", "b_") & (~F.arrays_overlap("a_lesser", "b_lesser") if once else F.lit(True)))
    across = cut(across.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct(), "links-across")
    tried = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = cut(verify(cut(across.join(tried, ["a", "b"], "left_anti"), "links-across")), "links-more")
    if more.isEmpty():
        return comp
    return cut(merged(comp, more), "links-components")


def _mixed(tagged: DataFrame) -> DataFrame:
    """The buckets (bucket, size) whose nodes are of two components (c) or more; of buckets that hold the same nodes one.

    Copies of one text share nearly all their buckets, so a pair would be compared in each of them.
    Sets of nodes are told apart by their size and 128 bits of hashes."""
    print_ = [F.bit_xor(F.xxhash64(F.lit(i), "node")).alias(f"x{i}") for i in range(2)]
    held = tagged.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size"), *print_).filter("lo < hi")
    return cut(held.groupBy("x0", "x1", "size").agg(F.min("bucket").alias("bucket")).select("bucket", "size"), "links-mixed")


def _possible(pairs: DataFrame, facts: DataFrame, may: Callable[[str, str], Column]) -> DataFrame:
    side = lambda p, k: facts.select(F.col("node").alias(k), *(F.col(c).alias(f"{p}_{c}") for c in facts.columns if c != "node"))
    return cut(pairs.join(side("a", "a"), "a").join(side("b", "b"), "b").filter(may("a_", "b_")).select("a", "b").hint("rebalance"), "links-possible")
