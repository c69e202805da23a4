"""URL allow and block rules by hashed host-suffix and path-prefix expressions (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lower_ascii

#: Hex digits of a digest that the first join compares (32 bits).
PREFIX_HEX = 8


def url_host(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def url_path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict (columns of these names are replaced).

    rules: host, path, verdict (allow or block). A rule fits its host and all its subdomains
    where the url's path starts with the rule's. The longest rule wins, of equally long ones
    that with the longer host, of equal ones block.

    Distinct hosts are expanded to their suffixes, which meet the rules' hosts; a url is then expanded to
    the path prefixes of the lengths that the rules of its suffixes have, and these expressions meet the
    rules. Both are equi-joins on the first 32 bits of a SHA-256, which the full digest confirms. The
    best rule of each (host, path) is found by a combinable max, then joined to the pages, so a host that
    a third of the pages share is one aggregate row. Rules may be of any number and form.

    Null or malformed urls: host and path are empty, no rule fits and the default holds.
    Repeated pages are all judged; an empty table gives an empty one; without rules the default holds.
    """
    rules = rules.select(
        lower_ascii(F.coalesce("host", F.lit(""))).alias("h"), F.coalesce("path", F.lit("")).alias("p"), F.col("verdict").alias("v")
    ).withColumns({"n": F.length("p"), "rule": F.concat("h", "p")})
    digest = lambda c: F.sha2(c, 256)
    short = lambda c: F.substring(c, 1, PREFIX_HEX)
    # A host holds no slash, so the first one parts an expression in one way only.
    said = digest(F.concat("h", F.lit("/"), "p"))
    listed = rules.select(
        short(said).alias("x"), said.alias("d"),
        F.struct(F.length("rule").alias("len"), F.length("h").alias("hlen"), (F.col("v") == "block").alias("block"), F.col("rule"), F.col("v")).alias("r"),
    )
    lengths = rules.groupBy("h").agg(F.collect_set("n").alias("ns")).withColumn("d", digest(F.col("h"))).withColumn("x", short(F.col("d")))
    parts = pages.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, -i, i), "."))
    hosts = parts.select("host").distinct().select("host", F.explode(suffixes).alias("suffix")).withColumn("full", digest(F.col("suffix"))).withColumn("x", short(F.col("full")))
    hosts = hosts.join(lengths, "x").filter(F.col("full") == F.col("d")).select("host", "suffix", "ns")
    met = (
        parts.select("host", "path").join(hosts, "host")
        .select("host", "path", "suffix", F.explode(F.filter("ns", lambda n: n <= F.length("path"))).alias("n"))
        .select("host", "path", digest(F.concat("suffix", F.lit("/"), F.expr("substr(path, 1, n)"))).alias("full"))
        .withColumn("x", short(F.col("full")))
    )
    best = (
        met.join(listed, "x").filter(F.col("full") == F.col("d")).groupBy("host", "path").agg(F.max("r").alias("r"))
        .select("host", "path", F.col("r.rule").alias("rule"), F.col("r.v").alias("verdict"))
    )
    best = cut(best, "url-verdicts")
    out = parts.drop("rule", "verdict").join(best, ["host", "path"], "left")
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(default)))
