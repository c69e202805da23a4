"""The numbered queries over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, license_scan, line_dedup, lm_scoring, minhash, packing, quality, sharding, token_counts, url_filter
from .common import read_table

#: The rules of op1.
URL_RULES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
)
SHARDS = 24
LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(read_table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"), percent=85)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    out = quality.judge(read_table(spark, sf_dir, "documents").select("doc_id", "text"), always=base)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select("doc_id", *base, failed.alias("base_failed"), "kept")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.repeated_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    out = sharding.assign(docs, SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(read_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(read_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), size=1024, end=2)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    out = lm_scoring.score(read_table(spark, sf_dir, "documents").select("doc_id", "text"), ~held_out)
    return out.select("doc_id", (~F.col("learns")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filters, op2_minhash_near_dedup, op3_quality_rules, op4_line_dedup, op5_decontamination,
        op6_sharding, op7_token_counts, op8_license_scan, op9_best_fit_packing, op10_lm_scoring,
    )
}

_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
SQL: dict[str, str] = {
    "op1_url_filters": f"""
with rules(h, p, v) as (values {_RULES}),
rest as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as r from pages),
parts as (select page_id, translate(regexp_extract(r, '^[^/?#]*', 0), {LOWER}) as host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path from rest),
best as (select host, path, arg_max(h || p, length(h || p)) as rule, arg_max(v, length(h || p)) as v
  from (select distinct host, path from parts) join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by host, path)
select page_id, parts.host, parts.path, rule, coalesce(v, 'allow') as verdict
from parts left join best on parts.host = best.host and parts.path = best.path""",
    "op2_minhash_near_dedup": f"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '[^\\x20\\x09-\\x0D]+') as ws from documents),
s as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
  else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) end as g from w),
e as (select doc_id, unnest(g) as g from s),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as n from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
near as (select a, b from pairs join s x on x.doc_id = a join s y on y.doc_id = b where 100 * n >= 85 * (len(x.g) + len(y.g) - n)),
links as (select a, b from near union select b, a from near),
reach(d, c) as (select doc_id, doc_id from documents union select reach.d, links.b from reach join links on links.a = reach.c),
least as (select d, min(c) as c from reach group by d)
select doc_id, len(g) as n_shingles, c as component_id, doc_id = c as kept from s join least on d = doc_id""",
    "op3_quality_rules": """
with w as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from documents),
g as (select doc_id, unnest(range(1, greatest(len(ws) - 1, 1))) as i, unnest(list_transform(range(1, greatest(len(ws) - 1, 1)), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) as g from w),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from g) where n > 1),
again as (select doc_id, count(distinct i + k) as n from twice, range(0, 3) r(k) group by doc_id),
f as (select w.doc_id, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) as n_symbols,
  len(ls) as n_lines, len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(again.n, 0) as n_repeat_words,
  len(list_filter(ws, lambda x: regexp_matches(x, '\\pL'))) as n_letter_words from w left join again on again.doc_id = w.doc_id),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from f)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or 10 * n_symbols > n_words or word_chars < 3 * n_words or word_chars > 12 * n_words or 2 * n_dup_lines > n_lines or 10 * n_letter_words < 8 * n_words) as kept from b""",
}
