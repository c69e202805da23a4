"""Near-duplicate documents: an inverted join on MinHash signature coordinates.

Each document's signature has COORDINATES values; a coordinate and its value are one item. Two
documents are candidates where MATCHES items or more collide, of the first POSTED coordinates
AGREE or more. The items of these are ordered by how many documents hold them, rarest first: two
documents with AGREE common ones share one among the first POSTED - AGREE + 1 items of each, so
only these are posted, and the lists skipped are the longest. Candidates' collisions are
then counted on whole signatures.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, cut, free, may_hold, row_key, scratch, small_batches, without
from .components import linked

#: A pair of Jaccard similarity 0.8 has fewer than AGREE collisions in POSTED coordinates, or than MATCHES in
#: all, with probability 4e-7 (binomial); one of 0.85 with 3e-10.
COORDINATES, MATCHES = 64, 34
POSTED, AGREE = 28, 9
#: Longs of a set's odd sketch: a bit for each class of shingles, set where their number is odd. Two sets differ
#: in at least as many shingles as their sketches do in bits, so comparing these loses nothing.
ODD = 8
BANDS = 40
SHINGLE = 5
_SEED = np.random.default_rng(20240229)
_A = _SEED.integers(1, 2**63, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _SEED.integers(0, 2**63, COORDINATES, np.uint64)
_M = _SEED.integers(1, 2**63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, words: Words, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of `width` words (A-Z lower-cased, parted by ASCII white space)."""
    w = words.hashes((text or "").encode("utf-8", "replace").lower().split())
    if not len(w):
        return w
    if len(w) < width:
        return mixed(np.array([np.bitwise_xor.reduce(mixed(w + _M[: len(w)] * np.uint64(len(w))))], np.uint64))
    n = len(w) - width + 1
    out = w[:n] * _M[0]
    for i in range(1, width):
        out = mixed(out) + w[i : n + i] * _M[i]
    return np.unique(mixed(out))


def signature(s: np.ndarray) -> np.ndarray:
    out = np.full(COORDINATES, 2**32 - 1, np.uint64)
    for at in range(0, len(s), 4096):
        part = s[at : at + 4096, None] * _A + _B
        out = np.minimum(out, (part >> np.uint64(32)).min(axis=0))
    return out.astype(np.uint32).view(np.int32)


def _banded(nodes: DataFrame) -> DataFrame:
    """Postings of nodes under BANDS samples of four coordinates: a pair of 0.8 shares none with probability 7e-10."""
    rng = np.random.default_rng(11)
    bands = [sorted(rng.choice(COORDINATES, 4, replace=False).tolist()) for _ in range(BANDS)]
    return nodes.select("node", F.explode(F.array(*(F.xxhash64(F.lit(-1 - n), *(f"s{i}" for i in b)) for n, b in enumerate(bands)))).alias("bucket"))


def odd_sketch(s: np.ndarray) -> np.ndarray:
    classes = (s >> np.uint64(64) - np.uint64((64 * ODD).bit_length() - 1)).astype(np.int64)
    return np.packbits((np.bincount(classes, minlength=64 * ODD) & 1).astype(np.uint8), bitorder="little").view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    import xxhash

    words = Words()
    for b in batches:
        ids, keys, texts = b.column("doc_id"), b.column("key"), b.column("text")
        n, prints, sigs, odd = [], [], [], []
        for t in texts:
            s = shingles(t.as_py(), words, width)
            n.append(len(s))
            prints.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            sigs.append(signature(s))
            odd.append(odd_sketch(s))
        flat = np.array(sigs, np.int32).reshape(len(n), COORDINATES)
        sketch = np.array(odd, np.int64).reshape(len(n), ODD)
        yield pa.RecordBatch.from_arrays(
            [ids, keys, pa.array(n, pa.int64()), pa.array(prints, pa.binary()), *(pa.array(np.ascontiguousarray(sketch[:, i])) for i in range(ODD)), *(pa.array(np.ascontiguousarray(flat[:, i])) for i in range(COORDINATES))],
            ["doc_id", "key", "n_shingles", "print", *(f"o{i}" for i in range(ODD)), *(f"s{i}" for i in range(COORDINATES))],
        )


def _agree(a: str, b: str, percent: int) -> Column:
    m, n = F.col(f"{a}n_shingles"), F.col(f"{b}n_shingles")
    apart = sum(F.bit_count(F.col(f"{a}o{i}").bitwiseXOR(F.col(f"{b}o{i}"))) for i in range(ODD))
    alike = sum((F.col(f"{a}s{i}") == F.col(f"{b}s{i}")).cast("int") for i in range(COORDINATES))
    return (100 * F.least(m, n) >= percent * F.greatest(m, n)) & ((100 + percent) * apart <= (100 - percent) * (m + n)) & (alike >= MATCHES)


def _checked(batches: Iterator[pa.RecordBatch], percent: int, width: int) -> Iterator[pa.RecordBatch]:
    words, last, mine = Words(), None, np.empty(0, np.uint64)
    for b in batches:
        keep = []
        for i in range(b.num_rows):
            if (a := b.column("a")[i].as_py(), text := b.column("a_text")[i].as_py()) != last:
                last, mine = (a, text), shingles(text, words, width)
            other = shingles(b.column("b_text")[i].as_py(), words, width)
            both = len(np.intersect1d(mine, other, assume_unique=True))
            keep.append(100 * both >= percent * (len(mine) + len(other) - both) and both > 0)
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = SHINGLE, text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept.

    Documents are linked where 100 * |A and B| >= percent * |A or B| for their sets of distinct
    shingles; component_id is the least doc_id reachable, kept says doc_id = component_id. A text
    of fewer words is one shingle; a null text, or one without words, has none and links to nothing.

    Equal sets are one class from the start (a combinable min), so exact copies make no pairs;
    classes that share a posted item are linked by `components.linked` and confirmed on whole sets.
    Null doc_ids are linked with nothing (component_id null, kept true); rows that repeat a doc_id
    are judged each by its own text, equal ones alike; an empty table gives an empty one. Other columns don't matter.
    """
    out = _judged(docs, percent, width, text)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least.doc_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = 80, width: int = SHINGLE) -> DataFrame:
    """docs (its columns) with one row of each group of `near_duplicates`, the one of the least doc_id.

    Rows are told apart by doc_id and text: of rows equal in both one stays, a row that repeats a doc_id with another
    text is judged by that text. Rows without a doc_id or without words stay. Only rows that may go are shuffled."""
    out = cut(_judged(docs, percent, width, "text").filter("least is not null").select("key", (F.struct("doc_id", "key") == F.col("least")).alias("stays")), "minhash-judged")
    gone = cut(out.filter("not stays").select(F.col("key").alias("__key")).distinct(), "minhash-gone")
    again = cut(out.filter("stays").groupBy(F.col("key").alias("__key")).agg(F.count("*").alias("n")).filter("n > 1").select("__key"), "minhash-again")
    left = without(docs, gone, "doc_id", "text")
    if again.isEmpty():
        return left
    own = free(docs)
    key, twice = f"{own}key", f"{own}twice"
    again = again.select(F.col("__key").alias(key), F.lit(True).alias(twice))
    held = may_hold(again, key)
    keyed = left.withColumn(key, row_key("doc_id", "text"))
    some = keyed.filter(held(key)).join(again.hint("merge"), key, "left")
    once = some.filter(F.col(twice)).dropDuplicates([key]).unionByName(some.filter(F.col(twice).isNull()))
    return keyed.filter(~held(key)).select(docs.columns).unionByName(once.select(docs.columns))


def _judged(docs: DataFrame, percent: int, width: int, text: str) -> DataFrame:
    """For each row of docs: doc_id, key (its row_key), n_shingles, least: the least (doc_id, key) reachable, null where it links with nothing."""
    with small_batches(docs.sparkSession), scratch(docs.sparkSession, ("minhash-signatures", "minhash-result")):
        return _classed(docs, percent, width, text)


def _classed(docs: DataFrame, percent: int, width: int, text: str) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key("doc_id", text).alias("key"), F.col(text).cast("string").alias("text"))
    fields = ", ".join(["doc_id long", "key long", "n_shingles long", "print binary", *(f"o{i} long" for i in range(ODD)), *(f"s{i} int" for i in range(COORDINATES))])
    sigs = cut(rows.mapInArrow(lambda b: _signed(b, width), fields), "minhash-signatures", scan=True)
    owned = sigs.filter("print is not null and doc_id is not null")
    reps = cut(owned.groupBy("print").agg(F.min(F.struct("doc_id", "key")).alias("first"), F.min("n_shingles").alias("n_shingles"), *(F.min(f"o{i}").alias(f"o{i}") for i in range(ODD)), *(F.min(f"s{i}").alias(f"s{i}") for i in range(COORDINATES))).withColumn("node", F.xxhash64("print")), "minhash-classes")
    facts = reps.drop("print").withColumn("id", F.col("first.doc_id")).drop("first")
    item = F.explode(F.array(*(F.xxhash64(F.lit(i), F.col(f"s{i}")) for i in range(POSTED)))).alias("bucket")
    items = reps.select("node", item)
    counted = cut(items.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "minhash-items")
    held = items.join(counted, "bucket").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "bucket"))).alias("i"))
    # Items that no other document holds come first in the order and need no posting.
    room = F.size("i") - (AGREE - 1)
    postings = cut(held.filter(room > 0).select("node", F.explode(F.slice("i", F.lit(1), room)).alias("i")).select("i.bucket", "node").distinct(), "minhash-postings")

    def verify(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        ids = cut(reps.select("node", "first.key").join(wanted, "node", "left_semi").hint("rebalance"), "minhash-wanted")
        some = may_hold(ids, "key")
        texts = cut(rows.select("key", "text").filter(some("key")).join(ids, "key").dropDuplicates(["node"]).select("node", "text"), "minhash-texts")
        side = lambda p: texts.select(F.col("node").alias(p), F.col("text").alias(f"{p}_text"))
        full = pairs.join(side("a"), "a").join(side("b"), "b").sortWithinPartitions("a")
        return full.mapInArrow(lambda b: _checked(b, percent, width), "a long, b long").distinct()

    comp = linked(postings, facts, lambda a, b: _agree(a, b, percent), verify, _banded, hub="id", once=True)
    grouped = cut(reps.select("print", "node", "first").join(comp, "node", "left").select("print", "first", F.coalesce("component", "node").alias("component")), "minhash-components")
    least = cut(grouped.groupBy("component").agg(F.min("first").alias("least")), "minhash-least")
    classes = cut(grouped.join(least, "component").select("print", "least"), "minhash-result")
    out = sigs.select("doc_id", "key", "n_shingles", "print").join(classes, "print", "left")
    return out.withColumn("least", F.when(F.col("doc_id").isNotNull(), F.col("least"))).drop("print")
