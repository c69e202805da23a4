"""Best-fit packing of token sequences: best-two-fit over the histogram of piece lengths.

Pieces of equal length are alike to a packing, so bins are planned on counts: a bin's pattern is
filled greedily with the longest lengths that fit, then its smallest piece gives way to two
unpacked ones where these fill the gap more tightly; the pattern repeats as often as the counts
allow. At most `size` lengths exist, so the plan's size doesn't depend on the number of pieces.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, small_batches
from .token_counts import ODD, tokenizer

SIZE, END = 1024, 2
#: Parts among which the pieces of one length are spread for numbering: PARTS at least, more where a part would hold over PART_ROWS.
PARTS, PART_ROWS = 128, 500_000
#: Encoded words that a worker remembers.
REMEMBERED = 100_000
_NEXT_TO_SPACE = re.compile(r" [ \t\n\r]|[\t\n\r] ")


def merge_ranks(path: str) -> dict[bytes, int] | None:
    """Token bytes to ids of a byte-level tokenizers file, where ids follow the order of the merges (else None)."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    ids = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if ids != sorted(ids):
        return None
    # The visible stand-ins of bytes: printable ones for themselves, the others from code point 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [x for x in range(256) if x not in shown]
    byte = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(hidden)}
    return {bytes(byte[c] for c in t): i for t, i in vocab.items() if all(c in byte for c in t)}


class Encoder(dict):
    """Texts to token ids (little-endian uint32 bytes), by the words that single spaces part.

    A byte-level pre-tokenizer joins a single space to the word behind it, so the ids of a text are
    those of its first word and of each ` word`; these are remembered. Texts with an unusual
    character, a special token's string or other white space beside a space are encoded whole.
    Words are merged by rank, which gives what the tokenizer's list of merges gives."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        super().__init__()
        self.tok = tokenizer(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        ranks = merge_ranks(path)
        self.ids = self.slow
        if ranks:
            self.ids = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def slow(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = array("I", self.ids(f" {word}")).tobytes()
        return value

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if ODD.search(text) or _NEXT_TO_SPACE.search(text) or any(s in text for s in self.special):
            return array("I", self.slow(text)).tobytes()
        first, *rest = text.split(" ")
        return array("I", self.ids(first)).tobytes() + b"".join(map(self.__getitem__, rest))


def _cut(batches: Iterator[pa.RecordBatch], path: str, size: int, end: int) -> Iterator[pa.RecordBatch]:
    made = Encoder(path)
    stop = np.array([end], "<u4").tobytes()
    for b in batches:
        for at in range(0, b.num_rows, 1000):
            part = b.slice(at, 1000)
            docs, piece, start, length, crc = [], [], [], [], []
            for i, t in enumerate(part.column(1)):
                ids = made.encode(t.as_py()) + stop
                n = len(ids) // 4
                first = (n - 1) % size + 1
                edges = [0, *range(first, n + 1, size)]
                for k, (a, z) in enumerate(zip(edges, edges[1:], strict=False)):
                    docs.append(i), piece.append(k), start.append(a), length.append(z - a), crc.append(zlib.crc32(ids[4 * a : 4 * z]))
            ids = part.column(0).take(pa.array(docs, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])


def plan(counts: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best-two-fit: (copies, [(length, times), ...]) of the patterns that use up counts (length: pieces)."""
    left = np.zeros(size + 1, np.int64)
    for k, n in counts.items():
        left[k] = n
    out = []
    while len(there := np.flatnonzero(left)):
        used = np.zeros(size + 1, np.int64)
        gap = size
        for k in there[::-1]:  # greedily, the longest first
            if k <= gap and (n := min(int(left[k]), gap // int(k))):
                used[k] = n
                gap -= n * int(k)
        small = int(np.flatnonzero(used)[0])
        if gap and used.sum() > 1:
            used[small] -= 1
            free = np.flatnonzero(left - used > 0)
            free = free[free < gap + small]
            # The two free lengths of the largest sum within the gap.
            best, i, j = (small, 0, 0), 0, len(free) - 1
            while i <= j:
                a, b = int(free[i]), int(free[j])
                if a + b > gap + small:
                    j -= 1
                    continue
                if a + b > best[0] and (i < j or left[a] - used[a] > 1):
                    best = (a + b, a, b)
                i += 1
            if best[1]:
                used[best[1]] += 1
                used[best[2]] += 1
            else:
                used[small] += 1
        at = np.flatnonzero(used)
        copies = int((left[at] // used[at]).min())
        left[at] -= used[at] * copies
        out.append((copies, [(int(k), int(used[k])) for k in at[::-1]]))
    return out


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, end: int = END, text: str = "text") -> DataFrame:
    """The pieces of all documents and their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids by the tokenizers file at path (one that every executor has; by default the
    public byte-level vocabulary) and the id `end`. One of more than size ids is cut into pieces of
    size, the first shorter. Sequences hold size ids at most.

    Pieces are numbered within their length: counts of length and hashed part give each part its offset, and
    ranks are taken within parts, whose number follows that of pieces, so that neither a frequent
    length nor copies of one text are one task. The number finds the place in the plan by a join on the length and a range of numbers.

    Null texts count as empty: one piece of the end id. Repeated rows are each packed. An empty table gives an empty one.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    pieces = rows.mapInArrow(lambda b: _cut(b, path, size, end), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")
    mark = F.xxhash64("doc_id", "piece", "ids_crc32").alias("mark")
    with small_batches(spark):
        pieces = cut(pieces.select("*", mark), "pack-pieces", scan=True)
    parts = max(PARTS, -(-pieces.count() // PART_ROWS))
    pieces = pieces.withColumn("part", F.pmod("mark", F.lit(parts)).cast("int")).drop("mark")
    counts = cut(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "pack-counts")
    entries, sequence, starts = [], 0, dict.fromkeys(range(size + 1), 0)
    for copies, pattern in plan({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, size):
        offset = 0
        for length, times in pattern:
            entries.append((length, starts[length], starts[length] + times * copies, times, sequence, offset))
            starts[length] += times * copies
            offset += times * length
        sequence += copies
    # As an Arrow table: rows would pass through Python workers of another kind, which then stay beside those of the tokenizer.
    names = ["length", "first", "stop", "times", "sequence", "base"]
    placed = spark.createDataFrame(pa.table([pa.array(x, pa.int64()) for x in zip(*entries, strict=True)] or [pa.array([], pa.int64())] * len(names), names))
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("length", "part", before.alias("before"))
    rank = F.row_number().over(W.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = pieces.withColumn("rank", rank).join(offsets, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    found = ranked.join(F.broadcast(placed), (ranked.length == placed.length) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("stop"))).drop(placed.length)
    nth = F.col("rank") - F.col("first")
    return found.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.floor(nth / F.col("times"))).alias("sequence_id"), (F.col("base") + nth % F.col("times") * F.col("length")).alias("offset"),
    )
