"""Near-duplicate lines: a segment-partition edit join over the distinct lines of a corpus.

With threshold t a line of n characters is cut into t + 1 even segments. A longer line within t edits
has at least one of them unchanged, shifted by the edits before it, so each line is indexed
under its segments and probes the substrings that a line of length n - t to n could have as
segment i, at the places that the edits left and right of it allow. Candidates are verified by
bit-parallel edit distance in a band of t around the diagonal. t depends on the shorter line of a
pair: short lines are alike only where they are equal, which their hash tells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap, cut, free, in_bitmap, may_hold, row_key, scratch, small_batches
from .components import LARGE, linked
from .minhash import mixed

#: Edits within which lines are alike: (characters of the shorter line, edits from there on), one in 20 characters at most.
EDITS = ((1, 0), (20, 1), (40, 2))
#: Least length (characters) of a line that takes part: each that holds more than white space.
MIN_CHARS = 1
_R = np.random.default_rng(5)
_CHAR = _R.integers(0, 2**63, 1 << 16, np.uint64) * np.uint64(2) + np.uint64(1)
_PLANE = np.uint64(0xA0761D6478BD642E)
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
#: Characters of texts whose substring hashes are held at once, and lines of which a task remembers at most that it has posted them (a power of two).
CHUNK, REMEMBERED = 64_000, 1 << 18
#: By base, the largest table of powers so far.
_POWERS: dict[int, np.ndarray] = {}
#: Parts into which the lines of large buckets are cut, and those of buckets that are large after that.
WINDOWS = (6, 16)


def banded_distance(a: str, b: str, limit: int) -> int:
    """Edit distance of a and b where it is at most limit, else limit + 1."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > limit:
        return limit + 1
    at = 0
    while at < len(b) and a[at] == b[at]:
        at += 1
    a, b = a[at:], b[at:]
    while b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not b:
        return len(a)
    if len(a) <= limit:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return min(row[-1], limit + 1)
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    # Bit k of column j stands for row j + k - (width - 1 - limit) of the band.
    width = 2 * limit + 2
    ones, top = (1 << width) - 1, 1 << (width - 1)
    up, down, out, edge = (ones << (width - limit - 1)) & ones, 0, limit, top >> 1
    for j, y in enumerate(b):
        shift = j + limit + 1 - width
        same = where.get(y, 0)
        same = (same >> shift if shift >= 0 else same << -shift) & ones
        flat = ((((same & up) + up) ^ up) | same | down) & ones
        right, left = (down | ~(flat | up)) & ones, flat & up
        if j < len(a) - limit:
            out += not flat & top
        else:
            out += bool(right & edge) - bool(left & edge)
            edge >>= 1
        flat >>= 1
        up, down = (left | ~(flat | right)) & ones, flat & right
    return min(out, limit + 1)


def steps_of(edits: int | tuple[tuple[int, int], ...]) -> tuple[tuple[int, int], ...]:
    """Steps as EDITS has them; a number holds for all lengths."""
    return ((1, edits),) if isinstance(edits, int) else tuple(sorted(edits))


def allowed(n: np.ndarray | int, steps: tuple[tuple[int, int], ...]) -> np.ndarray:
    """Edits within which a line of n characters is like another one that is not shorter."""
    at = np.searchsorted([least for least, _ in steps], n, "right")
    return np.array([0, *(e for _, e in steps)], np.int64)[at]


def powers(base: int, n: int) -> np.ndarray:
    """base to the powers 0 to n, from a table of a power of two entries that the worker keeps."""
    if n >= len(_POWERS.get(base, ())):
        made = np.full(1 << n.bit_length(), base, np.uint64)
        made[0] = 1
        _POWERS[base] = np.multiply.accumulate(made, out=made)
    return _POWERS[base][: n + 1]


def chunks(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """(number of the first text, texts) of runs of texts of about CHUNK characters."""
    at, size, held = 0, 0, []
    for i, t in enumerate(texts):
        held.append(t.as_py())
        size += len(held[-1] or "")
        if size > CHUNK:
            yield at, held
            at, size, held = i + 1, 0, []
    if held:
        yield at, held


class Lines:
    """The lines of some texts that have min_chars characters or more (white space at their ends
    taken off), with hashes of any of their substrings from one pass over their characters."""

    def __init__(self, texts: list[str | None], min_chars: int) -> None:
        rows, at, found = [], [], []
        for r, t in enumerate(texts):
            for i, line in enumerate((t or "").split("\n")):
                if len(line) >= min_chars and len(line := line.strip(" \t\r\x0b\x0c")) >= min_chars:
                    rows.append(r), at.append(i), found.append(line)
        self.rows, self.at, self.text = np.array(rows, np.int64), np.array(at, np.int64), found
        self.n = np.array([len(x) for x in found], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.n)[:-1]]).astype(np.int64) if found else self.n
        self.codes = np.frombuffer("".join(found).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.chars = self._chars()
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum(self.chars * powers(_BASE, len(self.chars))[:-1], dtype=np.uint64)])
            self.back = powers(_BACK, len(self.chars))
        self.h = mixed(self.part(self.start, self.n) + self.n.astype(np.uint64)) if found else np.empty(0, np.uint64)

    def _chars(self) -> np.ndarray:
        """A number for each character: by its place in its plane, and its plane."""
        if self.codes.max(initial=0) < len(_CHAR):
            return _CHAR[self.codes]
        return _CHAR[self.codes & np.uint32(0xFFFF)] + (self.codes >> np.uint32(16)).astype(np.uint64) * _PLANE

    def part(self, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (self.sums[start + n] - self.sums[start]) * self.back[start]

    def profile(self, pairs: bool) -> np.ndarray:
        """For each line a bit for each class of its characters (or pairs of neighbours): set where their number is odd."""
        if not len(self.n):
            return np.empty(0, np.int64)
        c = self.chars
        if pairs:
            c = mixed(c * np.uint64(31) + np.concatenate([c[1:], c[:1]]))
            c[self.start + self.n - 1] = 0
        bits = np.uint64(1) << ((c >> np.uint64(40)) & np.uint64(63))
        if pairs:
            bits[self.start + self.n - 1] = 0
        return np.bitwise_xor.reduceat(bits, self.start).view(np.int64)


def segment(n: np.ndarray, i: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of segment i (from 0) of lines of n characters; the last ones are longer by one."""
    q, more = n // (edits + 1), n % (edits + 1)
    short = edits + 1 - more
    return i * q + np.maximum(0, i - short), q + (i >= short)


def keys(lines: Lines, which: np.ndarray, steps: tuple[tuple[int, int], ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(key, number of the line) of all index and probe entries of the lines in which.

    Lines that allow no edit have none: those that equal them are the same node."""
    for edits in sorted({e for _, e in steps} - {0}):
        for less in range(edits + 1):
            some = which[allowed(lines.n[which] - less, steps) == edits]
            n, start = lines.n[some], lines.start[some]
            size = n - less
            for i in range(edits + 1):
                at, part = segment(size, i, edits)
                salt = (size * (edits + 1) + i).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
                low, high = max(-i, less - (edits - i)), min(i, less + (edits - i))
                for move in range(low, high + 1):
                    fits = (at + move >= 0) & (at + move + part <= n) & (part > 0)
                    yield mixed(lines.part((start + at + move)[fits], part[fits]) ^ salt[fits]), some[fits]


def _met(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for first, texts in chunks(b.column(1)):
            x = Lines(texts, min_chars)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).take(pa.array(x.rows + first)) for c in ("doc_id", "key")), pa.array(x.at), pa.array(x.h.view(np.int64)), pa.array(x.n), pa.array(x.profile(False)), pa.array(x.profile(True))],
                ["doc_id", "key", "line", "node", "n", "chars", "pairs"],
            )


def _entries(lines: Lines, found: Iterator[tuple[np.ndarray, np.ndarray]], marks: np.ndarray | None) -> pa.RecordBatch:
    """(bucket, node) of entries (key, number of the line) whose key may be marked, as one batch."""
    held = [(k, which) if marks is None else (k[some := in_bitmap(marks, k)], which[some]) for k, which in found]
    k, which = (np.concatenate([x[c] for x in held]) if held else np.empty(0, kind) for c, kind in enumerate((np.uint64, np.int64)))
    return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(lines.h[which].view(np.int64))], ["bucket", "node"])


def _posted(batches: Iterator[pa.RecordBatch], min_chars: int, steps: tuple[tuple[int, int], ...], marks: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    # Each line has one place, which a later line takes over; at first a place holds a number that belongs elsewhere.
    seen = np.arange(REMEMBERED, dtype=np.uint64) ^ np.uint64(1)
    for b in batches:
        for _, texts in chunks(b.column(0)):
            x = Lines(texts, min_chars)
            at = np.unique(x.h, return_index=True)[1]
            at = at[allowed(x.n[at], steps) > 0]
            place = (x.h[at] & np.uint64(REMEMBERED - 1)).astype(np.int64)
            new = seen[place] != x.h[at]
            seen[place] = x.h[at]
            at = at[new]
            yield _entries(x, keys(x, at, steps), marks)


def _shared(posted: Callable[[np.ndarray | None], DataFrame], name: str) -> DataFrame:
    """Of postings (bucket, node) those whose bucket holds two nodes or more, each once.

    posted makes them, of given marks only those whose bucket may be marked. Buckets are found by
    a combinable min and max; the postings of the others are not kept, but made anew for these."""
    held = cut(posted(None).groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select("bucket"), f"{name}-held")
    marks = bitmap(held, "bucket", 24)
    return cut(posted(marks).join(held, "bucket", "left_semi").distinct(), name)


def windows(lines: Lines, which: np.ndarray, steps: tuple[tuple[int, int], ...], parts: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(key, number of the line) as `keys`, of all the text outside as many of the parts as there are edits.

    Edits change so many parts of the shorter line at most; the text before, between and behind
    them is in both lines, moved by what the edits before it added or took away."""
    for edits in sorted({e for _, e in steps} - {0}):
        for less in range(edits + 1):
            some = which[allowed(lines.n[which] - less, steps) == edits]
            n, start = lines.n[some], lines.start[some]
            size = n - less
            cuts = [segment(size, i, parts - 1) for i in range(parts)]
            moves = [m for m in product(range(-edits, edits + 1), repeat=edits) if sum(map(abs, m)) <= edits and sum(m) == less]
            for number, changed in enumerate(combinations(range(parts), edits)):
                for m in moves:
                    key = mixed(size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(number * 64 + parts))
                    at, moved, fits = np.zeros_like(n), 0, np.ones(len(n), bool)
                    for i, add in (*zip(changed, m, strict=True), (None, 0)):
                        end = n if i is None else cuts[i][0] + moved
                        fits &= (0 <= at) & (at <= end) & (end <= n)
                        a, z = np.where(fits, at, 0), np.where(fits, end, 0)
                        key = mixed(key * np.uint64(31) + lines.part(start + a, z - a))
                        if i is not None:
                            moved += add
                            at = cuts[i][0] + cuts[i][1] + moved
                    yield key[fits], some[fits]


def _windowed(batches: Iterator[pa.RecordBatch], steps: tuple[tuple[int, int], ...], parts: int, marks: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for _, texts in chunks(b.column(0)):
            x = Lines(texts, 1)
            yield _entries(x, windows(x, np.arange(len(x.n)), steps, parts), marks)


def places(key: np.ndarray, line: np.ndarray) -> np.ndarray:
    """A hash of a row's key and the number of one of its lines."""
    return mixed(key.view(np.uint64) ^ mixed(line.astype(np.uint64)))


def _texts(batches: Iterator[pa.RecordBatch], rows: np.ndarray, marks: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(key, line, text) of the lines at places that may be marked, of rows whose key may be. Other rows aren't decoded."""
    for b in batches:
        b = b.filter(pa.array(in_bitmap(rows, b.column("key").to_numpy())))
        key, line, text = [], [], []
        for k, t in zip(b.column("key").to_pylist(), b.column("text"), strict=True):
            parts = (t.as_py() or "").split("\n")
            for i in np.flatnonzero(in_bitmap(marks, places(np.full(len(parts), k, np.int64), np.arange(len(parts))))).tolist():
                key.append(k), line.append(i), text.append(parts[i].strip(" \t\r\x0b\x0c"))
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(line, pa.int64()), pa.array(text, pa.string())], ["key", "line", "text"])


def _checked(batches: Iterator[pa.RecordBatch], steps: tuple[tuple[int, int], ...]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        pairs = list(zip(b.column("a_text").to_pylist(), b.column("b_text").to_pylist(), strict=True))
        limits = allowed(np.array([min(len(x), len(y)) for x, y in pairs], np.int64), steps).tolist()
        near = [banded_distance(x, y, e) <= e for (x, y), e in zip(pairs, limits, strict=True)]
        yield b.select(["a", "b"]).filter(pa.array(near, pa.bool_()))


def repeated_lines(docs: DataFrame, edits: int | tuple[tuple[int, int], ...] = EDITS, min_chars: int = MIN_CHARS, text: str = "text") -> DataFrame:
    """The lines that repeat an earlier one: doc_id, line (from 0), first_doc_id, first_line.

    Lines are the parts of a text between line feeds, without white space at their ends; those of
    min_chars characters or more take part. Lines within `edits` edits are linked (a number, or steps
    as EDITS has them, by the shorter line); a class is what links connect, its first line the one of the least (doc_id, line); all others are returned.

    Equal lines are one node from the start (a combinable min; equal in a 64-bit hash, the length and two
    profiles of 64 bits). Only (hash, hash) postings are shuffled, once for each distinct line of a
    task; a key held by very many lines goes through `components.linked`, so it makes no pairs inside
    a class, and those of different classes are dealt anew by all their text but a few windows. Texts
    of lines are read again for candidates alone.

    Null texts, or texts without such lines, have none; rows without doc_id are left out; rows that
    repeat a doc_id with another text are each judged by their own lines, rows that repeat both are one document;
    an empty table gives an empty one.
    """
    return _repeated(docs, edits, min_chars, text).drop("key")


def _repeated(docs: DataFrame, edits: int | tuple[tuple[int, int], ...], min_chars: int, text: str) -> DataFrame:
    """As `repeated_lines`, with the row_key (key) of the row that the line is in."""
    with small_batches(docs.sparkSession), scratch(docs.sparkSession, ("lines-met", "lines-known")):
        return _classed(docs, edits, min_chars, text)


def _classed(docs: DataFrame, edits: int | tuple[tuple[int, int], ...], min_chars: int, text: str) -> DataFrame:
    steps = steps_of(edits)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), row_key("doc_id", text).alias("key")).filter("doc_id is not null")
    met = cut(rows.select("doc_id", "text", "key").mapInArrow(lambda b: _met(b, min_chars), "doc_id long, key long, line long, node long, n long, chars long, pairs long"), "lines-met", scan=True)
    same, place = ["node", "n", "chars", "pairs"], ["doc_id", "line", "key"]
    lines = cut(met.groupBy(*same).agg(F.min(F.struct(*place)).alias("first"), F.count("*").alias("times")), "lines-distinct")
    postings = _shared(lambda marks: rows.select("text").mapInArrow(lambda b: _posted(b, min_chars, steps, marks), "bucket long, node long"), "lines-postings")

    def may(a: str, b: str) -> Column:
        # An edit changes the parity of two characters and of four pairs of neighbours at most.
        odd = lambda c: F.bit_count(F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}")))
        most = F.lit(0)
        for least, e in steps:
            most = F.when(F.least(f"{a}n", f"{b}n") >= least, e).otherwise(most)
        return (F.abs(F.col(f"{a}n") - F.col(f"{b}n")) <= most) & (odd("chars") <= 2 * most) & (odd("pairs") <= 4 * most)

    @F.arrow_udf("long")
    def place_of(key: pa.Array, line: pa.Array) -> pa.Array:
        return pa.array(places(key.to_numpy(), line.to_numpy()).view(np.int64))

    def texts_of(ids: DataFrame) -> DataFrame:
        # A node's text is read where it stands first.
        asked = lines.filter(may_hold(ids, "node")("node")).join(ids, "node", "left_semi").select("node", "first.key", "first.line")
        # Dealt out first: a task with two Python operators takes two workers, which then stay for the later steps.
        asked = cut(asked.hint("rebalance").withColumn("place", place_of("key", "line")), "lines-asked")
        rows_in, marks = bitmap(asked, "key"), bitmap(asked, "place")
        texts = rows.select("text", "key").mapInArrow(lambda b: _texts(b, rows_in, marks), "key long, line long, text string")
        return cut(texts.join(asked, ["key", "line"]).groupBy("node").agg(F.min("text").alias("text")), "lines-texts")

    def finer(nodes: DataFrame) -> DataFrame:
        texts, dealt = texts_of(cut(nodes.select("node").distinct(), "lines-large")), None
        for parts in WINDOWS:
            found = _shared(lambda marks: texts.select("text").mapInArrow(lambda b: _windowed(b, steps, parts, marks), "bucket long, node long"), "lines-windows")  # noqa: B023
            large = cut(found.groupBy("bucket").agg(F.count("*").alias("size")).filter(F.col("size") > LARGE).select("bucket"), "lines-large")
            if parts == WINDOWS[-1] or large.isEmpty():
                return found if dealt is None else dealt.union(found)
            small = found.join(large, "bucket", "left_anti")
            dealt = small if dealt is None else dealt.union(small)
            texts = cut(texts.join(found.join(large, "bucket", "left_semi").select("node").distinct(), "node", "left_semi"), "lines-texts")

    def verify(pairs: DataFrame) -> DataFrame:
        ids = cut(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct(), "lines-wanted")
        texts = texts_of(ids)
        side = lambda p: texts.select(F.col("node").alias(p), F.col("text").alias(f"{p}_text"))
        return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(lambda b: _checked(b, steps), "a long, b long")

    comp = linked(postings, lines.select("node", "n", "chars", "pairs"), may, verify, finer, rounds=1)
    of = cut(lines.join(comp, "node", "left").withColumn("class", F.coalesce("component", "node")).drop("component"), "lines-classed")
    firsts = cut(of.groupBy("class").agg(F.min("first").alias("class_first"), F.sum("times").alias("all")).filter("all > 1"), "lines-firsts")
    known = cut(of.join(firsts, "class").select(*same, "class_first"), "lines-known")
    again = met.join(known, same).filter(F.struct(*place) != F.col("class_first"))
    return again.select("doc_id", "line", F.col("class_first.doc_id").alias("first_doc_id"), F.col("class_first.line").alias("first_line"), "key").distinct()


def drop_repeated_lines(docs: DataFrame, edits: int | tuple[tuple[int, int], ...] = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs (its columns) without the lines of `repeated_lines`; n_chars, where docs has it, follows the text.

    A document that loses lines and has no word left is dropped: all it said stands in an earlier one.
    Rows without such lines stay where they are; only those that lose some are joined with them."""
    own = free(docs)
    key, gone, parts, kept = (own + x for x in ("key", "gone", "parts", "kept"))
    again = _repeated(docs, edits, min_chars, "text")
    lost = cut(again.groupBy("key").agg(F.collect_list(F.col("line").cast("int")).alias(gone)).withColumnRenamed("key", key), "lines-lost")
    held = may_hold(lost, key)
    keyed = docs.withColumn(key, row_key("doc_id", "text"))
    joined = keyed.filter(held(key)).join(lost.hint("merge"), key, "left")
    lines = F.split("text", "\n")
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone)), lambda i: F.get(parts, i))
    out = joined.withColumn(parts, F.when(F.col(gone).isNotNull(), lines)).withColumn(kept, F.when(F.col(gone).isNotNull(), F.array_join(left, "\n")))
    out = out.filter(F.col(kept).isNull() | F.col(kept).rlike(r"[^\x20\x09-\x0D]")).withColumn("text", F.coalesce(kept, "text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(gone).isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return keyed.filter(~held(key)).select(docs.columns).unionByName(out.select(docs.columns))
