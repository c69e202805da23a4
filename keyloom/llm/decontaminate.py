"""Documents that hold benchmark items: CGK embedding, bit-sampling LSH, exact edit verification.

The random walk of a window of words w copies the current word at each step and moves on where a
random bit of (step, word) says so. Windows at a small edit distance soon walk in step, so their
walks differ in few places: edit distance becomes Hamming distance. A key is a sample of places
of a walk; windows are as long as the items, and the number of walks and samples follows their
length, so that the recall doesn't fall with it. Candidates are verified by the exact
edit distance (in words) of the item to the part of the text that fits it best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, bitmap, cut, in_bitmap, row_key, small_batches, without
from .minhash import mixed

#: Edits (insertions, deletions, replacements of words) per word of an item within which it counts as held.
MAX_EDITS = 0.2
#: Walks of a window.
WALKS = 4
#: Sizes of windows follow each other in this ratio, so a window covers four fifths of an item at least.
RATIO = 1.25
#: Keys of windows that are made at once; their walks have up to 24 times as many steps.
KEYS = 250_000
#: Bytes of texts (and free places behind them) that are worked on at once.
CHUNK = 1_000_000
_SPACED = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256)).lower()
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def words_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased."""
    return (text or "").encode("utf-8", "replace").translate(_SPACED).split()


def window_of(n: int) -> int:
    """Words of the windows that items of n words are sought by: n, from 8 on the next lower one of sizes that grow by RATIO."""
    if n < 8:
        return n
    at = 8
    while (more := max(at + 1, round(at * RATIO))) <= n:
        at = more
    return at


def sampling(size: int) -> tuple[int, int]:
    """(samples of each walk, places of a sample) for windows of `size` words.

    The longer a window with a fifth of its words edited, the less often its walk agrees with the item's
    (0.7 of the places at 8 words, 0.2 at 250, 0.15 at 500): longer ones take fewer places and more samples."""
    return 12 * max(1, round(size / 128)), 3 if size <= 32 else 2


def allowed(n: int, max_edits: float) -> int:
    return int(n * max_edits)


def walk_keys(tokens: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """The keys (a row for each of starts, WALKS times the samples) of the windows of `size` tokens at starts; tokens goes on for `size` beyond the last start."""
    samples, places = sampling(size)
    steps = max(places, (3 * size) // 2)  # after these, 3/4 of the window on average
    taken, salt = np.empty((WALKS, samples, places), np.int64), np.empty((WALKS, steps, 1), np.uint64)
    for w in range(WALKS):
        rng = np.random.default_rng([w, size])
        taken[w] = np.sort([rng.choice(steps, places, replace=False) for _ in range(samples)])
        salt[w, :, 0] = rng.integers(0, 2**63, steps, np.uint64)
    walked = np.empty((WALKS, steps, len(starts)), np.uint64)
    at, end = np.tile(starts, (WALKS, 1)), starts + size
    for j in range(steps):
        walked[:, j] = now = np.where(at < end, tokens[np.minimum(at, len(tokens) - 1)], np.uint64(0))
        at += (mixed(now ^ salt[:, j]) >> np.uint64(63)).view(np.int64)
    walk = np.arange(WALKS)[:, None]
    keys = (np.uint64(size * WALKS) + walk.astype(np.uint64))[:, :, None]
    for p in range(places):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + walked[walk, taken[:, :, p]])
    return mixed(keys + np.arange(samples, dtype=np.uint64)[:, None]).reshape(WALKS * samples, -1).T


def held_distance(item: list[bytes], text: list[bytes]) -> tuple[int, int]:
    """(least edit distance of item to any part of text, end of that part), by Myers' bit vectors over words."""
    where: dict[bytes, int] = {}
    for i, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << i
    n = len(item)
    ones, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score = ones, 0, n
    best = (n, 0)
    for j, w in enumerate(text, 1):
        same = where.get(w, 0)
        x = same | down
        flat = ((((same & up) + up) ^ up) | same) & ones
        right, left = (down | ~(flat | up)) & ones, up & flat
        score += bool(right & top) - bool(left & top)
        right, left = right << 1 & ones, left << 1 & ones
        up, down = (left | ~(x | right)) & ones, right & x
        best = min(best, (score, j))
    return best


def neighbours(tokens: np.ndarray) -> np.ndarray:
    """For each token a hash of it and the next one."""
    return mixed(tokens[:-1] * np.uint64(0x9E3779B97F4A7C15) + tokens[1:])


def laid_out(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(the texts as words parted by spaces, where each word begins and ends in it, words before each text and in all); as `words_of` parts them."""
    data = b"".join((b" ", b" ".join(texts), b" " * 8)).translate(_SPACED)
    space = np.frombuffer(data, np.uint8) == 32
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    before = np.searchsorted(edges[::2], np.cumsum([1, *(len(t) + 1 for t in texts)]))
    return data, edges[::2], edges[1::2], before


def outlines(data: bytes, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of each word's length and first and last eight bytes: equal for equal words, and made for all words at once."""
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    long = last - first
    mask = _FIRST_BYTES[np.minimum(long, 8)]
    head, tail = eight[first] & mask, eight[np.maximum(last - 8, first)] & mask
    return mixed(mixed(head + long.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0x9E3779B97F4A7C15) + tail)


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, first, last, before = laid_out([t.as_py() or b"" for t in b.column("text").cast(pa.binary())])
        tokens = np.split(outlines(data, first, last), before[1:-1])
        for of, found in enumerate((tokens, [neighbours(t) for t in tokens if len(t)])):
            found = np.unique(np.concatenate([np.empty(0, np.uint64), *found])).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), of, np.int32)), pa.array(found)], ["of", "word"])


def _item_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = Words()
    for b in batches:
        for item, text in zip(b.column("item_id"), b.column("text").to_pylist(), strict=True):
            if w := words_of(text):
                k = walk_keys(cache.hashes(w), np.zeros(1, np.int64), window_of(len(w)))[0]
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array([item.as_py()] * len(k), item.type), pa.array([b" ".join(w).decode("utf-8", "replace")] * len(k))], ["key", "item_id", "item"])


def _candidates(batches: Iterator[pa.RecordBatch], windows: dict[int, tuple[int, int]], vocabulary: tuple[np.ndarray, np.ndarray], marks: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    cache = Words()
    most = max(windows)

    def chunk(ids: list, own: list, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        data, first, last, before = laid_out(texts)
        # Behind each text `most` places are free, so that no window reaches from one into the next.
        place = np.arange(len(first)) + np.repeat(np.arange(len(texts)) * most, np.diff(before))
        firsts = before + np.arange(len(before)) * most
        seen = np.zeros(firsts[-1], np.uint64)
        seen[place] = outlines(data, first, last)
        known = np.concatenate([np.zeros(1, np.int32), np.cumsum(in_bitmap(vocabulary[0], seen) & (seen != 0), dtype=np.int32)])
        paired = np.concatenate([np.zeros(1, np.int32), np.cumsum(in_bitmap(vocabulary[1], neighbours(seen)), dtype=np.int32)])
        walked, edge = {}, np.zeros(len(seen) + 1, np.int32)
        for size, (edits, _) in windows.items():
            n = len(seen) - size + 1
            # An edit changes one word and two pairs of neighbours at most.
            walked[size] = starts = np.flatnonzero((known[size : size + n] - known[:n] >= max(1, size - edits)) & (paired[size - 1 : size - 1 + n] - paired[:n] >= size - 1 - 2 * edits))
            edge[starts] += 1
            edge[starts + size] -= 1
        # Only words of windows that are walked are hashed whole.
        some = np.flatnonzero(np.cumsum(edge)[place])
        tokens = np.zeros(len(seen), np.uint64)
        tokens[place[some]] = cache.hashes([data[i:j] for i, j in zip(first[some].tolist(), last[some].tolist(), strict=True)])
        for size, (edits, longest) in windows.items():
            starts, step = walked[size], max(1, KEYS // (WALKS * sampling(size)[0]))
            for at in range(0, len(starts), step):
                part = starts[at : at + step]
                k = walk_keys(tokens, part, size)
                row, col = np.nonzero(in_bitmap(marks[0], k))
                both = in_bitmap(marks[1], k[row, col] >> np.uint64(32))
                row, col = row[both], col[both]
                if not len(row):
                    continue
                doc = np.searchsorted(firsts, part[row], "right") - 1
                # Passages begin at multiples of the edits, so that windows near each other give one.
                grid = max(1, edits)
                begin = np.maximum(part[row] - firsts[doc] - edits, 0) // grid * grid
                kept = np.unique(np.stack([col, begin, doc, k[row, col].view(np.int64)]), axis=1, return_index=True)[1]
                row, col, doc, begin = row[kept], col[kept], doc[kept], begin[kept]
                a, b = before[doc] + begin, np.minimum(before[doc] + begin + longest + 3 * edits + grid, before[doc + 1])
                cuts = [b" ".join(data[first[i] : last[j - 1]].split()).decode("utf-8", "replace") if i < j else "" for i, j in zip(a.tolist(), b.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(k[row, col].view(np.int64)), pa.array([ids[d] for d in doc], pa.int64()), pa.array([own[d] for d in doc], pa.int64()), pa.array(begin), pa.array(cuts, pa.string())], ["key", "doc_id", "row", "at", "part"])

    for b in batches:
        ids, own, texts, size = [], [], [], 0
        for i, r, t in zip(b.column("doc_id").to_pylist(), b.column("row").to_pylist(), b.column("text").cast(pa.binary()), strict=True):
            text = t.as_py() or b""
            ids.append(i), own.append(r), texts.append(text)
            size += len(text) + most
            if size > CHUNK:
                yield from chunk(ids, own, texts)
                ids, own, texts, size = [], [], [], 0
        if ids:
            yield from chunk(ids, own, texts)


def _verified(batches: Iterator[pa.RecordBatch], max_edits: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        near, ends, wanted = [], [], {}
        for item, part in zip(b.column("item").to_pylist(), b.column("part").to_pylist(), strict=True):
            if item not in wanted:
                words = item.encode("utf-8").split()
                wanted[item] = words, set(words), allowed(len(words), max_edits)
            words, distinct, most = wanted[item]
            text = part.encode("utf-8").split()
            # Each word that the part lacks takes an edit.
            lacks = len(distinct.difference(text))
            d, end = held_distance(words, text) if lacks <= most else (lacks, 0)
            near.append(d if d <= most else None)
            ends.append(end)
        at = pa.array(np.array(ends, np.int64) + b.column("at").to_numpy())
        out = pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), b.column("item_id"), pa.array(near, pa.int64()), at], ["doc_id", "row", "item_id", "edits", "end_word"])
        yield out.filter(out.column("edits").is_valid())


def contaminated(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS, text: str = "text") -> DataFrame:
    """(doc_id, item_id, edits, end_word) for each benchmark item that a document holds within
    max_edits edits a word: the fewest edits, and the first place (words from 0, exclusive) where the passage with them ends.

    Every place of every text is a window. A window is walked only where enough of its words and
    pairs of neighbouring words occur in the benchmark at all: with e edits allowed, all but e
    words and all but 2 e pairs must, so nothing is lost. For that, and to send on only windows
    whose key some item has, tasks hold bitmaps (of the benchmark's words, pairs and the two halves of keys) whose
    size follows their number up to a bound; the keys then meet by an ordinary
    equi-join, and words are compared exactly in the end.

    Null or wordless texts and items hold nothing and are held by nothing. Rows that repeat a
    doc_id are one document; null doc_ids are kept as one too. Equal items are all reported. Empty tables give an empty one.
    """
    found = _found(docs, benchmark, max_edits, text)
    return found.groupBy("doc_id", "item_id").agg(F.min(F.struct("edits", "end_word")).alias("m")).select("doc_id", "item_id", "m.edits", "m.end_word")


def _found(docs: DataFrame, benchmark: DataFrame, max_edits: float, text: str) -> DataFrame:
    """(doc_id, row, item_id, edits, end_word) of all verified windows; row is the document's row_key."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key("doc_id", text).alias("row"), F.col(text).cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    keys = cut(items.mapInArrow(_item_keys, "key long, item_id long, item string"), "leak-keys")
    lengths = [r.n for r in keys.select(F.size(F.split("item", " ")).alias("n")).distinct().collect()]
    # One entry for each window size: the most edits and words of its items; log(longest item) sizes.
    windows: dict[int, tuple[int, int]] = {}
    for n in sorted(lengths):
        windows[window_of(n)] = (allowed(n, max_edits), n)
    schema = "doc_id long, row long, item_id long, edits long, end_word long"
    if not windows:
        return docs.sparkSession.createDataFrame([], schema)
    said = cut(items.mapInArrow(_vocabulary, "of int, word long"), "leak-words")
    vocabulary = bitmap(said.filter("of = 0"), "word"), bitmap(said.filter("of = 1"), "word")
    marks = bitmap(keys, "key"), bitmap(keys.select(F.shiftright("key", 32).alias("key")), "key")
    found = rows.mapInArrow(lambda b: _candidates(b, windows, vocabulary, marks), "key long, doc_id long, row long, at long, part string")
    pairs = cut(found.join(keys, "key").select("doc_id", "row", "item_id", "at", "part", "item").distinct(), "leak-candidates")
    return pairs.mapInArrow(lambda b: _verified(b, max_edits), schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS) -> DataFrame:
    """docs (its columns) without the rows whose text holds an item, told apart by doc_id and text; only rows that may go are shuffled."""
    with small_batches(docs.sparkSession):
        bad = cut(_found(docs, benchmark, max_edits, "text").select(F.col("row").alias("__key")).distinct(), "leak-documents")
    return without(docs, bad, "doc_id", "text")
