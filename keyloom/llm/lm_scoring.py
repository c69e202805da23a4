"""Language-model scores from a sharded Elias-Fano n-gram trie.

The model interpolates absolute discounting over the orders down to add-one unigrams. Texts are
taken in chunks; a chunk asks for each of its distinct n-grams once. Contexts (all words but the
last) are dealt to shards by their hash; a shard builds its part of the trie from all chunks'
counts and answers each chunk's n-grams by two quantised numbers, from which the chunk's texts are
scored. So no task holds the whole model, what is gathered grows with the corpus, and a
frequent n-gram travels once for a chunk. The followers of a context with very many entries are
dealt to shards of their own, whose totals are added up before.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, cut
from .minhash import mixed

DISCOUNT = 0.75
#: Words of the longest n-grams.
ORDER = 2
#: Tokens of a chunk, of a shard on average, and of a context from which on its followers are spread over shards.
CHUNK, SHARD, HOT = 1_000_000, 2_000_000, 2_000_000
#: Levels of a quantised log10 probability for each unit, and the code of "not known"; down to 10**-15.9.
STEPS, UNKNOWN = 4096, 0xFFFF
#: Stands for the end of a text.
END = np.uint64(1)
_M = np.uint64(0x9E3779B97F4A7C15)
_COUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_SELECT = np.full((256, 8), 8, np.uint8)
for _i in range(256):
    for _k, _b in enumerate(b for b in range(8) if _i >> b & 1):
        _SELECT[_i, _k] = _b


class EliasFano:
    """A monotone sequence below `top`: low bytes as they are, high parts in unary as bits with a count for each 64.

    The levels lie in one anonymous memory map."""

    def __init__(self, values: np.ndarray, top: int) -> None:
        n = len(values)
        self.n, self.low_bytes = n, 0
        while top >> (8 * self.low_bytes) > 4 * max(n, 1):
            self.low_bytes += 1
        shift = np.uint64(8 * self.low_bytes)
        high = (values >> shift).astype(np.int64)
        self.buckets = (top >> (8 * self.low_bytes)) + 1
        n_bits = -(-(n + self.buckets + 1) // 64) * 64
        self.map = mmap.mmap(-1, max(1, n * self.low_bytes + n_bits // 8 + n_bits // 8))
        at = n * self.low_bytes
        self.low = np.frombuffer(self.map, np.uint8, at).reshape(n, self.low_bytes)
        self.low[:] = values.astype("<u8").view(np.uint8).reshape(n, 8)[:, : self.low_bytes]
        bits = np.zeros(n_bits, np.uint8)
        bits[high + np.arange(n)] = 1
        self.bits = np.frombuffer(self.map, np.uint8, n_bits // 8, at).reshape(-1, 8)
        self.bits[:] = np.packbits(bits, bitorder="little").reshape(-1, 8)
        ones = np.cumsum(_COUNT[self.bits].sum(1, dtype=np.uint32), dtype=np.uint32)
        self.ones = np.frombuffer(self.map, np.uint32, len(ones), at + n_bits // 8)
        self.ones[:] = ones

    def _select(self, nth: np.ndarray, one: bool) -> np.ndarray:
        """Positions of the nth (from 0) ones or zeros."""
        count = self.ones if one else (np.arange(1, len(self.ones) + 1, dtype=np.int64) * 64 - self.ones)
        word = np.searchsorted(count, nth, "right")
        nth = nth - np.where(word > 0, count[np.maximum(word, 1) - 1].astype(np.int64), 0)
        bytes_ = self.bits[word] if one else ~self.bits[word]
        sums = np.cumsum(_COUNT[bytes_], 1, dtype=np.int64)
        byte = (sums <= nth[:, None]).sum(1)
        rows = np.arange(len(nth))
        nth = nth - np.where(byte > 0, sums[rows, np.maximum(byte, 1) - 1], 0)
        return word * 64 + byte * 8 + _SELECT[bytes_[rows, byte], nth]

    def _lows(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros((len(at), 8), np.uint8)
        out[:, : self.low_bytes] = self.low[at]
        return out.view("<u8")[:, 0]

    def access(self, at: np.ndarray) -> np.ndarray:
        return ((self._select(at, True) - at).astype(np.uint64) << np.uint64(8 * self.low_bytes)) | self._lows(at)

    def successor(self, values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each value the first position in [begin, end) whose element is at least it, or end; equal is told by `holds`."""
        high = (values >> np.uint64(8 * self.low_bytes)).astype(np.int64)
        first = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) - (high - 1), 0)
        stop = self._select(high, False) - high
        at, last = np.clip(first, begin, end), np.clip(stop, begin, end)
        want = values & np.uint64((1 << 8 * self.low_bytes) - 1)
        # Equal high parts are in order of their low parts: bisect.
        live = np.flatnonzero(at < last)
        while len(live):
            middle = (at[live] + last[live]) // 2
            less = self._lows(middle) < want[live]
            at[live[less]] = middle[less] + 1
            last[live[~less]] = middle[~less]
            live = live[at[live] < last[live]]
        return at

    def holds(self, at: np.ndarray, values: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = at < end
        out[out] = self.access(at[out]) == values[out]
        return out


def quantised(x: np.ndarray) -> np.ndarray:
    """Codes of log10 probabilities: steps of 1 / STEPS downwards, so no probability is rounded up, whatever the shard or the corpus."""
    return np.minimum(np.ceil(-x * STEPS - 1e-9), UNKNOWN - 1).astype(np.uint16)


def decoded(code: np.ndarray, unknown: float) -> np.ndarray:
    """Probabilities of codes; `unknown` where there is none."""
    return np.where(code == UNKNOWN, unknown, 10 ** (code.astype(np.float64) / -STEPS))


class Trie:
    """One level of a shard: contexts (sorted hashes), pointers to their followers, followers relative to their
    context (word + context number * 2**32, one monotone sequence), quantised log10 of discounted
    probabilities of followers and of what contexts leave to the lower order."""

    def __init__(self, context: np.ndarray, word: np.ndarray, count: np.ndarray, total: np.ndarray, kinds: np.ndarray) -> None:
        """Distinct known n-grams in order of (context number, word of 32 bits) with their counts; total and kinds (distinct followers) of all contexts."""
        self.pointers = EliasFano(np.concatenate([[0], np.cumsum(np.bincount(context, minlength=len(total)))]).astype(np.uint64), len(word) + 1)
        self.followers = EliasFano((context.astype(np.uint64) << np.uint64(32)) | word, max(len(total), 1) << 32)
        self.code = quantised(np.log10((count - DISCOUNT) / total[context]))
        self.left = np.full(len(total), UNKNOWN, np.uint16)
        seen = total > 0
        self.left[seen] = quantised(np.log10(DISCOUNT * kinds[seen] / total[seen]))

    def codes(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The codes of n-grams, UNKNOWN for those that aren't there: successors within the context's followers."""
        begin = self.pointers.access(context).astype(np.int64)
        end = self.pointers.access(context + 1).astype(np.int64)
        want = (context.astype(np.uint64) << np.uint64(32)) | word
        at = self.followers.successor(want, begin, end)
        known = self.followers.holds(at, want, end)
        out = np.full(len(context), UNKNOWN, np.uint16)
        out[known] = self.code[at[known]]
        return out


def packed(x: np.ndarray) -> bytes:
    """Unsigned numbers, in as few bytes each as the largest needs, byte plane by plane, compressed."""
    width = next(k for k in (1, 2, 4, 8) if k == 8 or int(x.max(initial=0)) < 1 << 8 * k)
    planes = np.ascontiguousarray(x.astype(f"<u{width}")).view(np.uint8).reshape(-1, width).T
    return bytes([width]) + zstandard.compress(planes.tobytes(), 1)


def unpacked(x: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(x[1:]), np.uint8).reshape(x[0], -1)
    return np.ascontiguousarray(planes.T).view(f"<u{x[0]}")[:, 0]


def _chunked(batches: Iterator[pa.RecordBatch], fields: pa.Schema, most: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, learns, text) rows to chunks: their rows' ids, learns and numbers of tokens, the distinct tokens'
    hashes, times and training times, and the tokens as numbers of these."""
    cache, number = Words(), 0

    def chunk() -> pa.RecordBatch:
        flat, n = np.concatenate(texts), np.array([len(t) for t in texts])
        words, at = np.unique(flat, return_inverse=True)
        learnt = np.repeat(np.array(learns, np.float64), n)
        row = [(TaskContext.get().partitionId() << 32) + number, ids, learns, n, words.view(np.int64), np.bincount(at), np.bincount(at, learnt).astype(np.int64), packed(at)]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, fields, strict=True)], schema=fields)

    ids, learns, texts, size = [], [], [], 0
    for b in batches:
        for i, learn, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            words = (t.as_py() or "").encode("utf-8", "replace").lower().split()
            texts.append(np.append(np.maximum(cache.hashes(words), END + np.uint64(1)), END))
            ids.append(i), learns.append(bool(learn))
            size += len(words) + 1
            if size >= most:
                yield chunk()
                ids, learns, texts, size, number = [], [], [], 0, number + 1
    if ids:
        yield chunk()


class Grams:
    """The distinct n-grams of a chunk, order by order: level k holds those of k words, each by its context's number in level k - 1 and its word."""

    def __init__(self, words: np.ndarray, tokens: np.ndarray, sizes: np.ndarray) -> None:
        self.short = (words.view(np.uint64) >> np.uint64(32)).astype(np.uint32)
        self.tokens, self.order = tokens, 1
        #: For each place of `at` the number of its n-gram in this level, the number's hash, context and word.
        self.at, self.of, self.hash = np.arange(len(tokens)), tokens, words.view(np.uint64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.begins = np.zeros(len(tokens) + 1, bool)
        self.begins[self.ends] = True
        self.context, self.word = np.zeros(len(words), np.int64), np.arange(len(words))

    def next(self, only: np.ndarray | None = None) -> None:
        """The level of one word more (of contexts whose hash is in only); places are those of the n-grams' last words."""
        later = ~self.begins[self.at + 1]
        if only is not None:
            later &= np.isin(self.hash, only)[self.of]
        context, at = self.of[later], self.at[later] + 1
        key, self.of = np.unique(context.astype(np.int64) * len(self.short) + self.tokens[at], return_inverse=True)
        self.at, self.order = at, self.order + 1
        self.context, self.word = key // len(self.short), key % len(self.short)
        self.before = self.hash
        self.hash = mixed(self.before[self.context] * _M + self.short[self.word])

    def dealt(self, shards: int, hot: np.ndarray, spread: int) -> tuple[np.ndarray, np.ndarray]:
        """(shard of each n-gram in the order of shards, contexts and words; that order): by the context, for those in hot by the word too."""
        context = self.before[self.context]
        shard = (context % np.uint64(shards)).astype(np.int64)
        if len(hot):
            some = np.isin(context, hot)
            shard[some] = shards + (mixed(context[some] + self.short[self.word[some]]) % np.uint64(spread)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        return shard[order], order


def _grams(row: dict) -> Grams:
    return Grams(np.array(row["words"], np.int64), unpacked(row["tokens"]).astype(np.int64), np.array(row["sizes"], np.int64))


_ASK = "shard int, chunk long, contexts binary, runs binary, words binary, times binary, learnt binary"


def _asked(batches: Iterator[pa.RecordBatch], level: int, shards: int, hot: np.ndarray, spread: int, only_hot: bool) -> Iterator[pa.RecordBatch]:
    """A row for each shard and chunk: its contexts, the number of n-grams of each, their words, times and training times."""
    for b in batches:
        for i in range(b.num_rows):
            row = b.slice(i, 1).to_pylist()[0]
            g = _grams(row)
            learns = np.repeat(np.array(row["learns"], np.float64), np.array(row["sizes"], np.int64))
            while g.order < level:
                g.next(hot if only_hot and g.order == level - 1 else None)
            times, learnt = np.bincount(g.of, minlength=len(g.word)), np.bincount(g.of, learns[g.at], len(g.word)).astype(np.int64)
            shard, order = g.dealt(shards, hot, spread)
            edges = np.flatnonzero(np.diff(shard, prepend=-1, append=shards + spread + 1))
            rows = []
            for a, z in zip(edges, edges[1:], strict=False):
                if only_hot and shard[a] < shards:
                    continue
                some = order[a:z]
                heads = np.flatnonzero(np.diff(g.context[some], prepend=-1))
                numbers = (g.before[g.context[some[heads]]], np.diff(heads, append=z - a), g.short[g.word[some]], times[some], learnt[some])
                rows.append((int(shard[a]), row["chunk"], *map(packed, numbers)))
            for at in range(0, len(rows), 500):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows[at : at + 500], strict=True), (pa.int32(), pa.int64(), *[pa.binary()] * 5), strict=True)], [c.split()[0] for c in _ASK.split(", ")])


class Shard:
    """The rows of a shard: the chunks' contexts and n-grams one after the other, and the distinct ones with their training counts."""

    def __init__(self, table: pa.Table) -> None:
        read = lambda c: [unpacked(x.as_py()) for x in table.column(c)]
        contexts, words = read("contexts"), read("words")
        self.chunks = table.column("chunk").to_pylist()
        self.heads, self.sizes = np.array([len(x) for x in contexts]), np.array([len(x) for x in words])
        self.contexts, self.number = np.unique(np.concatenate(contexts).astype(np.uint64), return_inverse=True)
        runs = np.concatenate([x.astype(np.int64) for x in read("runs")])
        key = (np.repeat(self.number, runs).astype(np.uint64) << np.uint64(32)) | np.concatenate(words).astype(np.uint64)
        self.key, self.of = np.unique(key, return_inverse=True)
        sums = lambda c: np.bincount(self.of, np.concatenate(read(c)), len(self.key))
        self.times, self.count = sums("times"), sums("learnt")
        self.context = (self.key >> np.uint64(32)).astype(np.int64)
        self.word = self.key & np.uint64(0xFFFFFFFF)
        self.total = np.bincount(self.context, self.count, len(self.contexts))
        self.kinds = np.bincount(self.context, self.count > 0, len(self.contexts))


def _totals(table: pa.Table) -> pa.Table:
    """(context, total, kinds) of a shard of hot contexts."""
    s = Shard(table)
    return pa.table({"context": s.contexts.view(np.int64), "total": s.total.astype(np.int64), "kinds": s.kinds.astype(np.int64)})


_ANSWER = "level int, chunk long, shard int, codes binary, left binary, totals binary, hot long"


def _answered(table: pa.Table, level: int, hot: dict[int, tuple[int, int]], limit: float) -> pa.Table:
    """For each of a shard's rows the codes of its n-grams, and of its contexts what they leave and their totals; the
    n-grams that will be hot contexts in rows of their own (hot)."""
    s = Shard(table)
    for i, (total, kinds) in ((i, hot[c]) for i, c in enumerate(s.contexts.tolist()) if c in hot) if hot else ():
        s.total[i], s.kinds[i] = total, kinds
    learnt = s.count > 0
    trie = Trie(s.context[learnt], s.word[learnt], s.count[learnt], s.total, s.kinds)
    codes, left, total = trie.codes(s.context, s.word)[s.of], trie.left[s.number], s.total[s.number].astype(np.int64)
    shard = table.column("shard")[0].as_py()
    rows, a, h = [], 0, 0
    for chunk, n, m in zip(s.chunks, s.sizes.tolist(), s.heads.tolist(), strict=True):
        rows.append((level, chunk, shard, packed(codes[a : a + n]), packed(left[h : h + m]), packed(total[h : h + m]) if level == 2 else None, None))
        a, h = a + n, h + m
    large = np.flatnonzero(s.times > limit)
    found = mixed(s.contexts[s.context[large]] * _M + s.word[large]).view(np.int64)
    rows += [(level, None, None, None, None, None, x) for x in found.tolist()]
    kinds = (pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 3, pa.int64())
    return pa.table([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in _ANSWER.split(", ")])


def _scored(chunks: pa.Table, answers: pa.Table, levels: list[tuple[int, np.ndarray, int]], n: int, v: int, ends: int) -> pa.Table:
    """The rows of a chunk with their sums; levels: (shards, hot contexts, shards of these) of the orders from 2 on."""
    out = []
    for i in range(chunks.num_rows):
        row = chunks.slice(i, 1).to_pylist()[0]
        g = _grams(row)
        count = np.zeros(len(g.short), np.int64)
        count[g.hash == END] = ends
        p = None
        held = answers.sort_by([("level", "ascending"), ("shard", "ascending")])
        for level, dealt in enumerate(levels, 2):
            g.next()
            _, order = g.dealt(*dealt)
            mine = held.filter(pa.compute.equal(held.column("level"), level))
            read = lambda c: np.concatenate([np.empty(0, np.int64), *(unpacked(x.as_py()) for x in mine.column(c))])  # noqa: B023, E731
            heads = np.flatnonzero(np.diff(g.context[order], prepend=-1) | np.diff(_, prepend=-1))
            code, left = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
            code[order], left[order] = read("codes"), np.repeat(read("left"), np.diff(heads, append=len(order)))
            if level == 2:
                count[g.context[order[heads]]] = read("totals")
                p = (count + 1)[g.tokens] / (n + v + 1)
                lower = np.log10(p)
            p[g.at] = decoded(code, 0.0)[g.of] + decoded(left, 1.0)[g.of] * p[g.at]
        sums = lambda x: np.add.reduceat(x, g.starts)  # noqa: B023, E731
        out.append(pa.table([pa.array(row["ids"], chunks.schema.field("ids").type.value_type), pa.array(row["learns"]), pa.array(g.ends - g.starts), pa.array(sums((count > 0).astype(np.int64)[g.tokens])), pa.array(sums(lower)), pa.array(sums(np.log10(p)))], ["doc_id", "learns", "n_tokens", "n_known", "base_score", "score"]))
    return pa.concat_tables(out)


def score(docs: DataFrame, learns: Column, text: str = "text", order: int = ORDER, chunk: int = CHUNK, shard: int = SHARD, hot_tokens: int = HOT) -> DataFrame:
    """docs' rows as doc_id, learns, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words of a text (A-Z lower-cased, parted by ASCII white space) and one end.
    Rows where learns is true train the model. base_score is the sum of log10((c + 1) / (N + V + 1))
    over the tokens, score the model's log10 probability of the text, by n-grams of up to `order` (2 or more) words.

    Chunks (of about `chunk` tokens) and their answers are joined by the chunk; the number of shards follows that of
    tokens (`shard` each), and contexts of more than hot_tokens entries are spread, so a task holds a chunk or a
    shard. Scores don't depend on these three. N-grams are told apart by a 64-bit hash of the context and 32 bits of the word's; counts of words by 64 bits.

    Null texts count as empty: the end alone. Repeated rows are each scored and each train. Without
    training rows all counts are 0. An empty table gives an empty one.
    """
    if order < 2:
        raise ValueError("order is 2 at least")
    spark = docs.sparkSession
    rows = docs.select("doc_id", learns.alias("learns"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    fields = f"chunk long, ids array<{kind}>, learns array<boolean>, sizes array<int>, words array<long>, times array<int>, learnt array<int>, tokens binary"
    as_arrow = _arrow(spark, fields)
    chunks = cut(rows.mapInArrow(lambda b: _chunked(b, as_arrow, chunk), fields), "lm-chunks", scan=True)
    said = chunks.select(F.explode(F.arrays_zip("words", "times", "learnt")).alias("x")).groupBy("x.words").agg(F.sum("x.times").alias("times"), F.sum("x.learnt").alias("c"))
    said = cut(said, "lm-words")
    zero = F.lit(0).cast("long")
    n, v, tokens, ends = said.agg(F.coalesce(F.sum("c"), zero), F.count_if(F.col("c") > 0), F.coalesce(F.sum("times"), zero), F.coalesce(F.sum(F.when(F.col("words") == int(END), F.col("c"))), zero)).first()
    shards = max(1, -(-tokens // shard))
    # At most one hot context for hot_tokens tokens.
    hot = [r.words for r in said.filter((F.col("times") > hot_tokens) & (F.col("words") != int(END))).select("words").collect()]
    levels, answers = [], None
    for level in range(2, order + 1):
        held, spread = np.array(hot, np.int64).view(np.uint64), min(shards, 2 * len(hot) + 1)
        levels.append((shards, held, spread))
        asked = lambda only_hot: chunks.mapInArrow(lambda b: _asked(b, level, shards, held, spread, only_hot), _ASK)  # noqa: B023, E731
        totals: dict[int, tuple[int, int]] = {}
        if hot:
            found = asked(True).groupBy("shard").applyInArrow(_totals, "context long, total long, kinds long").groupBy("context").agg(F.sum("total").alias("t"), F.sum("kinds").alias("k"))
            totals = {r.context & (2**64 - 1): (r.t, r.k) for r in found.collect()}
        made = cut(asked(False).groupBy("shard").applyInArrow(lambda t: _answered(t, level, totals, hot_tokens if level < order else np.inf), _ANSWER), "lm-answers")  # noqa: B023
        hot = [r.hot for r in made.filter("hot is not null").select("hot").collect()] if level < order else []
        some = made.filter("hot is null").drop("hot")
        answers = some if answers is None else answers.unionByName(some)
    result = f"doc_id {kind}, learns boolean, n_tokens long, n_known long, base_score double, score double"
    out = chunks.drop("times", "learnt").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lambda a, b: _scored(a, b, levels, n, v, ends), result)
    return out.select("doc_id", "learns", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def _arrow(spark, fields: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], fields).schema)
