"""Token counts, licence scans, packing and language-model scores by brute force and round trips."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from keyloom.llm import license_scan, lm_scoring, packing, queries, token_counts

DATA = "/root/testdata/sf0.001"
TEXTS = [
    None, "“Curly” — naïve\u00a0Δοκιμή тест\u2003测试 ΟΔΟΣ İstanbul \u1e9e", "x <|endoftext|> “y”", "", " ", "one", "Two  spaces\tand\n\nlines ", "ÀÉ straße ﬁ ½ e\u0301 \u00a0x\u2028y", "日本語 テスト 😀", "<|endoftext|> [UNK] <s> </s>", "don't can't A.B.C, 12345 x_y", "\r\n a \x0b b \x85 c",
    "z" * 20_000, "word " * 30_000, " ".join(f"w{i}!" for i in range(20_000)),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 1.5, "x") for i, t in enumerate(TEXTS * 2)] + [(None, "null id", 0.0, "x")], "doc_id long, text string, n_tokens double, score string")


def library(name):
    tok = Tokenizer.from_file(public_tokenizers.path(name))
    tok.no_truncation(), tok.no_padding()
    return tok


def test_token_counts_equal_the_library(spark, odd):
    tok, path = library("word_bpe_49k.json"), public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for df in (odd, docs):
        want = Counter((r.doc_id, len((r.text or "").encode()), n := len(tok.encode(r.text or "", add_special_tokens=False)), n > 2048) for r in df.collect())
        assert Counter(map(tuple, token_counts.count_tokens(df, path).collect())) == want
    assert token_counts.count_tokens(odd.limit(0), path).count() == 0


def test_frequent_pre_tokens_stay_remembered(monkeypatch):
    import pyarrow as pa

    asked = Counter()

    class Letters:
        def get_added_tokens_decoder(self):
            return {}

        def encode_batch_fast(self, words, add_special_tokens):
            asked.update(words)
            return words

    monkeypatch.setattr(token_counts, "tokenizer", lambda path: Letters())
    monkeypatch.setattr(token_counts, "REMEMBERED", 50)
    monkeypatch.setattr(token_counts, "CHUNK", 100)
    often = [f"w{i}" for i in range(10)]
    texts = [" ".join(often + [f"rare{k}-{i}" for i in range(15)] + often) for k in range(30)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(30)), pa.array(texts)], ["doc_id", "text"])
    got = [n for b in token_counts.counted(iter([batch]), "") for n in b.column(2).to_pylist()]
    assert got == [sum(map(len, t.split())) for t in texts]
    assert set(asked.values()) == {1}


def base_scan(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for p, label in license_scan.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_license_base_by_brute_force(spark, odd):
    more = ["Under the MIT License", "under-the_mit license under the mit license", "CC BY-NC, cc.by.nc cc by nc by nc", "apache license version 2.0; Apache License, Version 2", "under the mit licenses", "é under the mit license é"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(more)], "doc_id long, text string").unionByName(odd.select("doc_id", "text")).unionByName(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text"))
    got = license_scan.scan_licenses(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == Counter((r.doc_id, *base_scan(r.text)) for r in docs.collect())
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    assert license_scan.scan_licenses(docs.limit(0)).count() == 0


@pytest.mark.parametrize(
    "expression, labels, permissive",
    [
        ("MIT", {"mit"}, True), ("MIT OR GPL-2.0-only", {"mit", "gpl-2.0-only"}, True), ("MIT AND GPL-2.0-only", {"mit", "gpl-2.0-only"}, False),
        ("GPL-2.0-only WITH Classpath-exception-2.0 OR MIT", {"gpl-2.0-only with classpath-exception-2.0", "mit"}, True), ("(MIT OR GPL-2.0) AND Apache-2.0", {"mit", "gpl-2.0", "apache-2.0"}, True),
        ("GPL-2.0 AND MIT OR ISC", {"gpl-2.0", "mit", "isc"}, True), ("MIT */", {"mit"}, True), ("LGPL-2.1+", {"lgpl-2.1+"}, False), ("see the file COPYING", {"see"}, False),
    ],
)
def test_license_expressions(expression, labels, permissive):
    assert license_scan.evaluate(license_scan.postfix(expression)) == (labels, permissive)


def test_broken_license_expressions():
    assert license_scan.postfix("") == [] and license_scan.postfix("AND") == [] and license_scan.postfix("(MIT") == []
    found = license_scan.automaton()
    scan = lambda x: license_scan.scan(f"SPDX-License-Identifier: {x}\n", found)[5:]
    assert scan("Apache-2.0 OR GPL-3.0-only") == ("apache-2.0,gpl-3.0-only", True, 1.0)
    assert scan("see the file COPYING") == ("unknown:see", False, 0.5)
    assert scan("GPL-2.0+ WITH Classpath-exception-2.0") == ("gpl-2.0+ with classpath-exception-2.0", False, 1.0)
    assert scan("LicenseRef-mine") == ("licenseref-mine", False, 1.0)
    assert len(license_scan.IDENTIFIERS) < 200 and license_scan.scan("Boost Software License, all rights reserved", found)[5] == "all-rights-reserved,bsl"


def check_packing(rows, docs, tok, size=1024):
    want = Counter()
    for r in docs:
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 2]
        want[(r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= size
    for r in docs:
        if want[(r.doc_id, 0, 0)] == 0 and sum(k[0] == r.doc_id for k in want.elements()) == 1:
            ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 2]
            mine = sorted(pieces[r.doc_id], key=lambda p: p.piece)
            assert [p.piece for p in mine] == list(range(len(mine))) and sum(p.length for p in mine) == len(ids)
            assert all(p.length == size for p in mine[1:])
            assert all(p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) for p in mine)
    return len(bins)


def test_packing_round_trip(spark, odd):
    tok = library("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").union(odd.select(F.col("doc_id") + 100_000, "text"))
    rows, held = packing.pack(docs).collect(), docs.collect()
    used = check_packing(rows, held, tok)
    assert used <= 1.01 * math.ceil(sum(r.length for r in rows) / 1024) + 1
    assert packing.pack(docs.limit(0)).count() == 0


def test_plan_uses_every_piece_and_fits():
    rng = random.Random(2)
    for _ in range(40):
        size = rng.randint(5, 60)
        counts = Counter(rng.randint(1, size) for _ in range(rng.randint(1, 400)))
        used = Counter()
        for copies, pattern in packing.plan(counts, size):
            assert copies > 0 and sum(k * n for k, n in pattern) <= size
            for k, n in pattern:
                used[k] += n * copies
        assert used == counts
    # The smallest of 6 + 3 gives way to 2 + 2, which fill the gap.
    assert packing.plan({6: 1, 3: 1, 2: 2}, 10)[0] == (1, [(6, 1), (2, 2)])


def best_two_fit(pieces, size):
    """Bins (sorted lengths) one by one over a plain list of pieces."""
    left, bins = sorted(pieces, reverse=True), []
    while left:
        held, gap = [], size
        for x in list(left):
            if x <= gap:
                held.append(x), left.remove(x)
                gap -= x
        small = min(held)
        if gap and len(held) > 1:
            pairs = [(a + b, -min(a, b), a, b) for i, a in enumerate(left) for b in left[i + 1 :] if small < a + b <= gap + small and max(a, b) < gap + small]
            if pairs:
                _, _, a, b = max(pairs)
                held.remove(small), left.append(small), held.extend([a, b]), left.remove(a), left.remove(b)
                left.sort(reverse=True)
        bins.append(tuple(sorted(held)))
    return Counter(bins)


def test_plan_equals_best_two_fit_by_hand():
    rng = random.Random(3)
    for _ in range(60):
        size = rng.randint(5, 40)
        pieces = [rng.randint(1, size) for _ in range(rng.randint(1, 120))]
        got = Counter()
        for copies, pattern in packing.plan(Counter(pieces), size):
            got[tuple(sorted(k for k, n in pattern for _ in range(n)))] += copies
        assert got == best_two_fit(pieces, size)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_scores(docs, order):
    """(doc_id, text) rows and whether each trains, to n_tokens, n_known, N, base score and unquantised score."""
    grams, after, follows = Counter(), defaultdict(set), Counter()
    for _, t, learns in docs:
        w = [*words(t), None]
        for k in range(1, order + 1):
            for i in range(len(w) - k + 1) if learns else ():
                grams[tuple(w[i : i + k])] += 1
                if k > 1:
                    after[tuple(w[i : i + k - 1])].add(w[i + k - 1])
                    follows[tuple(w[i : i + k - 1])] += 1
    n, v = sum(c for g, c in grams.items() if len(g) == 1), sum(len(g) == 1 for g in grams)

    def p(gram):
        if len(gram) == 1:
            return (grams[gram] + 1) / (n + v + 1)
        context, lower = gram[:-1], p(gram[1:])
        if not follows[context]:
            return lower
        known = (grams[gram] - lm_scoring.DISCOUNT) / follows[context] if grams[gram] else 0
        return known + lm_scoring.DISCOUNT * len(after[context]) / follows[context] * lower

    out = []
    for i, t, _ in docs:
        w = [*words(t), None]
        places = range(len(w))
        out.append((i, len(w), sum(grams[(x,)] > 0 for x in w), n, sum(math.log10(p((x,))) for x in w), sum(math.log10(p(tuple(w[max(0, k - order + 1) : k + 1]))) for k in places)))
    return out


@pytest.mark.parametrize("order, sizes", [(2, {}), (3, {"chunk": 5000, "shard": 20_000, "hot_tokens": 1000}), (4, {"chunk": 50_000, "shard": 100_000})])
def test_scores_by_brute_force(spark, odd, order, sizes):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").union(odd.select(F.col("doc_id") + 100_000, "text")).fillna({"doc_id": -5})
    got = {r.doc_id: r for r in lm_scoring.score(docs, F.pmod("doc_id", F.lit(7)) != 2, order=order, **sizes).collect()}
    rows = [(r.doc_id, r.text, r.doc_id % 7 != 2) for r in docs.collect()]
    assert len(got) == len(rows)
    for i, n, known, total, base, score in brute_scores(rows, order):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        # Each order's numbers are rounded down by a level at most.
        assert -n * (order - 1) / lm_scoring.STEPS - 1e-6 <= r.score - score <= 1e-6


def test_scores_of_nulls_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, None, 1, "x"), (None, "a b", 1, "x"), (1, "a b", 1, "x"), (1, "a b", 1, "x"), (2, "", 1, "x")], "doc_id long, text string, score int, learns string")
    got = lm_scoring.score(docs, F.lit(True)).collect()
    assert sorted((r.n_tokens, r.train_tokens) for r in got) == [(1, 11), (1, 11), (3, 11), (3, 11), (3, 11)]
    assert lm_scoring.score(docs.limit(0), F.lit(True)).count() == 0
    assert {r.n_known for r in lm_scoring.score(docs, F.lit(False)).collect()} == {0}


def test_model_beats_the_base_on_held_out_texts(spark):
    got = queries.QUERIES["op10_lm_scoring"](spark, "/root/testdata/sf0.01").filter("held_out").agg(F.sum("base_score").alias("b"), F.sum("score").alias("s")).first()
    assert got.s > got.b


def test_elias_fano_holds_monotone_sequences():
    rng = np.random.default_rng(4)
    for n, top in ((0, 10), (1, 1), (500, 600), (500, 10**12), (3000, 3)):
        x = np.sort(rng.integers(0, top, n)).astype(np.uint64)
        made = lm_scoring.EliasFano(x, top)
        assert (made.access(np.arange(n)) == x).all()
        ask = np.concatenate([x, rng.integers(0, top, 50).astype(np.uint64)])
        at = made.successor(ask, np.zeros(len(ask), np.int64), np.full(len(ask), n))
        assert (at == np.searchsorted(x, ask)).all()
