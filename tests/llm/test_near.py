"""Near-duplicate documents and lines, and benchmark leaks, against all pairs on small tables."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from keyloom.llm import components, decontaminate, line_dedup, minhash

DATA = "/root/testdata/sf0.001"


def least_of(nodes, links):
    to = {n: n for n in nodes}

    def find(n):
        while to[n] != n:
            n = to[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        to[b] = a
    return {n: find(n) for n in nodes}


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_by_brute_force(rows, percent):
    sets = {i: shingle_set(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    comp = least_of(ids, links)
    return {i: (len(sets[i]), comp[i], comp[i] == i) for i in ids}


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return w


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_by_brute_force(spark, percent):
    rng = random.Random(percent)
    texts = [None, "", " \n", "one", "one", "ONE", "a b c d", "a b c d", "a b c d e", " ".join(f"w{i}" for i in range(30_000)), " ".join(f"w{i}" for i in range(30_500))]
    for _ in range(12):
        base = [f"v{rng.randrange(3000)}" for _ in range(rng.choice([40, 120, 400]))]
        texts += [" ".join(base)] * 2 + [" ".join(edited(rng, base, rng.randrange(1, 6))) for _ in range(8)]
    base = [f"v{rng.randrange(3000)}" for _ in range(150)]
    texts += [" ".join(base)] * 100 + [" ".join(edited(rng, base, 2)) for _ in range(60)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, component_id string, node int")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, percent).collect()}
    assert got == near_by_brute_force(rows, percent)


def test_near_duplicates_of_the_test_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, 85).collect()}
    assert got == near_by_brute_force([(r.doc_id, r.text) for r in docs.collect()], 85)


def test_near_duplicates_in_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(components, "LARGE", 5)
    rng = random.Random(12)
    base = [f"v{rng.randrange(3000)}" for _ in range(150)]
    texts = [" ".join(edited(rng, base, rng.randrange(1, 7))) for _ in range(80)] + [" ".join(f"v{rng.randrange(3000)}" for _ in range(80)) for _ in range(20)]
    rows = list(enumerate(texts))
    seen = []
    banded = minhash._banded
    monkeypatch.setattr(minhash, "_banded", lambda nodes: seen.append(nodes.count()) or banded(nodes))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()}
    assert got == near_by_brute_force(rows, 85)
    assert sum(seen) > 20


def test_dropping_near_duplicates_judges_rows(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long, "a"), (1, long, "b"), (2, long + " more", "c"), (1, "other text of its own with some words", "d"), (3, "other text of its own with some words", "e"), (None, long, "f"), (4, None, "g"), (4, None, "h")]
    got = minhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, `__key` string"))
    assert got.columns == ["doc_id", "text", "__key"]
    left = Counter((r.doc_id, r.text) for r in got.collect())
    assert left == Counter([(1, long), (1, "other text of its own with some words"), (None, long), (4, None), (4, None)])


def test_near_duplicates_with_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, None)], "doc_id long, text string")
    got = Counter((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect())
    assert got == Counter([(None, None, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)])
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(200, 201 + i) for i in range(30)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == least_of(nodes, links)


def test_links_that_are_stars_take_no_round(spark, monkeypatch):
    written, cut = [], components.cut
    monkeypatch.setattr(components, "cut", lambda df, name, **more: written.append(name) or cut(df, name, **more))
    links = [(200, 201 + i) for i in range(30)] + [(3, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {200 + i: 200 for i in range(31)} and written == ["cc-edges"]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_after_more_links(spark, seed):
    rng = random.Random(seed)
    first = [(rng.randrange(300), rng.randrange(300)) for _ in range(100)] + [(400, 401 + i) for i in range(20)]
    more = [(rng.randrange(330), rng.randrange(330)) for _ in range(25)] + [(7, 7), (405, 350), (351, 352), (360, 351)]
    frame = lambda x: spark.createDataFrame(x, "a long, b long")
    got = components.merged(components.components(frame(first)), frame(more)).collect()
    nodes = {x for a, b in first + more if a != b for x in (a, b)}
    assert {r.node: r.component for r in got} == least_of(nodes, [x for x in first + more if x[0] != x[1]]) and len(got) == len(nodes)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("limit", [1, 2, 3])
def test_banded_distance(limit):
    rng = random.Random(limit)
    for _ in range(3000):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 25)))
        b = list(a)
        for _ in range(rng.randrange(0, 5)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice(["", "a", "b", "x"])
        assert line_dedup.banded_distance(a, "".join(b), limit) == min(limit + 1, distance(a, "".join(b)))


def lines_by_brute_force(rows, edits, least):
    found = sorted((d, i, x) for d, t in rows if d is not None for i, line in enumerate((t or "").split("\n")) if len(x := line.strip(" \t\r\x0b\x0c")) >= least)
    texts = sorted({x for _, _, x in found})
    links = [(a, b) for a in texts for b in texts if a < b and abs(len(a) - len(b)) <= edits and distance(a, b) <= edits]
    comp = least_of(texts, links)
    first = {}
    for d, i, x in found:
        first.setdefault(comp[x], (d, i))
    return {(d, i, *first[comp[x]]) for d, i, x in found if first[comp[x]] != (d, i)}


def line_rows(rng):
    bases = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(20, 45))) + "." for _ in range(12)]
    rows = []
    for d in range(40):
        lines = []
        for _ in range(rng.randrange(0, 6)):
            x = list(rng.choice(bases))
            for _ in range(rng.randrange(0, 4)):
                at = rng.randrange(len(x))
                x[at : at + rng.randrange(2)] = rng.choice(["", "z", "é", "😀"])
            lines.append(rng.choice(["", " ", "\t"]) + "".join(x))
        rows.append((d, "\n".join(lines)))
    return [*rows, (40, None), (41, ""), (42, "\n\n"), (None, bases[0]), (43, bases[0] + "\n" + bases[0])]


def test_repeated_lines_by_brute_force(spark):
    rows = line_rows(random.Random(8))
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, line int, first string")
    got = {tuple(r) for r in line_dedup.repeated_lines(docs, 2, 20).collect()}
    assert got == lines_by_brute_force(rows, 2, 20)
    assert line_dedup.repeated_lines(docs.limit(0)).count() == 0


def test_short_lines_take_part_with_fewer_edits(spark):
    rng = random.Random(10)
    alphabet = "abcdefgh 12é😀\uf600"
    bases = ["".join(rng.choice(alphabet) for _ in range(n)).strip() or "x" for n in (1, 1, 2, 5, 9, 12, 18, 19, 20, 21, 24, 38, 39, 40, 41, 44)] + ["😀", "\uf600"]
    rows = []
    for d in range(50):
        lines = []
        for _ in range(6):
            x = list(rng.choice(bases))
            for _ in range(rng.randrange(0, 3)):
                at = rng.randrange(len(x) + 1)
                x[at : at + rng.randrange(2)] = rng.choice(["", "z", "a"])
            lines.append("".join(x))
        rows.append((d, "\n".join(lines)))
    want_edits = lambda a, b: min(2, min(len(a), len(b)) // 20)
    found = sorted((d, i, x) for d, t in rows for i, line in enumerate(t.split("\n")) if (x := line.strip(" \t\r\x0b\x0c")))
    texts = sorted({x for _, _, x in found})
    links = [(a, b) for a in texts for b in texts if a < b and abs(len(a) - len(b)) <= want_edits(a, b) and distance(a, b) <= want_edits(a, b)]
    comp, first = least_of(texts, links), {}
    for d, i, x in found:
        first.setdefault(comp[x], (d, i))
    got = {tuple(r) for r in line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert links and got == {(d, i, *first[comp[x]]) for d, i, x in found if first[comp[x]] != (d, i)}


def test_large_buckets_are_dealt_anew_without_loss(spark, monkeypatch):
    rng = random.Random(11)
    start = "2024-01-01 INFO the same first words of a log line "
    base = [start + "".join(rng.choice("abcdefgh") for _ in range(30)) for _ in range(260)]
    near = []
    for x in base[:150]:
        y = list(x)
        for _ in range(rng.randrange(1, 3)):
            at = rng.randrange(len(y) + 1)
            y[at : at + rng.randrange(2)] = rng.choice(["", "z", "y"])
        near.append("".join(y))
    rows = [(i, x) for i, x in enumerate(base + near)]
    seen = []

    def spied(postings, facts, may, verify, finer=None, **more):
        held = components.linked(postings, facts, may, verify, finer, **more)
        largest = lambda p: p.groupBy("bucket").count().agg({"count": "max"}).first()[0]
        seen.append((largest(postings), largest(finer(facts))))
        return held

    monkeypatch.setattr(line_dedup, "linked", spied)
    got = {tuple(r) for r in line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = sorted({x for _, x in rows})
    comp = least_of(texts, [(a, b) for i, a in enumerate(texts) for b in texts[i + 1 :] if line_dedup.banded_distance(a, b, 2) <= 2])
    first = {}
    for i, x in rows:
        first.setdefault(comp[x], i)
    assert got == {(i, 0, first[comp[x]], 0) for i, x in rows if first[comp[x]] != i} and len(got) >= 100
    assert seen[0][0] > components.LARGE > 2 * seen[0][1]


@pytest.mark.parametrize("edits", [1, 2])
def test_windows_meet_for_all_lines_within_the_edits(edits):
    rng = random.Random(edits)
    for parts in line_dedup.WINDOWS:
        for _ in range(25):
            a = "".join(rng.choice("ab") for _ in range(rng.randrange(20, 30)))
            y = list(a)
            for _ in range(edits):
                at = rng.randrange(len(y) + 1)
                y[at : at + rng.randrange(2)] = rng.choice(["", "a", "b", "c"])
            lines = line_dedup.Lines([a, "".join(y)], 1)
            sides = ({int(k) for some, _ in line_dedup.windows(lines, np.array([i]), line_dedup.steps_of(edits), parts) for k in some} for i in range(2))
            assert set.intersection(*sides)


def test_dropping_lines_follows_the_found_ones(spark):
    rows = line_rows(random.Random(9))
    docs = spark.createDataFrame([(d, t, len(t or "")) for d, t in rows], "doc_id long, text string, n_chars long")
    gone = {(d, i) for d, i, *_ in lines_by_brute_force(rows, 2, 20)}
    want = Counter()
    for d, t in rows:
        if d is None or not any(x == d for x, _ in gone):
            want[d, t, len(t or "")] += 1
            continue
        left = "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone)
        if left.strip(" \t\n\r\x0b\x0c"):
            want[d, left, len(left)] += 1
    assert Counter(map(tuple, line_dedup.drop_repeated_lines(docs, 2, 20).collect())) == want


def test_rows_that_share_an_id_lose_only_their_own_lines(spark):
    rows = [(0, "x"), (1, "x\nshort tail"), (1, "y\nother tail"), (2, "y\nlast"), (2, "y\nlast"), (None, "x")]
    left = Counter((r.doc_id, r.text) for r in line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert left == Counter([(0, "x"), (1, "short tail"), (1, "y\nother tail"), (2, "last"), (2, "last"), (None, "x")])


def test_lines_of_other_planes_are_no_copies():
    a, b = "а" * 45, "".join(chr(0x10000 + ord("а")) for _ in range(45))
    lines = line_dedup.Lines([a, b], 1)
    assert lines.h[0] != lines.h[1] and lines.profile(True).tolist() is not None


def held(item, text):
    """Least edit distance of item to a part of text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


@pytest.mark.parametrize("head", [False, True])
def test_recall_does_not_fall_with_the_length(spark, head):
    """A fifth of the words edited, anywhere or all in the first half."""
    rng = random.Random(7)
    lengths, each = (8, 20, 59, 150, 250, 500), 15
    items = [(100 * n + k, [f"b{rng.randrange(20_000)}" for _ in range(n)]) for n in lengths for k in range(each)]
    rows = []
    for i, w in items:
        own, edits = list(w), decontaminate.allowed(len(w), decontaminate.MAX_EDITS)
        for _ in range(edits):
            at = rng.randrange(len(own) // 2 if head else len(own))
            own[at : at + rng.randrange(2)] = rng.choice([[], [f"t{rng.randrange(500)}"]])
        rows.append((i, " ".join([f"t{rng.randrange(500)}" for _ in range(30)] + own + [f"t{rng.randrange(500)}" for _ in range(30)])))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {r.doc_id for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect() if r.doc_id == r.item_id}
    by = {n: sum(100 * n + k in got for k in range(each)) / each for n in lengths}
    print(by)
    assert len(got) >= 0.9 * len(items) and min(by.values()) >= 0.8


def test_leaks_by_brute_force(spark):
    rng = random.Random(6)
    items = [(i, " ".join(f"b{rng.randrange(400)}" for _ in range(rng.choice([3, 8, 15, 30, 60])))) for i in range(25)] + [(25, None), (26, "?!")]
    rows = [(900, None), (901, ""), (902, "b1 " * 5000)]
    for d in range(80):
        w = [f"t{rng.randrange(500)}" for _ in range(rng.randrange(5, 80))]
        own = items[rng.randrange(25)][1].split()
        for _ in range(rng.randrange(0, max(1, len(own) // 4))):
            at = rng.randrange(len(own))
            own[at : at + rng.randrange(2)] = rng.choice([[], [f"t{rng.randrange(500)}"]])
        at = rng.randrange(len(w))
        rows.append((d, " ".join(w[:at] + (own if d % 4 else []) + w[at:])))
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.contaminated(docs, bench).collect()}
    want = {}
    for d, t in rows:
        tw = [x.decode() for x in decontaminate.words_of(t)]
        for i, x in items:
            iw = [y.decode() for y in decontaminate.words_of(x)]
            if tw and iw and d != 902 and (e := held(iw, tw)) <= decontaminate.allowed(len(iw), decontaminate.MAX_EDITS):
                want[d, i] = e
    assert got.keys() <= want.keys() and len(got) >= 0.9 * len(want)
    assert sum(got[k] == want[k] for k in got) >= 0.95 * len(got)
    exact = {k for k, e in want.items() if not e}
    assert exact <= got.keys()
    left = {r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()}
    assert left == {d for d, _ in rows} - {d for d, _ in got}
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_few_characters_are_held_at_once(monkeypatch):
    import pyarrow as pa

    held, made = [], line_dedup.Lines.__init__

    def spy(self, texts, least):
        made(self, texts, least)
        held.append(len(self.codes))

    monkeypatch.setattr(line_dedup.Lines, "__init__", spy)
    lines = [f"line {i} of the text with enough words to take part in it" for i in range(30_000)]
    texts = pa.array(["\n".join(lines[at : at + 100]) for at in range(0, 30_000, 100)])
    steps, each = line_dedup.steps_of(line_dedup.EDITS), line_dedup.Lines(lines[:50], 1)
    found = [b for b in line_dedup._posted(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), 1, steps, None)]
    assert max(held) < 300_000 and len(found) == len(held) - 1
    got = {(r["bucket"], r["node"]) for b in found for r in b.to_pylist()}
    assert got >= {(int(k), int(each.h[w].view(np.int64))) for ks, ws in line_dedup.keys(each, np.arange(50), steps) for k, w in zip(ks.view(np.int64), ws, strict=True)}
    assert len({n for _, n in got}) == 30_000


def test_texts_of_lines_come_from_the_places_asked_for():
    import pyarrow as pa

    key, text = [5, -7, 9], ["a\n b b \nc", None, "d\n\ne"]
    batch = pa.RecordBatch.from_arrays([pa.array(text), pa.array(key)], ["text", "key"])

    def marks(values):
        out = np.zeros(1 << 11, np.uint32)
        at = values & np.uint64(len(out) * 32 - 1)
        np.bitwise_or.at(out, (at >> np.uint64(5)).astype(np.int64), np.uint32(1) << (at & np.uint64(31)).astype(np.uint32))
        return out

    asked = line_dedup.places(np.array([5, 9]), np.array([1, 2]))
    got = pa.Table.from_batches(list(line_dedup._texts(iter([batch]), marks(np.array([5, 9], np.uint64)), marks(asked)))).to_pylist()
    assert [tuple(r.values()) for r in got] == [(5, 1, "b b"), (9, 2, "e")]


def bits_of(values, bits=16):
    out, at = np.zeros(1 << (bits - 5), np.uint32), values.astype(np.uint64) & np.uint64((1 << bits) - 1)
    np.bitwise_or.at(out, (at >> np.uint64(5)).astype(np.int64), np.uint32(1) << (at & np.uint64(31)).astype(np.uint32))
    return out


def test_only_words_of_walked_windows_are_hashed(monkeypatch):
    """Texts of other words than the benchmark's cost no hash for each word, and what they hold is found at its place."""
    import pyarrow as pa

    item = [f"b{i}" for i in range(20)]
    texts = [" ".join(f"t{d}x{i}" for i in range(200)) for d in range(100)] + [None, "", "?!"]
    texts[7] = f"{texts[7]}\n{' '.join(item)}, {texts[7]}"
    items = pa.RecordBatch.from_pydict({"item_id": [0], "text": [" ".join(item)]})
    said = pa.Table.from_batches(list(decontaminate._vocabulary(iter([items]))))
    vocabulary = tuple(bits_of(said.filter(pa.compute.equal(said["of"], of))["word"].to_numpy()) for of in range(2))
    keys = np.concatenate([b.column("key").to_numpy() for b in decontaminate._item_keys(iter([items]))])
    hashed, made = [], decontaminate.Words.__missing__
    monkeypatch.setattr(decontaminate.Words, "__missing__", lambda self, w: (hashed.append(w), made(self, w))[1])
    docs = pa.RecordBatch.from_pydict({"doc_id": range(len(texts)), "row": range(len(texts)), "text": pa.array(texts, pa.string())})
    got = [r for b in decontaminate._candidates(iter([docs]), {decontaminate.window_of(20): (4, 20)}, vocabulary, (bits_of(keys), bits_of(keys >> 32))) for r in b.to_pylist()]
    assert {r["doc_id"] for r in got} == {7} and {r["key"] for r in got} >= set(keys.tolist())
    words = [x.decode() for x in decontaminate.words_of(texts[7])]
    assert all(r["part"].split() == words[r["at"] : r["at"] + 36] for r in got)
    assert set(x.encode() for x in item) <= set(hashed) and len(hashed) < 100


def test_words_of_texts_at_once():
    texts = ["", " a", "B c\tD\x00e", "?", "naïve ÄÖ 漢字 漢字-x", "\n", "abcdefgh abcdefghi abcdefgh_", "abcdefghXijklmnop abcdefghYijklmnop", "b c "]
    data, first, last, before = decontaminate.laid_out([t.encode() for t in texts])
    words = [data[i:j] for i, j in zip(first, last, strict=True)]
    assert [words[i:j] for i, j in zip(before, before[1:])] == [decontaminate.words_of(t) for t in texts]
    marks = {}
    for w, h in zip(words, decontaminate.outlines(data, first, last).tolist(), strict=True):
        marks.setdefault((len(w), w[:8], w[-8:]), set()).add(h)
    assert all(len(x) == 1 for x in marks.values()) and len(set.union(*marks.values())) == len(marks)
    data, first, last, before = decontaminate.laid_out([])
    assert not len(first) and before.tolist() == [0] and not len(decontaminate.outlines(data, first, last))


@pytest.mark.parametrize("size", [1, 2, 5, 15, 48, 200])
def test_walks_step_by_step(size):
    tokens = np.concatenate([np.random.default_rng(3).integers(1, 40, 300, np.uint64), np.zeros(size, np.uint64)])
    starts, (samples, places) = np.array([0, 3, 4, 250, 299]), decontaminate.sampling(size)
    hashed = lambda x: int(minhash.mixed(np.array([x % 2**64], np.uint64))[0])
    got = decontaminate.walk_keys(tokens, starts, size)
    for w in range(decontaminate.WALKS):
        rng = np.random.default_rng([w, size])
        steps = max(places, (3 * size) // 2)
        taken = [sorted(rng.choice(steps, places, replace=False).tolist()) for _ in range(samples)]
        salt = rng.integers(0, 2**63, steps, np.uint64)
        for i, start in enumerate(starts.tolist()):
            at, walk = 0, []
            for j in range(steps):
                walk.append(int(tokens[start + at]) if at < size else 0)
                at += hashed(walk[-1] ^ int(salt[j])) >> 63
            for s, own in enumerate(taken):
                key = size * decontaminate.WALKS + w
                for j in own:
                    key = hashed(key * 0x9E3779B97F4A7C15 + walk[j])
                assert int(got[i, w * samples + s]) == hashed(key + s)
