"""The pipeline stage by stage, and its rows against the stages' own operators."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import test_near
import test_native
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from keyloom.llm import common, decontaminate, line_dedup, minhash, packing, quality

DATA = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_the_columns(spark, tmp_path):
    docs = start = spark.read.parquet(f"{DATA}/documents.parquet")
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    rows = Counter
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if name == "quality_rules":
            want = {r.doc_id for r in quality.judge(docs).filter("kept").collect()}
            assert {r.doc_id for r in out.collect()} == want
        elif name == "line_dedup":
            assert rows(map(tuple, out.collect())) == rows(map(tuple, line_dedup.drop_repeated_lines(docs).collect()))
            assert line_dedup.repeated_lines(out).count() == 0
        elif name == "minhash_near_dedup":
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in minhash.near_duplicates(docs).filter("kept").collect()}
        elif name == "benchmark_decontamination":
            bad = {r.doc_id for r in decontaminate.contaminated(docs, bench).collect()}
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()} - bad
        else:
            assert rows((r.doc_id, r.piece, r.ids_crc32) for r in out.collect()) == rows((r.doc_id, r.piece, r.ids_crc32) for r in packing.pack(docs).collect())
            break
        assert out.columns == start.columns and 0 < out.count() <= docs.count()
        docs = out
    ran = corpus_pipeline.run(spark, DATA)
    assert rows((r.doc_id, r.piece, r.ids_crc32) for r in ran.collect()) == rows((r.doc_id, r.piece, r.ids_crc32) for r in out.collect())


def test_stages_on_an_empty_table_and_nulls(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", None, None, None), (1, "", None, None, None)], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).count() == 0
        stage(spark, odd, DATA).collect()


def fixture(rng):
    """(doc_id, text): prose with repeated lines, near and exact copies, passages of the benchmark, junk, nulls and a repeated id."""
    word = lambda k: f"{rng.choice(['tor', 'mel', 'ina', 'resh', 'oda', 'lun'])}{rng.choice(['ba', 'ki', 'to', 'en'])}{rng.randrange(k)}"
    line = lambda: " ".join(word(900) for _ in range(rng.randrange(9, 16)))
    items = [(i, " ".join(f"quiz{rng.randrange(400)}" for _ in range(rng.choice([10, 25, 40])))) for i in range(8)]
    shared = [line() for _ in range(3)]
    texts = ["\n".join(line() for _ in range(rng.randrange(6, 10))) for _ in range(24)]
    texts += [texts[0], texts[1] + "\n" + line(), "\n".join(x.replace("ba", "b", 1) for x in texts[2].split("\n"))]
    texts += ["\n".join([shared[k % 3], *(line() for _ in range(7)), shared[(k + 1) % 3] + "x" * (k % 3)]) for k in range(6)]
    texts += ["\n".join([line() for _ in range(6)] + [items[k][1] if k % 2 else " ".join(items[k][1].split()[1:])] + [line()]) for k in range(6)]
    long = [word(900) for _ in range(120)]
    texts += [" ".join(long), *(" ".join(test_near.edited(rng, long, 2)) for _ in range(4))]
    texts += [None, "", "few words", "spam spam spam " * 40, "# $ % & " * 40]
    rows = list(enumerate(texts))
    return [*rows, (3, "\n".join(line() for _ in range(7))), (None, "\n".join(line() for _ in range(7)))], items


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows, items = fixture(random.Random(21))
    kinds = spark.read.parquet(f"{DATA}/documents.parquet").schema
    made = [(i, t, "en", "src", len(t or "")) for i, t in rows]
    spark.createDataFrame(made, kinds).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def kept(text):
        n, chars, symbols, repeats, covered = test_native.features(text)
        lines = [x for x in (text or "").split("\n") if test_native.WORD.search(x)]
        letters = sum(any(c.isalpha() for c in w) for w in test_native.WORD.findall(text or ""))
        return not (n < 50 or 100 * covered > 50 * n or 10 * symbols > n or chars < 3 * n or chars > 12 * n or 2 * repeats > len(lines) or 10 * letters < 8 * n)

    left = [(i, t) for i, t in rows if kept(t)]
    # Lines: of classes of lines within the edits that their lengths allow all but the first go.
    found = sorted((i, k, t, x.strip()) for i, t in left if i is not None for k, x in enumerate(t.split("\n")) if x.strip())
    texts = sorted({x for *_, x in found})
    most = lambda a, b: min(2, min(len(a), len(b)) // 20)
    comp = test_near.least_of(texts, [(a, b) for n, a in enumerate(texts) for b in texts[n + 1 :] if abs(len(a) - len(b)) <= 2 and line_dedup.banded_distance(a, b, 2) <= most(a, b)])
    first, gone = {}, set()
    for i, k, t, x in found:
        if first.setdefault(comp[x], (i, k, t)) != (i, k, t):
            gone.add((i, t, k))
    assert gone
    left = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if (i, t, k) not in gone)) for i, t in left]
    left = [(i, t) for i, t in left if t.strip()]
    # Near copies: rows with an id, of each group the one of the least id.
    sets = [test_near.shingle_set(t) if i is not None else set() for i, t in left]
    links = [(a, b) for a in range(len(left)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = test_near.least_of(range(len(left)), links)
    best = {}
    for n in range(len(left)):
        best[comp[n]] = min(best.get(comp[n], n), n, key=lambda m: -1 if left[m][0] is None else left[m][0])
    assert links
    left = [left[n] for n in sorted(best.values())]
    words = lambda t: [x.decode() for x in decontaminate.words_of(t)]
    leaks = [(i, t) for i, t in left if any(test_near.held(w, words(t)) <= decontaminate.allowed(len(w), decontaminate.MAX_EDITS) for _, x in items if (w := words(x)))]
    assert leaks
    left = [x for x in left if x not in leaks]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((i, len(tok.encode(t, add_special_tokens=False).ids) + 1) for i, t in left)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    lengths = Counter()
    for r in got:
        lengths[r.doc_id] += r.length
    assert Counter(lengths.items()) == Counter({(i, sum(n for j, n in want.elements() if j == i)): 1 for i in {i for i, _ in want}})


def test_stages_with_more_columns_of_clashing_names(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    more = docs.withColumns({c: F.lit("own") for c in ("line", "node", "key", "__key", "kept", "least", "component", "item_id", "part", "row", "n_words", "__lost")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out, plain = stage(spark, more, DATA), stage(spark, docs, DATA)
        assert out.columns == more.columns, name
        assert Counter(map(tuple, out.select(docs.columns).collect())) == Counter(map(tuple, plain.collect())), name
        assert {r.key for r in out.collect()} == {"own"}


def test_workers_get_small_batches_of_long_texts(spark, monkeypatch):
    """A batch was 10,000 rows whatever their length: tens of MB of text in executor and worker at once."""
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.col("id"), F.expr("repeat('long text ', 10000)")).alias("text")).coalesce(1)
    sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n long")
    with common.small_batches(spark):
        found = [r.n for r in sizes.collect()]
    assert sum(found) > 30_000_000 and max(found) < 2 * common.BATCH_BYTES
    assert spark.conf.get(common._BATCH, None) is None
    seen, docs, bench = {}, spark.read.parquet(f"{DATA}/documents.parquet").limit(50), spark.read.parquet(f"{DATA}/benchmark.parquet")
    for module, run in ((line_dedup, line_dedup.drop_repeated_lines), (minhash, minhash.drop_near_duplicates), (decontaminate, lambda d: decontaminate.decontaminate(d, bench)), (packing, packing.pack)):
        monkeypatch.setattr(module, "cut", lambda df, name, *a, **b: seen.setdefault(name, spark.conf.get(common._BATCH, None)) and False or common.cut(df, name, *a, **b))
        run(docs)
    assert {seen[x] for x in ("lines-met", "lines-distinct", "minhash-signatures", "leak-documents", "pack-pieces")} == {str(common.BATCH_BYTES)}
    spark.conf.set(common._BATCH, "1000000")
    try:
        with common.small_batches(spark):
            assert spark.conf.get(common._BATCH) == "1000000"
        assert spark.conf.get(common._BATCH) == "1000000"
    finally:
        spark.conf.unset(common._BATCH)


def test_lines_remembered_as_posted_are_bounded_and_lose_none(monkeypatch):
    rng = random.Random(4)
    texts = ["\n".join(f"line {rng.randrange(300)} of a text with some length to it" for _ in range(20)) for _ in range(60)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 7])], ["text"]) for i in range(0, 60, 7)]
    posted = lambda: [p for b in line_dedup._posted(iter(batches), 1, line_dedup.steps_of(line_dedup.EDITS), None) for p in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    lines = line_dedup.Lines(texts, 1)
    every = {(k, h) for keys, which in line_dedup.keys(lines, range_of(lines), line_dedup.steps_of(line_dedup.EDITS)) for k, h in zip(keys.view("int64").tolist(), lines.h[which].view("int64").tolist(), strict=True)}
    once = posted()
    assert set(once) == every and len(once) == len(every)
    monkeypatch.setattr(line_dedup, "REMEMBERED", 2)
    assert set(posted()) == every
    # Few characters are held at once, and one table of powers for each base, whose entries are right.
    assert line_dedup.CHUNK <= 64_000
    assert line_dedup.powers(3, 5).tolist() == [1, 3, 9, 27, 81, 243] and line_dedup.powers(3, 50)[:6].tolist() == line_dedup.powers(3, 5).tolist()


def range_of(lines):
    return np.arange(len(lines.n))


def test_packing_needs_no_plain_python_workers(spark, monkeypatch):
    docs = spark.range(20).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"))
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", None)
    assert packing.pack(docs).count() == 20 and packing.pack(docs.filter("doc_id < 0")).count() == 0


def test_no_task_of_line_dedup_needs_two_workers(spark, monkeypatch):
    said = []

    def cut(df, name, *a, **b):
        if name == "lines-asked":
            said.append(df._jdf.queryExecution().optimizedPlan().toString().split("\n"))
        return common.cut(df, name, *a, **b)

    monkeypatch.setattr(line_dedup, "cut", cut)
    docs = spark.createDataFrame([(1, "a line of forty characters or more than that"), (2, "a line of forty characters or more than this")], "doc_id long, text string")
    assert line_dedup.repeated_lines(docs).count() == 1
    for plan in said:
        at = [i for i, x in enumerate(plan) if "ArrowEvalPython" in x]
        assert len(at) > 1 and any("Rebalance" in x for x in plan[at[0] : at[1]])
    assert said
