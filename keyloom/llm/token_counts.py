"""Token counts by pre-token: pieces are counted once for each distinct pre-token of a batch."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import mul

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A character outside printable ASCII, tab, line feed, carriage return and the visible Latin-1 letters and signs.
#: Without one, normal form C changes nothing and lower-casing is that of Python.
ODD = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\xff]")
#: White space as the tokenizer's normaliser has it. No normal form or case joins what it parts.
SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Pre-tokens whose pieces a worker remembers (some 150 bytes each), and characters of texts whose frequencies are held at once.
REMEMBERED, CHUNK = 500_000, 2_000_000


def tokenizer(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


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


def counted(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """(key, text) to (key, n_bytes, n_tokens).

    For each text the frequencies of its pre-tokens (runs between white space); of some texts' distinct
    ones those not yet known are encoded once, for their number of pieces only; then frequencies and
    numbers are joined and summed. Only texts with a special token's string go to the tokenizer whole."""
    tok = tokenizer(path)
    special = [t.content for t in tok.get_added_tokens_decoder().values()]
    pieces: dict[str, int] = {}
    for b in batches:
        for first, texts in chunks(b.column(1)):
            held: list[Counter | None] = []
            for t in texts:
                t = t or ""
                words = SPACE.split(t) if ODD.search(t) else t.lower().split()
                held.append(None if any(s in t for s in special) else Counter(words))
            asked = set().union(*(h for h in held if h))
            new = [w for w in asked if w not in pieces]
            if len(pieces) + len(new) > REMEMBERED:
                # Those met again in these texts stay, frequent ones among them.
                pieces = {w: pieces[w] for w in asked if w in pieces}
            for at in range(0, len(new), 20_000):
                part = new[at : at + 20_000]
                pieces |= {w: len(e) for w, e in zip(part, tok.encode_batch_fast(part, add_special_tokens=False), strict=True)}
            n = [sum(map(mul, h.values(), map(pieces.__getitem__, h))) if h is not None else len(tok.encode(t, add_special_tokens=False)) for t, h in zip(texts, held, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(texts)), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs, as the tokenizers file at path counts.

    The path is one that every executor has. The join of frequencies with pieces is local to an
    Arrow batch: shuffling (document, pre-token) rows would move several times the input. So there is no shuffle and no hot key.
    Null texts count as empty (0 tokens); repeated rows are each counted; an empty table gives an empty one.
    """
    rows = docs.select("doc_id", F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(lambda b: counted(b, path), f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
