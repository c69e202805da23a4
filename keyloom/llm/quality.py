"""Quality rules as a short-circuit cascade (native)."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free

SPACE = r"\x20\x09-\x0D"
SYMBOLS = "#*$%&|<>"
#: Rows of the sample on which cost and rejection of the rules are measured, and in how many runs (the least time counts).
SAMPLE_ROWS, RUNS = 1000, 2


@dataclass(frozen=True)
class Rule:
    """A document is rejected where `fails`, given a function from a feature's name to its column, is true."""

    name: str
    needs: tuple[str, ...]
    fails: Callable[[Callable[[str], Column]], Column]


#: In the order of definition; the cascade puts them in its own.
RULES = (
    Rule("few_words", ("n_words",), lambda f: f("n_words") < 50),
    Rule("repeated_words", ("n_words", "n_repeat_words"), lambda f: 100 * f("n_repeat_words") > 50 * f("n_words")),
    Rule("symbols", ("n_words", "n_symbols"), lambda f: 10 * f("n_symbols") > f("n_words")),
    Rule("word_length", ("n_words", "word_chars"), lambda f: (f("word_chars") < 3 * f("n_words")) | (f("word_chars") > 12 * f("n_words"))),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), lambda f: 2 * f("n_dup_lines") > f("n_lines")),
    Rule("letters", ("n_words", "n_letter_words"), lambda f: 10 * f("n_letter_words") < 8 * f("n_words")),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))


def _neighbours(a: Column, merge: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(F.slice(a, F.lit(1), F.size(a) - 1), F.slice(a, F.lit(2), F.size(a) - 1), merge)


def _repeat_words(w: Column) -> Column:
    # Sorted (hash, place) of the windows: equal neighbours repeat. Then the words that their places cover.
    windows = F.sort_array(F.transform(F.slice(w, F.lit(1), F.size(w) - 2), lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("k"), i.alias("i"))))
    twice = lambda g: F.flatten(F.filter(_neighbours(g, lambda a, b: F.when(a["k"] == b["k"], F.array(a["i"], b["i"]))), lambda x: x.isNotNull()))
    covered = lambda p: F.aggregate(_neighbours(p, lambda a, b: F.least(F.lit(3), b - a)), F.lit(3), lambda s, x: s + x)
    found = _let(windows, lambda g: _let(twice(g), lambda r: F.when(F.size(r) > 0, _let(F.sort_array(F.array_distinct(r)), covered))))
    return F.when(F.size(w) > 3, F.coalesce(found, F.lit(0))).otherwise(0)


#: Features by name, of the text and its words (runs without white space). n_repeat_words: words in three-word windows
#: that the text has twice or more (told apart by 64-bit hashes); n_dup_lines: lines with a word, equal to an earlier one.
FEATURES: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda t, w: F.size(w),
    "word_chars": lambda t, w: F.length(F.regexp_replace(t, f"[{SPACE}]+", "")),
    "n_symbols": lambda t, w: F.length(t) - F.length(F.translate(t, SYMBOLS, "")),
    "n_letter_words": lambda t, w: F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))),
    "n_lines": lambda t, w: F.size(_lines(t)),
    "n_dup_lines": lambda t, w: _let(_lines(t), lambda x: F.size(x) - F.size(F.array_distinct(x))),
    "n_repeat_words": lambda t, w: _repeat_words(w),
}


def ordered(docs: DataFrame, text: str, rules: tuple[Rule, ...], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejection per second on a sample of about sample_rows documents, best first.

    The sample is drawn from the whole table by a hash of the text (its rate from the number of rows). What a job
    takes that only reads the sample is taken off, and each rule's first run, which compiles it, doesn't count.
    Only the order depends on the sample and the clock, never a verdict."""
    rate = max(1, docs.count() // sample_rows)
    t = F.coalesce(F.col(text), F.lit(""))
    sample = cut(docs.filter(F.pmod(F.xxhash64(text), F.lit(rate)) == 0).select(t.alias("t")), "quality-sample")

    def timed(fails: Column) -> tuple[float, int, int]:
        took = []
        for _ in range(1 + RUNS):
            began = time.perf_counter()
            n, bad = sample.agg(F.count("*"), F.count_if(fails)).first()
            took.append(time.perf_counter() - began)
        return min(took[1:]), n, bad

    least = timed(F.length("t") < 0)[0]
    scored = []
    for rule in rules:
        took, n, bad = timed(_let(_words(F.col("t")), lambda w: rule.fails(lambda name: FEATURES[name](F.col("t"), w))))  # noqa: B023
        scored.append((-(bad + 0.5) / (n + 1) / max(took - least, 1e-3), rule.name, rule))
    return [x[2] for x in sorted(scored, key=lambda x: x[:2])]


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, always: tuple[str, ...] = (), sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with kept and the features in always (columns of these names are replaced).

    kept is false where any rule fails. The rules are the branches of one CASE in the order of
    `ordered`: once a row has failed one, later rules neither run nor have their features
    computed for it, but for those in always. One pass, no shuffle: a hot key is harmless.
    Null texts count as empty (no words: rejected by few_words); repeated rows are each judged;
    an empty table gives an empty one.
    """
    order = ordered(docs, text, rules, sample_rows)
    own = free(docs)
    whole, words = f"{own}text", f"{own}words"
    out = docs.drop("kept", *(c for c in always if c != text)).withColumn(whole, F.coalesce(F.col(text), F.lit("")))
    t = F.col(whole)
    if always:
        out = out.withColumn(words, _words(t))
        out = out.withColumns({name: FEATURES[name](t, F.col(words)).cast("long") for name in always})

    def verdict(w: Column) -> Column:
        one = F.when(F.lit(False), False)
        for rule in order:
            one = one.when(rule.fails(lambda name: F.col(name) if name in always else FEATURES[name](t, w)), False)
        return one.otherwise(True)

    out = out.withColumn("kept", verdict(F.col(words)) if always else _let(_words(t), verdict))
    return out.drop(whole, words)
