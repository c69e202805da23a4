"""Licence notices and identifier tags in texts: Aho-Corasick over words, expressions by shunting-yard."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Notice phrases (words) and their labels that the base asks for.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Further notice phrases and their labels.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "gnu general public license": "gpl",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "isc license": "isc",
    "boost software license": "bsl",
    "zlib license": "zlib",
    "common development and distribution license": "cddl",
    "european union public licence": "eupl",
    "gnu free documentation license": "gfdl",
    "sil open font license": "ofl",
    "artistic license": "artistic",
    "academic free license": "afl",
    "open software license": "osl",
    "microsoft public license": "ms-pl",
    "python software foundation license": "psf",
    "postgresql license": "postgresql",
    "business source license": "busl",
    "server side public license": "sspl",
    "licensed under the apache license": "apache",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "neither the name of the copyright holder nor the names of its contributors": "bsd-3",
    "permission to use copy modify and or distribute this software for any purpose with or without fee": "isc",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "all rights reserved": "all-rights-reserved",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0 universal": "cc0",
}
TAG = "spdx license identifier"
#: Identifiers of the public SPDX licence list that texts carry, the common ones.
IDENTIFIERS = (
    "0BSD AAL AFL-1.1 AFL-1.2 AFL-2.0 AFL-2.1 AFL-3.0 AGPL-1.0 AGPL-1.0-only AGPL-1.0-or-later AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.0 Apache-1.1 Apache-2.0 "
    "APSL-1.0 APSL-1.1 APSL-1.2 APSL-2.0 Artistic-1.0 Artistic-1.0-Perl Artistic-1.0-cl8 Artistic-2.0 Beerware BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause "
    "BSD-3-Clause-Clear BSD-3-Clause-LBNL BSD-4-Clause BSD-4-Clause-UC BSL-1.0 BUSL-1.1 bzip2-1.0.6 CAL-1.0 CATOSL-1.1 CC-BY-1.0 CC-BY-2.0 CC-BY-2.5 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-1.0 CC-BY-NC-2.0 "
    "CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-NC-ND-3.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0 CC-BY-ND-3.0 CC-BY-ND-4.0 CC-BY-SA-1.0 CC-BY-SA-2.0 CC-BY-SA-2.5 CC-BY-SA-3.0 CC-BY-SA-4.0 "
    "CC-PDDC CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-1.0 CECILL-2.0 CECILL-2.1 CECILL-B CECILL-C CPAL-1.0 CPL-1.0 curl ECL-1.0 ECL-2.0 EFL-1.0 EFL-2.0 Entessa EPL-1.0 EPL-2.0 EUDatagrid "
    "EUPL-1.0 EUPL-1.1 EUPL-1.2 Fair FTL GFDL-1.1 GFDL-1.2 GFDL-1.3 GFDL-1.3-only GFDL-1.3-or-later GPL-1.0 GPL-1.0-only GPL-1.0-or-later GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later "
    "HPND ICU IJG ImageMagick Intel IPL-1.0 ISC JSON LGPL-2.0 LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later LiLiQ-P-1.1 "
    "Libpng libtiff LPL-1.02 LPPL-1.3c MirOS MIT MIT-0 MIT-CMU Motosoto MPL-1.0 MPL-1.1 MPL-2.0 MPL-2.0-no-copyleft-exception MS-PL MS-RL MulanPSL-2.0 Multics NASA-1.3 NCSA NGPL NPL-1.1 "
    "NTP OCLC-2.0 ODbL-1.0 ODC-By-1.0 OFL-1.0 OFL-1.1 OGTSL OLDAP-2.8 OpenSSL OSL-1.0 OSL-2.0 OSL-2.1 OSL-3.0 PDDL-1.0 PHP-3.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 Ruby Sleepycat SSPL-1.0 "
    "TCL Unicode-DFS-2016 Unlicense UPL-1.0 Vim W3C WTFPL X11 Xnet ZPL-2.0 ZPL-2.1 Zlib"
).lower().split()
#: Identifiers of exceptions, which stand behind `with`.
EXCEPTIONS = (
    "389-exception Autoconf-exception-2.0 Autoconf-exception-3.0 Bison-exception-2.2 Bootloader-exception Classpath-exception-2.0 CLISP-exception-2.0 eCos-exception-2.0 Font-exception-2.0 "
    "freertos-exception-2.0 GCC-exception-2.0 GCC-exception-3.1 GPL-3.0-linking-exception GPL-CC-1.0 LGPL-3.0-linking-exception Libtool-exception Linux-syscall-note LLVM-exception "
    "OCaml-LGPL-linking-exception OpenJDK-assembly-exception-1.0 openvpn-openssl-exception Qt-GPL-exception-1.0 Qt-LGPL-exception-1.1 u-boot-exception-2.0 Universal-FOSS-exception-1.0 WxWindows-exception-3.1"
).lower().split()
#: Licences (by how their identifiers begin) under which a text may be used without further conditions but attribution.
PERMISSIVE = ("mit", "apache-", "bsd-", "isc", "zlib", "cc0-", "cc-by-1", "cc-by-2", "cc-by-3", "cc-by-4", "unlicense", "0bsd", "bsl-1", "ncsa", "postgresql", "python-", "psf-", "upl-", "wtfpl", "x11", "libpng", "icu", "hpnd", "ntp", "blueoak-")
#: Evidence of a text's labels: an identifier tag of known licences, one of unknown ones, a base phrase, another notice.
TAGGED, UNSURE, PHRASE, NOTICE = 1.0, 0.5, 0.9, 0.6
#: Words are runs of these bytes after A-Z are lower-cased: digits, a-z and all of characters beyond ASCII.
_WORDS = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256)).lower()
_LINE = re.compile(r"SPDX-License-Identifier\s*:?[ \t]*([^\r\n]*)", re.IGNORECASE)
_TOKEN = re.compile(r"\s*([()]|[A-Za-z0-9][A-Za-z0-9.+:\-]*)")
_RANK = {"or": 1, "and": 2, "with": 3}
_KNOWN = {*IDENTIFIERS, *EXCEPTIONS}


def postfix(expression: str) -> list[str]:
    """An and/or/with expression in postfix order, by the shunting-yard method; with binds most, or least.

    Reading stops before what can't go on the expression; [] where there is none or a bracket is left open."""
    out: list[str] = []
    held: list[str] = []
    operand, at, good = True, 0, ([], 0)
    while m := _TOKEN.match(expression, at):
        t, at = m[1], m.end()
        op = t.lower()
        if operand and t == "(":
            held.append(t)
        elif operand and op not in _RANK and t != ")":
            out.append(t)
            operand = False
        elif not operand and op in _RANK:
            while held and held[-1] != "(" and _RANK[held[-1]] >= _RANK[op]:
                out.append(held.pop())
            held.append(op)
            operand = True
        elif not operand and t == ")" and "(" in held:
            while (x := held.pop()) != "(":
                out.append(x)
        else:
            break
        if not operand and "(" not in held:
            good = (out + held[::-1], at)
    return good[0]


def evaluate(rpn: list[str]) -> tuple[set[str], bool] | None:
    """The labels (lower case; `x with y` as one) of a postfix expression, and whether it can be
    met by permissive licences alone: or by either side, and by both."""
    stack: list[tuple[set[str], bool]] = []
    for t in rpn:
        if t in _RANK:
            (b, y), (a, x) = stack.pop(), stack.pop()
            if t == "with":
                stack.append(({f"{'/'.join(sorted(a))} with {'/'.join(sorted(b))}"}, x))
            else:
                stack.append((a | b, x or y if t == "or" else x and y))
        else:
            low = t.lower()
            stack.append(({low}, known(low) and low.startswith(PERMISSIVE)))
    return stack[0] if stack else None


def known(identifier: str) -> bool:
    """Whether a lower-case identifier is on the lists (with + behind it or not) or a reference of one's own."""
    return identifier.removesuffix("+") in _KNOWN or identifier.startswith(("licenseref-", "documentref-"))


def marked(label: str) -> str:
    """A label as it is where all its identifiers are known, else with `unknown:` before it."""
    return label if all(known(x) for part in label.split(" with ") for x in part.split("/")) else f"unknown:{label}"


def automaton():
    import ahocorasick

    made = ahocorasick.Automaton()
    for phrase in {**BASE, **NOTICES, TAG: ""}:
        made.add_word(f" {phrase} ", phrase)
    made.make_automaton()
    return made


def scan(text: str | None, found) -> tuple:
    """n_words, base places, first and last word of them, base labels, all labels, whether permissive (null: no tag), score."""
    words = (text or "").encode("utf-8", "replace").translate(_WORDS).split()
    spaced = f" {b' '.join(words).decode('utf-8', 'replace')} "
    n, first, last, base, more, tagged, at, passed = 0, None, None, set(), set(), False, 0, 0
    for end, phrase in found.iter(spaced):
        if phrase == TAG:
            tagged = True
        elif phrase in BASE:
            passed, at = passed + spaced.count(" ", at, end), end
            start = passed - len(phrase.split())
            n, first, last = n + 1, start if first is None else min(first, start), start if last is None else max(last, start)
            base.add(BASE[phrase])
        else:
            more.add(NOTICES[phrase])
    permissive, score = None, PHRASE if base else NOTICE if more else 0.0
    for m in _LINE.finditer(text) if tagged else ():
        if got := evaluate(postfix(m[1])):
            labels = {marked(x) for x in got[0]}
            more |= labels
            sure = not any(x.startswith("unknown:") for x in labels)
            permissive, score = got[1] and permissive is not False, max(score, TAGGED if sure else UNSURE)
    return len(words), n, first, last, ",".join(sorted(base)), ",".join(sorted(base | more)), permissive, score


_FIELDS = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "permissive": pa.bool_(), "score": pa.float64()}


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = automaton()
    for b in batches:
        rows = [scan(t.as_py(), found) for t in b.column(1)]
        cols = zip(*rows, strict=True) if rows else [[]] * len(_FIELDS)
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), k) for c, k in zip(cols, _FIELDS.values(), strict=True))], ["doc_id", *_FIELDS])


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """For each row of docs: doc_id; n_words; n_base, first_word, last_word (places of BASE phrases, and
    the words where the first and last begin, from 0; null without any); base_labels and labels (also
    those of NOTICES and of identifier tags' expressions; distinct, sorted, joined by commas);
    permissive (whether all tags' expressions can be met by permissive licences; null without a tag);
    score (the best evidence: 1 a tag of listed identifiers, 0.9 a base phrase, 0.6 another notice, 0.5 a tag with an
    identifier that isn't listed, whose label has `unknown:` before it; else 0).

    One pass without a shuffle. Null texts count as empty: no words, no labels (''), score 0;
    repeated rows are each scanned; an empty table gives an empty one.
    """
    rows = docs.select("doc_id", F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    fields = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, permissive boolean, score double"
    return rows.mapInArrow(_scanned, f"doc_id {kind}, {fields}")
