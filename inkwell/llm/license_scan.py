"""Licence scan: an Aho-Corasick automaton and a parser of licence expressions.

Texts are reduced to lower-case words (runs of a-z, 0-9 and non-ASCII), joined
by single spaces, and passed once through an automaton of notice phrases. The
identifier tag ``SPDX-License-Identifier:`` is a hit of the same pass (its words
stand consecutively); the expression after it, on the raw line, is parsed by a
shunting-yard parser with and / or / with and brackets. Its names must be known
identifiers, those of ``data/licence_ids.txt`` unless others are given.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import batch, map_rows

#: Fixed values of the contract: phrase and label.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notice phrases of well-known licences, in words, and their labels.
NOTICES = {
    "permission is hereby granted free of charge": "mit",
    "licensed under the mit license": "mit",
    "released under the mit license": "mit",
    "under the terms of the mit license": "mit",
    "licensed under the apache license": "apache",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "eclipse public license": "epl",
    "permission to use copy modify and or distribute this software": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "boost software license": "bsl",
    "gnu free documentation license": "gfdl",
    "the software is provided as is without warranty of any kind": "no-warranty",
    "this software is provided as is without any express or implied warranty": "zlib",
    "this software is provided by the copyright holders and contributors as is": "bsd",
    "neither the name of the copyright holder nor the names of its contributors": "bsd",
    "you may not use this file except in compliance with the license": "apache",
    "this source code form is subject to the terms of the mozilla public": "mpl",
    "licensed under the bsd": "bsd",
    "eclipse distribution license": "edl",
    "gnu lesser general public": "lgpl",
    "gnu affero general public": "agpl",
    "common development and distribution license": "cddl",
    "european union public licence": "eupl",
    "open software license": "osl",
    "academic free license": "afl",
    "artistic license": "artistic",
    "do what the fuck you want to public license": "wtfpl",
    "sil open font license": "ofl",
    "python software foundation license": "psf",
    "business source license": "busl",
    "server side public license": "sspl",
    "open database license": "odbl",
    "attribution noncommercial": "cc-nc",
    "attribution sharealike": "cc-by-sa",
    "dedicated to the public domain": "public-domain",
    "released into the public domain": "public-domain",
    "used with permission": "permission",
    "reproduced with permission": "permission",
    "no part of this publication may be reproduced": "reserved",
}
TAG = "spdx license identifier"

#: Bytes to words: A-Z lowered, other ASCII but digits and letters to spaces.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(r"[0-9A-Za-z\x80-\U0010FFFF]+")
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+")
_LEVEL = {"or": 1, "and": 2, "with": 3}
#: References of a document's own, which the identifier list leaves open.
_OWN = re.compile(r"(?:documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+")
IDS = Path(__file__).with_name("data") / "licence_ids.txt"

#: Licences that ask for no more than notices: what ``accepted`` is by default.
PERMISSIVE = frozenset("""0bsd apache-2.0 bsd-2-clause bsd-3-clause bsl-1.0 cc-by-3.0 cc-by-4.0 cc0-1.0 isc mit mit-0
    postgresql psf-2.0 unlicense upl-1.0 zlib""".split())


@dataclass(frozen=True)
class Names:
    """Known licence and exception identifiers, in lower case."""

    licences: frozenset[str]
    exceptions: frozenset[str]

    @classmethod
    @lru_cache
    def load(cls, path: str = str(IDS)) -> Names:
        found: dict[bool, set[str]] = {False: set(), True: set()}
        for line in Path(path).read_text(encoding="utf-8").lower().splitlines():
            is_exception = line.startswith("exception:")
            name, *versions = line.removeprefix("exception:").split() or ["#"]
            if not name.startswith("#"):
                found[is_exception] |= {f"{name}-{v}" for v in versions} or {name}
        return cls(frozenset(found[False]), frozenset(found[True]))

    def is_licence(self, name: str) -> bool:
        return name in self.licences or name.endswith("+") and name[:-1] in self.licences or bool(_OWN.fullmatch(name))


def parse_expression(text: str, names: Names | None = None) -> tuple[list, int]:
    """The licence expression at the start of ``text`` in reverse Polish order
    (names, and operators as 1-tuples), and the number of its tokens; ([], 0)
    if there is none.

    Shunting-yard: ``with`` binds tighter than ``and``, that tighter than
    ``or``; operators are read in any case. The expression ends before the
    first token that cannot go on with it, such as the end of a comment. It is
    valid if it is complete there, all brackets closed, and every name is
    known; ``with`` joins a licence and an exception.
    """
    names = names or Names.load()
    out, ops, operand, depth, used = [], [], True, 0, 0
    for token in _TOKEN.findall(text):
        low = token.lower()
        if operand:
            if token == "(":
                if ops and ops[-1] == "with":
                    return [], 0
                ops.append("(")
                depth += 1
            elif low in names.exceptions if ops and ops[-1] == "with" else names.is_licence(low):
                out.append(low)
                operand = False
            else:
                return [], 0
        elif token == ")" and depth:
            while ops[-1] != "(":
                out.append((ops.pop(),))
            ops.pop()
            depth -= 1
        elif low in _LEVEL:
            if low == "with" and (not isinstance(out[-1], str) or ops and ops[-1] == "with"):
                return [], 0  # only a licence by itself has an exception
            while ops and ops[-1] != "(" and _LEVEL[ops[-1]] >= _LEVEL[low]:
                out.append((ops.pop(),))
            ops.append(low)
            operand = True
        else:
            break
        used += 1
    if operand or depth:
        return [], 0
    return [*out, *[(o,) for o in reversed(ops)]], used


def evaluate(rpn: list, accepted: frozenset[str] = PERMISSIVE) -> bool:
    """Whether the accepted licences satisfy an expression: one side of an
    ``or``, both sides of an ``and``. A licence with an exception is accepted
    where the licence is, or the pair as ``licence with exception``. One pass,
    whatever the size; the empty expression is not satisfied."""
    def holds(x) -> bool:
        return x in accepted if isinstance(x, str) else x

    stack: list = []  # names, and truths of the parts evaluated
    for item in rpn:
        if isinstance(item, str):
            stack.append(item)
            continue
        b, a = stack.pop(), stack.pop()
        if item[0] == "with":
            stack.append(holds(a) or f"{a} with {b}" in accepted)
        else:
            stack.append(holds(a) or holds(b) if item[0] == "or" else holds(a) and holds(b))
    return bool(stack) and holds(stack[0])


def licences_of(rpn: list) -> set[str]:
    """All names of an expression; an exception stays with its licence."""
    out: list[str] = []
    for item in rpn:
        if isinstance(item, str):
            out.append(item)
        elif item[0] == "with":  # its two names stand directly before it
            exception = out.pop()
            out.append(f"{out.pop()} with {exception}")
    return set(out)


def written(rpn: list) -> str:
    """An expression in reverse Polish order, as text."""
    return " ".join(x if isinstance(x, str) else x[0] for x in rpn)


def words_of(text: str) -> bytes:
    """The words of a text joined by single spaces, as UTF-8."""
    return b" ".join(text.encode("utf-8", "surrogatepass").translate(_TABLE).split())


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase in {**BASE, **NOTICES, TAG: None}:
        a.add_word(f" {phrase} ", phrase)
    a.make_automaton()
    return a


def _after_tags(text: str, words: list[int]) -> list[str]:
    """The rest of the line behind each identifier tag, whose first of three
    words has one of the numbers ``words``."""
    at = [m.span() for m in _WORD.finditer(text)]
    out = []
    for w in words:
        start, end = at[w][0], at[w + 2][1]
        if text[start : end + 1].lower() == "spdx-license-identifier:":
            out.append(re.match(r"[^\r\n]*", text[end + 1 :])[0])
    return out


def scan(text: str, a: ahocorasick.Automaton, names: Names, accepted: frozenset[str] = PERMISSIVE) -> dict:
    words = words_of(text)
    line = f" {words.decode('latin-1')} "  # one character per byte; keys are ASCII
    hits, seen, at = [], 0, 0
    for end, phrase in a.iter(line):
        start = end - len(phrase)  # of the first word, behind its space
        seen += line.count(" ", at, start) if start >= at else -line.count(" ", start, at)
        at = start
        hits.append((seen - 1, phrase))
    base = [(w, p) for w, p in hits if p in BASE]
    found = {BASE.get(p) or NOTICES[p] for _, p in hits if p != TAG}
    tagged = [w for w, p in hits if p == TAG]
    parsed = [(rest.strip(), rpn) for rest in (_after_tags(text, tagged) if tagged else ()) for rpn, _ in [parse_expression(rest, names)] if rpn]
    for _, rpn in parsed:
        found |= licences_of(rpn)
    return {
        "n_words": words.count(b" ") + 1 if words else 0,
        "n_base": len(base),
        "first_word": min((w for w, _ in base), default=None),
        "last_word": max((w for w, _ in base), default=None),
        "base_labels": ",".join(sorted({BASE[p] for _, p in base})),
        "labels": ",".join(sorted(found)),
        "score": 1.0 if parsed else 1 - 0.5 ** len({p for _, p in hits if p != TAG}),
        "expressions": [e for e, _ in parsed],
        "parsed": [written(rpn) for _, rpn in parsed],
        "accepted": [evaluate(rpn, accepted) for _, rpn in parsed],
    }


_OUT = {
    "doc_id": pa.int64(), "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(),
    "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(),
    "expressions": pa.list_(pa.string()), "parsed": pa.list_(pa.string()), "accepted": pa.list_(pa.bool_()),
}


def _scan_batches(names: Names, accepted: frozenset[str]):
    def run(batches):
        a = automaton()
        for rb in batches:
            out = {n: [] for n in _OUT}
            for doc_id, text in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()):
                out["doc_id"].append(doc_id)
                for n, v in scan(text or "", a, names, accepted).items():
                    out[n].append(v)
            yield batch(_OUT, out)

    return run


def scan_licences(docs: DataFrame, names: Names | None = None, accepted: frozenset[str] = PERMISSIVE) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score, and per valid expression after an identifier tag:
    expressions (the rest of its line), parsed (in reverse Polish order),
    accepted (whether the licences ``accepted`` satisfy it).

    score: 1 with a valid expression, else 1 - 0.5^(distinct phrases). Null and
    empty texts have no words and score 0. Repeated rows repeat. An expression
    that does not parse, or names an unknown licence, adds no label.
    Expressions may have any size. Only doc_id and text are read.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_rows(d, _scan_batches(names or Names.load(), accepted), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, parsed array<string>, accepted array<boolean>")
