"""Text search used by the reports and list views.

The reports search with ``column LIKE '%' + text + '%'`` and do not escape the
text, so ``%``, ``_`` and bracket classes in it act as wildcards. Two modes:

* ``"contains"`` (default): the text is a literal substring.
* ``"like"``: the text keeps its wildcard meaning (``%`` any run, ``_`` one
  character, ``[abc]`` / ``[a-z]`` / ``[^abc]`` a class). The pattern is turned
  into an anchored regular expression, because Spark's LIKE has no bracket
  classes and rejects a stray backslash.

``collation`` compares under a Spark collation, e.g. ``"UTF8_LCASE"`` for a
case-insensitive search. In ``"like"`` mode text and pattern are folded the way
the collation ignores differences (case, accents, trailing blanks) and then
compared; a text without wildcards is an ordinary ``contains``. Only the
collations of ``LIKE_COLLATIONS`` fold by rule; others are refused there.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def like_to_regex(pattern: str) -> str:
    """Translate a bracket-class LIKE pattern to an anchored Java regex."""
    out, i, n = ["(?s)^"], 0, len(pattern)
    while i < n:
        ch = pattern[i]
        if ch == "%":
            out.append(".*")
        elif ch == "_":
            out.append(".")
        elif ch == "[":
            end = pattern.find("]", i + 2 if i + 1 < n and pattern[i + 1] == "^" else i + 1)
            if end == -1:  # unmatched bracket: literal
                out.append(re.escape(ch))
            else:
                body = pattern[i + 1:end]
                neg = body.startswith("^")
                if neg:
                    body = body[1:]
                out.append(_char_class(body, neg))
                i = end
        else:
            out.append(re.escape(ch))
        i += 1
    out.append("$")
    return "".join(out)


def _char_class(body: str, neg: bool) -> str:
    """A character class with its ranges. An empty class, and a range that
    runs backwards, match no character, rather than failing the job."""
    parts, i = [], 0
    while i < len(body):
        if i + 2 < len(body) and body[i + 1] == "-":
            if body[i] <= body[i + 2]:
                parts.append(f"{re.escape(body[i])}-{re.escape(body[i + 2])}")
            i += 3
        else:
            parts.append(re.escape(body[i]))
            i += 1
    if not parts:
        return "." if neg and body else "(?!)"
    return f"[{'^' if neg else ''}{''.join(parts)}]"


#: Collations that ``"like"`` mode knows, each also with ``_RTRIM``: those under
#: which Spark searches text at all, of no language in particular.
LIKE_COLLATIONS = ("UTF8_BINARY", "UTF8_LCASE", "UNICODE", "UNICODE_CI", "UNICODE_CI_AI")


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """(characters, their replacements) for ``translate``: composed letters to
    their base letter; the marks, listed last, have no replacement and go."""
    def is_mark(c: str) -> bool:
        # from 10 on: points, vowel marks and accents, not signs that are letters of a script
        return unicodedata.combining(c) >= 10

    every = [chr(n) for n in range(0x80, 0x10000) if not 0xD800 <= n < 0xE000]
    base = {c: d[0] for c in every for d in [unicodedata.normalize("NFD", c)] if len(d) > 1 and all(map(is_mark, d[1:]))}
    return "".join(base) + "".join(c for c in every if is_mark(c)), "".join(base.values())


def _folding(collation: str | None) -> tuple[bool, bool, bool, bool]:
    """(by lower case, by full case folding, without accents, without trailing
    blanks) of a collation."""
    name = (collation or "UTF8_BINARY").upper()
    base = name.removesuffix("_RTRIM")
    if base not in LIKE_COLLATIONS:
        raise ValueError(f"no wildcard search under the collation {collation!r}; known are {', '.join(LIKE_COLLATIONS)}, also with _RTRIM")
    return base == "UTF8_LCASE", "_CI" in base, base == "UNICODE_CI_AI", base != name


def fold(col: Column, collation: str | None) -> Column:
    """Text such that values which are equal under ``collation`` become equal."""
    lower, ci, ai, rtrim = _folding(collation)
    if ai:
        chars, base = _accents()
        col = F.translate(col, chars, base)
    if lower or ci:
        # through upper case for full folding: sharp s is ss, ligatures are
        # letters (the optimiser would drop an upper directly inside a lower)
        col = F.translate(F.lower(F.translate(F.upper(col), "\0", "\0") if ci else col), "ς", "σ")
    return F.rtrim(col) if rtrim else col


def fold_text(text: str, collation: str | None) -> str:
    """``fold`` of a Python text, for patterns."""
    lower, ci, ai, rtrim = _folding(collation)
    if ai:
        chars, base = _accents()
        text = text.translate(str.maketrans(chars[:len(base)], base, chars[len(base):]))
    if lower or ci:
        text = (text.upper() if ci else text).lower().replace("ς", "σ")
    return text.rstrip(" ") if rtrim else text


def _collated(col: Column, collation: str | None) -> Column:
    return F.collate(col, collation) if collation else col


def text_match(col: Column | str, text: str, mode: str = "contains",
               collation: str | None = None) -> Column:
    """Boolean column: does ``col`` contain ``text`` (see module doc)."""
    c = F.col(col) if isinstance(col, str) else col
    if mode == "contains":
        return _collated(c, collation).contains(F.lit(text))
    if mode == "like":
        folded = fold_text(text, collation)     # refuses other collations
        if not set("%_[") & set(text):
            return _collated(c, collation).contains(F.lit(text))
        return fold(c, collation).rlike(like_to_regex(f"%{folded}%"))
    raise ValueError(f"unknown text match mode: {mode!r}")


def equals(col: Column | str, value: str, collation: str | None = None) -> Column:
    """Name equality under an optional collation (e.g. ``UTF8_LCASE``, or an
    ``*_RTRIM`` collation to ignore trailing blanks as SQL Server does)."""
    c = F.col(col) if isinstance(col, str) else col
    return _collated(c, collation) == F.lit(value)
