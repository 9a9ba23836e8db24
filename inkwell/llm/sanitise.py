"""Personal data: patterns, and terms that disclose what they stand beside.

Base spans are found by pattern (email, ip, card, phone). Each distinct value
is a protected entity e. Corpus co-occurrence says how much a neighbouring term
t tells about it:

    PMI(t; e) = log2( n(t, e) N / (n(t) n(e)) ),   IC(e) = log2( N / n(e) )

with counts in whole documents. A term is a run of letters of any length. One
with PMI >= ``alpha`` * IC, that is with p(e | t) >= p(e)^(1 - alpha), discloses
e and is a span too at every place outside base spans, in every document, also
in one that does not print e. It must do so in ``support`` distinct texts, so
what a text and its exact copies share is no evidence.

Pairs are counted only where they can disclose: for entities in ``support``
texts, and, as n(t, e) <= n(e), for terms with n(t) <= N (n(e) / N)^alpha.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import batch, fingerprints, join_spread, map_rows, stored

KINDS = ("email", "ip", "card", "phone", "term")
ALPHA, SUPPORT = 0.9, 3
#: Hot entities and terms meet their texts in a join salted by text.
SALTS = 16
#: Bits of the filter sent to the tasks that mark terms; with more terms it only lets more places through.
MOST_BITS = 1 << 25

#: Patterns of the contract.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # a match in a run of digits starts it
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_TERM = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str):
    """Spans of the email pattern, in linear time. Each match holds one @. It
    starts where the run of local characters before that @ starts, or where
    the match before ended: from within a run the pattern fails as from its start."""
    done, at = 0, text.find("@")
    while at >= 0:
        start, end = at, at + 1
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = end = m.end()
            yield start, done
        at = text.find("@", end)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the four kinds, by start and then kind."""
    out = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _entity(text: str, span: tuple[int, int, int]) -> int:
    a, kind, b = span
    value = text[a:b].lower() if kind < 2 else "".join(c for c in text[a:b] if c.isdigit())
    return xxhash.xxh3_64_intdigest(f"{KINDS[kind]}:{value}".encode("utf-8", "surrogatepass")) - 2**63


def term_hash(term: str) -> int:
    return xxhash.xxh3_64_intdigest(term.encode("utf-8", "surrogatepass")) - 2**63


def terms_of(text: str) -> set[str]:
    return {w.lower() for w in set(_TERM.findall(text))}


def _outside(base: list[tuple[int, int, int]]):
    """A test whether a place overlaps no base span: of the spans that start
    before its end, the furthest end lies at or before its start."""
    starts, furthest = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max))

    def test(a: int, b: int) -> bool:
        i = bisect_left(starts, b)
        return not i or furthest[i - 1] <= a

    return test


_OUT = {
    "doc_id": pa.int64(), "fp1": pa.int64(), "fp2": pa.int64(),
    "base": pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])),
    "base_sha256": pa.string(), "entities": pa.list_(pa.int64()), "terms": pa.list_(pa.int64()),
}
_SCHEMA = "doc_id long, fp1 long, fp2 long, base array<struct<start: long, kind: int, end: long>>, base_sha256 string, entities array<long>, terms array<long>"


def _find(batches):
    for rb in batches:
        out = {n: [] for n in _OUT}
        for n, c in zip(_OUT, range(3)):
            out[n] = rb.column(c)
        for text in rb.column(3).to_pylist():
            text = text or ""
            spans = base_spans(text)
            out["base"].append([{"start": a, "kind": k, "end": b} for a, k, b in spans])
            out["base_sha256"].append(hashlib.sha256(written(spans).encode()).hexdigest())
            out["entities"].append(sorted({_entity(text, s) for s in spans}))
            out["terms"].append(sorted(map(term_hash, terms_of(text))) if spans else [])
        yield batch(_OUT, out)


#: Terms a task counts before it hands its counts on.
_FLUSH = 200_000


def _count_terms(batches):
    kinds = {"term": pa.int64(), "n": pa.int64()}
    count: Counter[str] = Counter()
    for rb in batches:
        for text in rb.column(0).to_pylist():
            count.update(terms_of(text) if text else ())
            if len(count) >= _FLUSH:
                yield batch(kinds, {"term": list(map(term_hash, count)), "n": list(count.values())})
                count.clear()
    yield batch(kinds, {"term": list(map(term_hash, count)), "n": list(count.values())})


#: Words a task keeps with their hash or None, so that each is hashed once.
_KEEP = 400_000


def _bits(h: int, size: int) -> tuple[int, int]:
    return h & (size - 1), (h >> 32) & (size - 1)


def _filter(terms: DataFrame) -> np.ndarray:
    """A Bloom filter of the term hashes, two bits each, in at most MOST_BITS / 64 words."""
    size = min(MOST_BITS, 1 << max(6, (64 * terms.count()).bit_length()))
    at = F.explode(F.array(F.col("term").bitwiseAND(F.lit(size - 1)), F.shiftright("term", 32).bitwiseAND(F.lit(size - 1))))
    words = terms.select(at.alias("at")).selectExpr("shiftright(at, 6) word", "shiftleft(1L, cast(at & 63 as int)) bit")
    words = words.groupBy("word").agg(F.expr("bit_or(bit)").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out


def _places(words: np.ndarray):
    """Places outside base spans of the terms that pass the filter."""
    kinds = {"fp1": pa.int64(), "fp2": pa.int64(), "term": pa.int64(), "start": pa.int64(), "end": pa.int64()}
    size = 64 * len(words)

    def run(batches):
        data = words.astype("<i8").tobytes()
        known: dict[str, int | None] = {}
        for rb in batches:
            rows = []
            for fp1, fp2, text in zip(*(rb.column(i).to_pylist() for i in range(3))):
                wanted = {}
                for w in set(_TERM.findall(text)) if text else ():
                    if w not in known:
                        if len(known) >= _KEEP:
                            known.clear()
                        h = term_hash(w.lower())
                        known[w] = h if all(data[i >> 3] >> (i & 7) & 1 for i in _bits(h, size)) else None
                    if known[w] is not None:
                        wanted[w] = known[w]
                if wanted:
                    outside = _outside(base_spans(text))
                    rows += [(fp1, fp2, wanted[m[0]], *m.span()) for m in _TERM.finditer(text) if m[0] in wanted and outside(*m.span())]
            yield batch(kinds, dict(zip(kinds, zip(*rows))) if rows else {n: [] for n in kinds})

    return run


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _salt(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.pmod(F.col("fp1"), F.lit(SALTS)).cast("int"))


def _disclosing(docs: DataFrame, found: DataFrame, total: int, alpha: float, support: int) -> DataFrame | None:
    """The distinct terms that disclose an entity, or None."""
    text = found.filter(F.size("entities") > 0).groupBy("fp1", "fp2").agg(F.count(F.lit(1)).alias("n"), F.first("entities").alias("entities"), F.first("terms").alias("terms"))  # copies first
    held = text.select("fp1", "fp2", "n", F.explode("entities").alias("entity"))
    live = held.groupBy("entity").agg(F.sum("n").alias("n_e"), F.count(F.lit(1)).alias("texts")).filter((F.col("texts") >= support) & (F.col("n_e") < total))
    most = F.lit(float(total)) * F.pow(F.col("n_e") / F.lit(float(total)), F.lit(float(alpha))) * F.lit(1 + 1e-9)
    live = live.select("entity", "n_e", most.alias("most"))
    held = stored(_salt(held).join(_salted(live), ["entity", "salt"]).drop("salt"), "held")
    if held.isEmpty():
        return None
    some = held.groupBy("fp1", "fp2").agg(F.max("most").alias("most"))
    held_term = text.select("fp1", "fp2", "terms").join(some, ["fp1", "fp2"]).select("fp1", "fp2", "most", F.explode("terms").alias("term"))
    term = held_term.groupBy("term").agg(F.count(F.lit(1)).alias("texts"), F.max("most").alias("most")).filter(F.col("texts") >= support)
    counts = map_rows(docs.select("text"), _count_terms, "term long, n long").groupBy("term").agg(F.sum("n").alias("n_t"))
    term = stored(term.join(counts, "term").filter("n_t <= most").select("term", "n_t"), "terms")
    pair = _salt(held_term).join(_salted(term), ["term", "salt"]).filter("n_t <= most").select("fp1", "fp2", "term", "n_t")
    pair = pair.join(held, ["fp1", "fp2"]).filter("n_t <= most")
    pair = pair.groupBy("entity", "term").agg(F.sum("n").alias("n_te"), F.count(F.lit(1)).alias("texts"), F.first("n_t").alias("n_t"), F.first("n_e").alias("n_e")).filter(F.col("texts") >= support)
    ic = F.log2(F.lit(float(total)) / F.col("n_e"))
    pmi = F.log2(F.col("n_te") * F.lit(float(total)) / (F.col("n_t") * F.col("n_e")))
    told = stored(pair.filter(pmi >= alpha * ic).select("term").distinct(), "told")
    return None if told.isEmpty() else told


def find_personal_data(docs: DataFrame, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, all
    (array of start, kind, end), n_term; and fp1, fp2, the keys of a text.

    Null and empty texts have no spans. Rows that repeat a text share their
    spans. Offsets count code points, ends are exclusive. Other columns are not
    read.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *fingerprints(), "text")
    found = stored(map_rows(d, _find, _SCHEMA).withColumn("row", F.monotonically_increasing_id()), "spans")
    total = found.count()

    told = _disclosing(docs, found, total, alpha, support)
    span = "struct<start: long, kind: int, end: long>"
    if told is None:
        out = found.withColumn("more", F.array().cast(f"array<{span}>"))
    else:
        place = map_rows(docs.select(*fingerprints(), "text"), _places(_filter(told)), "fp1 long, fp2 long, term long, start long, end long").distinct()  # copies first
        place = _salt(place).join(_salted(told), ["term", "salt"])
        more = place.groupBy("fp1", "fp2").agg(F.collect_list(F.struct("start", F.lit(4).alias("kind"), "end")).alias("more"))
        out = join_spread(found, more, ["fp1", "fp2"], F.col("row"))  # copies of one text spread
    out = out.drop("entities", "terms")
    every = F.sort_array(F.concat("base", F.coalesce("more", F.array().cast(f"array<{span}>"))))
    out = out.withColumn("all", every)
    name = F.array(*map(F.lit, KINDS))
    text = F.array_join(F.transform("all", lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"], s["end"])), ",")
    kinds = F.transform("all", lambda s: s["kind"])
    count = [(F.size("all") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{n}") for k, n in enumerate(KINDS)]
    return out.select("doc_id", *count[:4], "base_sha256", text.alias("spans"), count[4], "all", "fp1", "fp2")


def _replace(batches):
    for rb in batches:
        texts = []
        for text, spans in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()):
            if text and spans:
                out, at = [], 0
                for s in spans:
                    if s["start"] >= at:
                        out.append(text[at : s["start"]])
                        out.append(f"[{KINDS[s['kind']].upper()}]")
                    at = max(at, s["end"])
                text = "".join(out) + text[at:]
            texts.append(text)
        yield rb.select(range(2, rb.num_columns)).append_column("_text", pa.array(texts, pa.string()))


def sanitised_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents with every span replaced by its kind in brackets (a term
    is so generalised); overlapping spans go with the first. Same columns as
    ``docs``; ``n_chars`` follows the text where there is one.

    Null and empty texts stay as they are. Rows that repeat a text are each
    returned, with the same replacements. An empty table gives no rows.
    """
    found = find_personal_data(docs, **options).filter(F.size("all") > 0)
    found = found.groupBy("fp1", "fp2").agg(F.first("all").alias("_spans")).select(F.col("fp1").alias("_fp1"), F.col("fp2").alias("_fp2"), "_spans")
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    d = docs.select("text", F.struct(*rest).alias("_rest") if rest else F.lit(None).alias("_rest"), *fingerprints())
    d = join_spread(d, found, ["_fp1", "_fp2"], F.xxhash64(F.to_json("_rest")) if rest else F.lit(0))
    kind = d.schema["_rest"].dataType.simpleString()
    d = map_rows(d.select("text", "_spans", "_rest"), _replace, f"_rest {kind}, _text string")
    new = {"text": F.col("_text"), "n_chars": F.char_length("_text")}
    return d.select(*[new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col("_rest")[c].alias(c) for c in docs.columns])
