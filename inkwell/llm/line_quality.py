"""Quality rules with cross-document line frequency.

1. Each text is measured alone (words, symbols, repeated lines and windows),
   and its lines are normalised (lower case A-Z, single spaces) and hashed.
2. Per host, the distinct documents that hold a line are counted. Documents
   are told apart by their text, so exact copies count once. Documents carry
   their host in ``source``.
3. A line in more documents of its host than the limit is removed from all but
   the first of them (smallest id), so that one original survives. The limit
   is ``least_documents`` whatever the size of the host; a caller may raise it
   to ``share`` of the host's documents, which is 0 unless given.
4. A document that loses more than ``most_removed`` of its words, or keeps
   fewer than ``LEAST_WORDS``, is rejected.

Frequent lines meet the documents that hold them in a join salted by document,
so a line in a third of all documents is spread over ``SALTS`` tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import batch, fingerprints, map_rows, stored, windows, word_hashes

SALTS = 32
LEAST_DOCUMENTS, SHARE, MOST_REMOVED = 10, 0.0, 0.7
LEAST_WORDS = 20
_SPACE, _SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
WINDOW = 8


def measures(text: str | None) -> tuple[int, int, int, int, int, dict[int, list]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and per
    normalised line hash its words in the text and its line numbers."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    chars = len(text) - (len(data) - len(data.translate(None, _SPACE)))
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    seen, twice, lines = set(), 0, {}
    for at, line in enumerate(data.split(b"\n")):
        here = line.lower().split()
        if here:
            twice += line in seen
            seen.add(line)
            h = xxhash.xxh3_64_intdigest(b" ".join(here)) - 2**63
            places = lines.setdefault(h, [0, []])
            places[0] += len(here)
            places[1].append(at)
    repeat = 0
    if len(words) > WINDOW:
        _, back, count = np.unique(windows(word_hashes(words), WINDOW), return_inverse=True, return_counts=True)
        start = np.flatnonzero(count[back] > 1)
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + WINDOW, -1)
        repeat = int((np.cumsum(edge) > 0).sum())
    return len(words), chars, symbols, twice, repeat, lines


_OUT = {
    "doc_id": pa.int64(), "host": pa.int64(), "fp1": pa.int64(), "fp2": pa.int64(),
    "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(),
    "lines": pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int64()), ("places", pa.list_(pa.int32()))])),
}
_SCHEMA = "doc_id long, host long, fp1 long, fp2 long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<line: long, words: long, places: array<int>>>"


def _measure(batches):
    for rb in batches:
        out = {n: [] for n in _OUT}
        for n, c in zip(_OUT, range(4)):
            out[n] = rb.column(c)
        for text in rb.column(4).to_pylist():
            *numbers, lines = measures(text)
            for n, v in zip(list(_OUT)[4:9], numbers):
                out[n].append(v)
            out["lines"].append([{"line": h, "words": w, "places": p} for h, (w, p) in lines.items()])
        yield batch(_OUT, out)


_KEY = ["host", "fp1", "fp2"]


def quality(docs: DataFrame, host_col: str = "source", least_documents: int = LEAST_DOCUMENTS, share: float = SHARE, most_removed: float = MOST_REMOVED) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, removed_words, removed_lines (numbers from 0),
    kept; and host, fp1, fp2, the keys of a distinct document.

    base_failed: under 20 words, or over 30 % of the words in repeated 8-word
    windows. Null and empty texts have no words and fail. A null host is a host
    of its own. Rows that repeat a text on one host share one verdict. A null
    id counts as the last. Other columns are not read.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col(host_col)).alias("host"), *fingerprints(), "text")
    measured = stored(map_rows(d, _measure, _SCHEMA), "measured")

    line = measured.select("doc_id", *_KEY, F.explode("lines").alias("l")).select("doc_id", *_KEY, "l.*")
    place = F.coalesce(F.col("doc_id"), F.lit(2**63 - 1))
    held = line.groupBy(*_KEY, "line").agg(F.min(place).alias("first"))
    seen = held.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("first", "fp1", "fp2")).alias("owner"))
    seen = seen.filter(F.col("n") > least_documents)
    often = seen
    if share > 0:
        total = measured.groupBy("host", "fp1", "fp2").count().groupBy("host").agg(F.count(F.lit(1)).alias("documents"))
        often = seen.join(total, "host").filter(F.col("n") > F.col("documents") * share)
    often = often.select("host", "line", "owner").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    one = line.groupBy(*_KEY, "line").agg(F.max("words").alias("words"), F.max("places").alias("places"))
    one = one.withColumn("salt", F.pmod(F.col("fp1"), F.lit(SALTS)).cast("int"))
    lost = one.join(often, ["host", "line", "salt"]).filter((F.col("owner.fp1") != F.col("fp1")) | (F.col("owner.fp2") != F.col("fp2")))
    lost = lost.groupBy(*_KEY).agg(F.sum("words").alias("removed_words"), F.flatten(F.collect_list("places")).alias("removed_lines"))

    out = measured.drop("lines").join(lost, _KEY, "left")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = out.withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long"))).withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & (F.col("removed_words") <= most_removed * F.col("n_words")) & (F.col("n_words") - F.col("removed_words") >= LEAST_WORDS)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", F.coalesce("removed_lines", F.array().cast("array<int>")).alias("removed_lines"), kept.alias("kept"), *_KEY)


def cleaned_documents(docs: DataFrame, host_col: str = "source", **options) -> DataFrame:
    """The documents that are kept, without their removed lines. Same columns
    as ``docs``; ``n_chars`` follows the text where there is one."""
    verdict = quality(docs, host_col, **options)
    good = verdict.filter("kept").groupBy(*_KEY).agg(F.first("removed_lines").alias("removed_lines"))
    good = good.select(F.col("host").alias("_host"), F.col("fp1").alias("_fp1"), F.col("fp2").alias("_fp2"), F.col("removed_lines").alias("_removed"))
    d = docs.select(F.struct("*").alias("_doc"), F.xxhash64(F.col(host_col)).alias("_host"), *fingerprints())
    d = d.join(good, ["_host", "_fp1", "_fp2"])
    text = F.col("_doc")["text"]
    rest = F.array_join(F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains("_removed", i)), "\n")
    d = d.withColumn("_text", F.when(F.size("_removed") > 0, rest).otherwise(text))
    new = {"text": F.col("_text"), "n_chars": F.char_length("_text")}
    return d.select(*[new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col("_doc")[c].alias(c) for c in docs.columns])
