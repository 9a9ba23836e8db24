"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.session import written_table

#: Words of the contract's plain form: runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of one Arrow batch sent to Python; a batch of very long texts stays small.
BATCH_BYTES = 4 * 1024 * 1024


def _give_back_memory() -> None:
    """Python workers serve many tasks: free memory goes back to the system
    between them, so that one task's peak does not stay with the executor."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def map_rows(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches bounded in bytes, so that long texts do not pile up in one batch."""
    conf = df.sparkSession.conf
    now = conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches):
        yield from fn(batches)
        _give_back_memory()

    return df.mapInArrow(run, schema)


def batch(columns: dict[str, pa.DataType], values: dict[str, Iterable]) -> pa.RecordBatch:
    """A record batch from Python values or numpy arrays, in the order of ``columns``."""
    arrays = [v if isinstance(v, pa.Array) else pa.array(v, kind) for v, kind in ((values[n], kind) for n, kind in columns.items())]
    return pa.RecordBatch.from_arrays(arrays, list(columns))


def fingerprints(text: str = "text") -> list[Column]:
    """Two independent 64-bit hashes of a text as ``_fp1``, ``_fp2`` (null text: its own value)."""
    return [F.xxhash64(F.col(text)).alias("_fp1"), F.xxhash64(F.lit("second"), F.col(text)).alias("_fp2")]


def ascii_words(text: str) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (multiply and xor-shift)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit value per window of ``width`` consecutive hashes."""
    out = np.zeros(len(h) - width + 1, np.uint64)
    for j in range(width):
        out = mix64(out + h[j : len(h) - width + 1 + j])
    return out


def running_sum(df: DataFrame, group: list[str], key: str, ties: list[str], value: str, out: str, rows: int, bucket_rows: int = 16_384) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the earlier rows of the group, in
    the order of ``key`` (a uniform 64-bit hash) and then ``ties``.

    A group may hold any share of the ``rows`` in total: the hash range is cut
    into equal buckets of about ``bucket_rows`` rows, sums are pre-aggregated
    per bucket, and only a bucket is ever ordered by one task. ``group``
    columns must not be null. Rows equal in key and ties get their places in
    any order.
    """
    buckets = max(1, -(-rows // bucket_rows))
    high = F.shiftright(F.col(key), 32) + F.lit(1 << 31)
    df = df.withColumn("_bucket", F.shiftright(high * F.lit(buckets), 32).cast("int"))
    at = [*group, "_bucket"]
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*at).agg(F.sum(value).alias("_sum"))
    offsets = sums.select(*at, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*at).orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(offsets, at)
        .withColumn(out, F.col("_offset") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_bucket", "_offset")
    )


def stored(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared checkpoint folder and read it back."""
    return written_table(df, f"llm-{label}")


#: Bound of the bitmap that ``among`` broadcasts: 2^25 bits in rows of 64.
MOST_BITS = 1 << 25


def among(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``key`` is among the distinct keys ``wanted``.

    A bitmap of hashed keys goes first, so that only few other rows are
    shuffled for the join. It is broadcast: at most MOST_BITS / 64 rows of 16
    bytes, whatever the input; with more keys than that serves it only lets
    more rows through.
    """
    bits = min(MOST_BITS, 1 << max(6, (16 * wanted.count()).bit_length()))

    def at(name):
        return F.xxhash64(F.col(name).cast("long")).bitwiseAND(F.lit(bits - 1))

    (name,) = wanted.columns
    marks = wanted.select(at(name).alias("_at")).selectExpr("shiftright(_at, 6) _word", "shiftleft(1L, cast(_at & 63 as int)) _bit")
    marks = marks.groupBy("_word").agg(F.expr("bit_or(_bit)").alias("_bits"))
    some = df.withColumn("_at", at(key)).withColumn("_word", F.shiftright("_at", 6)).join(F.broadcast(marks), "_word")
    some = some.filter("shiftrightunsigned(_bits, cast(_at & 63 as int)) & 1 = 1").drop("_at", "_word", "_bits")
    return some.join(wanted.withColumnRenamed(name, "_wanted"), F.col(key) == F.col("_wanted"), "left_semi")


#: Keys that ``join_spread`` treats as heavy: at most so many.
HEAVY = 1024


def join_spread(df: DataFrame, other: DataFrame, keys: list[str], spread: Column, how: str = "left") -> DataFrame:
    """Join ``other`` (one row per key) to ``df``, where a key may hold any share
    of the rows.

    A key with more than 1 / HEAVY of the rows is cut by ``spread`` (a hash of
    the row) into salts of about that many rows, and its row of ``other`` is
    repeated for each. There are fewer than HEAVY such keys, so the table of
    their salts is broadcast and repeats add fewer than 2 * HEAVY rows.
    ``keys`` must be short and not null; ``df`` is read three times.
    """
    limit = max(1, -(-df.count() // HEAVY))
    heavy = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit)
    heavy = F.broadcast(heavy.select(*keys, F.ceil(F.col("_n") / limit).cast("long").alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1).cast("long"))
    left = df.join(heavy, keys, "left").withColumn("_salt", F.pmod(spread, salts)).drop("_salts")
    right = other.join(heavy, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("_salts")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
