"""Filter interaction audit: what each filter removes, in every order.

Five filters give a document a mask of the ones it fails. In an order of the
filters a document is removed at the first it fails, so all documents of one
mask behave alike: only their counts per part and mask go on, at most 32 rows
per part.

Orders are ranked lexicographically (Lehmer rank, 0 to 119). A mask is removed
at step s by filter f in exactly the orders that begin with s - 1 filters it
passes, then f; orders with a common beginning of s filters are consecutive
ranks, an interval of (5 - s)! of them. So each beginning adds the mask's
counts at its first rank and takes them off behind its last one, and a prefix
sum over the 120 ranks gives the removals of all orders at once.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.common import batch, fingerprints, map_rows, stored

FILTERS = "ABCDE"
RANKS = factorial(len(FILTERS))

#: Fixed values of the contract: fewest words, percent of distinct words, percent of capitals, characters of D.
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 50, 65, 5, b"#$%&*|"
_CAPITALS = bytes(range(65, 91))


def lehmer_rank(order: tuple[int, ...], n: int) -> int:
    """Rank of the first of all orders of ``n`` items that begin with ``order``."""
    left, rank = list(range(n)), 0
    for k, item in enumerate(order):
        rank += left.index(item) * factorial(n - 1 - k)
        left.remove(item)
    return rank


def intervals(n: int = len(FILTERS)) -> list[tuple[int, int, int, int]]:
    """(mask, step from 1, first rank, rank behind the last) of every beginning
    that ends with the first filter a mask fails."""
    out = []
    for mask in range(1, 1 << n):
        fails = [f for f in range(n) if mask >> f & 1]
        passes = [f for f in range(n) if not mask >> f & 1]
        for s in range(len(passes) + 1):
            for head in permutations(passes, s):
                for f in fails:
                    first = lehmer_rank((*head, f), n)
                    out.append((mask, s + 1, first, first + factorial(n - 1 - s)))
    return out


def failed(text: str) -> int:
    """The mask of A to D that a text fails (bit 0 is A)."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: ASCII white space only
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    return (
        (len(words) < MIN_WORDS)
        | (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
        | (100 * capitals > CAPITAL_PERCENT * len(text)) << 2
        | (len(raw.translate(None, SYMBOLS)) < len(raw)) << 3
    )


def _masks(batches):
    for rb in batches:
        masks = [failed(text or "") for text in rb.column("text").to_pylist()]
        rest = rb.select([n for n in rb.schema.names if n != "text"])
        yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(masks, pa.int32())], [*rest.schema.names, "mask"])


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask per row: the filters the document fails (bit 0 is A).

    E needs the smallest id of each text. Rows find out whether they hold it by
    a join on text and id together, so a large group of copies is no hot key.
    """
    text = F.coalesce("text", F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    narrow = stored(map_rows(d.select("doc_id", "part", *fingerprints(), "text"), _masks, "doc_id long, part string, _fp1 long, _fp2 long, mask int"), "masks")
    named = narrow.filter("doc_id is not null")
    first = named.groupBy("_fp1", "_fp2").agg(F.min("doc_id").alias("doc_id")).withColumn("_first", F.lit(True))
    copy = F.when(F.col("_first").isNull(), F.lit(1 << 4)).otherwise(F.lit(0))
    named = named.join(first, ["_fp1", "_fp2", "doc_id"], "left").withColumn("mask", F.col("mask") + copy)
    return named.select("doc_id", "part", "mask").union(narrow.filter("doc_id is null").select("doc_id", "part", "mask"))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: at most 32 rows per part."""
    is_one = [F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(f"_{c}") for c in ("quality", "toxic")]
    label = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").filter("doc_id is not null").groupBy("doc_id").agg(*is_one)
    m = masks(docs)
    # rows without an id have no label: kept out of the join, where they would share one key
    named = m.filter("doc_id is not null").join(label, "doc_id", "left")
    rows = named.unionByName(m.filter("doc_id is null"), allowMissingColumns=True)
    total = [F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(n) for c, n in (("_quality", "good"), ("_toxic", "toxic"))]
    return rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), *total)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, order of the five filters and step: kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley.

    A part is a value of ``source``; null and empty sources are one part ''.
    Null and empty texts are alike: no words, equal to each other. Rows that
    repeat an id and text count each time, and fail E only by a smaller id;
    rows without an id are no copies, make no copies and have no labels. Where
    an id has several labels, one of 1 is enough. Without documents there are
    no rows. Other columns are not read.
    """
    spark, n = docs.sparkSession, len(FILTERS)
    count = stored(mask_counts(docs, labels), "counts")
    counted = ["n", "good", "toxic"]

    # fixed tables, 120 orders and the intervals of 31 masks: their size does not depend on the data
    steps = [(rank, "".join(FILTERS[f] for f in order), s, f) for rank, order in enumerate(permutations(range(n))) for s, f in enumerate(order, 1)]
    order = F.broadcast(spark.createDataFrame(steps, "rank int, filter_order string, step int, filter int"))
    ends = [(mask, step, at, sign) for mask, step, first, last in intervals() for at, sign in ((first, 1), (last, -1)) if at < RANKS]
    ends = F.broadcast(spark.createDataFrame(ends, "mask int, step int, rank int, sign int"))

    change = count.join(ends, "mask").groupBy("part", "step", "rank").agg(*[F.sum(F.col(c) * F.col("sign")).alias(c) for c in counted])
    every = count.select("part").distinct().withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(RANKS - 1)))).join(order, "rank")
    along = Window.partitionBy("part", "step").orderBy("rank")  # 120 rows
    running = [F.sum(F.coalesce(c, F.lit(0))).over(along).alias(f"_{c}") for c in counted]
    gone = every.join(change, ["part", "step", "rank"], "left").select(*every.columns, *running)

    bit = F.expr("(mask >> filter) & 1")
    fails = count.withColumn("filter", F.explode(F.array(*map(F.lit, range(n))))).groupBy("part", "filter").agg(
        F.sum("n").alias("_all"), F.sum(F.col("n") * bit).alias("_fails"), F.sum(F.expr("if(mask = 1 << filter, n, 0)")).alias("_only"))
    before = Window.partitionBy("part", "rank").orderBy("step")  # 5 rows
    whole = Window.partitionBy("part", "filter")  # 120 rows
    out = gone.join(fails, ["part", "filter"]).select(
        "part", "filter_order", "step",
        (F.col("_all") - F.sum("_n").over(before)).alias("kept"),
        F.col("_n").alias("removed"),
        (F.col("_fails") - F.col("_n")).alias("redundant"),
        F.col("_only").alias("unique_fails"),
        F.col("_good").alias("good_lost"),
        F.col("_toxic").alias("toxic_lost"),
        F.sum("_n").over(whole).alias("shapley"),
    )
    return out.select("part", "filter_order", "step", *[F.col(c).cast("long").alias(c) for c in out.columns[3:]])
