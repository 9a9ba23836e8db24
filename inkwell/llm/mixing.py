"""Mixing sources to target weights along a time-varying curriculum.

DataFrame functions only.

1. A source's share of the token budget follows its weight; a share above
   ``max_epochs`` times the source's size stops there and the excess is shared
   again by weight among the others, until none is above.
2. A source's schedule is a piecewise linear weight over training progress 0..1.
   Its integral, scaled to the source's target, is its cumulative token demand.
3. Documents of a source are taken in the order of a keyed hash, pass after
   pass, until the target is met; the last one is cut at the target. A
   document's training position is where the demand curve reaches the words
   taken before it (the quadratic inverse of the integral).
4. Rows are range-sorted by position.

Sums per source are pre-aggregated in hash-range buckets, so a source of any
size is spread over tasks; only single totals reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.ordinal import with_ordinal
from inkwell.llm.common import WORD, running_sum, stored

#: Schedules over training progress by weight class: falling, level, rising.
FALLING, LEVEL, RISING = ((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5))


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[float] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """One row per source: source, weight_class, source_size, target, by code point and null last.

    ``weights`` repeat over the sources in that order. An input without words
    gives targets of 0.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").isNull(), F.col("source")]
    ranked = with_ordinal(sizes, order, "_rank", start=0)
    kind = F.pmod(F.col("_rank"), F.lit(len(weights)))
    t = ranked.withColumn("weight_class", kind.cast("int")).withColumn("_cap", F.lit(max_epochs) * F.col("source_size"))
    t = t.withColumn("_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("weight_class") + 1))
    t = stored(t, "sources")
    total = t.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:  # each round caps at least one more source, or ends
        capped = F.col("_cap") <= F.lit(level) * F.col("_weight")
        full, open_weight = t.agg(F.sum(F.when(capped, F.col("_cap"))), F.sum(F.when(~capped, F.col("_weight")))).first()
        higher = (total - (full or 0)) / open_weight if open_weight else level
        if higher <= level:
            break
        level = higher
    return t.select("source", "weight_class", "source_size", F.least(F.col("_cap").cast("double"), F.lit(level) * F.col("_weight")).alias("target"))


def _position(share: Column, schedule: Column) -> Column:
    """Progress at which the integral of ``schedule`` (array of struct t, v, c;
    c the integral up to t) reaches ``share`` of its total."""
    need = share * F.element_at(schedule, -1)["c"]
    at = F.greatest(F.lit(1), F.least(F.size(schedule) - 1, F.size(F.filter(schedule, lambda p: p["c"] <= need))))
    p, q = F.element_at(schedule, at), F.element_at(schedule, at + 1)
    slope, rest = (q["v"] - p["v"]) / (q["t"] - p["t"]), need - p["c"]
    root = F.sqrt(F.greatest(F.lit(0.0), p["v"] * p["v"] + 2 * slope * rest))
    # the stable form of the root of slope/2 d^2 + v d = rest
    return p["t"] + F.when(rest <= 0, F.lit(0.0)).otherwise(2 * rest / (p["v"] + root))


def _schedule(points: Sequence[tuple[float, float]]) -> Column:
    out, c = [], 0.0
    for i, (t, v) in enumerate(points):
        if i:
            c += (v + points[i - 1][1]) / 2 * (t - points[i - 1][0])
        out.append(F.struct(F.lit(float(t)).alias("t"), F.lit(float(v)).alias("v"), F.lit(c).alias("c")))
    return F.array(*out)


def _plan(docs: DataFrame, weights, max_epochs, schedules, seed, carry) -> DataFrame:
    """Every row with what the mix takes of it, ``_before`` (its source's words
    before it in one pass), ``_source_words`` to take, and its ``_curve``."""
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"))
    docs = docs.select("doc_id", "source", "size", *carry)
    small = stored(docs.select("doc_id", "source", "size"), "sizes")  # the words are counted once for the totals
    targets = source_targets(small, weights, max_epochs)
    named = targets.select(F.col("source").alias("_source"), "weight_class", "source_size", "target")
    d = (docs if carry else small).withColumn("_key", key).join(named, F.col("source").eqNullSafe(F.col("_source")))
    d = d.withColumn("_source", F.xxhash64("_source"))
    d = running_sum(d, ["_source"], "_key", ["doc_id", "size"], "size", "_before", small.count())
    whole = F.round("target").cast("long")
    some = F.col("size") > 0
    d = d.withColumn("_source_words", whole).withColumn("passes", F.when(some, F.floor(whole / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    left = F.col("_source_words") - F.col("passes") * F.col("source_size") - F.col("_before")
    d = d.withColumn("rest_words", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left)))
    d = d.withColumn("taken", F.col("passes") * F.col("size") + F.col("rest_words"))
    return d.withColumn("_curve", F.element_at(F.array(*[_schedule(s) for s in schedules]), F.col("weight_class") + 1))


def _due(before: Column) -> Column:
    """Position at which a source's word number ``before`` is due."""
    return _position(F.least(F.lit(1.0), before / F.greatest(F.col("_source_words"), F.lit(1))), F.col("_curve"))


def _in_order(d: DataFrame) -> DataFrame:
    """Range-partitioned and sorted by position. Positions spread the budget
    evenly over 0..1, so equal ranges of them make even partitions without a
    sampling pass; rows without one are spread by hash."""
    n = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.floor(F.coalesce("position", F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5) * n).cast("int")
    return d.repartitionById(n, F.least(at, F.lit(n - 1))).sortWithinPartitions("position", "doc_id")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (1, 2, 3),
    max_epochs: int = 3,
    schedules: Sequence[Sequence[tuple[float, float]]] = (FALLING, LEVEL, RISING),
    seed: int = 20260102,
) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size (its words, not null) and
    ``source_size, target, passes, rest_words, taken, position``, range-sorted by position.

    ``taken`` = ``passes`` * size + ``rest_words``: whole passes, then the
    first ``rest_words`` words of one more. ``position`` is the progress at
    which its first word is due; it is null where nothing is taken, and such
    rows lie anywhere. ``schedules`` belong to the weights in order; a schedule
    is points (progress, weight) from 0 to 1 with weights >= 0, of which one
    interval at least is positive. Null sources form a source of their own, the
    last. Documents without words are never taken. Rows equal in id and size
    are taken in any order, with the same totals. Other columns are not read.
    """
    d = _plan(docs, weights, max_epochs, schedules, seed, ())
    d = _in_order(d.withColumn("position", F.when(F.col("taken") > 0, _due(F.col("_before")))))
    return d.select("doc_id", "source", "size", "source_size", "target", "passes", "rest_words", "taken", "position")


def mixed_documents(
    docs: DataFrame,
    weights: Sequence[float] = (1, 2, 3),
    max_epochs: int = 3,
    schedules: Sequence[Sequence[tuple[float, float]]] = (FALLING, LEVEL, RISING),
    seed: int = 20260102,
) -> DataFrame:
    """The mix as documents in training order: one row per pass, each at its own
    position, and one row with the first ``rest_words`` words for the cut pass.
    Same columns as ``docs``; ``n_chars`` follows the text where there is one."""
    d = docs.select("doc_id", "source", n_words().alias("size"), F.struct("*").alias("_doc"))
    m = _plan(d, weights, max_epochs, schedules, seed, ("_doc",)).filter("taken > 0")
    times = F.col("passes") + (F.col("rest_words") > 0).cast("int")
    m = m.withColumn("_pass", F.explode(F.sequence(F.lit(1).cast("long"), times)))
    m = m.withColumn("position", _due((F.col("_pass") - 1) * F.col("source_size") + F.col("_before")))
    text = F.col("_doc")["text"]
    piece = F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*" + WORD + ")"), F.lit(1))
    cut = F.array_join(F.slice(piece, 1, F.greatest(F.lit(1), F.col("rest_words")).cast("int")), "")
    all_of_it = (F.col("_pass") <= F.col("passes")) | (F.col("rest_words") == F.col("size"))
    m = _in_order(m.select("doc_id", "position", "_doc", F.when(all_of_it, text).otherwise(cut).alias("_text")))
    new = {"text": F.col("_text"), "n_chars": F.char_length("_text")}
    return m.select(*[new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col("_doc")[c].alias(c) for c in docs.columns])
