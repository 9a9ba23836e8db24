"""Order-dependent acceptance, the one part of posting that is not a
relational expression.

``bounded_walk``: per key (e.g. one inventory row), events arrive in order,
each with a signed ``delta``; an event is accepted when ``state + delta >= 0``
and then changes the state, a refused event changes nothing. Stock
adjustments (W6) and the stock check of an invoice form (W4) are this walk.

Only keys whose state could go negative need the walk; for all others every
event is accepted, decided by an aggregate. A key with more than ``chunk``
events is cut into chunks of consecutive events, and no chunk waits for
another:

1. Two sums of a chunk give an upper bound of the state before the next one
   (``_reach``).
2. A chunk is summed up, on its own, as the map from the state before it to
   the state after it, up to that bound. The map is piecewise ``state +
   constant``, and one backward pass over the events builds it (``walk_map``).
3. One scan per key passes the state through the maps of its chunks: a lookup
   per chunk, streamed, no events read.
4. With its state before known, every chunk decides its own events.

So the work on one hot key is spread over as many tasks as it has chunks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.ordinal import number_within
from inkwell.session import written_table

#: Events of one key that a task walks at most.
DEFAULT_CHUNK = 16_384
#: Rows of one pandas call, on average.
CALL_ROWS = 200_000

_CHUNK_KEY = ["_key", "_chunk"]


def _map_fn():
    """``walk_map``, built as a nested function like the others below: Spark
    pickles nested functions with their code, so executors need only pandas,
    not this package."""

    def walk_map(deltas: Sequence[int]) -> tuple[list[int], list[int]]:
        """The walk over ``deltas`` as a map of the state before it: from
        ``starts[i]`` on (up to the next start) the state after it is
        ``states[i]`` + the distance from the start. The last piece has no end.

        Taken backwards, an event changes the map F of the events behind it in one
        of two ways: an increase d gives F(s + d), which drops the first d states
        of F; a decrease d leaves states below d alone and takes d from the others,
        which puts a copy of the first d states of F before F."""
        # pieces (length, state of the first), the first piece last; None: no end
        pieces: list[tuple[int | None, int]] = [(None, 0)]
        for delta in reversed(deltas):
            if delta >= 0:
                left = delta
                while pieces[-1][0] is not None and pieces[-1][0] <= left:
                    left -= pieces.pop()[0]
                length, state = pieces[-1]
                pieces[-1] = (None if length is None else length - left, state + left)
            else:
                left, at, copy = -delta, len(pieces) - 1, []
                while left:
                    length, state = pieces[at]
                    take = left if length is None else min(length, left)
                    copy.append((take, state))
                    left, at = left - take, at - 1
                (length, state), (take, first) = pieces[-1], copy[-1]
                if first + take == state:      # the seam: one piece again
                    pieces[-1] = (None if length is None else length + take, first)
                    copy.pop()
                pieces.extend(reversed(copy))
        starts, states, at = [], [], 0
        for length, state in reversed(pieces):
            starts.append(at)
            states.append(state)
            at += length or 0
        return starts, states

    return walk_map


walk_map = _map_fn()


def _walk_fn():
    import pandas as pd

    def _walk(pdf: pd.DataFrame) -> pd.DataFrame:
        """Walk every chunk of one bucket: rows sorted by chunk then arrival;
        the state restarts at ``_state0`` whenever the chunk changes."""
        pdf = pdf.sort_values(["_key", "_chunk", "_order", "_event"], kind="stable")
        keys, chunks = pdf["_key"].to_numpy(), pdf["_chunk"].to_numpy()
        deltas = pdf["_delta"].to_numpy()
        state0 = pdf["_state0"].to_numpy()
        acc = [False] * len(pdf)
        state, prev = 0, None
        for i in range(len(pdf)):
            k = (keys[i], chunks[i])
            if k != prev:
                state, prev = int(state0[i]), k
            d = int(deltas[i])
            if state + d >= 0:
                state += d
                acc[i] = True
        return pd.DataFrame({"_event": pdf["_event"].to_numpy(), "_accepted": acc})

    return _walk


def _summary_fn():
    from bisect import bisect_right

    import pandas as pd

    to_map = _map_fn()

    def _summaries(pdf: pd.DataFrame) -> pd.DataFrame:
        """The map of every chunk of one bucket, up to the chunk's bound."""
        pdf = pdf.sort_values(["_key", "_chunk", "_order", "_event"], kind="stable")
        rows = []
        for (key, chunk), part in pdf.groupby(["_key", "_chunk"], sort=False):
            starts, states = to_map([int(d) for d in part["_delta"]])
            held = bisect_right(starts, int(part["_reach"].iloc[0]))
            rows.append((key, int(chunk), int(part["_state0"].iloc[0]), starts[:held], states[:held]))
        return pd.DataFrame(rows, columns=["_key", "_chunk", "_state0", "_starts", "_states"])

    return _summaries


def _scan_fn():
    from bisect import bisect_right

    import pandas as pd

    def _scan(batches):
        """Pass the state through the maps of sorted chunks, row by row."""
        prev, state = None, 0
        for pdf in batches:
            before = []
            for key, state0, starts, states in zip(pdf["_key"], pdf["_state0"], pdf["_starts"], pdf["_states"]):
                if key != prev:
                    prev, state = key, int(state0)
                before.append(state)
                i = bisect_right(starts, state) - 1
                state += int(states[i]) - int(starts[i])
            yield pd.DataFrame({"_key": pdf["_key"], "_chunk": pdf["_chunk"], "_before": pd.Series(before, dtype="int64")})

    return _scan


def bounded_walk(events: DataFrame, keys: Sequence[str], order: str, delta: str, initial: str,
                 event_id: str, chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """Return ``(event_id, Accepted)`` for every event.

    ``events`` carries per row: the key columns, a unique ``order`` within the
    key, the signed ``delta``, the key's starting ``initial`` state (same on
    every row of a key) and a unique long ``event_id``.
    """
    keys = list(keys)
    ev = events.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                       F.col(order).alias("_order"), F.col(delta).cast("long").alias("_delta"),
                       F.col(initial).cast("long").alias("_state0"),
                       F.col(event_id).cast("long").alias("_event"))
    keys = [f"_k{i}" for i in range(len(keys))]
    # Fast paths, by plain (partially aggregated, skew-safe) sums: if the state
    # stays >= 0 even when every negative event is applied, no prefix can go
    # negative and every event of the key is accepted. Exact when all deltas
    # are negative (an invoice form); conservative otherwise. And the only
    # event of a key is decided by its own state.
    worst = ev.groupBy(*keys).agg(
        (F.first("_state0") + F.sum(F.when(F.col("_delta") < 0, F.col("_delta")).otherwise(F.lit(0))))
        .alias("_worst"), F.count(F.lit(1)).alias("_n"))
    hard_keys = (worst.filter((F.col("_worst") < 0) & (F.col("_n") > 1))
                 .select(*[F.col(k).alias(f"_h{k}") for k in keys], F.lit(True).alias("_hard")))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_h{k}")) for k in keys])
    # the walk reads its events several times: written once, with the easy ones,
    # which hold no key, decided
    marked = ev.join(hard_keys, same, "left")
    # one text key: nulls and the types of the keys do not matter to pandas
    key = F.when(F.col("_hard"), F.to_json(F.struct(*keys)))
    # an event with others on an easy key fits in any order, and alone on its key it fits if the state allows
    events = written_table(marked.select(key.alias("_key"), "_order", "_delta", "_state0", "_event",
                                         F.coalesce(F.col("_state0") + F.col("_delta") >= 0, F.lit(False)).alias("_accepted")), "walk")
    easy = events.filter(F.col("_key").isNull()).select("_event", "_accepted")
    hard = events.filter(F.col("_key").isNotNull()).drop("_accepted")
    decided = _walk_chunks(hard, chunk)
    return easy.unionByName(decided).select(F.col("_event").alias(event_id),
                                            F.col("_accepted").alias("Accepted"))


def _by_bucket(df: DataFrame, rows: int, fn, schema: str) -> DataFrame:
    """Apply ``fn`` to hash buckets of whole chunks (one call per chunk would
    cost a Python round trip per chunk)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(n * 4, rows // CALL_ROWS)
    return (df.withColumn("_bucket", F.pmod(F.hash(*_CHUNK_KEY), F.lit(buckets)))
            .groupBy("_bucket").applyInPandas(fn, schema))


def _reach(cut: DataFrame) -> DataFrame:
    """(_key, _chunk, _reach): a state that the walk does not exceed before the
    chunk. With M the key's largest decrease, c -> max(c + delta, M) stays at
    or above the walk: a refused decrease leaves a state below M. Over a chunk
    that is c -> max(c + A, B) with A the sum of its deltas and B = M + A - the
    lowest running sum, so the chunks of a key chain by running sums."""
    inside = Window.partitionBy(*_CHUNK_KEY).orderBy("_order", "_event")
    total = (cut.withColumn("_run", F.sum("_delta").over(inside)).groupBy(*_CHUNK_KEY)
             .agg(F.sum("_delta").alias("_a"), F.min("_run").alias("_low"),
                  F.max(-F.col("_delta")).alias("_most"), F.first("_state0").alias("_state0")))
    # one row per chunk from here on
    along = Window.partitionBy("_key").orderBy("_chunk")
    total = (total.withColumn("_m", F.greatest(F.lit(0), F.max("_most").over(Window.partitionBy("_key"))))
             .withColumn("_cum", F.sum("_a").over(along)))
    peak = F.max(F.col("_m") + F.col("_a") - F.col("_low") - F.col("_cum"))
    earlier = peak.over(along.rowsBetween(Window.unboundedPreceding, -1))
    reach = F.col("_cum") - F.col("_a") + F.greatest("_state0", "_m", earlier)
    return total.select(*_CHUNK_KEY, reach.alias("_reach"))


def _walk_chunks(hard: DataFrame, chunk: int) -> DataFrame:
    sizes = hard.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    largest, rows = sizes.agg(F.coalesce(F.max("_n"), F.lit(0)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    walk = "_event long, _accepted boolean"
    if largest <= chunk:
        return _by_bucket(hard.withColumn("_chunk", F.lit(0).cast("long")), rows, _walk_fn(), walk)
    long_keys = sizes.filter(F.col("_n") > chunk).select("_key")
    short = hard.join(long_keys, "_key", "left_anti").withColumn("_chunk", F.lit(0).cast("long"))
    ranked = number_within(hard.join(long_keys, "_key", "left_semi"), ["_key"], ["_order", "_event"], "_rank")
    cut = ranked.withColumn("_chunk", F.floor((F.col("_rank") - 1) / chunk).cast("long")).drop("_rank")
    maps = _by_bucket(cut.join(_reach(cut), _CHUNK_KEY), rows, _summary_fn(),
                      "_key string, _chunk long, _state0 long, _starts array<long>, _states array<long>")
    # the maps of a key in one task, streamed in order: a lookup each
    before = (maps.repartition("_key").sortWithinPartitions(*_CHUNK_KEY)
              .mapInPandas(_scan_fn(), "_key string, _chunk long, _before long"))
    cut = cut.drop("_state0").join(before, _CHUNK_KEY).withColumnRenamed("_before", "_state0")
    return _by_bucket(short.unionByName(cut), rows, _walk_fn(), walk)
