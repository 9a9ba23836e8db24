"""Consecutive numbering without a one-partition window.

``row_number() over (order by k)`` puts every row in one task. Here the rows
are range-partitioned on the sort key, numbered inside each partition, and
shifted by the sizes of the partitions before them. The size table has one
row per partition, so broadcasting it is bounded by the partition count, not
by the data.

Numbering inside groups (invoice lines) uses the same global ordinal and
subtracts each group's first ordinal. A group that holds a third of all rows
is then spread over several range partitions instead of one window task.

``number_in_blocks`` numbers rows that hold a position already (lines of an
invoice) without a global sort and without writing them: it stays lazy, so a
reader that leaves the number out pays nothing for it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.session import written_table

_PID, _MID, _OFF, _FIRST = "_ord_pid", "_ord_mid", "_ord_off", "_ord_first"


def _partitions(df: DataFrame, partitions: int | None) -> int:
    if partitions:
        return partitions
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def with_ordinal(df: DataFrame, order_by: Sequence[str | Column], name: str,
                 start: int | Column = 1, partitions: int | None = None) -> DataFrame:
    """Add ``name`` = position of the row in ``order_by`` order, from ``start``.

    ``order_by`` should be unique for a deterministic result (ties get
    consecutive numbers in an unspecified order). ``start`` may be a scalar
    column, e.g. ``max(existing id) + 1`` as a scalar subquery.
    """
    n = _partitions(df, partitions)
    # Range-partition and sort, then record each row's partition and its
    # position inside it. The rows are written once as a table in the shared
    # checkpoint folder: the partition-size count reads back only the
    # partition column, and the numbering uses the stored positions, so the
    # result does not depend on how the table is read back or on task re-runs
    # (only the committed attempt of each write task is kept).
    ranged = (df.repartitionByRange(n, *order_by)
              .sortWithinPartitions(*order_by)
              .withColumn(_PID, F.spark_partition_id())
              .withColumn(_MID, F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    stored = written_table(ranged, "ordinal")
    sizes = stored.groupBy(_PID).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(_PID, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(_OFF))
    start_col = start if isinstance(start, Column) else F.lit(start)
    # offsets: one row per range partition, so the broadcast is bounded by
    # the partition count
    return (stored.join(F.broadcast(offsets), _PID)
            .withColumn(name, (F.col(_OFF) + F.col(_MID) + start_col.cast("long")))
            .drop(_PID, _MID, _OFF))


def number_within(df: DataFrame, group_by: Sequence[str], order_by: Sequence[str | Column],
                  name: str, partitions: int | None = None) -> DataFrame:
    """Add ``name`` = 1-based position of the row inside its ``group_by`` group
    in ``order_by`` order (``row_number() over (partition by g order by o)``)
    without sending a whole group to one task."""
    tmp = "_ord_g"
    g = with_ordinal(df, [*group_by, *order_by], tmp, start=0, partitions=partitions)
    first = g.groupBy(*group_by).agg(F.min(tmp).alias(_FIRST))
    return (g.join(first, list(group_by))
            .withColumn(name, (F.col(tmp) - F.col(_FIRST) + 1).cast("int"))
            .drop(tmp, _FIRST))


def number_in_blocks(df: DataFrame, group_by: Sequence[str], position: str, then_by: Sequence[str | Column],
                     name: str, block_rows: int = 4096) -> DataFrame:
    """``number_within`` in the order (``position``, *``then_by``), where
    ``position`` is an integer column of which few rows of a group share a
    value. A group is cut into blocks of ``block_rows`` positions; rows are
    numbered inside their block and shifted by the sizes of the blocks before,
    so no task sorts a whole group. Nothing runs and nothing is written here:
    where ``name`` is not read, all of it is pruned."""
    block = "_ord_block"
    whole = reduce(lambda a, b: a | b, [F.col(g).isNull() for g in group_by])     # a NULL group is one block
    rows = df.withColumn(block, F.when(whole, F.lit(0)).otherwise(
        F.coalesce(F.floor(F.col(position) / block_rows), F.lit(-(1 << 62)))))
    sizes = rows.groupBy(*group_by, block).agg(F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy(*group_by).orderBy(block)
    shifts = sizes.withColumn("_before", F.sum("_n").over(along) - F.col("_n")).filter(F.col("_before") > 0)
    # unique keys, told to the planner by the grouping: an unread shift is dropped with its join
    shifts = shifts.groupBy(*[F.col(g).alias(f"_shift_{i}") for i, g in enumerate(group_by)],
                            F.col(block).alias("_shift_block")).agg(F.max("_before").alias(_OFF))
    inside = Window.partitionBy(*group_by, block).orderBy(position, *then_by)
    numbered = rows.withColumn(_MID, F.row_number().over(inside))
    same = F.col(block) == F.col("_shift_block")
    for i, g in enumerate(group_by):
        same = same & (F.col(g) == F.col(f"_shift_{i}"))
    return (numbered.join(shifts, same, "left")
            .withColumn(name, (F.col(_MID) + F.coalesce(F.col(_OFF), F.lit(0))).cast("int"))
            .select(*df.columns, name))
