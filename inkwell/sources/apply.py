"""Apply a batch of insert/edit/delete requests to the current snapshot and
publish the next one (the batch form of the reference's book, store,
inventory and purchase forms)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators import upserts as U
from inkwell.session import ensure_checkpoint_dir
from inkwell.sources.snapshots import bucket_of, current_snapshot, is_bucketed, last_epochs, load_snapshot, publish_snapshot


def _tables_of(result) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """(changed tables, accepted, rejected) of an operator result."""
    if isinstance(result, U.UpsertResult):
        return {}, result.accepted, result.rejected
    changed = {k: v for k, v in result.items() if k[:1].isupper()}
    return changed, result["accepted"], result["rejected"]


# operation -> (operator, table it changes when it returns an UpsertResult)
OPERATIONS: dict[str, tuple[Callable, str | None]] = {
    "insert_inventory": (U.insert_inventory, "Inventory"),
    "edit_inventory": (U.edit_inventory, "Inventory"),
    "insert_books": (U.insert_books, None),
    "edit_books": (U.edit_books, None),
    "insert_stores": (U.insert_stores, "Store"),
    "edit_stores": (U.edit_stores, "Store"),
    "delete_stores": (U.delete_stores, "Store"),
    "insert_purchases": (U.insert_purchases, "PublisherPurchase"),
}


def apply_requests(spark: SparkSession, root: str, operation: str, requests: DataFrame,
                   epoch: int | None = None) -> tuple[int | None, DataFrame]:
    """Run ``operation`` on ``requests`` against the newest snapshot and
    publish the result. Returns (new snapshot number or None when ``epoch``
    was already committed, refused requests with reasons)."""
    fn, table = OPERATIONS[operation]
    _, paths, _ = current_snapshot(spark, root)
    if epoch is not None and epoch <= last_epochs(spark, root).get(operation, -1):
        return None, requests.limit(0).withColumn("Reason", F.lit(None).cast("string"))
    tables = load_snapshot(spark, root)
    result = fn(tables, requests)
    changed, accepted, rejected = _tables_of(result)
    ensure_checkpoint_dir(spark)
    rejected = rejected.checkpoint(eager=True)      # reported after the new snapshot is live
    if table == "PublisherPurchase":
        new = publish_snapshot(spark, root, appended={table: result.accepted}, epoch=epoch, source=operation)
    elif table == "Inventory" and is_bucketed(paths.get("Inventory", [])):
        touched = [r[0] for r in accepted.select(bucket_of("Inventory").alias("b")).distinct().collect()]
        new = publish_snapshot(spark, root, patched={"Inventory": (result.table, touched)}, epoch=epoch, source=operation)
    elif table is not None:
        new = publish_snapshot(spark, root, changed={table: result.table}, epoch=epoch, source=operation)
    else:
        new = publish_snapshot(spark, root, changed=changed, epoch=epoch, source=operation)
    return new, rejected
