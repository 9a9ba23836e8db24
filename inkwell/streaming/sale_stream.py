"""Sale posting and stock adjustments driven by Structured Streaming.

In the reference each sale is posted as it is entered. Here sale request
lines arrive as a stream (e.g. files dropped into a folder); every
micro-batch is posted with ``post_sales`` against the current committed
snapshot, in arrival order, and published as the next snapshot (new sales
and lines appended, stock replaced), together with the refused requests.

``foreachBatch`` gives at-least-once delivery: a batch may be replayed after
a failure. The commit record carries the batch id (epoch), and a batch whose
epoch is already committed is skipped, so each batch is posted once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from inkwell.operators.posting import HEADER_COLS, post_sales
from inkwell.sources.snapshots import (bucket_of, current_snapshot, is_bucketed, last_epochs,
                                       load_snapshot, publish_snapshot)
from inkwell.sources.tables import sale_lines

# Sources of batches: each stream counts its own.
SALES, ADJUSTMENTS = "sales", "adjustments"

#: Reason of a request whose lines name different headers.
CONFLICTING_HEADER = "conflicting_header"

# One row per request line; header columns are repeated on every line.
REQUEST_LINE_SCHEMA = T.StructType([
    T.StructField("RequestID", T.LongType()),
    T.StructField("StoreCode", T.IntegerType()),
    T.StructField("CustomerCode", T.IntegerType()),
    T.StructField("EmployeeNationalCode", T.StringType()),
    T.StructField("InvoiceDate", T.DateType()),
    T.StructField("LinePos", T.IntegerType()),
    T.StructField("ISBN", T.StringType()),
    T.StructField("Quantity", T.IntegerType()),
])


def post_batch(spark: SparkSession, root: str, batch: DataFrame, epoch: int) -> int | None:
    """Post one batch of request lines; returns the new snapshot number, or
    None when this epoch was already committed."""
    _, paths, _ = current_snapshot(spark, root)
    if epoch <= last_epochs(spark, root).get(SALES, -1):
        return None
    tables = load_snapshot(spark, root)
    # a request has one header: where its lines disagree there is none to post
    header = F.struct(*[c for c in HEADER_COLS if c != "RequestID"])
    told = batch.groupBy("RequestID").agg(F.min(header).alias("_first"), F.max(header).alias("_last"))
    same = F.col("_first").eqNullSafe(F.col("_last"))
    headers = told.filter(same).select("RequestID", "_first.*")
    lines = batch.select("RequestID", "ISBN", "Quantity", "LinePos")
    res = post_sales(tables, headers, lines)
    disagree = told.filter(~same).select("RequestID", F.lit(CONFLICTING_HEADER).alias("_why"))
    refused = (res.rejected.join(disagree, "RequestID", "left")
               .select("RequestID", F.coalesce("_why", "Reason").alias("Reason")))
    appended = {"Sale": res.sales, "SaleItem": res.items}
    if "SaleLine" in tables:          # keep the sales fact table in step
        appended["SaleLine"] = sale_lines(res.sales, res.items)
    if not is_bucketed(paths.get("Inventory", [])):
        return publish_snapshot(spark, root, changed={"Inventory": res.inventory},
                                appended=appended, epoch=epoch, source=SALES, refused=refused)
    # only the stock buckets of stores with accepted sales change (<= bucket count ids)
    touched = [r[0] for r in res.sales.select(bucket_of("Inventory").alias("b")).distinct().collect()]
    return publish_snapshot(spark, root, appended=appended,
                            patched={"Inventory": (res.inventory, touched)}, epoch=epoch,
                            source=SALES, refused=refused)


def start_sale_posting(spark: SparkSession, source_dir: str, root: str, checkpoint_location: str,
                       source_format: str = "parquet", trigger_seconds: int | None = None,
                       max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start the posting stream. ``root`` must already hold a committed
    snapshot of the tables (see ``publish_snapshot``)."""
    reader = spark.readStream.schema(REQUEST_LINE_SCHEMA).format(source_format)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.load(source_dir)
    writer = (stream.writeStream
              .foreachBatch(lambda df, epoch: post_batch(spark, root, df, epoch))
              .option("checkpointLocation", checkpoint_location))
    if trigger_seconds:
        writer = writer.trigger(processingTime=f"{trigger_seconds} seconds")
    return writer.start()


# Stock adjustments (W6) arriving as a stream: each micro-batch is applied in
# arrival order against the current snapshot; only the Inventory buckets of
# the adjusted stores are rewritten.
ADJUSTMENT_SCHEMA = T.StructType([
    T.StructField("AdjustID", T.LongType()),
    T.StructField("StoreCode", T.IntegerType()),
    T.StructField("ISBN", T.StringType()),
    T.StructField("Amount", T.IntegerType()),
    T.StructField("Direction", T.IntegerType()),
])


def adjust_batch(spark: SparkSession, root: str, batch: DataFrame, epoch: int) -> int | None:
    """Apply one batch of stock adjustments; returns the new snapshot number,
    or None when this epoch was already committed."""
    from inkwell.operators.posting import adjust_stock
    _, paths, _ = current_snapshot(spark, root)
    if epoch <= last_epochs(spark, root).get(ADJUSTMENTS, -1):
        return None
    tables = load_snapshot(spark, root)
    out = adjust_stock(tables, batch.select(*ADJUSTMENT_SCHEMA.fieldNames()))
    refused = out["decisions"].filter("not Accepted").withColumnRenamed("AdjustID", "RequestID")
    if not is_bucketed(paths.get("Inventory", [])):
        return publish_snapshot(spark, root, changed={"Inventory": out["inventory"]}, epoch=epoch,
                                source=ADJUSTMENTS, refused=refused)
    accepted = batch.join(out["decisions"].filter("Accepted").select("AdjustID"), "AdjustID", "left_semi")
    touched = [r[0] for r in accepted.select(bucket_of("Inventory").alias("b")).distinct().collect()]
    return publish_snapshot(spark, root, patched={"Inventory": (out["inventory"], touched)}, epoch=epoch,
                            source=ADJUSTMENTS, refused=refused)


def start_stock_adjustments(spark: SparkSession, source_dir: str, root: str, checkpoint_location: str,
                            source_format: str = "parquet", trigger_seconds: int | None = None) -> StreamingQuery:
    """Start the stock-adjustment stream (see ``adjust_batch``)."""
    stream = spark.readStream.schema(ADJUSTMENT_SCHEMA).format(source_format).load(source_dir)
    writer = (stream.writeStream
              .foreachBatch(lambda df, epoch: adjust_batch(spark, root, df, epoch))
              .option("checkpointLocation", checkpoint_location))
    if trigger_seconds:
        writer = writer.trigger(processingTime=f"{trigger_seconds} seconds")
    return writer.start()
