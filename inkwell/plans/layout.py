"""Physical layout of the stored tables, standing in for the reference's
indexes (the reports filter Sale by store and date, customer or employee,
SaleItem and Inventory by ISBN).

Each large table is range-partitioned and sorted on the columns its reports
filter, so Parquet min/max statistics let the scan skip row groups (the
filters reach the scan as ``PushedFilters``):

* Sale      by (InvoiceDate, StoreCode): date ranges of R3/R9 skip files.
* SaleItem  by (InvoiceNumber, LineNumber): invoice numbers grow with time,
            so a date range of invoices is a narrow key range; joins on
            InvoiceNumber read it in key order.
* Inventory by (ISBN, StoreCode): R10 filters one ISBN.
* PublisherPurchase by (PublisherID).

Small dimensions are written as they are. File count follows the data:
``spark.sql.files.maxRecordsPerFile`` bounds every file.

``SaleLine`` (SaleItem joined to its Sale header) is the fact table the sales
reports read when it exists: folders per ``InvoiceYear`` (date ranges prune
folders), rows sorted by (StoreCode, InvoiceDate) inside (store and date
filters skip row groups by min/max), and Parquet bloom filters on
CustomerCode and EmployeeNationalCode (one customer's or one employee's lines
skip the row groups that cannot hold them).

Where there is a catalog, ``write_catalog_tables`` keeps the plain twelve
tables joinable without a shuffle: Sale and SaleItem are bucketed alike on
InvoiceNumber, in folders of consecutive invoices (``InvoiceRange``). A report
on one employee or customer joins bucket by bucket and reads only the folders
of that employee's or customer's invoices.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.schemas import TABLES
from inkwell.sources.tables import conform, sale_lines

# table -> sort columns of its layout
LAYOUT: dict[str, tuple[str, ...]] = {
    "Sale": ("InvoiceDate", "StoreCode"),
    "SaleItem": ("InvoiceNumber", "LineNumber"),
    "Inventory": ("ISBN", "StoreCode"),
    "PublisherPurchase": ("PublisherID",),
    "BookAuthor": ("ISBN",),
}

MAX_RECORDS_PER_FILE = 4_000_000
BLOOM_COLUMNS = ("CustomerCode", "EmployeeNationalCode")


def write_sale_lines(lines: DataFrame, root: str, mode: str = "overwrite") -> None:
    """Write SaleLine rows with its layout (see module doc)."""
    w = (lines.repartitionByRange("InvoiceYear", "StoreCode", "InvoiceDate")
         .sortWithinPartitions("StoreCode", "InvoiceDate")
         .write.mode(mode).partitionBy("InvoiceYear")
         .option("maxRecordsPerFile", MAX_RECORDS_PER_FILE))
    for c in BLOOM_COLUMNS:
        w = w.option(f"parquet.bloom.filter.enabled#{c}", "true")
    w.parquet(f"{root}/SaleLine")


def write_tables(tables: Mapping[str, DataFrame], root: str, partitions: int | None = None,
                 mode: str = "overwrite", with_sale_lines: bool = True) -> None:
    """Write the twelve tables under ``root/<Table>`` with the layout above,
    and (by default) the SaleLine fact table from the written Sale and
    SaleItem."""
    for name in TABLES:
        df = conform(tables[name], name)
        spark = df.sparkSession
        n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
        cols = LAYOUT.get(name)
        if cols:
            df = df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
        (df.write.mode(mode)
         .option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
         .parquet(f"{root}/{name}"))
    if with_sale_lines:
        from inkwell.sources.tables import load_tables
        stored = load_tables(tables["Sale"].sparkSession, root)
        write_sale_lines(sale_lines(stored["Sale"], stored["SaleItem"]), root, mode)


CO_LOCATED = ("Sale", "SaleItem")
#: Invoices of one folder, and buckets of a folder, of the co-located tables.
INVOICE_STEP, INVOICE_BUCKETS = 10_000_000, 64


def write_catalog_tables(tables: Mapping[str, DataFrame], database: str, buckets: int = INVOICE_BUCKETS,
                         step: int = INVOICE_STEP, mode: str = "overwrite") -> None:
    """Write the twelve tables into ``database`` of the session's catalog, Sale
    and SaleItem bucketed on InvoiceNumber in folders of ``step`` invoices.
    Both must be written with the same ``buckets`` and ``step``, also when rows
    are appended later."""
    for name in TABLES:
        df = conform(tables[name], name)
        if name in CO_LOCATED:
            df = df.withColumn("InvoiceRange", F.floor(F.col("InvoiceNumber") / step).cast("long"))
            # the rows of a bucket in one task: one file for each folder and bucket
            w = (df.repartition(buckets, "InvoiceNumber").sortWithinPartitions("InvoiceRange", "InvoiceNumber")
                 .write.partitionBy("InvoiceRange").bucketBy(buckets, "InvoiceNumber").sortBy("InvoiceNumber"))
        else:
            w = df.write
        w.mode(mode).option("maxRecordsPerFile", MAX_RECORDS_PER_FILE).saveAsTable(f"{database}.{name}")
