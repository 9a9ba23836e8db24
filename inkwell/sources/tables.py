"""Reading the stored tables, writing them, and table row counts."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from string import Formatter
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.utils import AnalysisException

from inkwell.schemas import SCHEMAS, TABLES, VIEW_SCHEMAS


class StoredTables(Mapping[str, DataFrame]):
    """Tables stored as ``<root>/<Table>/`` parquet folders, read with the
    declared schema (no inference, no schema-merging scan of file footers).
    Derived tables (``VIEW_SCHEMAS``, e.g. SaleLine) are found when present."""

    def __init__(self, spark: SparkSession, root: str, fmt: str = "parquet"):
        self.spark, self.root, self.fmt = spark, root.rstrip("/"), fmt
        self._cache: dict[str, DataFrame] = {}
        self._missing: set[str] = set()

    def __getitem__(self, name: str) -> DataFrame:
        schema = SCHEMAS.get(name) or VIEW_SCHEMAS.get(name)
        if schema is None or name in self._missing:
            raise KeyError(name)
        if name not in self._cache:
            try:
                self._cache[name] = (self.spark.read.format(self.fmt).schema(schema)
                                     .load(f"{self.root}/{name}"))
            except AnalysisException:
                if name in VIEW_SCHEMAS:
                    self._missing.add(name)
                    raise KeyError(name) from None
                raise
        return self._cache[name]

    def __iter__(self) -> Iterator[str]:
        return iter(TABLES)

    def __len__(self) -> int:
        return len(TABLES)


def load_tables(spark: SparkSession, root: str, fmt: str = "parquet") -> StoredTables:
    """The twelve tables under ``root``. Report arguments are bound as
    literals in the plan (``F.lit``), never pasted into SQL text."""
    return StoredTables(spark, root, fmt)


class CatalogTables(Mapping[str, DataFrame]):
    """The twelve tables of a catalog database (``plans.layout.write_catalog_tables``)."""

    def __init__(self, spark: SparkSession, database: str):
        self.spark, self.database = spark, database

    def __getitem__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise KeyError(name)
        return self.spark.table(f"{self.database}.{name}")

    def __iter__(self) -> Iterator[str]:
        return iter(TABLES)

    def __len__(self) -> int:
        return len(TABLES)


def load_jdbc_tables(spark: SparkSession, url: str, properties: dict[str, str],
                     schema: str = "dbo") -> dict[str, DataFrame]:
    """S1 for a live relational source: one JDBC read per table. Filters and
    projections of a report are pushed into the remote query by Spark."""
    return {t: spark.read.jdbc(url, f"{schema}.{t}", properties=properties) for t in TABLES}


def query(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame],
          args: Sequence[Any] | Mapping[str, Any] | None = None) -> DataFrame:
    """A SQL statement over ``tables``, named in braces, with bound values:

        query(spark, "select * from {Store} where CityCode = ? and Phone = ?", t, [3, "021-1"])

    ``args``: values of the ``?`` markers in order, or a mapping for ``:name``
    markers. They reach the plan as literals and are never pasted into the
    text. Only the named tables are read; they leave no views behind."""
    named = dict.fromkeys(n for _, n, _, _ in Formatter().parse(sql) if n)
    return spark.sql(sql, args=args, **{n: tables[n] for n in named})


def table_counts(tables: Mapping[str, DataFrame], names: tuple[str, ...] = TABLES) -> DataFrame:
    """S3: one row per table with its row count, as a single frame."""
    parts = [tables[n].select(F.lit(n).alias("TableName"), F.count(F.lit(1)).alias("RowCount"))
             for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def conform(df: DataFrame, table: str) -> DataFrame:
    """Cast and order columns to the declared schema of ``table``."""
    schema = SCHEMAS.get(table) or VIEW_SCHEMAS[table]
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def sale_lines(sale: DataFrame, items: DataFrame) -> DataFrame:
    """SaleLine rows: each sale line with its invoice header."""
    return conform(items.join(sale, "InvoiceNumber")
                   .withColumn("InvoiceYear", F.year("InvoiceDate")), "SaleLine")
