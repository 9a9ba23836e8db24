"""Schemas of the twelve tables and their constraint metadata.

One source of truth for loading (typed reads), quality checks (keys,
references, value rules) and the upsert operators.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
# Result type for money sums and products; both Spark and the SQL oracle are
# cast to it so that schemas agree.
MONEY_SUM = T.DecimalType(38, 2)


def _schema(*cols: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in cols])


S, I, L, SH, D = T.StringType(), T.IntegerType(), T.LongType(), T.ShortType(), T.DateType()

SCHEMAS: dict[str, T.StructType] = {
    "City": _schema(("CityCode", I, False), ("CityName", S, False), ("ProvinceName", S, False)),
    "Store": _schema(
        ("StoreCode", I, False), ("CityCode", I, False), ("ManagerNationalCode", S, True),
        ("Phone", S, False), ("Address", S, False),
    ),
    "Employee": _schema(
        ("NationalCode", S, False), ("FullName", S, False), ("Phone", S, True),
        ("Address", S, False), ("Gender", S, False), ("StoreCode", I, False),
    ),
    "Customer": _schema(
        ("CustomerCode", I, False), ("FullName", S, False), ("Phone", S, True),
        ("Address", S, True), ("DebtAmount", MONEY, False),
    ),
    "Publisher": _schema(("PublisherID", I, False), ("PublisherName", S, False)),
    "Author": _schema(("AuthorID", I, False), ("AuthorName", S, False)),
    "Book": _schema(
        ("ISBN", S, False), ("Title", S, False), ("Subject", S, False), ("Price", MONEY, False),
        ("PublisherID", I, False), ("PublicationYear", SH, True),
    ),
    "BookAuthor": _schema(("ISBN", S, False), ("AuthorID", I, False)),
    "Inventory": _schema(
        ("StoreCode", I, False), ("ISBN", S, False), ("AvailableQuantity", I, False),
        ("MinimumQuantity", I, False), ("Description", S, True),
    ),
    "Sale": _schema(
        ("InvoiceNumber", L, False), ("InvoiceDate", D, False), ("CustomerCode", I, False),
        ("StoreCode", I, False), ("EmployeeNationalCode", S, False),
    ),
    "SaleItem": _schema(
        ("InvoiceNumber", L, False), ("LineNumber", I, False), ("ISBN", S, False),
        ("Quantity", I, False), ("UnitPrice", MONEY, False),
    ),
    "PublisherPurchase": _schema(
        ("PurchaseID", I, False), ("PublisherID", I, False), ("StoreCode", I, False),
        ("PurchaseDate", D, False), ("TotalAmount", MONEY, False), ("PaidAmount", MONEY, False),
    ),
}

TABLES = tuple(SCHEMAS)

# Derived tables kept next to the twelve for large deployments (not part of
# the reference's schema): SaleLine = SaleItem joined to its Sale header, the
# fact table the sales reports filter (store, date, customer, employee).
VIEW_SCHEMAS: dict[str, T.StructType] = {
    "SaleLine": _schema(
        ("InvoiceNumber", L, False), ("LineNumber", I, False), ("ISBN", S, False),
        ("Quantity", I, False), ("UnitPrice", MONEY, False), ("InvoiceDate", D, False),
        ("CustomerCode", I, False), ("StoreCode", I, False), ("EmployeeNationalCode", S, False),
        ("InvoiceYear", I, False),
    ),
}

PRIMARY_KEYS: dict[str, tuple[str, ...]] = {
    "City": ("CityCode",),
    "Store": ("StoreCode",),
    "Employee": ("NationalCode",),
    "Customer": ("CustomerCode",),
    "Publisher": ("PublisherID",),
    "Author": ("AuthorID",),
    "Book": ("ISBN",),
    "BookAuthor": ("ISBN", "AuthorID"),
    "Inventory": ("StoreCode", "ISBN"),
    "Sale": ("InvoiceNumber",),
    "SaleItem": ("InvoiceNumber", "LineNumber"),
    "PublisherPurchase": ("PurchaseID",),
}


@dataclass(frozen=True)
class ForeignKey:
    name: str
    child: str
    child_cols: tuple[str, ...]
    parent: str
    parent_cols: tuple[str, ...]


# The fifteen relationships of the entity diagram.
FOREIGN_KEYS: tuple[ForeignKey, ...] = (
    ForeignKey("store_city", "Store", ("CityCode",), "City", ("CityCode",)),
    ForeignKey("employee_store", "Employee", ("StoreCode",), "Store", ("StoreCode",)),
    ForeignKey("store_manager", "Store", ("ManagerNationalCode",), "Employee", ("NationalCode",)),
    ForeignKey("book_publisher", "Book", ("PublisherID",), "Publisher", ("PublisherID",)),
    ForeignKey("bookauthor_book", "BookAuthor", ("ISBN",), "Book", ("ISBN",)),
    ForeignKey("bookauthor_author", "BookAuthor", ("AuthorID",), "Author", ("AuthorID",)),
    ForeignKey("inventory_store", "Inventory", ("StoreCode",), "Store", ("StoreCode",)),
    ForeignKey("inventory_book", "Inventory", ("ISBN",), "Book", ("ISBN",)),
    ForeignKey("sale_customer", "Sale", ("CustomerCode",), "Customer", ("CustomerCode",)),
    ForeignKey("sale_store", "Sale", ("StoreCode",), "Store", ("StoreCode",)),
    ForeignKey("sale_employee", "Sale", ("EmployeeNationalCode",), "Employee", ("NationalCode",)),
    ForeignKey("saleitem_sale", "SaleItem", ("InvoiceNumber",), "Sale", ("InvoiceNumber",)),
    ForeignKey("saleitem_book", "SaleItem", ("ISBN",), "Book", ("ISBN",)),
    ForeignKey("purchase_publisher", "PublisherPurchase", ("PublisherID",), "Publisher", ("PublisherID",)),
    ForeignKey("purchase_store", "PublisherPurchase", ("StoreCode",), "Store", ("StoreCode",)),
)


@dataclass(frozen=True)
class Check:
    """A SQL CHECK constraint: violated only where the condition is FALSE
    (a NULL result passes, as in SQL)."""

    name: str
    table: str
    condition: str  # Spark SQL boolean expression


CHECKS: tuple[Check, ...] = (
    Check("purchase_total_positive", "PublisherPurchase", "TotalAmount > 0"),
    Check("purchase_paid_range", "PublisherPurchase", "PaidAmount >= 0 AND PaidAmount <= TotalAmount"),
)


def not_null_columns(table: str) -> tuple[str, ...]:
    return tuple(f.name for f in SCHEMAS[table].fields if not f.nullable)


def references_of(child: str) -> tuple[ForeignKey, ...]:
    """References that a row of ``child`` must satisfy."""
    return tuple(fk for fk in FOREIGN_KEYS if fk.child == child)


def dependents_of(parent: str) -> tuple[ForeignKey, ...]:
    """References that block deleting a parent row."""
    return tuple(fk for fk in FOREIGN_KEYS if fk.parent == parent and fk.child != parent)
