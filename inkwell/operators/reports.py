"""The eleven parameterised reports (R1-R11), plus the stand-alone script
variants where they differ (R3 ``mode="script"``, R6c).

Every report takes ``t``, a mapping table name -> DataFrame, and typed
parameters, and returns a lazy DataFrame with English column names. Parameters
become literals in the plan, so Catalyst pushes them into the scans. No join
carries a fixed broadcast hint: dimensions that are small after filtering are
broadcast by the planner or by AQE from measured sizes, and stay sort-merge
joins when they are not.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.textmatch import equals, text_match
from inkwell.schemas import MONEY_SUM

Tables = Mapping[str, DataFrame]

# The report form's default parameters (start date, debt
# amount); the default end date is today.
DEFAULT_START = dt.date(2009, 1, 1)
DEFAULT_DEBT = Decimal(10000)


def _date(d: dt.date | str) -> dt.date:
    return d if isinstance(d, dt.date) else dt.date.fromisoformat(str(d))


def _range(start: dt.date | str | None, end: dt.date | str | None) -> tuple[dt.date, dt.date]:
    """Date range, closed on both ends; the form's defaults are 2009-01-01
    and today."""
    s = _date(start) if start is not None else DEFAULT_START
    e = _date(end) if end is not None else dt.date.today()
    if s > e:
        raise ValueError("start date must not be after end date")
    return s, e


def line_total() -> Column:
    """Quantity x UnitPrice, exact decimal (M1)."""
    return (F.col("Quantity") * F.col("UnitPrice")).cast(MONEY_SUM)


def _stores_with_city(t: Tables) -> DataFrame:
    return t["Store"].join(t["City"], "CityCode")


# R1 -------------------------------------------------------------------------
def stores_in_city(t: Tables, city: str, collation: str | None = None) -> DataFrame:
    """Stores of the cities named ``city``, by store code. ``collation``
    (e.g. ``UTF8_LCASE``, ``UTF8_BINARY_RTRIM``) sets how names compare."""
    city_rows = t["City"].filter(equals("CityName", city, collation))
    return (t["Store"].join(city_rows, "CityCode")
            .select("StoreCode", "CityName", "ProvinceName", "Phone", "Address")
            .orderBy("StoreCode"))


# R2 -------------------------------------------------------------------------
def stores_without_author(t: Tables, author: str, collation: str | None = None) -> DataFrame:
    """R2: stores holding no in-stock book (AvailableQuantity > 0) by the
    authors named ``author``. A store holding such a book only with quantity
    zero is listed."""
    isbns = (t["BookAuthor"]
             .join(t["Author"].filter(equals("AuthorName", author, collation)), "AuthorID")
             .select("ISBN").distinct())
    holding = (t["Inventory"].filter(F.col("AvailableQuantity") > 0)
               .join(isbns, "ISBN").select("StoreCode").distinct())
    return (_stores_with_city(t).join(holding, "StoreCode", "left_anti")
            .select("StoreCode", "CityName", "Phone", "Address")
            .orderBy("StoreCode"))


# Sale lines -----------------------------------------------------------------
def _has(t: Tables, name: str) -> bool:
    try:
        t[name]
    except KeyError:
        return False
    return True


def sale_lines(t: Tables, *, start: dt.date | None = None, end: dt.date | None = None,
               store: int | None = None, employee: str | None = None,
               customer: int | None = None) -> DataFrame:
    """Sale lines with their invoice header (Sale inner-joined to SaleItem:
    an invoice without lines has no row), filtered on the header. Read from
    the SaleLine fact table when the tables have one (year folders, sorted
    store/date, bloom filters on customer and employee), else by the join,
    with the filters applied to Sale before it. Where both tables lie in
    invoice folders and buckets, the join needs no shuffle and reads only the
    folders of the filtered invoices."""
    conds = []
    if start is not None:
        conds.append(F.col("InvoiceDate").between(F.lit(start), F.lit(end)))
    if store is not None:
        conds.append(F.col("StoreCode") == F.lit(store))
    if employee is not None:
        conds.append(F.col("EmployeeNationalCode") == F.lit(employee))
    if customer is not None:
        conds.append(F.col("CustomerCode") == F.lit(customer))
    if _has(t, "SaleLine"):
        lines = t["SaleLine"]
        if start is not None:     # prune year folders
            lines = lines.filter(F.col("InvoiceYear").between(start.year, end.year))
        for c in conds:
            lines = lines.filter(c)
        return lines.drop("InvoiceYear")
    sale, items = t["Sale"], t["SaleItem"]
    for c in conds:
        sale = sale.filter(c)
    if "InvoiceRange" in sale.columns and "InvoiceRange" in items.columns:
        # co-located tables: bucketed alike on InvoiceNumber, in folders of
        # consecutive invoices. The folders of the wanted invoices (at most one
        # row per folder, so a bounded broadcast) prune those of the lines.
        if conds:
            items = items.join(F.broadcast(sale.select("InvoiceRange").distinct()), "InvoiceRange", "left_semi")
        sale, items = sale.drop("InvoiceRange"), items.drop("InvoiceRange")
    elif hasattr(t, "sale_items_of") and (employee is not None or customer is not None):
        # derived lines: those of one person's invoices are taken first, so
        # that only they are numbered
        items = t.sale_items_of(sale)
    return sale.join(items, "InvoiceNumber")


# R3 -------------------------------------------------------------------------
def _sales_lines(t: Tables, store: int | None, start: dt.date, end: dt.date) -> DataFrame:
    return sale_lines(t, start=start, end=end, store=store).select(
        "InvoiceNumber", "StoreCode", "Quantity", "UnitPrice")


def _sales_measures() -> list[Column]:
    return [
        F.count_distinct("InvoiceNumber").alias("InvoiceCount"),
        F.sum("Quantity").cast("bigint").alias("SoldQuantity"),
        F.sum(F.col("Quantity") * F.col("UnitPrice")).cast(MONEY_SUM).alias("TotalSales"),
    ]


def store_sales(t: Tables, store: int, start: dt.date | str | None = None,
                end: dt.date | str | None = None, mode: str = "ui") -> DataFrame:
    """Invoices, books sold and sales amount of one store, dates inclusive.

    ``mode="ui"``: always one row, zeros when nothing was sold.
    ``mode="script"``: grouped by store, no row when nothing was sold.
    """
    s, e = _range(start, end)
    lines = _sales_lines(t, store, s, e)
    if mode == "script":
        return lines.groupBy("StoreCode").agg(*_sales_measures())
    if mode != "ui":
        raise ValueError(f"unknown mode {mode!r}")
    agg = lines.agg(*_sales_measures())
    return agg.select(
        F.lit(store).cast("int").alias("StoreCode"),
        "InvoiceCount",
        F.coalesce("SoldQuantity", F.lit(0).cast("bigint")).alias("SoldQuantity"),
        F.coalesce("TotalSales", F.lit(0).cast(MONEY_SUM)).alias("TotalSales"),
    )


def store_sales_all(t: Tables, start: dt.date | str | None = None,
                    end: dt.date | str | None = None) -> DataFrame:
    """R3 for every store in one pass (the script form without a store
    filter): one row per store that sold something in the range."""
    s, e = _range(start, end)
    return _sales_lines(t, None, s, e).groupBy("StoreCode").agg(*_sales_measures())


def store_sales_for(t: Tables, params: DataFrame) -> DataFrame:
    """R3 (form semantics) for a DataFrame of requests (StoreCode, StartDate,
    EndDate) in one pass: one row per distinct request, zeros when nothing
    was sold. Sale lines join the requests on the store with the date range
    as a join condition (an inner join, so a store holding many lines can be
    split by AQE); requests without sales are added by an anti join."""
    req = params.select("StoreCode", "StartDate", "EndDate").distinct()
    lines = sale_lines(t).select("InvoiceNumber", F.col("StoreCode").alias("_store"),
                                 "InvoiceDate", "Quantity", "UnitPrice")
    cond = ((req.StoreCode == lines._store)
            & lines.InvoiceDate.between(req.StartDate, req.EndDate))
    sold = (req.join(lines, cond)
            .groupBy("StoreCode", "StartDate", "EndDate").agg(*_sales_measures()))
    keys = ["StoreCode", "StartDate", "EndDate"]
    none = req.join(sold.select(*keys), keys, "left_anti").select(
        *keys, F.lit(0).cast("bigint").alias("InvoiceCount"), F.lit(0).cast("bigint").alias("SoldQuantity"),
        F.lit(0).cast(MONEY_SUM).alias("TotalSales"))
    return sold.unionByName(none)


# R4 -------------------------------------------------------------------------
def employees_of_store(t: Tables, store: int) -> DataFrame:
    """Employees of one store, by name."""
    return (t["Employee"].filter(F.col("StoreCode") == F.lit(store))
            .select("NationalCode", "FullName", "Phone", "Address", "Gender", "StoreCode")
            .orderBy("FullName", "NationalCode"))


# R5 -------------------------------------------------------------------------
def employee_sales(t: Tables, employee: str) -> DataFrame:
    """Every sale line recorded by one employee, newest first."""
    lines = sale_lines(t, employee=employee)
    emp = t["Employee"].select(F.col("NationalCode").alias("EmployeeNationalCode"),
                               F.col("FullName").alias("EmployeeName"))
    cust = t["Customer"].select("CustomerCode", F.col("FullName").alias("CustomerName"))
    book = t["Book"].select("ISBN", "Title")
    return (lines.join(emp, "EmployeeNationalCode")
            .join(cust, "CustomerCode")
            .join(book, "ISBN")
            .select("InvoiceNumber", "InvoiceDate", "EmployeeName", "CustomerName", "StoreCode",
                    "Title", "Quantity", "UnitPrice", line_total().alias("LineTotal"), "LineNumber")
            .orderBy(F.col("InvoiceDate").desc(), "InvoiceNumber", "LineNumber")
            .drop("LineNumber"))


# R6 -------------------------------------------------------------------------
def _check_text(text: str) -> str:
    text = (text or "").strip()
    if not text:
        raise ValueError("search text is empty")
    return text


def books_by_author(t: Tables, text: str, match: str = "contains",
                    collation: str | None = None) -> DataFrame:
    """Books with an author whose name contains ``text``; one row per
    book and matching author."""
    text = _check_text(text)
    authors = t["Author"].filter(text_match("AuthorName", text, match, collation))
    pub = t["Publisher"].select("PublisherID", "PublisherName")
    return (t["BookAuthor"].join(authors, "AuthorID")
            .join(t["Book"], "ISBN")
            .join(pub, "PublisherID")
            .select("ISBN", "Title", "Subject", "AuthorName", "PublisherName", "Price")
            .distinct()
            .orderBy("Title", "ISBN", "AuthorName"))


def books_by_subject(t: Tables, text: str, match: str = "contains",
                     collation: str | None = None) -> DataFrame:
    """Books whose subject contains ``text``."""
    text = _check_text(text)
    pub = t["Publisher"].select("PublisherID", "PublisherName")
    return (t["Book"].filter(text_match("Subject", text, match, collation))
            .join(pub, "PublisherID")
            .select("ISBN", "Title", "Subject", "PublisherName", "Price")
            .orderBy("Title", "ISBN"))


def books_by_author_or_subject(t: Tables, text: str, match: str = "contains",
                               collation: str | None = None) -> DataFrame:
    """R6c (script form): books whose subject or one of whose authors
    contains ``text``; author-less books can match on subject."""
    text = _check_text(text)
    by_author = (t["BookAuthor"]
                 .join(t["Author"].filter(text_match("AuthorName", text, match, collation)), "AuthorID")
                 .select("ISBN").distinct()
                 .withColumn("_by_author", F.lit(True)))
    pub = t["Publisher"].select("PublisherID", "PublisherName")
    return (t["Book"].join(by_author, "ISBN", "left")
            .filter(text_match("Subject", text, match, collation) | F.col("_by_author").isNotNull())
            .join(pub, "PublisherID")
            .select("ISBN", "Title", "Subject", "PublisherName", "Price")
            .distinct())


# R7 -------------------------------------------------------------------------
def debtors_above(t: Tables, amount: Decimal | int | str = DEFAULT_DEBT) -> DataFrame:
    """Customers whose debt is strictly above ``amount``, largest first."""
    amt = Decimal(str(amount).replace(",", "").strip())
    if amt < 0:
        raise ValueError("debt amount must not be negative")
    return (t["Customer"].filter(F.col("DebtAmount") > F.lit(amt))
            .select("CustomerCode", "FullName", "Phone", "Address", "DebtAmount")
            .orderBy(F.col("DebtAmount").desc(), "CustomerCode"))


# R8 -------------------------------------------------------------------------
def customer_purchases(t: Tables, customer: int, with_code: bool = True) -> DataFrame:
    """Every purchase line of one customer, newest first. The form view
    adds the customer code column (``with_code``); the script does not."""
    cust = t["Customer"].filter(F.col("CustomerCode") == F.lit(customer)).select("CustomerCode", "FullName")
    store = t["Store"].select("StoreCode", "Address")
    book = t["Book"].select("ISBN", "Title")
    cols = (["CustomerCode"] if with_code else []) + [
        "FullName", "InvoiceNumber", "InvoiceDate", "StoreCode", "Address", "ISBN", "Title",
        "Quantity", "UnitPrice"]
    return (cust.join(sale_lines(t, customer=customer), "CustomerCode")
            .join(store, "StoreCode")
            .join(book, "ISBN")
            .select(*cols, line_total().alias("LineTotal"), "LineNumber")
            .orderBy(F.col("InvoiceDate").desc(), "InvoiceNumber", "LineNumber")
            .drop("LineNumber"))


# R9 -------------------------------------------------------------------------
def unsold_books(t: Tables, start: dt.date | str | None = None,
                 end: dt.date | str | None = None) -> DataFrame:
    """Books with no sale line dated in the range, in any store."""
    s, e = _range(start, end)
    # distinct ISBNs first: the anti join then shuffles one row per sold book,
    # not one per sale line
    sold = sale_lines(t, start=s, end=e).select("ISBN").distinct()
    pub = t["Publisher"].select("PublisherID", "PublisherName")
    return (t["Book"].join(sold, "ISBN", "left_anti")
            .join(pub, "PublisherID")
            .select("ISBN", "Title", "Subject", "PublisherName", "Price")
            .orderBy("Title", "ISBN"))


# R10 ------------------------------------------------------------------------
def stores_short_of_book(t: Tables, isbn: str) -> DataFrame:
    """Stores where one book is below its minimum, largest shortage first."""
    inv = t["Inventory"].filter((F.col("ISBN") == F.lit(isbn))
                                & (F.col("AvailableQuantity") < F.col("MinimumQuantity")))
    book = t["Book"].select("ISBN", "Title")
    return (inv.join(_stores_with_city(t).select("StoreCode", "CityName", "Address"), "StoreCode")
            .join(book, "ISBN")
            .select("StoreCode", "CityName", "Address", "Title", "AvailableQuantity", "MinimumQuantity",
                    (F.col("MinimumQuantity") - F.col("AvailableQuantity")).alias("Shortage"))
            .orderBy(F.col("Shortage").desc(), "StoreCode"))


# R11 ------------------------------------------------------------------------
def publisher_debt(t: Tables, publisher: str, collation: str | None = None) -> DataFrame:
    """Purchases from, payments to and debt to the publishers named
    ``publisher`` (grouped by name); no row without purchases."""
    pub = t["Publisher"].filter(equals("PublisherName", publisher, collation))
    return (t["PublisherPurchase"].join(pub, "PublisherID")
            .groupBy("PublisherName")
            .agg(F.sum("TotalAmount").cast(MONEY_SUM).alias("TotalPurchase"),
                 F.sum("PaidAmount").cast(MONEY_SUM).alias("TotalPaid"),
                 F.sum(F.col("TotalAmount") - F.col("PaidAmount")).cast(MONEY_SUM).alias("Debt")))


def publisher_debt_all(t: Tables) -> DataFrame:
    """R11 for every publisher name in one pass."""
    return (t["PublisherPurchase"].join(t["Publisher"], "PublisherID")
            .groupBy("PublisherName")
            .agg(F.sum("TotalAmount").cast(MONEY_SUM).alias("TotalPurchase"),
                 F.sum("PaidAmount").cast(MONEY_SUM).alias("TotalPaid"),
                 F.sum(F.col("TotalAmount") - F.col("PaidAmount")).cast(MONEY_SUM).alias("Debt")))


REPORTS = {
    "r01_stores_in_city": stores_in_city,
    "r02_stores_without_author": stores_without_author,
    "r03_store_sales": store_sales,
    "r04_employees_of_store": employees_of_store,
    "r05_employee_sales": employee_sales,
    "r06a_books_by_author": books_by_author,
    "r06b_books_by_subject": books_by_subject,
    "r06c_books_by_author_or_subject": books_by_author_or_subject,
    "r07_debtors_above": debtors_above,
    "r08_customer_purchases": customer_purchases,
    "r09_unsold_books": unsold_books,
    "r10_stores_short_of_book": stores_short_of_book,
    "r11_publisher_debt": publisher_debt,
}
