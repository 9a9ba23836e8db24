"""List views (V1-V7): catalogue, stores, inventory, low stock, debtors."""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.formatting import or_default
from inkwell.functions.textmatch import text_match
from inkwell.schemas import MONEY_SUM

Tables = Mapping[str, DataFrame]

# Labels shown by the reference application.
AUTHOR_SEPARATOR = "، "            # Persian comma and a blank, between author names
STATUS_CRITICAL = "بحرانی"          # available < minimum
STATUS_BORDERLINE = "مرزی"          # available = minimum
STATUS_NORMAL = "عادی"              # otherwise (also when either side is NULL)
MANAGER_NOT_SET = "تعیین نشده"      # store without a manager of its own staff


def book_authors(t: Tables) -> DataFrame:
    """(ISBN, Authors): author names of each book joined in name order."""
    return (t["BookAuthor"].join(t["Author"], "AuthorID")
            .groupBy("ISBN")
            .agg(F.expr(f"listagg(AuthorName, '{AUTHOR_SEPARATOR}') "
                        "within group (order by AuthorName)").alias("Authors")))


def book_catalogue(t: Tables) -> DataFrame:
    """V1: every book with its authors (NULL when it has none), publisher,
    price and year, by title."""
    pub = t["Publisher"].select("PublisherID", "PublisherName")
    return (t["Book"].join(pub, "PublisherID")
            .join(book_authors(t), "ISBN", "left")
            .select("ISBN", "Title", "Subject", "Authors", "PublisherName", "Price", "PublicationYear")
            .orderBy("Title", "ISBN"))


def store_list(t: Tables, display: bool = False) -> DataFrame:
    """V2: stores with city and manager name. The manager must work in the
    store being managed (two-key left join); otherwise the name is NULL, or
    the fixed "not set" label with ``display=True``."""
    emp = t["Employee"].select(F.col("NationalCode").alias("ManagerNationalCode"),
                               F.col("StoreCode").alias("_mstore"),
                               F.col("FullName").alias("ManagerName"))
    s = t["Store"].join(t["City"], "CityCode")
    out = (s.join(emp, (s.ManagerNationalCode == emp.ManagerNationalCode)
                  & (s.StoreCode == emp._mstore), "left")
           .select("StoreCode", "CityName", "ProvinceName", "Phone", "Address",
                   s.ManagerNationalCode, "ManagerName"))
    if display:
        out = out.select("StoreCode", "CityName", "ProvinceName", "Phone", "Address",
                         F.coalesce("ManagerNationalCode", F.lit("")).alias("ManagerNationalCode"),
                         or_default(F.col("ManagerName"), MANAGER_NOT_SET).alias("ManagerName"))
    return out.orderBy("StoreCode")


def stock_status() -> Column:
    a, m = F.col("AvailableQuantity"), F.col("MinimumQuantity")
    return (F.when(a < m, F.lit(STATUS_CRITICAL))
            .when(a == m, F.lit(STATUS_BORDERLINE))
            .otherwise(F.lit(STATUS_NORMAL)))


def _inventory_base(t: Tables) -> DataFrame:
    stores = t["Store"].join(t["City"], "CityCode").select("StoreCode", "CityName")
    return (t["Inventory"].join(stores, "StoreCode")
            .join(t["Book"].select("ISBN", "Title"), "ISBN"))


def inventory_list(t: Tables, store_text: str | None = None, book_text: str | None = None,
                   match: str = "contains", collation: str | None = None) -> DataFrame:
    """V3: inventory rows with three-way status. ``store_text`` matches as a
    substring of the store code; ``book_text`` as a substring of the title or
    the ISBN (``match="like"`` keeps T-SQL wildcards, as in the reports)."""
    inv = _inventory_base(t)
    if store_text and store_text.strip():
        inv = inv.filter(text_match(F.col("StoreCode").cast("string"), store_text.strip(), match))
    if book_text and book_text.strip():
        b = book_text.strip()
        inv = inv.filter(text_match("Title", b, match, collation) | text_match("ISBN", b, match, collation))
    return (inv.select("StoreCode", "CityName", "ISBN", "Title", "AvailableQuantity", "MinimumQuantity",
                       stock_status().alias("Status"),
                       F.coalesce("Description", F.lit("")).alias("Description"))
            .orderBy("StoreCode", "Title", "ISBN"))


def low_stock(t: Tables, store: int | None = None) -> DataFrame:
    """V4: rows below their minimum over all stores (or one exact store),
    largest shortage first."""
    inv = t["Inventory"].filter(F.col("AvailableQuantity") < F.col("MinimumQuantity"))
    if store is not None:
        inv = inv.filter(F.col("StoreCode") == F.lit(int(store)))
    stores = t["Store"].join(t["City"], "CityCode").select("StoreCode", "CityName")
    return (inv.join(stores, "StoreCode")
            .join(t["Book"].select("ISBN", "Title"), "ISBN")
            .select("StoreCode", "CityName", "Title", "ISBN", "AvailableQuantity", "MinimumQuantity",
                    (F.col("MinimumQuantity") - F.col("AvailableQuantity")).alias("Shortage"),
                    F.coalesce("Description", F.lit("")).alias("Description"))
            .orderBy(F.col("Shortage").desc(), "StoreCode", "Title", "ISBN"))


def debtor_list(t: Tables, minimum: Decimal | int | str = 0) -> DataFrame:
    """V5: customers with debt strictly above ``minimum`` (default 0)."""
    amt = Decimal(str(minimum).replace(",", "").strip())
    if amt < 0:
        raise ValueError("minimum debt must not be negative")
    return (t["Customer"].filter(F.col("DebtAmount") > F.lit(amt))
            .select("CustomerCode", "FullName", "Phone", "Address", "DebtAmount")
            .orderBy(F.col("DebtAmount").desc(), "CustomerCode"))


def debtor_summary(t: Tables, minimum: Decimal | int | str = 0) -> DataFrame:
    """V6: number of listed debtors and their total debt (one row)."""
    return debtor_list(t, minimum).agg(
        F.count(F.lit(1)).alias("DebtorCount"),
        F.coalesce(F.sum("DebtAmount"), F.lit(0)).cast(MONEY_SUM).alias("TotalDebt"))


def price_list(t: Tables) -> DataFrame:
    """V7: books with subject and price, by title."""
    return t["Book"].select("ISBN", "Title", "Subject", "Price").orderBy("Title", "ISBN")
