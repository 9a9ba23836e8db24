"""Dimension lists (L1-L5): sorted projections used to pick parameters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Tables = Mapping[str, DataFrame]

# (table, columns, sort) of the plain dimension lists (L2)
DIMENSIONS: dict[str, tuple[str, tuple[str, ...], tuple[str, ...]]] = {
    "authors": ("Author", ("AuthorID", "AuthorName"), ("AuthorName", "AuthorID")),
    "customers": ("Customer", ("CustomerCode", "FullName", "Phone"), ("FullName", "CustomerCode")),
    "books": ("Book", ("ISBN", "Title"), ("Title", "ISBN")),
    "publishers": ("Publisher", ("PublisherID", "PublisherName"), ("PublisherName", "PublisherID")),
    "cities": ("City", ("CityCode", "CityName", "ProvinceName"), ("CityName", "CityCode")),
}


def city_names(t: Tables) -> DataFrame:
    """L1: distinct city names, sorted."""
    return t["City"].select("CityName").distinct().orderBy("CityName")


def dimension_list(t: Tables, table: str, cols: Sequence[str], order: Sequence[str]) -> DataFrame:
    """L2: ``cols`` of ``table`` sorted by ``order``."""
    return t[table].select(*cols).orderBy(*order)


def named_list(t: Tables, name: str) -> DataFrame:
    table, cols, order = DIMENSIONS[name]
    return dimension_list(t, table, cols, order)


def stores_with_city(t: Tables) -> DataFrame:
    """L3: stores with city name and address, by code."""
    return (t["Store"].join(t["City"], "CityCode")
            .select("StoreCode", "CityName", "Address").orderBy("StoreCode"))


def employees(t: Tables, store: int | None = None) -> DataFrame:
    """L4: employees, all or those of one store (candidate managers and
    sellers), by name."""
    e = t["Employee"]
    if store is not None:
        e = e.filter(F.col("StoreCode") == F.lit(int(store)))
    return e.select("NationalCode", "FullName", "StoreCode").orderBy("FullName", "NationalCode")


def sellable_books(t: Tables, store: int) -> DataFrame:
    """Books in stock at one store with price and quantity, by title."""
    inv = t["Inventory"].filter((F.col("StoreCode") == F.lit(int(store)))
                                & (F.col("AvailableQuantity") > 0))
    return (inv.join(t["Book"].select("ISBN", "Title", "Price"), "ISBN")
            .select("ISBN", "Title", "Price", "AvailableQuantity")
            .orderBy("Title", "ISBN"))
