"""Batch inserts, edits and deletes (W7-W14) as DataFrame operations.

The reference changes one row per form submit. Here each operator takes a
DataFrame of requests with an arrival column and returns accepted rows,
refused rows with a reason, and the table as it is after the batch; nothing
is mutated in place (publishing the new state is ``inkwell.sources.snapshots``).

Every batch first passes the write gate (``inkwell.operators.gate``), which
refuses requests that break an input rule or name a row that does not exist;
refused rows carry a ``Reason`` and, from the gate, all their ``Violations``.
Then three generic operators cover W7-W14:

* ``insert_new``: a key already in the table, or already taken by an earlier
  request of the batch, is refused.
* ``update_by_key``: the last request per key wins; a key not in the table
  is refused. Keys never change.
* ``delete_unreferenced``: a key still referenced by a child table is
  refused.

Within-batch "first"/"last" per key is a grouped min/max of the arrival
column joined back, so a key with many requests is partially aggregated
rather than sent whole to one window task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions.ordinal import with_ordinal
from inkwell.functions.parsing import parse_authors
from inkwell.operators.gate import gate, passed, refused
from inkwell.operators.quality import book_rules, inventory_key_rules, inventory_rules, store_rules
from inkwell.schemas import MONEY, SCHEMAS, ForeignKey, dependents_of, references_of
from inkwell.session import written_table

Tables = Mapping[str, DataFrame]

DUPLICATE_KEY = "duplicate_key"
DUPLICATE_IN_BATCH = "duplicate_in_batch"
NO_SUCH_ROW = "no_such_row"
SUPERSEDED = "superseded"
REFERENCED = "referenced"
UNKNOWN_PUBLISHER = "unknown_publisher"
MANAGER_NOT_IN_STORE = "manager_not_in_store"
INVALID_INPUT = "invalid_input"


@dataclass
class UpsertResult:
    accepted: DataFrame
    rejected: DataFrame   # request columns + Reason
    table: DataFrame      # the table after the batch


def _reason(df: DataFrame, reason: str) -> DataFrame:
    return df.withColumn("Reason", F.lit(reason))


def _first_per_key(requests: DataFrame, keys: list[str], arrival: str, last: bool = False) -> tuple[DataFrame, DataFrame]:
    """Split requests into (the first -- or last -- per key, the others)."""
    pick = F.max(arrival) if last else F.min(arrival)
    chosen = requests.groupBy(*keys).agg(pick.alias("_pick"))
    win = requests.join(chosen, keys).filter(F.col(arrival) == F.col("_pick")).drop("_pick")
    rest = requests.join(win.select(*keys, arrival), [*keys, arrival], "left_anti")
    return win, rest


def insert_new(table: DataFrame, requests: DataFrame, keys: Sequence[str], arrival: str) -> UpsertResult:
    """Insert requests whose key is new; ``requests`` carries the table's
    columns plus ``arrival`` (unique)."""
    keys = list(keys)
    first = requests.groupBy(*keys).agg(F.min(arrival).alias("_first"))
    existing = table.select(*keys).distinct().withColumn("_taken", F.lit(True))
    # judged once for the accepted and the refused (a key that is NULL is no first one)
    judged = written_table(requests.join(first, keys, "left").join(existing, keys, "left").withColumn(
        "Reason", F.when(~F.coalesce(F.col(arrival) == F.col("_first"), F.lit(False)), F.lit(DUPLICATE_IN_BATCH))
                   .when(F.col("_taken"), F.lit(DUPLICATE_KEY))).drop("_first", "_taken"), "judged")
    accepted = judged.filter(F.col("Reason").isNull()).drop("Reason")
    rejected = judged.filter(F.col("Reason").isNotNull())
    new_table = table.unionByName(accepted.select(*table.columns))
    return UpsertResult(accepted, rejected, new_table)


def update_by_key(table: DataFrame, requests: DataFrame, keys: Sequence[str], arrival: str,
                  set_cols: Sequence[str]) -> UpsertResult:
    """Overwrite ``set_cols`` of existing rows; the last request per key wins
    (NULL values are written as NULL)."""
    keys = list(keys)
    last, older = _first_per_key(requests, keys, arrival, last=True)
    existing = table.select(*keys).distinct()
    accepted = last.join(existing, keys, "left_semi")
    missing = last.join(existing, keys, "left_anti")
    rejected = _reason(missing, NO_SUCH_ROW).unionByName(_reason(older, SUPERSEDED))
    upd = accepted.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in set_cols],
                          F.lit(True).alias("_matched"))
    joined = table.join(upd, keys, "left")
    out_cols = [F.when(F.col("_matched"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
                if c in set_cols else F.col(c) for c in table.columns]
    return UpsertResult(accepted, rejected, joined.select(*out_cols))


def delete_unreferenced(table: DataFrame, requests: DataFrame, keys: Sequence[str],
                        children: Sequence[tuple[DataFrame, Sequence[str]]]) -> UpsertResult:
    """Delete the requested keys that no child row references."""
    keys = list(keys)
    req = requests.select(*keys).distinct()
    refs: DataFrame | None = None
    for child, cols in children:
        r = child.select(*[F.col(c).alias(k) for c, k in zip(cols, keys)]).distinct()
        refs = r if refs is None else refs.unionByName(r)
    # distinct child keys first, so the semi/anti joins shuffle one row per key
    refs = refs.distinct()
    referenced = req.join(refs, keys, "left_semi")
    deletable = req.join(refs, keys, "left_anti").join(table.select(*keys), keys, "left_semi")
    missing = req.join(table.select(*keys), keys, "left_anti")
    rejected = _reason(referenced, REFERENCED).unionByName(_reason(missing, NO_SUCH_ROW))
    return UpsertResult(deletable, rejected, table.join(deletable, keys, "left_anti"))


#: The form gives a publisher by name, and a manager among the store's own staff.
PUBLISHER_BY_NAME = ForeignKey("book_publisher", "Book", ("PublisherName",), "Publisher", ("PublisherName",))
MANAGER_IN_STORE = ForeignKey("manager_in_store", "Store", ("ManagerNationalCode", "StoreCode"),
                              "Employee", ("NationalCode", "StoreCode"))
_REASONS = {PUBLISHER_BY_NAME.name: UNKNOWN_PUBLISHER, MANAGER_IN_STORE.name: MANAGER_NOT_IN_STORE}


def _after_gate(res: UpsertResult, gated: DataFrame, rules) -> UpsertResult:
    """``res`` with the requests that the gate refused."""
    by_key = res.rejected.withColumn("Violations", F.array().cast("array<string>"))
    res.rejected = by_key.unionByName(refused(gated, rules, _REASONS), allowMissingColumns=True)
    return res


# --- W7, W8: inventory ------------------------------------------------------------
INVENTORY_KEYS = ["StoreCode", "ISBN"]


def insert_inventory(t: Tables, requests: DataFrame, arrival: str = "RequestID") -> UpsertResult:
    """New (store, ISBN) rows of stores and books that exist; quantities
    integers >= 0 (C4); blank description NULL."""
    rules = {**inventory_key_rules(), **inventory_rules()}
    gated = gate(t, requests, "Inventory", rules, references_of("Inventory"))
    return _after_gate(insert_new(t["Inventory"], passed(gated), INVENTORY_KEYS, arrival), gated, rules)


def edit_inventory(t: Tables, requests: DataFrame, arrival: str = "RequestID") -> UpsertResult:
    """Overwrite quantities and description of existing rows; quantities
    as for new rows."""
    rules = inventory_rules()
    gated = gate(t, requests, "Inventory", rules)
    res = update_by_key(t["Inventory"], passed(gated), INVENTORY_KEYS, arrival,
                        ["AvailableQuantity", "MinimumQuantity", "Description"])
    return _after_gate(res, gated, rules)


# --- W9-W11: books and authors ----------------------------------------------------
def resolve_authors(t: Tables, names: DataFrame, arrival: str = "RequestID") -> dict[str, DataFrame]:
    """(ISBN, AuthorName, arrival, Pos) -> author ids; names not in the
    table get new ids ``max + 1, ...`` in order of first use. A name held by
    several authors resolves to the smallest id. Returns ``authors`` (the
    table with the new ones) ``new_authors`` and ``links`` (ISBN, AuthorID)."""
    author = t["Author"]
    known = author.groupBy("AuthorName").agg(F.min("AuthorID").alias("AuthorID"))
    first_use = names.groupBy("AuthorName").agg(F.min(F.struct(arrival, "Pos")).alias("_first"))
    fresh = first_use.join(known, "AuthorName", "left_anti")
    base = author.select(F.coalesce(F.max("AuthorID"), F.lit(0)).cast("long")).scalar()
    new_authors = (with_ordinal(fresh, ["_first", "AuthorName"], "AuthorID", start=base + F.lit(1))
                   .select(F.col("AuthorID").cast("int"), "AuthorName"))
    ids = known.unionByName(new_authors.select("AuthorName", "AuthorID"))
    links = names.join(ids, "AuthorName").select("ISBN", "AuthorID").distinct()
    return {"authors": author.unionByName(new_authors), "new_authors": new_authors, "links": links}


def _book_gate(t: Tables, requests: DataFrame) -> tuple[DataFrame, DataFrame, dict]:
    """(gated requests, those that passed with the publisher's id, rules). A
    name held by several publishers resolves to the smallest id."""
    rules = book_rules(parse_authors(F.col("Authors")))
    gated = gate(t, requests, "Book", rules, [PUBLISHER_BY_NAME])
    pubs = t["Publisher"].groupBy("PublisherName").agg(F.min("PublisherID").alias("PublisherID"))
    return gated, passed(gated).join(pubs, "PublisherName"), rules


def _author_names(req: DataFrame, arrival: str) -> DataFrame:
    """(ISBN, AuthorName, arrival, Pos) from the Authors text of book requests."""
    return (req.select("ISBN", arrival, F.posexplode(parse_authors(F.col("Authors"))).alias("Pos", "AuthorName")))


def insert_books(t: Tables, requests: DataFrame, arrival: str = "RequestID") -> dict[str, DataFrame]:
    """W9 + W11: new books (ISBN, Title, Subject, Price, PublisherName,
    PublicationYear, Authors text); requests that break C5-C7, name an unknown
    publisher or an ISBN already taken are refused; authors resolved by name,
    missing ones created."""
    gated, resolved, rules = _book_gate(t, requests)
    book_cols = [f.name for f in SCHEMAS["Book"].fields]
    res = _after_gate(insert_new(t["Book"], resolved.select(*book_cols, arrival, "Authors"), ["ISBN"], arrival), gated, rules)
    au = resolve_authors(t, _author_names(res.accepted, arrival), arrival)
    return {
        "accepted": res.accepted.drop("Authors"),
        "rejected": res.rejected.drop("PublisherID"),
        "Book": res.table.select(*book_cols),
        "Author": au["authors"],
        "BookAuthor": t["BookAuthor"].unionByName(au["links"]).distinct(),
    }


def edit_books(t: Tables, requests: DataFrame, arrival: str = "RequestID") -> dict[str, DataFrame]:
    """W10 + W11: overwrite book fields (ISBN is the key and does not
    change), under the rules for new books; the book's author links are
    deleted and rebuilt from the new list. Authors that lose their last book
    are kept."""
    gated, resolved, rules = _book_gate(t, requests)
    book_cols = [f.name for f in SCHEMAS["Book"].fields]
    sets = [c for c in book_cols if c != "ISBN"]
    res = _after_gate(update_by_key(t["Book"], resolved.select(*book_cols, arrival, "Authors"), ["ISBN"], arrival, sets), gated, rules)
    au = resolve_authors(t, _author_names(res.accepted, arrival), arrival)
    kept_links = t["BookAuthor"].join(res.accepted.select("ISBN"), "ISBN", "left_anti")
    return {
        "accepted": res.accepted.drop("Authors"),
        "rejected": res.rejected.drop("PublisherID"),
        "Book": res.table,
        "Author": au["authors"],
        "BookAuthor": kept_links.unionByName(au["links"]),
    }


# --- W12-W14: stores --------------------------------------------------------------
def insert_stores(t: Tables, requests: DataFrame, arrival: str = "RequestID") -> UpsertResult:
    """New stores under C8, in a city that exists; the manager is always
    unset on insert."""
    rules = store_rules()
    req = requests.withColumn("ManagerNationalCode", F.lit(None).cast("string"))
    gated = gate(t, req, "Store", rules, [fk for fk in references_of("Store") if fk.parent == "City"])
    return _after_gate(insert_new(t["Store"], passed(gated), ["StoreCode"], arrival), gated, rules)


def edit_stores(t: Tables, requests: DataFrame, arrival: str = "RequestID") -> UpsertResult:
    """Overwrite city, manager, phone and address, under the rules for new
    stores. The manager must be unset or an employee of that same store."""
    rules = store_rules()
    gated = gate(t, requests, "Store", rules, [*(fk for fk in references_of("Store") if fk.parent == "City"), MANAGER_IN_STORE])
    res = update_by_key(t["Store"], passed(gated), ["StoreCode"], arrival,
                        ["CityCode", "ManagerNationalCode", "Phone", "Address"])
    return _after_gate(res, gated, rules)


def delete_stores(t: Tables, requests: DataFrame) -> UpsertResult:
    """Delete stores nothing depends on (employees, stock, sales,
    purchases)."""
    children = [(t[fk.child], fk.child_cols) for fk in dependents_of("Store")]
    return delete_unreferenced(t["Store"], requests, ["StoreCode"], children)


# --- C9-C12, C14, C19: publisher purchases -----------------------------------------
def insert_purchases(t: Tables, requests: DataFrame, order_by: Sequence[str] = ("RequestID",)) -> UpsertResult:
    """New purchases (PublisherID, StoreCode, PurchaseDate, TotalAmount,
    PaidAmount). PaidAmount defaults to 0 (C12); TotalAmount > 0 and
    0 <= PaidAmount <= TotalAmount (C9, C10); publisher and store must exist
    (C14). Accepted rows get identity ids max + 1, ... in ``order_by`` order
    (C19)."""
    req = requests.withColumn("PaidAmount", F.coalesce(F.col("PaidAmount").cast(MONEY), F.lit(0).cast(MONEY)))
    valid = ((F.col("TotalAmount") > 0) & (F.col("PaidAmount") >= 0)
             & (F.col("PaidAmount") <= F.col("TotalAmount"))
             & F.col("PurchaseDate").isNotNull() & F.col("PublisherID").isNotNull()
             & F.col("StoreCode").isNotNull())
    valid = F.coalesce(valid, F.lit(False))
    ok = (req.filter(valid)
          .join(t["Publisher"].select("PublisherID").distinct(), "PublisherID", "left_semi")
          .join(t["Store"].select("StoreCode").distinct(), "StoreCode", "left_semi"))
    bad_ref = (req.filter(valid).join(ok.select(*order_by), list(order_by), "left_anti"))
    base = t["PublisherPurchase"].select(F.coalesce(F.max("PurchaseID"), F.lit(0)).cast("long")).scalar()
    numbered = with_ordinal(ok, list(order_by), "PurchaseID", start=base + F.lit(1))
    cols = [f.name for f in SCHEMAS["PublisherPurchase"].fields]
    accepted = numbered.select(F.col("PurchaseID").cast("int"), *[c for c in cols if c != "PurchaseID"])
    rejected = _reason(req.filter(~valid), INVALID_INPUT).unionByName(_reason(bad_ref, "unknown_reference"))
    return UpsertResult(accepted, rejected, t["PublisherPurchase"].unionByName(accepted))
