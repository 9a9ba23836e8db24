"""Registered queries of the write gate (W7, W9, W10, W12, W13 under C4-C8),
of rows tagged with the rules they break (C1-C4, C9-C18), of display and
staged text (F1, F9, F10), and of bound SQL parameters (S1).

The test data breaks few rules by itself, so requests and tables with broken
rows are derived from all orders, customers or parts: which rule a row breaks
follows from its key.
"""

from __future__ import annotations

import datetime as dt
import re
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions.formatting import format_frame
from inkwell.functions.headings import REPORT_HEADINGS, localise
from inkwell.functions.parsing import parse_int, parse_money
from inkwell.operators import quality as Q
from inkwell.operators import reports as R
from inkwell.operators import upserts as U
from inkwell.plans.catalog import _summary_sql
from inkwell.plans.registry import register
from inkwell.schemas import MONEY
from inkwell.sources.tables import query

_ISBN = "lpad(cast({} as varchar), 13, '0')"
_NAT = "lpad(cast({} as varchar), 10, '0')"


def _pick(k: str, *cases: tuple[int, int, str], other: str) -> str:
    """SQL, the same in both dialects: the text of the first case (m, r, text)
    with ``k % m = r``."""
    return "case " + " ".join(f"when {k} % {m} = {r} then {v}" for m, r, v in cases) + f" else {other} end"


def _outcome(accepted: DataFrame, rejected: DataFrame, arrival: str = "RequestID") -> DataFrame:
    """One row per request: its Reason (NULL if accepted) and violations."""
    return (accepted.select(arrival, F.lit(None).cast("string").alias("Reason"), F.lit("").alias("Violations"))
            .unionByName(rejected.select(arrival, "Reason", F.array_join("Violations", ",").alias("Violations"))))


# Decisions behind the gate, shared by the statements below. ``gated`` has
# (RequestID, key columns, Broken): the broken rules and references, in order.
_INSERT = """
    select g.RequestID,
           case when len(g.Broken) > 0 then {reason}
                when g.Nth > 1 then 'duplicate_in_batch'
                when exists (select 1 from {table} x where {same}) then 'duplicate_key' end as Reason,
           array_to_string(g.Broken, ',') as Violations
    from (select *, row_number() over (partition by {keys}, len(Broken) > 0 order by RequestID) as Nth from gated) g"""
_UPDATE = """
    select g.RequestID,
           case when len(g.Broken) > 0 then {reason}
                when g.Nth > 1 then 'superseded'
                when not exists (select 1 from {table} x where {same}) then 'no_such_row' end as Reason,
           array_to_string(g.Broken, ',') as Violations
    from (select *, row_number() over (partition by {keys}, len(Broken) > 0 order by RequestID desc) as Nth from gated) g"""


def _broken(*rules: tuple[str, str]) -> str:
    """SQL list of the names of the rules whose SQL condition is not true."""
    flags = ", ".join(f"case when not coalesce({cond}, false) then '{name}' end" for name, cond in rules)
    return f"list_filter([{flags}], lambda x: x is not null)"


# ------------------------------------------------------------ W7, C4 -------
# (as typed into the form; its value or null)
_AVAILABLE = ((7, 0, "'-3'"), (7, 1, "'x'"), (7, 2, "' 12 '"), (7, 3, "'۱۲'"), (7, 4, "'12.5'"))
_STORE = ((13, 0, "'900000001'"), (17, 0, "''"))
_BOOK = ((23, 0, "null"), (29, 0, "'9999999999999'"))
_MINIMUM = ((31, 0, "null"), (37, 0, "'-1'"))

_STAGED_STOCK = f"""
    select o_orderkey as RequestID,
           {_pick('o_orderkey', *_STORE, other="' ' || cast(o_custkey % (select count(*) from supplier) as varchar)")} as StoreCode,
           {_pick('o_orderkey', *_BOOK, other=_ISBN.format('o_orderkey % (select count(*) from part)'))} as ISBN,
           {_pick('o_orderkey', *_AVAILABLE, other="cast(o_orderkey % 50 as varchar)")} as AvailableQuantity,
           {_pick('o_orderkey', *_MINIMUM, other="cast(o_orderkey % 5 as varchar)")} as MinimumQuantity,
           {_pick('o_orderkey', (3, 0, "'  '"), other="'shelf ' || cast(o_orderkey % 20 as varchar)")} as Description
    from orders"""


def _staged(t, sql: str, *tables: str) -> DataFrame:
    """Staged requests by the statement that the oracle runs, over the same
    tables: they are input, not what is tested."""
    sql = re.sub(rf"\bfrom ({'|'.join(tables)})\b", r"from {\1}", sql.replace("as varchar)", "as string)"))
    return query(t.spark, sql, {n: t.raw(n) for n in tables})


_GATED_STOCK = {"staged": _STAGED_STOCK, "gated": """
    select s.RequestID, cast(trim(s.StoreCode) as int) as StoreCode, s.ISBN, list_concat(""" + _broken(
        ("store_present", "length(trim(s.StoreCode)) > 0"), ("book_present", "length(s.ISBN) > 0"),
        ("available_nonnegative_int", "s.RequestID % 7 not in (0, 1, 4)"),
        ("minimum_nonnegative_int", "s.RequestID % 31 <> 0 and s.RequestID % 37 <> 0")) + """,
        list_filter([case when length(trim(s.StoreCode)) > 0 and st.StoreCode is null then 'inventory_store' end,
                     case when length(s.ISBN) > 0 and b.ISBN is null then 'inventory_book' end], lambda x: x is not null)) as Broken
    from (select RequestID, nullif(trim(StoreCode), '') as StoreCode, ISBN from staged) s
    left join bk_Store st on st.StoreCode = cast(s.StoreCode as int) left join bk_Book b on b.ISBN = s.ISBN"""}


@register("w7_inventory_gate", _INSERT.format(
    table="bk_Inventory", keys="StoreCode, ISBN", same="x.StoreCode = g.StoreCode and x.ISBN = g.ISBN",
    reason="case when g.Broken[1] like 'inventory_%' then 'unknown_reference' else 'invalid_input' end"),
    extra_ctes=_GATED_STOCK)
def _w7_gate(t):
    res = U.insert_inventory(t, _staged(t, _STAGED_STOCK, "orders", "supplier", "part"))
    return _outcome(res.accepted, res.rejected)


@register("c4_inventory_text", f"""
    select RequestID, array_to_string({_broken(
        ("available_nonnegative_int", "RequestID % 7 not in (0, 1, 4)"),
        ("minimum_nonnegative_int", "RequestID % 31 <> 0 and RequestID % 37 <> 0"))}, ',') as Violations,
        case when RequestID % 7 = 0 then -3 when RequestID % 7 in (1, 4) then null when RequestID % 7 in (2, 3) then 12
             else cast(RequestID % 50 as int) end as AvailableQuantity
    from staged""", extra_ctes={"staged": _STAGED_STOCK})
def _c4(t):
    staged = Q.validate_inventory_input(_staged(t, _STAGED_STOCK, "orders", "supplier", "part"))
    return staged.select("RequestID", F.array_join("Violations", ",").alias("Violations"),
                         parse_int("AvailableQuantity").alias("AvailableQuantity"))


# ------------------------------------------------------------ W9, W10 ------
_PRICE = ((9, 0, "'-1'"), (9, 1, "'abc'"), (9, 2, "null"), (9, 3, "'1,234.50'"), (9, 4, "' ۱۲٬۵'"))
_YEAR = ((8, 0, "''"), (8, 1, "'999'"), (8, 2, "'10000'"), (8, 3, "'۱۳۹۰'"), (8, 4, "'x'"), (8, 5, "null"))

_STAGED_BOOKS = f"""
    select o_orderkey as RequestID,
           {_pick('o_orderkey', (41, 0, "' '"), (10, 0, _ISBN.format('o_orderkey % (select count(*) from part)')),
                  (10, 5, "'N' || cast(o_orderkey // 20 as varchar)"), other="'M' || cast(o_orderkey as varchar)")} as ISBN,
           {_pick('o_orderkey', (43, 0, "'  '"), other="' Title ' || cast(o_orderkey as varchar)")} as Title,
           {_pick('o_orderkey', (47, 0, "null"), other="'Subject'")} as Subject,
           {_pick('o_orderkey', *_PRICE, other="cast(o_orderkey % 100 as varchar)")} as Price,
           {_pick('o_orderkey', (14, 0, "''"), other="'Brand#' || cast(o_orderkey % 30 as varchar)")} as PublisherName,
           {_pick('o_orderkey', *_YEAR, other="'1390'")} as PublicationYear,
           {_pick('o_orderkey', (12, 0, "' ، ,'"), other="'Writer ' || cast(o_orderkey % 50 as varchar) || ' ، Old'")} as Authors
    from orders""".replace("o_orderkey // 20", "(o_orderkey - o_orderkey % 20)")

_BOOK_RULES = _broken(
    ("isbn_present", "length(trim(s.ISBN)) > 0"), ("title_present", "length(trim(s.Title)) > 0"),
    ("subject_present", "length(s.Subject) > 0"), ("author_present", "s.Authors like '%r%'"),
    ("publisher_present", "length(s.PublisherName) > 0"),
    ("price_nonnegative_decimal", "s.Price is not null and s.Price not in ('-1', 'abc', ' ۱۲٬۵')"),
    ("year_range", "coalesce(s.PublicationYear, '') in ('', '1390', '۱۳۹۰')"))
_GATED_BOOKS = {"staged": _STAGED_BOOKS, "gated": f"""
    select s.RequestID, trim(s.ISBN) as ISBN, list_concat({_BOOK_RULES},
        case when length(s.PublisherName) > 0 and s.PublisherName not in (select PublisherName from bk_Publisher)
             then ['book_publisher'] else [] end) as Broken
    from staged s"""}


@register("w9_book_gate", _INSERT.format(
    table="bk_Book", keys="ISBN", same="x.ISBN = g.ISBN",
    reason="case when g.Broken[1] = 'book_publisher' then 'unknown_publisher' else 'invalid_input' end"),
    extra_ctes=_GATED_BOOKS)
def _w9_gate(t):
    res = U.insert_books(t, _staged(t, _STAGED_BOOKS, "orders", "part"))
    return _outcome(res["accepted"], res["rejected"])


# Every third part is edited; of those every sixth again, later. The later
# edit of every 18th names no publisher that exists, so the earlier one holds.
_BOOK_EDITS = f"""
    select p_partkey as RequestID, {_ISBN.format('p_partkey')} as ISBN, p_name || ' revised' as Title, p_type as Subject,
           cast(p_retailprice as decimal(18,2)) as Price, p_brand as PublisherName, cast(null as smallint) as PublicationYear,
           substring(p_name, 1, 3) || ' ' || p_brand || '، New Writer ' || cast(p_partkey % 20 as varchar) as Authors
    from part where p_partkey % 3 = 0
    union all
    select p_partkey + 1000000000 as RequestID, {_ISBN.format('p_partkey')} as ISBN, p_name || ' again' as Title, 'Edited' as Subject,
           cast(10 + p_partkey as decimal(18,2)) as Price,
           case when p_partkey % 18 = 0 then 'No such house' else p_brand end as PublisherName, cast(1400 as smallint) as PublicationYear,
           'Late Writer, Late Writer ,' || p_type as Authors
    from part where p_partkey % 6 = 0
    union all
    select p_partkey + 2000000000 as RequestID, 'X' || cast(p_partkey as varchar) as ISBN, 'T' as Title, 'S' as Subject,
           cast(1 as decimal(18,2)) as Price, p_brand as PublisherName, cast(null as smallint) as PublicationYear, 'W' as Authors
    from part where p_partkey % 50 = 0"""
_EDITED = {"edit": _BOOK_EDITS, "won": """
    select e.*, p.PublisherID
    from (select *, row_number() over (partition by ISBN order by RequestID desc) as Nth from edit
          where PublisherName in (select PublisherName from bk_Publisher)) e
    join bk_Publisher p on p.PublisherName = e.PublisherName
    where e.Nth = 1 and e.ISBN in (select ISBN from bk_Book)"""}
_NEW_AUTHORS = {**_EDITED, "used": """
    select RequestID, ISBN, Pos, trim(Parts[Pos]) as AuthorName
    from (select *, unnest(range(1, len(Parts) + 1)) as Pos
          from (select *, string_split(replace(Authors, '،', ','), ',') as Parts from won) w) p
    where trim(Parts[Pos]) <> ''""", "all_authors": """
    select AuthorID, AuthorName from bk_Author
    union all
    select cast((select max(AuthorID) from bk_Author) + row_number() over (order by First, AuthorName) as int), AuthorName
    from (select AuthorName, min(RequestID * 1000 + Pos) as First from used
          where AuthorName not in (select AuthorName from bk_Author) group by AuthorName) fresh"""}


def _edit_books(t):
    return U.edit_books(t, _staged(t, _BOOK_EDITS, "part"))


@register("w10_edit_books", """
    select b.ISBN, coalesce(w.Title, b.Title) as Title, coalesce(w.Subject, b.Subject) as Subject,
           coalesce(w.Price, b.Price) as Price, coalesce(w.PublisherID, b.PublisherID) as PublisherID,
           case when w.ISBN is null then b.PublicationYear else w.PublicationYear end as PublicationYear
    from bk_Book b left join won w on w.ISBN = b.ISBN""", extra_ctes=_EDITED)
def _w10(t):
    return _edit_books(t)["Book"]


@register("w10_edit_books_links", """
    select ba.ISBN, ba.AuthorID from bk_BookAuthor ba where ba.ISBN not in (select ISBN from won)
    union all
    select distinct u.ISBN, a.AuthorID from used u join all_authors a on a.AuthorName = u.AuthorName""",
          extra_ctes=_NEW_AUTHORS)
def _w10_links(t):
    return _edit_books(t)["BookAuthor"]


@register("w10_edit_books_authors", """
    select a.AuthorID, a.AuthorName,
           a.AuthorID in (select AuthorID from bk_BookAuthor where ISBN not in (select ISBN from won))
           or a.AuthorName in (select AuthorName from used) as HasBook
    from all_authors a""", extra_ctes=_NEW_AUTHORS)
def _w10_authors(t):
    """All authors after the edits: those without a book are kept."""
    res = _edit_books(t)
    linked = res["BookAuthor"].select("AuthorID").distinct().withColumn("HasBook", F.lit(True))
    return (res["Author"].join(linked, "AuthorID", "left")
            .select("AuthorID", "AuthorName", F.coalesce("HasBook", F.lit(False)).alias("HasBook")))


@register("w10_edit_books_outcome", """
    select e.RequestID,
           case when e.PublisherName not in (select PublisherName from bk_Publisher) then 'unknown_publisher'
                when exists (select 1 from edit l where l.ISBN = e.ISBN and l.RequestID > e.RequestID
                             and l.PublisherName in (select PublisherName from bk_Publisher)) then 'superseded'
                when e.ISBN not in (select ISBN from bk_Book) then 'no_such_row' end as Reason,
           case when e.PublisherName not in (select PublisherName from bk_Publisher) then 'book_publisher' else '' end as Violations
    from edit e""", extra_ctes={"edit": _BOOK_EDITS})
def _w10_outcome(t):
    res = _edit_books(t)
    return _outcome(res["accepted"], res["rejected"])


# ------------------------------------------------------------ W12, W13 -----
_CITY = ((9, 0, "null"),)
_STORE_FIELDS = f"""
           {_pick('c_custkey', *_CITY, other="cast(c_custkey % 30 as varchar)")} as CityCode,
           {_pick('c_custkey', (8, 0, "' '"), other="'021-' || cast(c_custkey as varchar)")} as Phone,
           {_pick('c_custkey', (11, 0, "''"), other="'Street ' || cast(c_custkey as varchar)")} as Address"""
_STAGED_STORES = f"""
    select c_custkey as RequestID, cast(null as varchar) as ManagerNationalCode,
           {_pick('c_custkey', (6, 0, "'0'"), (10, 3, "'abc'"), (7, 0, "cast(c_custkey % (select count(*) from supplier) as varchar)"),
                  (7, 1, "cast(2000000 + c_custkey % 50 as varchar)"), other="cast(1000000 + c_custkey as varchar)")} as StoreCode,
           {_STORE_FIELDS}
    from customer"""
_STORE_RULES = _broken(
    ("store_code_positive_int", "try_cast(s.StoreCode as int) > 0"), ("city_present", "length(s.CityCode) > 0"),
    ("phone_present", "length(trim(s.Phone)) > 0"), ("address_present", "length(s.Address) > 0"))
_NO_CITY = "s.CityCode is not null and cast(s.CityCode as int) not in (select CityCode from bk_City)"
_STORE_REASON = """case g.Broken[1] when 'store_city' then 'unknown_reference' when 'manager_in_store' then 'manager_not_in_store'
                        else 'invalid_input' end"""


@register("w12_store_gate", _INSERT.format(
    table="bk_Store", keys="StoreCode", same="x.StoreCode = g.StoreCode", reason=_STORE_REASON),
    extra_ctes={"staged": _STAGED_STORES, "gated": f"""
    select s.RequestID, try_cast(s.StoreCode as int) as StoreCode,
           list_concat({_STORE_RULES}, case when {_NO_CITY} then ['store_city'] else [] end) as Broken
    from staged s"""})
def _w12_gate(t):
    res = U.insert_stores(t, _staged(t, _STAGED_STORES, "customer", "supplier"))
    return _outcome(res.accepted, res.rejected)


_STORE_NUMBER = "(c_custkey % (select count(*) + 5 from supplier))"
_STORE_EDITS = f"""
    select c_custkey as RequestID, cast({_STORE_NUMBER} as varchar) as StoreCode,
           {_pick('c_custkey', (5, 0, "null"), (5, 2, _NAT.format(f'({_STORE_NUMBER} + 1) * 10')),
                  other=_NAT.format(f'{_STORE_NUMBER} * 10 + 1'))} as ManagerNationalCode,
           {_STORE_FIELDS}
    from customer"""


@register("w13_store_gate", _UPDATE.format(
    table="bk_Store", keys="StoreCode", same="x.StoreCode = g.StoreCode", reason=_STORE_REASON),
    extra_ctes={"staged": _STORE_EDITS, "gated": f"""
    select s.RequestID, try_cast(s.StoreCode as int) as StoreCode,
           list_concat({_STORE_RULES}, case when {_NO_CITY} then ['store_city'] else [] end,
                       case when s.ManagerNationalCode is not null and not exists (
                                select 1 from bk_Employee e where e.NationalCode = s.ManagerNationalCode
                                and e.StoreCode = cast(s.StoreCode as int)) then ['manager_in_store'] else [] end) as Broken
    from staged s"""})
def _w13_gate(t):
    res = U.edit_stores(t, _staged(t, _STORE_EDITS, "customer", "supplier"))
    return _outcome(res.accepted, res.rejected)


# ------------------------------------------------------------ C1-C3 --------
_STAGED_LINES = """
    select l_orderkey * 10 + l_linenumber as LineID,
           case when l_orderkey % 19 = 0 then ' ' else cast(l_suppkey as varchar) end as StoreCode,
           case when l_orderkey % 23 = 0 then null else cast(l_partkey as varchar) end as CustomerCode,
           case when l_linenumber = 5 then '' else 'E1' end as EmployeeNationalCode,
           case when l_linenumber = 6 then null else 'B1' end as ISBN,
           case l_orderkey % 7 when 0 then '2009-2-30' when 1 then '2009/1/5' when 2 then '2009-1-5' when 3 then ' 2008-2-29 '
                when 4 then null when 5 then 'today' else '2009-12-31' end as InvoiceDate,
           case l_partkey % 6 when 0 then '0' when 1 then '۳' when 2 then '-2' when 3 then '2.5' when 4 then '' else ' 4 ' end as Quantity
    from lineitem"""


@register("c1_c3_tagged_lines", f"""
    select LineID, array_to_string({_broken(
        ("date_format", "trim(InvoiceDate) in ('2009-1-5', '2008-2-29', '2009-12-31')"),
        ("quantity_positive_int", "trim(Quantity) in ('۳', '4')"),
        ("store_present", "length(trim(StoreCode)) > 0"), ("customer_present", "length(CustomerCode) > 0"),
        ("employee_present", "length(EmployeeNationalCode) > 0"), ("book_present", "length(ISBN) > 0"))}, ',') as Violations
    from staged""", extra_ctes={"staged": _STAGED_LINES})
def _c1_tagged(t):
    staged = Q.validate_sale_lines(_staged(t, _STAGED_LINES, "lineitem"))
    return staged.select("LineID", F.array_join("Violations", ",").alias("Violations"))


# ------------------------------------------------------------ C9-C18 -------
# The tables with rows that break rules: spoilt by their keys, some repeated.
_SPOILT = {
    "PublisherPurchase": """
        select PurchaseID, case when PurchaseID % 11 = 0 then -1 else PublisherID end as PublisherID,
               case when PurchaseID % 13 = 0 then null when PurchaseID % 17 = 0 then 900000001 else StoreCode end as StoreCode,
               PurchaseDate,
               cast(case when PurchaseID % 5 = 0 then -TotalAmount when PurchaseID % 19 = 0 then null else TotalAmount end as decimal(18,2)) as TotalAmount,
               cast(case when PurchaseID % 7 = 0 then TotalAmount + 1 when PurchaseID % 23 = 0 then -1 else PaidAmount end as decimal(18,2)) as PaidAmount
        from {pp}
        union all
        select PurchaseID, PublisherID, StoreCode, PurchaseDate, TotalAmount, PaidAmount from {pp} where PurchaseID % 29 = 0""",
    "Sale": """
        select InvoiceNumber, case when InvoiceNumber % 31 = 0 then null else InvoiceDate end as InvoiceDate,
               case when InvoiceNumber % 37 = 0 then -5 else CustomerCode end as CustomerCode,
               case when InvoiceNumber % 41 = 0 then 900000001 else StoreCode end as StoreCode,
               case when InvoiceNumber % 43 = 0 then 'nobody' when InvoiceNumber % 47 = 0 then null
                    else EmployeeNationalCode end as EmployeeNationalCode
        from {sale}
        union all
        select InvoiceNumber, InvoiceDate, CustomerCode, StoreCode, EmployeeNationalCode from {sale} where InvoiceNumber % 53 = 0""",
    "Store": """
        select StoreCode, case when StoreCode % 3 = 0 then 99 else CityCode end as CityCode,
               case when StoreCode % 4 = 2 then '0000000020' else ManagerNationalCode end as ManagerNationalCode,
               case when StoreCode % 10 = 0 then null else Phone end as Phone, Address
        from {store}""",
}
_NAMES = {"pp": "PublisherPurchase", "sale": "Sale", "store": "Store"}


class _Spoilt(dict):
    """The derived tables, with spoilt ones in place of some."""

    def __init__(self, t, *spoilt: str):
        self.t = t
        for name in spoilt:
            # only the tables named: some are computed when they are built
            self[name] = query(t.spark, _SPOILT[name], {k: t[v] for k, v in _NAMES.items() if "{" + k + "}" in _SPOILT[name]})

    def __missing__(self, name):
        return self.t[name]


def _spoilt_sql(name: str) -> str:
    return _SPOILT[name].format(**{k: f"bk_{v}" for k, v in _NAMES.items()})


def _tagged_sql(cols: str, *rules: tuple[str, str]) -> str:
    flags = ", ".join(f"case when {bad} then '{name}' end" for name, bad in rules)
    return f"select {cols}, array_to_string(list_filter([{flags}], lambda x: x is not null), ',') as Violations from spoilt r"


def _tagged(t, name: str):
    df = Q.tagged(_Spoilt(t, name), name)
    return df.withColumn("Violations", F.array_join("Violations", ","))


@register("c_tagged_purchases", _tagged_sql(
    "PurchaseID, PublisherID, StoreCode, PurchaseDate, TotalAmount, PaidAmount",
    ("pk_PublisherPurchase", "count(*) over (partition by PurchaseID) > 1"),
    ("not_null_PublisherPurchase", "StoreCode is null or TotalAmount is null"),
    ("check_purchase_total_positive", "not coalesce(TotalAmount > 0, true)"),
    ("check_purchase_paid_range", "not coalesce(PaidAmount >= 0 and PaidAmount <= TotalAmount, true)"),
    ("fk_purchase_publisher", "PublisherID not in (select PublisherID from bk_Publisher)"),
    ("fk_purchase_store", "StoreCode is not null and StoreCode not in (select StoreCode from bk_Store)")),
    extra_ctes={"spoilt": _spoilt_sql("PublisherPurchase")})
def _c_purchases(t):
    return _tagged(t, "PublisherPurchase")


@register("c_tagged_sales", _tagged_sql(
    "InvoiceNumber, InvoiceDate, CustomerCode, StoreCode, EmployeeNationalCode",
    ("pk_Sale", "count(*) over (partition by InvoiceNumber) > 1"),
    ("not_null_Sale", "InvoiceDate is null or EmployeeNationalCode is null"),
    ("fk_sale_customer", "CustomerCode not in (select CustomerCode from bk_Customer)"),
    ("fk_sale_store", "StoreCode not in (select StoreCode from bk_Store)"),
    ("fk_sale_employee", "EmployeeNationalCode is not null and EmployeeNationalCode not in (select NationalCode from bk_Employee)"),
    ("sale_has_items", "InvoiceNumber not in (select InvoiceNumber from bk_SaleItem)"),
    ("seller_in_store", "not exists (select 1 from bk_Employee e where e.NationalCode = r.EmployeeNationalCode and e.StoreCode = r.StoreCode)")),
    extra_ctes={"spoilt": _spoilt_sql("Sale")})
def _c_sales(t):
    return _tagged(t, "Sale")


@register("c_tagged_stores", _tagged_sql(
    "StoreCode, CityCode, ManagerNationalCode, Phone, Address",
    ("pk_Store", "false"), ("not_null_Store", "Phone is null"),
    ("fk_store_city", "CityCode not in (select CityCode from bk_City)"),
    ("fk_store_manager", "ManagerNationalCode is not null and ManagerNationalCode not in (select NationalCode from bk_Employee)"),
    ("manager_in_store", "ManagerNationalCode is not null and not exists (select 1 from bk_Employee e "
                         "where e.NationalCode = r.ManagerNationalCode and e.StoreCode = r.StoreCode)"),
    ("manager_of_one_store", "ManagerNationalCode is not null and count(*) over (partition by ManagerNationalCode) > 1")),
    extra_ctes={"spoilt": _spoilt_sql("Store")})
def _c_stores(t):
    return _tagged(t, "Store")


# The summary over the spoilt tables: those rules that some row breaks.
@register("c_quality_summary_broken", "select * from (" + re.sub(
    r"\bbk_(PublisherPurchase|Sale|Store)\b", r"bad_\1", _summary_sql()) + ") c where Violations > 0",
    extra_ctes={f"bad_{name}": _spoilt_sql(name) for name in _SPOILT})
def _c_summary_broken(t):
    return Q.quality_summary(_Spoilt(t, *_SPOILT)).filter("Violations > 0")


# ------------------------------------------------------------ F1, F9, F10 --
@register("f1_display_cells", """
    select cast(PurchaseID as varchar) as PurchaseID, cast(PublisherID as varchar) as PublisherID,
           coalesce(cast(StoreCode as varchar), '') as StoreCode, strftime(PurchaseDate, '%Y-%m-%d') as PurchaseDate,
           coalesce(format('{:,}', cast(round_even(TotalAmount, 0) as bigint)), '') as TotalAmount,
           coalesce(format('{:,}', cast(round_even(PaidAmount, 0) as bigint)), '') as PaidAmount
    from (select PurchaseID, PublisherID, StoreCode, PurchaseDate,
                 cast(case when PurchaseID % 2 = 0 then floor(TotalAmount) + 0.5 when PurchaseID % 19 = 0 then null
                           else -TotalAmount end as decimal(18,2)) as TotalAmount,
                 PaidAmount from bk_PublisherPurchase) p""")
def _f1(t):
    """Money at exact halves, negative and missing, dates, NULLs."""
    odd = (F.when(F.col("PurchaseID") % 2 == 0, F.floor("TotalAmount") + F.lit(Decimal("0.5")))
           .when(F.col("PurchaseID") % 19 == 0, F.lit(None)).otherwise(-F.col("TotalAmount")))
    return format_frame(t["PublisherPurchase"].withColumn("TotalAmount", odd.cast(MONEY)))


_HEADINGS = REPORT_HEADINGS["r11_publisher_debt"]


@register("f9_localised_headings", f"""
    select p.PublisherName as "{_HEADINGS['PublisherName']}",
           cast(sum(pp.TotalAmount) as decimal(38,2)) as "{_HEADINGS['TotalPurchase']}",
           cast(sum(pp.PaidAmount) as decimal(38,2)) as "{_HEADINGS['TotalPaid']}",
           cast(sum(pp.TotalAmount) - sum(pp.PaidAmount) as decimal(38,2)) as "{_HEADINGS['Debt']}"
    from bk_Publisher p join bk_PublisherPurchase pp using (PublisherID) group by p.PublisherName""")
def _f9(t):
    return localise(R.publisher_debt_all(t), "r11_publisher_debt")


_MONEY_TEXT = """
    select o_orderkey as OrderKey,
           case o_orderkey % 8 when 0 then ' 1,234,567.5 ' when 1 then '۱۲۳۴' when 2 then '٤٥,٦' when 3 then '12x' when 4 then ''
                when 5 then null when 6 then '-7.25' else cast(o_custkey as varchar) || ',000.10' end as Price
    from orders"""


@register("f10_money_text", """
    select OrderKey, cast(case OrderKey % 8 when 0 then 1234567.5 when 1 then 1234 when 2 then 456 when 6 then -7.25
                               when 7 then cast(replace(Price, ',', '') as decimal(18,2)) end as decimal(18,2)) as Amount
    from staged""", extra_ctes={"staged": _MONEY_TEXT})
def _f10(t):
    return _staged(t, _MONEY_TEXT, "orders").select("OrderKey", parse_money("Price").alias("Amount"))


# ------------------------------------------------------------ S1 -----------
@register("s1_bound_parameters", """
    select s.StoreCode, c.CityName, count(*) as Invoices, cast(sum(x.Amount) as decimal(38,2)) as Amount
    from bk_Store s join bk_City c on c.CityCode = s.CityCode
    join (select v.StoreCode, v.InvoiceNumber, sum(i.Quantity * i.UnitPrice) as Amount
          from bk_Sale v join bk_SaleItem i on i.InvoiceNumber = v.InvoiceNumber
          where v.InvoiceDate >= date '1995-01-01' group by v.StoreCode, v.InvoiceNumber) x on x.StoreCode = s.StoreCode
    where c.CityName <> 'O''Brien''s; drop table bk_Store --' and s.StoreCode between 5 and 60
    group by s.StoreCode, c.CityName""")
def _s1_bound(t):
    """Values bound to markers: a quote, a semicolon and a comment stay text."""
    return query(t.spark, """
        select s.StoreCode, c.CityName, count(*) as Invoices, cast(sum(x.Amount) as decimal(38,2)) as Amount
        from {Store} s join {City} c using (CityCode)
        join (select StoreCode, InvoiceNumber, sum(Quantity * UnitPrice) as Amount
              from {Sale} join {SaleItem} using (InvoiceNumber)
              where InvoiceDate >= ? group by StoreCode, InvoiceNumber) x using (StoreCode)
        where c.CityName <> ? and s.StoreCode between ? and ?
        group by s.StoreCode, c.CityName""",
        {n: t[n] for n in ("Store", "City", "Sale", "SaleItem")},
        [dt.date(1995, 1, 1), "O'Brien's; drop table bk_Store --", 5, 60])
