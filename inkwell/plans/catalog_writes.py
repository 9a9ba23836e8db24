"""Registered write operators (W4, W6-W14) over request batches derived from
the test tables, so that the work grows with the data.

Order-dependent outcomes (W4, W6) have recursive SQL that walks one event
after another; the tests also check them against plain sequential replays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions.ordinal import with_ordinal
from inkwell.operators import posting as P
from inkwell.operators import upserts as U
from inkwell.plans.registry import register
from inkwell.schemas import MONEY

_ISBN = "lpad(cast({} as varchar), 13, '0')"
LATER = 1 << 40     # request ids of a second submission: after every first one


# ------------------------------------------------------------ W7, W8 -------
def _stock_requests(t) -> DataFrame:
    """Insert requests: the dense posting stock, one request per row."""
    return (t.post_stock()
            .withColumn("RequestID", (F.col("StoreCode").cast("long") * 100
                                      + F.substring("ISBN", 12, 2).cast("long"))))


@register("w7_insert_inventory", """
    select ps.StoreCode, ps.ISBN, ps.AvailableQuantity, 0 as MinimumQuantity,
           cast(null as varchar) as Description
    from bk_PostStock ps
    where not exists (select 1 from bk_Inventory i where i.StoreCode = ps.StoreCode and i.ISBN = ps.ISBN)""")
def _w7(t):
    res = U.insert_inventory(t, _stock_requests(t))
    return res.accepted.select("StoreCode", "ISBN", "AvailableQuantity", "MinimumQuantity", "Description")


@register("w7_insert_inventory_refused", """
    select ps.StoreCode, ps.ISBN, 'duplicate_key' as Reason
    from bk_PostStock ps
    where exists (select 1 from bk_Inventory i where i.StoreCode = ps.StoreCode and i.ISBN = ps.ISBN)""")
def _w7r(t):
    return U.insert_inventory(t, _stock_requests(t)).rejected.select("StoreCode", "ISBN", "Reason")


@register("w8_restock_low_inventory", """
    select i.StoreCode, i.ISBN,
           case when i.AvailableQuantity < i.MinimumQuantity then i.MinimumQuantity * 2
                else i.AvailableQuantity end as AvailableQuantity,
           i.MinimumQuantity,
           case when i.AvailableQuantity < i.MinimumQuantity then 'restocked'
                else i.Description end as Description
    from bk_Inventory i""")
def _w8(t):
    low = t["Inventory"].filter(F.col("AvailableQuantity") < F.col("MinimumQuantity"))
    req = low.select("StoreCode", "ISBN", (F.col("MinimumQuantity") * 2).alias("AvailableQuantity"),
                     "MinimumQuantity", F.lit("  restocked ").alias("Description"),
                     F.lit(1).cast("long").alias("RequestID"))     # one request per row: order is moot
    return U.edit_inventory(t, req).table


# ------------------------------------------------------------ W9-W11 -------
def _book_requests(t) -> DataFrame:
    """Second editions of every book (new ISBNs, one new co-author per
    subject) and a resubmission of every book larger than size 40 (refused)."""
    p = t.raw("part")
    second = p.select(
        F.col("p_partkey").alias("RequestID"),
        F.concat(F.lit("9"), F.lpad(F.col("p_partkey").cast("string"), 12, "0")).alias("ISBN"),
        F.concat(F.col("p_name"), F.lit(" 2nd ed")).alias("Title"),
        F.col("p_type").alias("Subject"),
        (F.col("p_retailprice").cast(MONEY) * F.lit(1.1).cast("decimal(2,1)")).cast(MONEY).alias("Price"),
        F.col("p_brand").alias("PublisherName"),
        F.lit(None).cast("short").alias("PublicationYear"),
        F.concat(F.split_part(F.col("p_name"), F.lit(" "), F.lit(1)), F.lit(" "), F.col("p_brand"),
                 F.lit("، "), F.col("p_type"), F.lit(" Writer")).alias("Authors"))
    again = p.filter(F.col("p_size") > 40).select(
        (F.col("p_partkey") + LATER).alias("RequestID"),
        F.lpad(F.col("p_partkey").cast("string"), 13, "0").alias("ISBN"),
        F.col("p_name").alias("Title"), F.col("p_type").alias("Subject"),
        F.col("p_retailprice").cast(MONEY).alias("Price"), F.col("p_brand").alias("PublisherName"),
        F.lit(None).cast("short").alias("PublicationYear"),
        F.concat(F.split_part(F.col("p_name"), F.lit(" "), F.lit(2)), F.lit(" "), F.col("p_brand")).alias("Authors"))
    return second.unionByName(again)


@register("w9_insert_books", """
    select '9' || lpad(cast(p_partkey as varchar), 12, '0') as ISBN, p_name || ' 2nd ed' as Title,
           p_type as Subject,
           cast(cast(p_retailprice as decimal(18,2)) * cast(1.1 as decimal(2,1)) as decimal(18,2)) as Price,
           cast(substr(p_brand, 7) as int) as PublisherID, cast(null as smallint) as PublicationYear
    from part""")
def _w9(t):
    res = U.insert_books(t, _book_requests(t))
    return res["accepted"].select("ISBN", "Title", "Subject", "Price", "PublisherID", "PublicationYear")


@register("w9_insert_books_refused", f"""
    select {_ISBN.format('p_partkey')} as ISBN, 'duplicate_key' as Reason
    from part where p_size > 40""")
def _w9r(t):
    return U.insert_books(t, _book_requests(t))["rejected"].select("ISBN", "Reason")


_NEW_NAMES = """
    select p_partkey as req, 0 as pos, split_part(p_name, ' ', 1) || ' ' || p_brand as AuthorName from part
    union all
    select p_partkey as req, 1 as pos, p_type || ' Writer' as AuthorName from part"""


@register("w11_new_authors", """
    select cast((select max(AuthorID) from bk_Author)
                + row_number() over (order by first_use, AuthorName) as int) as AuthorID,
           AuthorName
    from (select AuthorName, min(req * 10 + pos) as first_use from new_names group by AuthorName) n
    where AuthorName not in (select AuthorName from bk_Author)""", extra_ctes={"new_names": _NEW_NAMES})
def _w11(t):
    return U.insert_books(t, _book_requests(t))["Author"].join(t["Author"], "AuthorID", "left_anti")


@register("w11_new_book_links", """
    select distinct '9' || lpad(cast(req as varchar), 12, '0') as ISBN, AuthorName from new_names""",
          extra_ctes={"new_names": _NEW_NAMES})
def _w11l(t):
    res = U.insert_books(t, _book_requests(t))
    return (res["BookAuthor"].join(t["BookAuthor"], ["ISBN", "AuthorID"], "left_anti")
            .join(res["Author"], "AuthorID").select("ISBN", "AuthorName"))


# ------------------------------------------------------------ W12-W14 ------
def _store_edits(t) -> DataFrame:
    """Every store asks for a manager: even codes one of its own staff,
    odd codes the first employee of the next store (refused, as is store 0,
    whose code is not positive)."""
    s = t["Store"]
    k = F.col("StoreCode").cast("long")
    mgr = F.when(k % 2 == 0, F.lpad((k * 10 + 1).cast("string"), 10, "0")) \
           .otherwise(F.lpad(((k + 1) * 10).cast("string"), 10, "0"))
    return s.select("StoreCode", "CityCode", mgr.alias("ManagerNationalCode"),
                    F.concat(F.lit("026-"), k.cast("string")).alias("Phone"), "Address",
                    k.alias("RequestID"))


@register("w13_edit_stores", f"""
    select StoreCode, CityCode,
           case when StoreCode % 2 = 0 and StoreCode > 0 then lpad(cast(StoreCode * 10 + 1 as varchar), 10, '0')
                else ManagerNationalCode end as ManagerNationalCode,
           case when StoreCode % 2 = 0 and StoreCode > 0 then '026-' || StoreCode else Phone end as Phone,
           Address
    from bk_Store""")
def _w13(t):
    return U.edit_stores(t, _store_edits(t)).table


@register("w14_delete_stores", """
    select s.StoreCode, 'referenced' as Reason from bk_Store s
    where exists (select 1 from bk_Employee e where e.StoreCode = s.StoreCode)
       or exists (select 1 from bk_Inventory i where i.StoreCode = s.StoreCode)
       or exists (select 1 from bk_Sale x where x.StoreCode = s.StoreCode)
       or exists (select 1 from bk_PublisherPurchase pp where pp.StoreCode = s.StoreCode)""")
def _w14(t):
    return U.delete_stores(t, t["Store"].select("StoreCode")).rejected.select("StoreCode", "Reason")


@register("w12_insert_stores", """
    select cast(s_suppkey + (select count(*) from supplier) as int) as StoreCode,
           cast(s_nationkey as int) as CityCode, cast(null as varchar) as ManagerNationalCode,
           '031-' || s_suppkey as Phone, s_name || ' annex' as Address
    from supplier""")
def _w12(t):
    sup = t.raw("supplier")
    n = sup.select(F.count(F.lit(1))).scalar()
    req = sup.select((F.col("s_suppkey").cast("int") + n.cast("int")).alias("StoreCode"),
                     F.col("s_nationkey").cast("int").alias("CityCode"),
                     F.lit("0000000000").alias("ManagerNationalCode"),
                     F.concat(F.lit("031-"), F.col("s_suppkey").cast("string")).alias("Phone"),
                     F.concat(F.col("s_name"), F.lit(" annex")).alias("Address"),
                     F.col("s_suppkey").alias("RequestID"))
    # every request is sent twice: the second copy is refused as a repeat
    req = req.unionByName(req.withColumn("RequestID", F.col("RequestID") + LATER))
    return U.insert_stores(t, req).accepted.select("StoreCode", "CityCode", "ManagerNationalCode",
                                                   "Phone", "Address")


# ------------------------------------------------------------ W4, W6 -------
def _additions(t) -> DataFrame:
    """Form additions: each line item is one addition of one of books 0..19
    to its request's form; Seq is its rank in line-item order."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    src = with_ordinal(t._post_source().select("RequestID", *order), order, "Seq")
    return src.select("RequestID", "Seq",
                      F.col("l_suppkey").cast("int").alias("StoreCode"),
                      F.lpad((F.col("l_partkey") % 20).cast("string"), 13, "0").alias("ISBN"),
                      (F.floor(F.col("l_quantity") / 4) + 1).cast("int").alias("Quantity"))


# One addition after another on each (form, book); a refused one leaves the line.
@register("w4_invoice_lines", """
    select w.RequestID, w.ISBN, cast(sum(w.Quantity) as int) as Quantity, min(w.Seq) as LinePos,
           any_value(b.Title) as Title, any_value(b.Price) as UnitPrice
    from added w join bk_Book b on b.ISBN = w.ISBN where w.Taken group by w.RequestID, w.ISBN""",
          extra_ctes={"addition": """
        select a.RequestID, a.Seq, a.ISBN, a.Quantity, ps.AvailableQuantity as Stock,
               row_number() over (partition by a.RequestID, a.ISBN order by a.Seq) as Nth
        from (select l_orderkey // 100 * 1000000000 + l_suppkey as RequestID, cast(l_suppkey as int) as StoreCode,
                     row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) as Seq,
                     lpad(cast(l_partkey % 20 as varchar), 13, '0') as ISBN,
                     cast(floor(l_quantity / 4) + 1 as int) as Quantity
              from lineitem join orders on l_orderkey = o_orderkey) a
        join bk_PostStock ps on ps.StoreCode = a.StoreCode and ps.ISBN = a.ISBN
        where ps.AvailableQuantity > 0 and a.ISBN in (select ISBN from bk_Book)""",
                      "added": """
        with recursive step as (
            select RequestID, ISBN, Seq, Quantity, Nth, Quantity <= Stock as Taken,
                   case when Quantity <= Stock then Stock - Quantity else Stock end as Room
            from addition where Nth = 1
            union all
            select n.RequestID, n.ISBN, n.Seq, n.Quantity, n.Nth, n.Quantity <= s.Room,
                   case when n.Quantity <= s.Room then s.Room - n.Quantity else s.Room end
            from step s join addition n on n.RequestID = s.RequestID and n.ISBN = s.ISBN and n.Nth = s.Nth + 1)
        select RequestID, ISBN, Seq, Quantity, Taken from step"""})
def _w4(t):
    pt = t.posting_tables()
    return P.build_invoice_lines(pt, _additions(t))["lines"]


def _adjustments(t) -> DataFrame:
    """Stock adjustments from line items on their (supplier, part) stock
    row: returned lines add their quantity, the others remove it, in
    ship-date order."""
    li = t.raw("lineitem")
    d = F.when(F.col("l_returnflag") == "R", F.lit(1)).otherwise(F.lit(-1))
    adj = li.select(
        "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag",
        F.col("l_suppkey").cast("int").alias("StoreCode"),
        F.lpad(F.col("l_partkey").cast("string"), 13, "0").alias("ISBN"),
        F.col("l_quantity").cast("int").alias("Amount"), d.alias("Direction"))
    # arrival order = ship date, then the line's own fields; AdjustID is its rank
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag"]
    return with_ordinal(adj, order, "AdjustID").drop(*order)


# One event after another on each stock row; a refused one leaves the state.
@register("w6_adjust_stock", """
    select AdjustID, false as Accepted,
           case when coalesce(Amount, 0) < 1 then 'invalid_amount' else 'no_stock_row' end as Reason
    from adjustment where coalesce(Amount, 0) < 1 or Stock is null
    union all
    select AdjustID, Taken, case when not Taken then 'insufficient_stock' end from walked""",
          extra_ctes={"adjustment": """
        select a.*, i.AvailableQuantity as Stock
        from (select row_number() over (order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey,
                                                 l_quantity, l_returnflag) as AdjustID,
                     cast(l_suppkey as int) as StoreCode, lpad(cast(l_partkey as varchar), 13, '0') as ISBN,
                     cast(l_quantity as int) as Amount,
                     case when l_returnflag = 'R' then 1 else -1 end as Direction
              from lineitem) a
        left join bk_Inventory i on i.StoreCode = a.StoreCode and i.ISBN = a.ISBN""",
                      "turn": """
        select AdjustID, StoreCode, ISBN, Stock, Amount * Direction as Delta,
               row_number() over (partition by StoreCode, ISBN order by AdjustID) as Nth
        from adjustment where Amount >= 1 and Stock is not null""",
                      "walked": """
        with recursive step as (
            select AdjustID, StoreCode, ISBN, Nth, Stock + Delta >= 0 as Taken,
                   case when Stock + Delta >= 0 then Stock + Delta else Stock end as Left_
            from turn where Nth = 1
            union all
            select n.AdjustID, n.StoreCode, n.ISBN, n.Nth, s.Left_ + n.Delta >= 0,
                   case when s.Left_ + n.Delta >= 0 then s.Left_ + n.Delta else s.Left_ end
            from step s join turn n on n.StoreCode = s.StoreCode and n.ISBN = s.ISBN and n.Nth = s.Nth + 1)
        select AdjustID, Taken from step"""})
def _w6(t):
    return P.adjust_stock(t, _adjustments(t))["decisions"]


# ------------------------------------------------------------ C19 ----------
@register("c19_insert_purchases", """
    select cast((select max(PurchaseID) from bk_PublisherPurchase)
                + row_number() over (order by b.PublisherID, i.StoreCode) as int) as PurchaseID,
           b.PublisherID, i.StoreCode, date '2010-01-01' as PurchaseDate,
           cast(sum((i.MinimumQuantity - i.AvailableQuantity) * b.Price) as decimal(18,2)) as TotalAmount,
           cast(0 as decimal(18,2)) as PaidAmount
    from bk_Inventory i join bk_Book b on b.ISBN = i.ISBN
    where i.AvailableQuantity < i.MinimumQuantity
    group by b.PublisherID, i.StoreCode""")
def _c19(t):
    """A restocking order per (publisher, store) for every row below its
    minimum, not yet paid: ids continue the purchase table."""
    low = (t["Inventory"].filter(F.col("AvailableQuantity") < F.col("MinimumQuantity"))
           .join(t["Book"].select("ISBN", "Price", "PublisherID"), "ISBN"))
    req = (low.groupBy("PublisherID", "StoreCode")
           .agg(F.sum((F.col("MinimumQuantity") - F.col("AvailableQuantity")) * F.col("Price"))
                .cast(MONEY).alias("TotalAmount"))
           .select("PublisherID", "StoreCode", F.lit("2010-01-01").cast("date").alias("PurchaseDate"),
                   "TotalAmount", F.lit(None).cast(MONEY).alias("PaidAmount")))
    return U.insert_purchases(t, req, order_by=("PublisherID", "StoreCode")).accepted


# ------------------------------------------------------------ C1-C3 --------
def _staged_sale_lines(t) -> DataFrame:
    """Sale request lines as typed into the form: text fields, dates without
    zero padding (``2009-1-5``), and quantities as entered (one less than the
    posted quantity, so single copies arrive as ``0``)."""
    h = t.post_headers()
    ln = t.post_lines()
    d = F.col("InvoiceDate")
    return (ln.join(h, "RequestID").select(
        "RequestID", "ISBN",
        F.col("StoreCode").cast("string").alias("StoreCode"),
        F.col("CustomerCode").cast("string").alias("CustomerCode"),
        "EmployeeNationalCode",
        F.concat_ws("-", F.year(d).cast("string"), F.month(d).cast("string"),
                    F.dayofmonth(d).cast("string")).alias("InvoiceDate"),
        (F.col("Quantity") - 1).cast("string").alias("Quantity")))


@register("c1_c3_sale_line_checks", """
    select Rule, count(*) as Violations from (
        select case when try_cast(Quantity as int) > 0 then null else 'quantity_positive_int' end as Rule
        from staged
        union all
        select case when try_strptime(InvoiceDate, '%Y-%m-%d') is null then 'date_format' end from staged
    ) r where Rule is not null group by Rule""",
          extra_ctes={"post_head": """
        select l_orderkey // 100 * 1000000000 + l_suppkey as RequestID,
               cast(min(o_orderdate) as date) as InvoiceDate
        from lineitem join orders on l_orderkey = o_orderkey
        group by 1""",
                      "staged": """
        select l.RequestID, l.ISBN, cast(l.Quantity - 1 as varchar) as Quantity,
               cast(year(h.InvoiceDate) as varchar) || '-' || cast(month(h.InvoiceDate) as varchar) || '-'
               || cast(day(h.InvoiceDate) as varchar) as InvoiceDate
        from bk_PostLine l join post_head h on h.RequestID = l.RequestID"""})
def _c1(t):
    from inkwell.operators import quality as Q
    tagged = Q.validate_sale_lines(_staged_sale_lines(t))
    return (tagged.select(F.explode("Violations").alias("Rule"))
            .groupBy("Rule").agg(F.count(F.lit(1)).alias("Violations")))
