"""Registered list views, dimension lists, table loads, quality checks and
posting steps."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from inkwell.operators import lists as L
from inkwell.operators import quality as Q
from inkwell.operators import views as V
from inkwell.plans.registry import STORE, register
from inkwell.schemas import CHECKS, FOREIGN_KEYS, PRIMARY_KEYS, SCHEMAS, TABLES, not_null_columns
from inkwell.sources.tables import table_counts

# ----------------------------------------------------------- table loads -----
# Each derived table as a query, so the adapter (including the numbered
# keys AuthorID, LineNumber, PurchaseID) is checked against the oracle.
for _tb in TABLES:
    _cols = ", ".join(f.name for f in SCHEMAS[_tb].fields)

    def _make(tb):
        return lambda t: t[tb]

    register(f"s1_table_{_tb.lower()}", f"select {_cols} from bk_{_tb}")(_make(_tb))

_COUNTS_SQL = " union all ".join(
    f"select '{tb}' as TableName, count(*) as RowCount from bk_{tb}" for tb in TABLES)


@register("s3_table_counts", _COUNTS_SQL)
def _s3(t):
    return table_counts(t)


# ----------------------------------------------------------------- views -----
@register("v1_book_catalogue", """
    select b.ISBN, b.Title, b.Subject, au.Authors, p.PublisherName, b.Price, b.PublicationYear
    from bk_Book b
    join bk_Publisher p on p.PublisherID = b.PublisherID
    left join (select ba.ISBN, string_agg(a.AuthorName, '، ' order by a.AuthorName) as Authors
               from bk_BookAuthor ba join bk_Author a on a.AuthorID = ba.AuthorID
               group by ba.ISBN) au on au.ISBN = b.ISBN""")
def _v1(t):
    return V.book_catalogue(t)


@register("v2_store_list", """
    select s.StoreCode, c.CityName, c.ProvinceName, s.Phone, s.Address, s.ManagerNationalCode,
           e.FullName as ManagerName
    from bk_Store s
    join bk_City c on c.CityCode = s.CityCode
    left join bk_Employee e on e.NationalCode = s.ManagerNationalCode and e.StoreCode = s.StoreCode""")
def _v2(t):
    return V.store_list(t)


@register("v2_store_list_display", """
    select s.StoreCode, c.CityName, c.ProvinceName, s.Phone, s.Address,
           coalesce(s.ManagerNationalCode, '') as ManagerNationalCode,
           case when coalesce(e.FullName, '') = '' then 'تعیین نشده' else e.FullName end as ManagerName
    from bk_Store s
    join bk_City c on c.CityCode = s.CityCode
    left join bk_Employee e on e.NationalCode = s.ManagerNationalCode and e.StoreCode = s.StoreCode""")
def _v2d(t):
    return V.store_list(t, display=True)


_V3 = """
    select i.StoreCode, c.CityName, i.ISBN, b.Title, i.AvailableQuantity, i.MinimumQuantity,
           case when i.AvailableQuantity < i.MinimumQuantity then 'بحرانی'
                when i.AvailableQuantity = i.MinimumQuantity then 'مرزی'
                else 'عادی' end as Status,
           coalesce(i.Description, '') as Description
    from bk_Inventory i
    join bk_Store s on s.StoreCode = i.StoreCode
    join bk_City c on c.CityCode = s.CityCode
    join bk_Book b on b.ISBN = i.ISBN
    where 1 = 1 {filters}"""


@register("v3_inventory_list", _V3.format(filters=""))
def _v3(t):
    return V.inventory_list(t)


@register("v3_inventory_list_filtered", _V3.format(
    filters="and cast(i.StoreCode as varchar) like '%4%' and (b.Title like '%7%' or i.ISBN like '%7%')"))
def _v3f(t):
    return V.inventory_list(t, store_text="4", book_text="7")


@register("v3_inventory_status_counts", """
    select case when AvailableQuantity < MinimumQuantity then 'بحرانی'
                when AvailableQuantity = MinimumQuantity then 'مرزی'
                else 'عادی' end as Status,
           count(*) as Items
    from bk_Inventory i
    join bk_Store s on s.StoreCode = i.StoreCode
    join bk_City c on c.CityCode = s.CityCode
    join bk_Book b on b.ISBN = i.ISBN
    group by 1""")
def _v3c(t):
    from pyspark.sql import functions as F
    return V.inventory_list(t).groupBy("Status").agg(F.count(F.lit(1)).alias("Items"))


_V4 = """
    select i.StoreCode, c.CityName, b.Title, i.ISBN, i.AvailableQuantity, i.MinimumQuantity,
           i.MinimumQuantity - i.AvailableQuantity as Shortage, coalesce(i.Description, '') as Description
    from bk_Inventory i
    join bk_Store s on s.StoreCode = i.StoreCode
    join bk_City c on c.CityCode = s.CityCode
    join bk_Book b on b.ISBN = i.ISBN
    where i.AvailableQuantity < i.MinimumQuantity {filters}"""


@register("v4_low_stock", _V4.format(filters=""))
def _v4(t):
    return V.low_stock(t)


@register("v4_low_stock_store", _V4.format(filters=f"and i.StoreCode = {STORE}"))
def _v4s(t):
    return V.low_stock(t, STORE)


@register("v5_debtor_list", """
    select CustomerCode, FullName, Phone, Address, DebtAmount from bk_Customer where DebtAmount > 0""")
def _v5(t):
    return V.debtor_list(t)


@register("v6_debtor_summary", """
    select count(*) as DebtorCount, cast(coalesce(sum(DebtAmount), 0) as decimal(38,2)) as TotalDebt
    from bk_Customer where DebtAmount > 5000""")
def _v6(t):
    return V.debtor_summary(t, Decimal(5000))


@register("v7_price_list", "select ISBN, Title, Subject, Price from bk_Book")
def _v7(t):
    return V.price_list(t)


# ----------------------------------------------------------------- lists -----
@register("l1_city_names", "select distinct CityName from bk_City")
def _l1(t):
    return L.city_names(t)


for _name, (_tb, _cols, _order) in L.DIMENSIONS.items():
    def _mk(name):
        return lambda t: L.named_list(t, name)

    register(f"l2_{_name}", f"select {', '.join(_cols)} from bk_{_tb}")(_mk(_name))


@register("l3_stores_with_city", """
    select s.StoreCode, c.CityName, s.Address from bk_Store s join bk_City c on c.CityCode = s.CityCode""")
def _l3(t):
    return L.stores_with_city(t)


@register("l4_employees", "select NationalCode, FullName, StoreCode from bk_Employee")
def _l4(t):
    return L.employees(t)


@register("l4_employees_of_store", f"""
    select NationalCode, FullName, StoreCode from bk_Employee where StoreCode = {STORE}""")
def _l4s(t):
    return L.employees(t, STORE)


@register("l5_sellable_books", f"""
    select i.ISBN, b.Title, b.Price, i.AvailableQuantity
    from bk_Inventory i join bk_Book b on b.ISBN = i.ISBN
    where i.StoreCode = {STORE} and i.AvailableQuantity > 0""")
def _l5(t):
    return L.sellable_books(t, STORE)


# --------------------------------------------------------------- quality -----
def _pk_sql(tb: str) -> str:
    pk = ", ".join(PRIMARY_KEYS[tb])
    return f"select count(*) from (select {pk} from bk_{tb} group by {pk} having count(*) > 1) d"


def _nn_sql(tb: str) -> str:
    cond = " or ".join(f"{c} is null" for c in not_null_columns(tb)) or "false"
    return f"select count(*) from bk_{tb} where {cond}"


def _fk_sql(fk) -> str:
    on = " and ".join(f"p.{pc} = c.{cc}" for pc, cc in zip(fk.parent_cols, fk.child_cols))
    nn = " and ".join(f"c.{cc} is not null" for cc in fk.child_cols)
    return (f"select count(*) from bk_{fk.child} c where {nn} "
            f"and not exists (select 1 from bk_{fk.parent} p where {on})")


def _summary_sql() -> str:
    rows: list[tuple[str, str, str]] = []
    for tb in TABLES:
        rows.append((f"pk_{tb}", tb, _pk_sql(tb)))
        rows.append((f"not_null_{tb}", tb, _nn_sql(tb)))
    for fk in FOREIGN_KEYS:
        rows.append((f"fk_{fk.name}", fk.child, _fk_sql(fk)))
    for ck in CHECKS:
        rows.append((f"check_{ck.name}", ck.table,
                     f"select count(*) from bk_{ck.table} where not coalesce({ck.condition}, true)"))
    rows += [
        ("sale_has_items", "Sale", "select count(*) from bk_Sale s where not exists "
                                   "(select 1 from bk_SaleItem si where si.InvoiceNumber = s.InvoiceNumber)"),
        ("manager_in_store", "Store", "select count(*) from bk_Store s where s.ManagerNationalCode is not null "
                                      "and not exists (select 1 from bk_Employee e where e.NationalCode = "
                                      "s.ManagerNationalCode and e.StoreCode = s.StoreCode)"),
        ("manager_of_one_store", "Store", "select count(*) from (select ManagerNationalCode from bk_Store "
                                          "where ManagerNationalCode is not null group by ManagerNationalCode "
                                          "having count(*) > 1) m"),
        ("seller_in_store", "Sale", "select count(*) from bk_Sale s where not exists (select 1 from "
                                    "bk_Employee e where e.NationalCode = s.EmployeeNationalCode "
                                    "and e.StoreCode = s.StoreCode)"),
    ]
    return " union all ".join(
        f"select '{r}' as Rule, '{tb}' as TableName, ({q}) as Violations" for r, tb, q in rows)


@register("c_quality_summary", _summary_sql())
def _cq(t):
    return Q.quality_summary(t)


@register("c16_managers_outside_store", """
    select s.StoreCode, s.CityCode, s.ManagerNationalCode, s.Phone, s.Address
    from bk_Store s where s.ManagerNationalCode is not null and not exists (
        select 1 from bk_Employee e
        where e.NationalCode = s.ManagerNationalCode and e.StoreCode = s.StoreCode)""")
def _c16(t):
    return Q.managers_outside_store(t).select("StoreCode", "CityCode", "ManagerNationalCode", "Phone", "Address")


@register("c9_c10_purchase_checks", """
    select PurchaseID, TotalAmount, PaidAmount,
           TotalAmount > 0 as TotalPositive,
           PaidAmount >= 0 and PaidAmount <= TotalAmount as PaidInRange
    from bk_PublisherPurchase
    where not coalesce(TotalAmount > 0, true)
       or not coalesce(PaidAmount >= 0 and PaidAmount <= TotalAmount, true)""")
def _c9(t):
    from pyspark.sql import functions as F
    fails = None
    for ck in CHECKS:
        df = Q.check_failures(t, ck)
        fails = df if fails is None else fails.unionByName(df)
    return (fails.distinct().select(
        "PurchaseID", "TotalAmount", "PaidAmount",
        (F.col("TotalAmount") > 0).alias("TotalPositive"),
        ((F.col("PaidAmount") >= 0) & (F.col("PaidAmount") <= F.col("TotalAmount"))).alias("PaidInRange")))


# --------------------------------------------------------------- posting -----
def _posting(t):
    from inkwell.operators import posting as P
    return P, t.posting_tables(), t.post_headers(), t.post_lines()


_POST_LIVE = """
    select l.RequestID, cast(l.RequestID % 1000000000 as int) as StoreCode, l.ISBN, l.Quantity,
           ps.AvailableQuantity as Available
    from bk_PostLine l
    left join bk_PostStock ps on ps.StoreCode = cast(l.RequestID % 1000000000 as int) and ps.ISBN = l.ISBN"""


@register("w1_certain_rejects", """
    select RequestID,
           min(case when Available is null then 'no_stock_row'
                    when Quantity > Available then 'insufficient_stock' end) as Reason
    from post_live
    group by RequestID
    having count(case when Available is null or Quantity > Available then 1 end) > 0""",
          extra_ctes={"post_live": _POST_LIVE})
def _w1_rejects(t):
    P, pt, h, ln = _posting(t)
    return P.classify_requests(pt, h, ln)["rejected"]


_POST_CONTESTED = """
    select StoreCode, ISBN, cast(sum(Quantity) as bigint) as Demand, min(Available) as Available
    from post_live
    where RequestID not in (select RequestID from post_live
                            where Available is null or Quantity > Available)
    group by StoreCode, ISBN
    having sum(Quantity) > min(Available)"""


@register("w1_contested_pairs", "select * from post_contested",
          extra_ctes={"post_live": _POST_LIVE, "post_contested": _POST_CONTESTED})
def _w1_contested(t):
    P, pt, h, ln = _posting(t)
    return P.classify_requests(pt, h, ln)["contested_pairs"].select(
        "StoreCode", "ISBN", F.col("Demand").cast("bigint").alias("Demand"), "Available")


@register("w1_certain_accepts", """
    select distinct l.RequestID from post_live l
    where l.RequestID not in (select RequestID from post_live
                              where Available is null or Quantity > Available)
      and l.RequestID not in (select p.RequestID from post_live p
                              join post_contested c on c.StoreCode = p.StoreCode and c.ISBN = p.ISBN)""",
          extra_ctes={"post_live": _POST_LIVE, "post_contested": _POST_CONTESTED})
def _w1_accepts(t):
    P, pt, h, ln = _posting(t)
    return P.classify_requests(pt, h, ln)["certain_accepts"]


# One request after another in each store: its stock as a list by book number.
_POST_REPLAY = {"post_live": _POST_LIVE, "hopeless": """
        select RequestID,
               min(case when Available is null then 'no_stock_row'
                        when Quantity > Available then 'insufficient_stock' end) as Reason
        from post_live group by RequestID
        having count(case when Available is null or Quantity > Available then 1 end) > 0""",
                      "wanted": """
        select r.RequestID, r.StoreCode, list(coalesce(l.Quantity, 0) order by b.Book) as Need,
               r.Nth, bool_or(h.RequestID is not null) as Hopeless
        from (select RequestID, StoreCode,
                     row_number() over (partition by StoreCode order by RequestID) as Nth
              from (select distinct RequestID, StoreCode from post_live) d) r
        join (select unnest(range(0, 19)) as Book) b on true
        left join post_live l on l.RequestID = r.RequestID and cast(l.ISBN as bigint) = b.Book
        left join hopeless h on h.RequestID = r.RequestID
        group by r.RequestID, r.StoreCode, r.Nth""",
                      "replayed": """
        with recursive step as (
            select StoreCode, cast(0 as bigint) as Nth, cast(null as bigint) as RequestID, false as Taken,
                   list(AvailableQuantity order by ISBN) as Stock
            from bk_PostStock group by StoreCode
            union all
            select StoreCode, Nth, RequestID, Taken, case when Taken then Rest else Stock end
            from (select w.StoreCode, w.Nth, cast(w.RequestID as bigint) as RequestID, s.Stock,
                         list_transform(s.Stock, lambda x, i: cast(x - w.Need[i] as int)) as Rest,
                         not w.Hopeless
                         and list_min(list_transform(s.Stock, lambda x, i: x - w.Need[i])) >= 0 as Taken
                  from step s join wanted w on w.StoreCode = s.StoreCode and w.Nth = s.Nth + 1) n)
        select RequestID, Taken from step where RequestID is not null"""}

_POST_TAKEN = """
    select RequestID, (select coalesce(max(InvoiceNumber), 0) from bk_Sale)
           + row_number() over (order by RequestID) as InvoiceNumber
    from replayed where Taken"""


@register("w1_post_sales_outcome", """
    select t.RequestID,
           case when t.Taken then null else coalesce(f.Reason, 'insufficient_stock') end as Reason,
           case when t.Taken then (select max(InvoiceNumber) from bk_Sale)
                + row_number() over (partition by t.Taken order by t.RequestID) end as InvoiceNumber
    from replayed t left join hopeless f on f.RequestID = t.RequestID""",
          extra_ctes=_POST_REPLAY)
def _w1_outcome(t):
    P, pt, h, ln = _posting(t)
    res = P.post_sales(pt, h, ln)
    return (res.accepted.select("RequestID", F.lit(None).cast("string").alias("Reason"), "InvoiceNumber")
            .unionByName(res.rejected.select("RequestID", "Reason",
                                             F.lit(None).cast("long").alias("InvoiceNumber"))))


@register("w1_new_invoice_lines", """
    select t.InvoiceNumber, cast(row_number() over (partition by t.InvoiceNumber order by l.LinePos) as int) as LineNumber,
           l.ISBN, l.Quantity, b.Price as UnitPrice
    from taken t join bk_PostLine l on l.RequestID = t.RequestID join bk_Book b on b.ISBN = l.ISBN""",
          extra_ctes={**_POST_REPLAY, "taken": _POST_TAKEN})
def _w1_items(t):
    P, pt, h, ln = _posting(t)
    return P.post_sales(pt, h, ln).items


@register("w1_stock_after", """
    select ps.StoreCode, ps.ISBN,
           cast(ps.AvailableQuantity - coalesce(sum(l.Quantity), 0) as int) as AvailableQuantity,
           0 as MinimumQuantity, cast(null as varchar) as Description
    from bk_PostStock ps
    left join (select p.* from post_live p join taken t on t.RequestID = p.RequestID) l
           on l.StoreCode = ps.StoreCode and l.ISBN = ps.ISBN
    group by ps.StoreCode, ps.ISBN, ps.AvailableQuantity""",
          extra_ctes={**_POST_REPLAY, "taken": _POST_TAKEN})
def _w1_stock(t):
    P, pt, h, ln = _posting(t)
    return P.post_sales(pt, h, ln).inventory


@register("w5_invoice_totals", """
    select l.RequestID, cast(sum(l.Quantity * b.Price) as decimal(38,2)) as InvoiceTotal,
           count(*) as Lines
    from bk_PostLine l join bk_Book b on b.ISBN = l.ISBN
    group by l.RequestID""")
def _w5(t):
    from inkwell.operators import posting as P
    lines = t.post_lines()
    # the books asked for, which may be few with many lines each: where they
    # are, they go to the lines, and no task gets all lines of a book
    book = t["Book"].select("ISBN", F.col("Price").alias("UnitPrice"))
    asked = book.join(lines.select("ISBN").distinct(), "ISBN", "left_semi")
    return P.invoice_totals(lines.join(asked, "ISBN"))


from inkwell.plans import catalog_writes  # noqa: E402,F401  (registers W4, W6-W14)
from inkwell.plans import catalog_rules  # noqa: E402,F401  (registers the write gate and the rules)
from inkwell.plans import reference_samples  # noqa: E402,F401  (registers the reference's sample queries)
