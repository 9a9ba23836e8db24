"""Reference SQL for the correctness gate.

Each registered query has an independent SQL statement (DuckDB dialect) over
the driver's tables. The bookstore tables are rebuilt as common table
expressions named ``bk_*`` (the driver's views are case-insensitive, so
``Customer`` would collide with ``customer``). Only the CTEs a statement
needs, with their dependencies, are prepended.
"""

from __future__ import annotations

import re

_ISBN = "lpad(cast({} as varchar), 13, '0')"
_NAT = "lpad(cast({} as varchar), 10, '0')"
_NST = "(select count(*) from supplier)"

FIXTURE_CTES: dict[str, str] = {
    "bk_City": """
        select cast(n_nationkey as int) as CityCode, n_name as CityName, r_name as ProvinceName
        from nation join region on n_regionkey = r_regionkey""",
    "bk_Store": f"""
        select cast(s_suppkey as int) as StoreCode, cast(s_nationkey as int) as CityCode,
               case s_suppkey % 4 when 0 then null
                    when 1 then {_NAT.format('(s_suppkey + 1) * 10')}
                    else {_NAT.format('s_suppkey * 10')} end as ManagerNationalCode,
               concat('021-', s_suppkey) as Phone, s_name as Address
        from supplier""",
    "bk_Employee": f"""
        select {_NAT.format('s_suppkey * 10 + k')} as NationalCode,
               concat('Employee ', s_suppkey, '-', k) as FullName,
               case when k = 2 then null else concat('0912-', s_suppkey) end as Phone,
               s_name as Address,
               case when k % 2 = 0 then 'F' else 'M' end as Gender,
               cast(s_suppkey as int) as StoreCode
        from (select s_suppkey, s_name, unnest([0, 1, 2]) as k from supplier) sk""",
    "bk_Customer": """
        select cast(c_custkey as int) as CustomerCode, c_name as FullName,
               case when c_custkey % 7 = 0 then null else concat('0935-', c_custkey) end as Phone,
               c_mktsegment as Address, cast(c_acctbal as decimal(18,2)) as DebtAmount
        from customer""",
    "bk_Publisher": """
        select distinct cast(substr(p_brand, 7) as int) as PublisherID, p_brand as PublisherName
        from part""",
    "bk_Book": f"""
        select {_ISBN.format('p_partkey')} as ISBN, concat(p_name, ' ', p_partkey) as Title,
               p_type as Subject, cast(p_retailprice as decimal(18,2)) as Price,
               cast(substr(p_brand, 7) as int) as PublisherID,
               case when p_size % 10 = 0 then null else cast(1350 + p_size as smallint) end as PublicationYear
        from part""",
    "bk_bw": f"""
        select {_ISBN.format('p_partkey')} as ISBN,
               concat(split_part(p_name, ' ', 1), ' ', p_brand) as AuthorName
        from part where p_partkey % 50 <> 0
        union
        select {_ISBN.format('p_partkey')} as ISBN,
               concat(split_part(p_name, ' ', 2), ' ', p_brand) as AuthorName
        from part where p_partkey % 50 <> 0""",
    "bk_Author": """
        select cast(row_number() over (order by AuthorName) as int) as AuthorID, AuthorName
        from (select distinct AuthorName from bk_bw) n""",
    "bk_BookAuthor": """
        select w.ISBN, a.AuthorID from bk_bw w join bk_Author a on a.AuthorName = w.AuthorName""",
    "bk_Inventory": f"""
        select cast(l_suppkey as int) as StoreCode, {_ISBN.format('l_partkey')} as ISBN,
               cast((l_suppkey * 7 + l_partkey * 13) % 40 as int) as AvailableQuantity,
               cast((l_suppkey * 3 + l_partkey * 5) % 15 as int) as MinimumQuantity,
               case when (l_suppkey + l_partkey) % 3 = 0 then null
                    else concat('shelf ', l_partkey % 20) end as Description
        from (select distinct l_suppkey, l_partkey from lineitem) sp""",
    "bk_Sale": f"""
        select o_orderkey as InvoiceNumber, cast(o_orderdate as date) as InvoiceDate,
               cast(o_custkey as int) as CustomerCode,
               cast(o_orderkey % {_NST} as int) as StoreCode,
               {_NAT.format(f'(o_orderkey % {_NST}) * 10 + o_orderkey % 3')} as EmployeeNationalCode
        from orders""",
    "bk_SaleItem": f"""
        select l_orderkey as InvoiceNumber,
               cast(row_number() over (partition by l_orderkey
                    order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as int) as LineNumber,
               {_ISBN.format('l_partkey')} as ISBN, cast(l_quantity as int) as Quantity,
               cast(l_extendedprice as decimal(18,2)) as UnitPrice
        from lineitem""",
    "bk_PublisherPurchase": """
        select cast(row_number() over (order by p_brand, l_suppkey) as int) as PurchaseID,
               cast(substr(p_brand, 7) as int) as PublisherID, cast(l_suppkey as int) as StoreCode,
               cast(min(l_shipdate) as date) as PurchaseDate,
               cast(sum(cast(l_extendedprice as decimal(18,2))) as decimal(18,2)) as TotalAmount,
               cast(sum(case when l_returnflag <> 'R' then cast(l_extendedprice as decimal(18,2))
                             else 0 end) as decimal(18,2)) as PaidAmount
        from lineitem join part on l_partkey = p_partkey
        group by p_brand, l_suppkey""",
    "bk_PostStock": f"""
        select cast(s_suppkey as int) as StoreCode, {_ISBN.format('p')} as ISBN,
               cast(10 + (s_suppkey * 7 + p * 13) % 40 as int) as AvailableQuantity
        from (select s_suppkey, unnest(range(0, 19)) as p from supplier) sp""",
    "bk_PostLine": f"""
        select RequestID, {_ISBN.format('b')} as ISBN,
               cast(floor(sum(l_quantity) / 10) + 1 as int) as Quantity,
               cast(b + 1 as int) as LinePos
        from (select l_orderkey // 100 * 1000000000 + l_suppkey as RequestID,
                     l_partkey % 20 as b, l_quantity
              from lineitem join orders on l_orderkey = o_orderkey) src
        group by RequestID, b""",
}

_ORDER = list(FIXTURE_CTES)
_REF = re.compile(r"\bbk_\w+\b")


def _needed(sql: str) -> list[str]:
    seen: set[str] = set()
    stack = [m for m in _REF.findall(sql) if m in FIXTURE_CTES]
    while stack:
        name = stack.pop()
        if name in seen:
            continue
        seen.add(name)
        stack.extend(m for m in _REF.findall(FIXTURE_CTES[name]) if m in FIXTURE_CTES)
    return [n for n in _ORDER if n in seen]


def with_fixture(sql: str, extra_ctes: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with the fixture CTEs it references (and ``extra_ctes``,
    which may themselves reference fixture tables)."""
    extra = extra_ctes or {}
    probe = sql + " ".join(extra.values())
    names = _needed(probe)
    parts = [f"{n} as ({FIXTURE_CTES[n]})" for n in names]
    parts += [f"{n} as ({body})" for n, body in extra.items()]
    if not parts:
        return sql
    return "with " + ",\n".join(parts) + "\n" + sql
