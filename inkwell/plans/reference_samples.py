"""The reference's own sample queries: the eleven stand-alone reports of its
SQL script, with the script's semantics (R3 grouped by store, R6 by author
or subject, R8 without the customer code column) and its sample parameters.

On the test data most return no rows (the sample names and codes do not
occur); R2 lists every store and R9 every book.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from inkwell.operators import reports as R
from inkwell.plans.registry import (R05_SQL, R06C_SQL, R08_SQL, R09_CTES, R09_SQL, r06c_ctes, register,
                                     sold_lines)

# The sample parameters of the reference's SQL script, in report order.
REF_CITY = "اصفهان"
REF_AUTHOR = "پیشرو"
REF_STORE, REF_START, REF_END = 4545, dt.date(2009, 1, 1), dt.date(2011, 1, 1)
REF_EMPLOYEE_STORE = 2545
REF_EMPLOYEE = "0047853651"
REF_TEXT = "ثروت"
REF_DEBT = Decimal(10000)
REF_CUSTOMER = 123456
REF_UNSOLD_START, REF_UNSOLD_END = dt.date(2009, 10, 1), dt.date(2010, 1, 10)
REF_ISBN = "7845-45"
REF_PUBLISHER = "آیالر"

_SOLD_IN_STORE = sold_lines(f"StoreCode = {REF_STORE} and InvoiceDate between date '{REF_START}' and date '{REF_END}'")


@register("ref_r01_stores_in_city", f"""
    select StoreCode, CityName, ProvinceName, Phone, Address
    from bk_Store join (select * from bk_City where CityName = '{REF_CITY}') using (CityCode)""")
def _q1(t):
    return R.stores_in_city(t, REF_CITY)


@register("ref_r02_stores_without_author", """
    select StoreCode, CityName, Phone, Address
    from (select StoreCode from bk_Store except select StoreCode from holding)
    join bk_Store using (StoreCode) join bk_City using (CityCode)""", extra_ctes={"holding": f"""
        select StoreCode from bk_Inventory where AvailableQuantity > 0 and ISBN in (
            select ISBN from bk_BookAuthor where AuthorID in (
                select AuthorID from bk_Author where AuthorName = '{REF_AUTHOR}'))"""})
def _q2(t):
    return R.stores_without_author(t, REF_AUTHOR)


@register("ref_r03_store_sales", """
    select StoreCode, count(distinct InvoiceNumber) as InvoiceCount, cast(sum(Quantity) as bigint) as SoldQuantity,
           sum(LineTotal) as TotalSales
    from sold group by StoreCode""", extra_ctes=_SOLD_IN_STORE)
def _q3(t):
    return R.store_sales(t, REF_STORE, REF_START, REF_END, mode="script")


@register("ref_r04_employees_of_store", f"""
    select NationalCode, FullName, Phone, Address, Gender, StoreCode
    from bk_Employee where StoreCode = {REF_EMPLOYEE_STORE}""")
def _q4(t):
    return R.employees_of_store(t, REF_EMPLOYEE_STORE)


@register("ref_r05_employee_sales", R05_SQL, extra_ctes=sold_lines(f"EmployeeNationalCode = '{REF_EMPLOYEE}'"))
def _q5(t):
    return R.employee_sales(t, REF_EMPLOYEE)


@register("ref_r06_books_by_author_or_subject", R06C_SQL, extra_ctes=r06c_ctes(REF_TEXT))
def _q6(t):
    return R.books_by_author_or_subject(t, REF_TEXT)


@register("ref_r07_debtors_above", f"""
    select CustomerCode, FullName, Phone, Address, DebtAmount from bk_Customer where DebtAmount > {REF_DEBT}""")
def _q7(t):
    return R.debtors_above(t, REF_DEBT)


@register("ref_r08_customer_purchases", R08_SQL.format(code=""), extra_ctes=sold_lines(f"CustomerCode = {REF_CUSTOMER}"))
def _q8(t):
    return R.customer_purchases(t, REF_CUSTOMER, with_code=False)


@register("ref_r09_unsold_books", R09_SQL, extra_ctes={
    **sold_lines(f"InvoiceDate between date '{REF_UNSOLD_START}' and date '{REF_UNSOLD_END}'"), **R09_CTES})
def _q9(t):
    return R.unsold_books(t, REF_UNSOLD_START, REF_UNSOLD_END)


@register("ref_r10_stores_short_of_book", """
    select StoreCode, CityName, Address, Title, AvailableQuantity, MinimumQuantity, Shortage
    from short join bk_Book using (ISBN) join bk_Store using (StoreCode) join bk_City using (CityCode)""",
          extra_ctes={"short": f"""
        select *, MinimumQuantity - AvailableQuantity as Shortage from bk_Inventory
        where ISBN = '{REF_ISBN}' and MinimumQuantity > AvailableQuantity"""})
def _q10(t):
    return R.stores_short_of_book(t, REF_ISBN)


@register("ref_r11_publisher_debt", f"""
    select PublisherName, cast(sum(TotalAmount) as decimal(38,2)) as TotalPurchase,
           cast(sum(PaidAmount) as decimal(38,2)) as TotalPaid,
           cast(sum(TotalAmount) - sum(PaidAmount) as decimal(38,2)) as Debt
    from bk_PublisherPurchase join (select * from bk_Publisher where PublisherName = '{REF_PUBLISHER}') using (PublisherID)
    group by PublisherName""")
def _q11(t):
    return R.publisher_debt(t, REF_PUBLISHER)
