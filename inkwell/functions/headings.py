"""Localised column headings of the reports.

Reports return English column names; ``localise(df, report)`` renames them to
the headings the reference shows. ``\\u200c`` is the zero-width non-joiner
used inside two Persian words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

# The reference's report headings, report by report, in column order.
REPORT_HEADINGS: dict[str, dict[str, str]] = {
    "r01_stores_in_city": {
        "StoreCode": "کد فروشگاه", "CityName": "شهر", "ProvinceName": "استان",
        "Phone": "تلفن", "Address": "آدرس"},
    "r02_stores_without_author": {
        "StoreCode": "کد فروشگاه", "CityName": "شهر", "Phone": "تلفن", "Address": "آدرس"},
    "r03_store_sales": {
        "StoreCode": "کد فروشگاه", "InvoiceCount": "تعداد فاکتور",
        "SoldQuantity": "تعداد کتاب فروخته‌شده", "TotalSales": "مبلغ کل فروش"},
    "r04_employees_of_store": {
        "NationalCode": "کد ملی", "FullName": "نام کارمند", "Phone": "تلفن", "Address": "آدرس",
        "Gender": "جنسیت", "StoreCode": "کد فروشگاه"},
    "r05_employee_sales": {
        "InvoiceNumber": "شماره فاکتور", "InvoiceDate": "تاریخ", "EmployeeName": "نام کارمند",
        "CustomerName": "نام مشتری", "StoreCode": "فروشگاه", "Title": "عنوان کتاب", "Quantity": "تعداد",
        "UnitPrice": "قیمت واحد", "LineTotal": "مبلغ ردیف"},
    "r06a_books_by_author": {
        "ISBN": "شابک", "Title": "عنوان کتاب", "Subject": "موضوع", "AuthorName": "نویسنده",
        "PublisherName": "ناشر", "Price": "قیمت"},
    "r06b_books_by_subject": {
        "ISBN": "شابک", "Title": "عنوان کتاب", "Subject": "موضوع", "PublisherName": "ناشر", "Price": "قیمت"},
    "r07_debtors_above": {
        "CustomerCode": "کد مشتری", "FullName": "نام مشتری", "Phone": "تلفن", "Address": "آدرس",
        "DebtAmount": "مبلغ بدهی"},
    "r08_customer_purchases": {
        "CustomerCode": "کد مشتری", "FullName": "نام مشتری", "InvoiceNumber": "شماره فاکتور",
        "InvoiceDate": "تاریخ خرید", "StoreCode": "کد فروشگاه", "Address": "آدرس فروشگاه", "ISBN": "شابک",
        "Title": "عنوان کتاب", "Quantity": "تعداد", "UnitPrice": "قیمت واحد", "LineTotal": "مبلغ ردیف"},
    "r09_unsold_books": {
        "ISBN": "شابک", "Title": "عنوان کتاب", "Subject": "موضوع", "PublisherName": "ناشر", "Price": "قیمت"},
    "r10_stores_short_of_book": {
        "StoreCode": "کد فروشگاه", "CityName": "شهر", "Address": "آدرس فروشگاه", "Title": "عنوان کتاب",
        "AvailableQuantity": "موجودی فعلی", "MinimumQuantity": "حداقل موجودی", "Shortage": "مقدار کسری"},
    "r11_publisher_debt": {
        "PublisherName": "نام ناشر", "TotalPurchase": "جمع خرید", "TotalPaid": "جمع پرداخت‌شده",
        "Debt": "مبلغ بدهی"},
}


def localise(df: DataFrame, report: str) -> DataFrame:
    """Rename the columns of a report result to the reference's headings."""
    heads = {c: h for c, h in REPORT_HEADINGS[report].items() if c in df.columns}
    return df.withColumnsRenamed(heads)
