"""Reports and views on hand-made tables: the edge rows of the survey."""

import datetime as dt
from decimal import Decimal

import pytest

from inkwell.operators import reports as R
from inkwell.operators import views as V
from inkwell.operators import quality as Q
from inkwell.schemas import SCHEMAS


def _tables(spark, **rows):
    return {name: spark.createDataFrame(rows.get(name, []), SCHEMAS[name]) for name in SCHEMAS}


@pytest.fixture(scope="module")
def shop(spark):
    d = dt.date
    return _tables(
        spark,
        City=[(1, "Isfahan", "Isfahan"), (2, "Tehran", "Tehran")],
        Store=[(10, 1, "E1", "1", "a"), (20, 1, "E9", "2", "b"), (30, 2, None, "3", "c")],
        Employee=[("E1", "Ali", None, "x", "M", 10), ("E9", "Sara", "9", "y", "F", 30),
                  ("E3", "Reza", "3", "z", "M", 20)],
        Customer=[(1, "C1", None, None, Decimal("100.00")), (2, "C2", "p", "a", Decimal("0.00")),
                  (3, "C3", "p", "a", Decimal("-5.00"))],
        Publisher=[(1, "Pub")],
        Author=[(1, "Writer A"), (2, "Writer B")],
        Book=[("B1", "Alpha", "Poetry", Decimal("10.00"), 1, 1390),
              ("B2", "Beta", "Novel", Decimal("20.00"), 1, None),
              ("B3", "Gamma", "Novel", Decimal("5.00"), 1, None)],
        BookAuthor=[("B1", 2), ("B1", 1), ("B2", 2)],
        Inventory=[(10, "B1", 0, 2, None), (10, "B2", 3, 3, "s"), (20, "B1", 5, 1, "t"),
                   (30, "B3", 1, 4, None)],
        Sale=[(1, d(2009, 1, 1), 1, 10, "E1"), (2, d(2009, 6, 1), 2, 10, "E1"), (3, d(2010, 1, 1), 1, 20, "E3")],
        SaleItem=[(1, 1, "B1", 2, Decimal("10.00")), (1, 2, "B2", 1, Decimal("20.00")),
                  (2, 1, "B1", 1, Decimal("10.00")), (3, 1, "B2", 4, Decimal("20.00"))],
        PublisherPurchase=[(1, 1, 10, d(2009, 1, 1), Decimal("100.00"), Decimal("40.00"))],
    )


def test_r2_quantity_zero_counts_as_not_holding(shop):
    got = [r.StoreCode for r in R.stores_without_author(shop, "Writer A").collect()]
    # store 10 holds B1 only with quantity 0 -> listed; store 20 holds it in stock
    assert got == [10, 30]


def test_r3_ui_mode_always_one_row(shop):
    empty = R.store_sales(shop, 99, "2009-01-01", "2011-01-01").collect()
    assert [tuple(r) for r in empty] == [(99, 0, 0, Decimal("0.00"))]
    assert R.store_sales(shop, 99, "2009-01-01", "2011-01-01", mode="script").count() == 0
    row = R.store_sales(shop, 10, "2009-01-01", "2009-06-01").first()
    assert (row.InvoiceCount, row.SoldQuantity, row.TotalSales) == (2, 4, Decimal("50.00"))
    with pytest.raises(ValueError):
        R.store_sales(shop, 10, "2010-01-01", "2009-01-01")


def test_r7_strict_and_sorted(shop):
    assert [r.CustomerCode for r in R.debtors_above(shop, 0).collect()] == [1]
    with pytest.raises(ValueError):
        R.debtors_above(shop, -1)
    assert [r.CustomerCode for r in R.debtors_above(shop, "1,0").collect()] == [1]


def test_r6_modes(shop):
    assert R.books_by_author(shop, "Writer").count() == 3
    assert [r.ISBN for r in R.books_by_subject(shop, "Nov").collect()] == ["B2", "B3"]
    # B3 has no author but matches on subject
    assert sorted(r.ISBN for r in R.books_by_author_or_subject(shop, "Nov").collect()) == ["B2", "B3"]
    with pytest.raises(ValueError):
        R.books_by_subject(shop, "   ")


def test_r9_r10_r11(shop):
    assert [r.ISBN for r in R.unsold_books(shop, "2009-01-01", "2009-12-31").collect()] == ["B3"]
    rows = R.stores_short_of_book(shop, "B1").collect()
    assert [(r.StoreCode, r.Shortage) for r in rows] == [(10, 2)]
    debt = R.publisher_debt(shop, "Pub").first()
    assert (debt.TotalPurchase, debt.TotalPaid, debt.Debt) == (Decimal("100.00"), Decimal("40.00"), Decimal("60.00"))
    assert R.publisher_debt(shop, "Nobody").count() == 0


def test_v1_authors_in_name_order_and_null(shop):
    rows = {r.ISBN: r.Authors for r in V.book_catalogue(shop).collect()}
    assert rows == {"B1": "Writer A، Writer B", "B2": "Writer B", "B3": None}


def test_v2_manager_of_other_store_is_unset(shop):
    rows = {r.StoreCode: r.ManagerName for r in V.store_list(shop).collect()}
    assert rows == {10: "Ali", 20: None, 30: None}
    disp = {r.StoreCode: r.ManagerName for r in V.store_list(shop, display=True).collect()}
    assert disp[20] == V.MANAGER_NOT_SET


def test_v3_status_and_filters(shop):
    rows = {(r.StoreCode, r.ISBN): r.Status for r in V.inventory_list(shop).collect()}
    assert rows[(10, "B1")] == V.STATUS_CRITICAL and rows[(10, "B2")] == V.STATUS_BORDERLINE
    assert rows[(20, "B1")] == V.STATUS_NORMAL
    assert V.inventory_list(shop, store_text="1", book_text="Alp").count() == 1
    assert [r.StoreCode for r in V.low_stock(shop).collect()] == [30, 10]


def test_v6_summary(shop):
    r = V.debtor_summary(shop, 0).first()
    assert (r.DebtorCount, r.TotalDebt) == (1, Decimal("100.00"))


def test_quality_rules(shop):
    summary = {r.Rule: r.Violations for r in Q.quality_summary(shop).collect()}
    assert summary["manager_in_store"] == 1          # store 20's manager works at 30
    assert summary["seller_in_store"] == 0
    assert summary["fk_store_manager"] == 0
    assert summary["sale_has_items"] == 0


def test_input_validation(spark):
    df = spark.createDataFrame(
        [("10", "1", "E1", "2009-1-5", "B1", "2"), ("x", "", "E1", "2009-02-30", "B1", "0")],
        "StoreCode string, CustomerCode string, EmployeeNationalCode string, InvoiceDate string, "
        "ISBN string, Quantity string")
    v = [r.Violations for r in Q.validate_sale_lines(df).collect()]
    assert v[0] == []
    assert set(v[1]) == {"date_format", "quantity_positive_int", "customer_present"}


def test_book_store_inventory_validators(spark):
    from inkwell.functions.parsing import parse_authors
    books = spark.createDataFrame(
        [("B1", "T", "S", "1,250", "Pub", "", "الف، ب"), (" ", "T", "S", "-1", "Pub", "99", ""),
         ("B3", "T", "S", "۱۲", "Pub", "1390", "x")],
        "ISBN string, Title string, Subject string, Price string, PublisherName string, "
        "PublicationYear string, AuthorsText string")
    books = books.withColumn("Authors", parse_authors("AuthorsText"))
    v = [set(r.Violations) for r in Q.validate_book_input(books).collect()]
    assert v[0] == set() and v[2] == set()
    assert v[1] == {"isbn_present", "price_nonnegative_decimal", "year_range", "author_present"}
    stores = spark.createDataFrame([("12", "1", "021", "a"), ("-3", "", "x", "b"), ("۵", "1", "p", " ")],
                                   "StoreCode string, CityCode string, Phone string, Address string")
    v = [set(r.Violations) for r in Q.validate_store_input(stores).collect()]
    assert v == [set(), {"store_code_positive_int", "city_present"}, {"address_present"}]
    inv = spark.createDataFrame([("3", "0"), ("-1", "x")], "AvailableQuantity string, MinimumQuantity string")
    v = [set(r.Violations) for r in Q.validate_inventory_input(inv).collect()]
    assert v == [set(), {"available_nonnegative_int", "minimum_nonnegative_int"}]
    pp = spark.createDataFrame([(None,), (Decimal("2.00"),)], "PaidAmount decimal(18,2)")
    assert [r.PaidAmount for r in Q.with_paid_default(pp).collect()] == [Decimal("0.00"), Decimal("2.00")]


def test_name_reports_with_collation(shop):
    assert R.stores_in_city(shop, "isfahan").count() == 0
    assert [r.StoreCode for r in R.stores_in_city(shop, "isfahan", collation="UTF8_LCASE").collect()] == [10, 20]
    assert R.publisher_debt(shop, "pub ", collation="UTF8_LCASE_RTRIM").count() == 1


def test_inventory_list_like_mode(shop):
    assert V.inventory_list(shop, book_text="B_").count() == 0                 # literal
    assert V.inventory_list(shop, book_text="B_", match="like").count() == 4   # any ISBN B + one char
    assert V.inventory_list(shop, store_text="[12]0", match="like").count() == 3
