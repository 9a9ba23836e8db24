"""Physical plans: anti joins where the reference uses NOT EXISTS, no
cartesian products, no Python outside posting, filters reach the scans."""

import tempfile

import pytest

import __spark_entry__ as entry
from inkwell.operators import reports as R
from inkwell.plans import registry as REG
from inkwell.plans.layout import write_tables
from inkwell.sources.tables import load_tables
from tests.conftest import SF_SMALL

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "FlatMapCoGroupsInPandas",
                "MapInPandas", "PythonUDF")


def _formatted(df) -> str:
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def stored(spark, fixture_small):
    root = tempfile.mkdtemp(prefix="inkwell-plan-")
    write_tables(fixture_small, root)
    return load_tables(spark, root)


def test_not_exists_reports_plan_anti_joins(stored):
    for df in (R.stores_without_author(stored, REG.AUTHOR), R.unsold_books(stored, "1995-01-01", "1995-03-31")):
        assert "LeftAnti" in _formatted(df)


# the order-dependent steps: the only places Python runs inside tasks
ORDERED = {"w1_post_sales_outcome", "w1_new_invoice_lines", "w1_stock_after", "w4_invoice_lines", "w6_adjust_stock"}


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_no_cartesian_no_python(spark, name):
    df = entry.queries()[name](spark, SF_SMALL)
    text = _formatted(df)
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    if name not in ORDERED:
        assert not any(p in text for p in PYTHON_NODES)


def test_filters_reach_the_scan(stored):
    from inkwell.schemas import TABLES
    joined = {name: stored[name] for name in TABLES}          # no SaleLine: the join path
    text = _formatted(R.store_sales(joined, REG.STORE, REG.SALES_START, REG.SALES_END))
    assert "GreaterThanOrEqual(InvoiceDate" in text and "EqualTo(StoreCode" in text
    # column pruning: SaleItem is read without LineNumber and ISBN
    assert "ReadSchema: struct<InvoiceNumber:bigint,Quantity:int,UnitPrice:decimal(18,2)>" in text
    text = _formatted(R.store_sales(stored, REG.STORE, REG.SALES_START, REG.SALES_END))
    scan = [ln for ln in text.splitlines() if ln.startswith("ReadSchema")]
    assert scan and all("ISBN" not in ln and "CustomerCode" not in ln for ln in scan)


def test_reports_use_no_python(stored):
    for df in (R.employee_sales(stored, REG.EMPLOYEE), R.customer_purchases(stored, REG.CUSTOMER),
               R.books_by_author_or_subject(stored, "PROMO")):
        text = _formatted(df)
        assert not any(p in text for p in PYTHON_NODES)


def test_sale_line_path_matches_join_path(spark, stored, fixture_small):
    """Stored tables carry SaleLine; the reports read it and give the rows
    the Sale x SaleItem join gives."""
    assert "SaleLine" in stored
    cases = [
        lambda t: R.store_sales(t, REG.STORE, "1992-01-01", "2001-12-31"),
        lambda t: R.store_sales_all(t, "1995-06-01", "1998-12-31"),
        lambda t: R.employee_sales(t, REG.EMPLOYEE),
        lambda t: R.customer_purchases(t, 5),
        lambda t: R.unsold_books(t, "1995-01-01", "1996-06-30"),
    ]
    for build in cases:
        a, b = build(stored), build(fixture_small)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_sale_line_scan_prunes(stored):
    text = _formatted(R.employee_sales(stored, REG.EMPLOYEE))
    assert "SaleLine" in text and "EqualTo(EmployeeNationalCode,0000000451)" in text
    text = _formatted(R.store_sales(stored, REG.STORE, REG.SALES_START, REG.SALES_END))
    assert "PartitionFilters: [isnotnull(InvoiceYear" in text
