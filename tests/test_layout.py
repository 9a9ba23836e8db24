"""Reports on the plain tables, co-located by invoice in a catalog."""

import pytest
from pyspark.sql import functions as F

from inkwell.operators import reports as R
from inkwell.plans.layout import write_catalog_tables
from inkwell.sources.tables import CatalogTables

EMPLOYEE, CUSTOMER = "0000000050", 3


@pytest.fixture(scope="module")
def stored(spark, fixture_small, tmp_path_factory):
    spark.sql(f"create database colocated location '{tmp_path_factory.mktemp('colocated').as_uri()}'")
    write_catalog_tables(fixture_small, "colocated", buckets=4, step=50)
    yield CatalogTables(spark, "colocated")
    spark.sql("drop database colocated cascade")


@pytest.fixture
def no_broadcast(spark):
    """As where no side is small: only the hinted folder list is broadcast."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for k in old:
        spark.conf.set(k, "-1" if "Threshold" in k else "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def _nodes(plan):
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i))


def _item_scan(df):
    """(path from the root to the scan of SaleItem, the scan)"""
    def find(plan):
        if plan.nodeName().lower().startswith("scan parquet") and plan.nodeName().lower().endswith(".saleitem"):
            return [plan]
        children = plan.children()
        for i in range(children.size()):
            below = find(children.apply(i))
            if below:
                return [plan, *below]
        return None
    return find(df._jdf.queryExecution().executedPlan())


# at this size an employee sells in every folder, a customer buys in a few
@pytest.mark.parametrize("report, value, prunes", [(R.employee_sales, EMPLOYEE, False), (R.customer_purchases, CUSTOMER, True)])
def test_one_persons_sales_join_without_shuffle_and_prune(spark, fixture_small, stored, no_broadcast, report, value, prunes):
    want = sorted(map(str, report(fixture_small, value).collect()))
    df = report(stored, value)
    assert want and sorted(map(str, df.collect())) == want
    path = _item_scan(df)
    names = [p.nodeName() for p in path]
    # up to the join with the headers, nothing moves the lines
    join = max(i for i, n in enumerate(names) if n == "SortMergeJoin")
    assert not any("Exchange" in n for n in names[join:]), names
    headers = [p for p in _nodes(path[join]) if p.nodeName().lower().endswith(".sale")]
    assert headers and "Bucketed: true" in path[-1].verboseStringWithOperatorId() + str(path[-1])
    # and only the folders of the wanted invoices are read
    folders = stored["SaleItem"].select("InvoiceRange").distinct().count()
    read = path[-1].metrics().apply("numPartitions").value()
    column, key = ("EmployeeNationalCode", EMPLOYEE) if report is R.employee_sales else ("CustomerCode", CUSTOMER)
    mine = stored["Sale"].filter(F.col(column) == key).select("InvoiceRange").distinct().count()
    assert read <= mine and (mine < folders) == prunes


def test_reports_without_filter_read_all(spark, fixture_small, stored):
    a = R.store_sales_all(fixture_small, "1992-01-01", "1999-12-31").collect()
    assert sorted(map(str, R.store_sales_all(stored, "1992-01-01", "1999-12-31").collect())) == sorted(map(str, a))
    from inkwell.operators.quality import quality_summary
    assert sorted(map(str, quality_summary(stored).collect())) == sorted(map(str, quality_summary(fixture_small).collect()))
