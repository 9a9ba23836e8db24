"""CSV export, snapshots and the posting stream."""

import csv
import datetime as dt
import glob
import io
import os
import tempfile
from decimal import Decimal

import pytest

from inkwell.schemas import SCHEMAS, VIEW_SCHEMAS
from inkwell.sources.export import EmptyResultError, export_csv
from inkwell.sources.snapshots import current_snapshot, load_snapshot, publish_snapshot


def _python_csv(columns, rows):
    want = io.StringIO(newline="")
    w = csv.writer(want)
    w.writerow(columns)
    w.writerows(rows)
    return ("\ufeff" + want.getvalue()).encode("utf-8")


def _exported(df, **kw):
    out = tempfile.mkdtemp(prefix="inkwell-csv-")
    export_csv(df, f"{out}/r", single_file=True, **kw)
    (part,) = glob.glob(f"{out}/r/part-*")
    with open(part, "rb") as fh:
        return fh.read()


def test_export_matches_python_csv(spark):
    rows = [("he said \"hi\"", "a,b", Decimal("1234.50"), dt.date(2009, 1, 5)),
            ("line\nbreak", " lead", None, None), ("", "trail ", Decimal("2.50"), dt.date(2010, 12, 31)),
            ("cr\rlf\r\n\n", "\"", Decimal("-0.5"), None), ("۱٬۲ é \U0001f600", "\ttab", Decimal("-1234567.89"), None)]
    df = spark.createDataFrame(rows, "t string, `u,v` string, m decimal(18,2), d date")
    cells = [[t, u, "" if m is None else f"{m:,.0f}", "" if d is None else d.strftime("%Y-%m-%d")] for t, u, m, d in rows]
    assert _exported(df) == _python_csv(["t", "u,v", "m", "d"], cells)
    assert _exported(df, headings={"t": "عنوان \"x\""}) == _python_csv(["عنوان \"x\"", "u,v", "m", "d"], cells)


def test_export_of_one_column_quotes_empty_cells(spark):
    rows = [("",), ("a\nb",), (None,), ("x",)]
    assert _exported(spark.createDataFrame(rows, "t string")) == _python_csv(["t"], [[t or ""] for (t,) in rows])


def test_export_in_parts_has_a_header_each(spark):
    df = spark.range(10).repartition(3).selectExpr("id", "'a,b' as t")
    out = tempfile.mkdtemp(prefix="inkwell-csv-")
    export_csv(df, f"{out}/r")
    got = []
    for part in glob.glob(f"{out}/r/part-*"):
        with open(part, encoding="utf-8-sig", newline="") as fh:
            header, *rows = csv.reader(fh)
        assert header == ["id", "t"] and rows
        got += rows
    assert sorted(got) == [[str(i), "a,b"] for i in range(10)]


def test_export_refuses_empty(spark):
    df = spark.createDataFrame([], "a int")
    with pytest.raises(EmptyResultError):
        export_csv(df, tempfile.mkdtemp() + "/x")


def _inv(spark, rows):
    return spark.createDataFrame(rows, SCHEMAS["Inventory"])


def test_snapshots_publish_and_rollback(spark):
    root = tempfile.mkdtemp(prefix="inkwell-snap-")
    assert current_snapshot(spark, root)[0] == 0
    n1 = publish_snapshot(spark, root, changed={"Inventory": _inv(spark, [(1, "a", 5, 1, None)])})
    n2 = publish_snapshot(spark, root, changed={"Inventory": _inv(spark, [(1, "a", 3, 1, None)])})
    assert (n1, n2) == (1, 2)
    assert load_snapshot(spark, root)["Inventory"].first().AvailableQuantity == 3
    # a failed job: snapshot 3 written without its commit record stays invisible
    _inv(spark, [(1, "a", 0, 1, None)]).write.parquet(f"{root}/snapshot=3/Inventory")
    assert current_snapshot(spark, root)[0] == 2
    assert publish_snapshot(spark, root, changed={"Inventory": _inv(spark, [(1, "a", 9, 1, None)])}) == 3
    assert load_snapshot(spark, root)["Inventory"].first().AvailableQuantity == 9


def test_posting_stream(spark):
    from inkwell.streaming.sale_stream import REQUEST_LINE_SCHEMA, post_batch, start_sale_posting
    root = tempfile.mkdtemp(prefix="inkwell-stream-")
    publish_snapshot(spark, root, changed={
        "Inventory": _inv(spark, [(10, "a", 5, 0, None)]),
        "Book": spark.createDataFrame([("a", "A", "s", Decimal("3.00"), 1, None)], SCHEMAS["Book"]),
        "Sale": spark.createDataFrame([], SCHEMAS["Sale"]),
        "SaleItem": spark.createDataFrame([], SCHEMAS["SaleItem"]),
        "SaleLine": spark.createDataFrame([], VIEW_SCHEMAS["SaleLine"]),
    })
    src = tempfile.mkdtemp(prefix="inkwell-src-")
    d = dt.date(2010, 1, 1)
    spark.createDataFrame([(1, 10, 1, "E", d, 1, "a", 3), (2, 10, 1, "E", d, 1, "a", 3)],
                          REQUEST_LINE_SCHEMA).write.mode("append").parquet(src)
    q = start_sale_posting(spark, src, root, os.path.join(tempfile.mkdtemp(), "cp"))
    q.processAllAvailable()
    spark.createDataFrame([(3, 10, 1, "E", d, 1, "a", 2)], REQUEST_LINE_SCHEMA).write.mode("append").parquet(src)
    q.processAllAvailable()
    q.stop()
    t = load_snapshot(spark, root)
    assert sorted(r.InvoiceNumber for r in t["Sale"].collect()) == [1, 2]
    assert t["Inventory"].first().AvailableQuantity == 0
    assert sorted((r.InvoiceNumber, r.Quantity, r.InvoiceYear) for r in t["SaleLine"].collect()) == \
        [(1, 3, 2010), (2, 2, 2010)]
    # appended batches are compacted into one folder per table
    _, paths, _ = current_snapshot(spark, root)
    assert len(paths["Sale"]) == 3                # initial empty folder + 2 batches
    from inkwell.sources.snapshots import compact_snapshot
    inventory_folders = set(paths["Inventory"])
    assert compact_snapshot(spark, root) is not None
    _, paths, _ = current_snapshot(spark, root)
    assert len(paths["Sale"]) == 1 and len(paths["SaleLine"]) == 1
    assert set(paths["Inventory"]) == inventory_folders          # buckets are left as they are
    assert load_snapshot(spark, root)["SaleItem"].count() == 2
    # replaying an already committed batch is a no-op
    n, _, epoch = current_snapshot(spark, root)
    again = spark.createDataFrame([(3, 10, 1, "E", d, 1, "a", 2)], REQUEST_LINE_SCHEMA)
    assert post_batch(spark, root, again, epoch) is None
    assert current_snapshot(spark, root)[0] == n


def test_bucketed_inventory_patch(spark):
    from inkwell.sources.snapshots import BUCKETED, bucket_of
    root = tempfile.mkdtemp(prefix="inkwell-bucket-")
    stock = [(s, b, 5, 0, None) for s in range(1, 41) for b in ("a", "b")]
    publish_snapshot(spark, root, changed={"Inventory": _inv(spark, stock)})
    _, paths, _ = current_snapshot(spark, root)
    assert 1 < len(paths["Inventory"]) <= BUCKETED["Inventory"][1]
    new = _inv(spark, [(s, b, 1 if s == 7 else 5, 0, None) for s in range(1, 41) for b in ("a", "b")])
    touched = [r[0] for r in _inv(spark, [(7, "a", 0, 0, None)]).select(bucket_of("Inventory")).collect()]
    publish_snapshot(spark, root, patched={"Inventory": (new, touched)})
    _, paths2, _ = current_snapshot(spark, root)
    assert len(set(paths2["Inventory"]) - set(paths["Inventory"])) == 1     # one bucket rewritten
    got = {(r.StoreCode, r.ISBN): r.AvailableQuantity for r in load_snapshot(spark, root)["Inventory"].collect()}
    assert len(got) == 80 and got[(7, "a")] == 1 and got[(8, "a")] == 5


def test_command_line_report(spark, fixture_small, tmp_path):
    from inkwell.__main__ import main, report_params
    from inkwell.plans.layout import write_tables
    assert report_params("r03_store_sales", ["store=45", "start=2009-01-01"]) == \
        {"store": 45, "start": dt.date(2009, 1, 1)}
    assert report_params("r08_customer_purchases", ["customer=5", "with_code=false"]) == \
        {"customer": 5, "with_code": False}
    assert report_params("r07_debtors_above", ["amount=1,000"]) == {"amount": Decimal("1000")}
    root = str(tmp_path / "tables")
    write_tables(fixture_small, root)
    out = str(tmp_path / "r01")
    assert main(["report", "r01_stores_in_city", "--root", root, "--param", "city=NATION_3",
                 "--headings", "--csv", out]) == 0
    (part,) = glob.glob(f"{out}/part-*")
    header = open(part, encoding="utf-8-sig").readline().strip()
    assert header.split(",")[0] == "کد فروشگاه"


def test_adjustment_stream(spark):
    from inkwell.streaming.sale_stream import ADJUSTMENT_SCHEMA, start_stock_adjustments
    root = tempfile.mkdtemp(prefix="inkwell-adj-")
    publish_snapshot(spark, root, changed={"Inventory": _inv(spark, [(1, "a", 1, 0, None), (2, "b", 4, 0, None)])})
    src = tempfile.mkdtemp(prefix="inkwell-adj-src-")
    spark.createDataFrame([(1, 1, "a", 2, 1), (2, 1, "a", 3, -1), (3, 1, "a", 1, -1), (4, 2, "b", 4, -1)],
                          ADJUSTMENT_SCHEMA).write.mode("append").parquet(src)
    q = start_stock_adjustments(spark, src, root, os.path.join(tempfile.mkdtemp(), "cp"))
    q.processAllAvailable()
    q.stop()
    got = {(r.StoreCode, r.ISBN): r.AvailableQuantity for r in load_snapshot(spark, root)["Inventory"].collect()}
    assert got == {(1, "a"): 0, (2, "b"): 0}


def test_command_line_adjust(spark, tmp_path):
    from inkwell.__main__ import main
    from inkwell.streaming.sale_stream import ADJUSTMENT_SCHEMA
    root = str(tmp_path / "snap")
    publish_snapshot(spark, root, changed={"Inventory": _inv(spark, [(1, "a", 5, 0, None)])})
    req = str(tmp_path / "adj")
    spark.createDataFrame([(1, 1, "a", 2, -1)], ADJUSTMENT_SCHEMA).write.parquet(req)
    assert main(["adjust", "--root", root, "--requests", req]) == 0
    assert load_snapshot(spark, root)["Inventory"].first().AvailableQuantity == 3


def test_streams_count_their_own_batches(spark, tmp_path):
    import datetime as dt

    from inkwell.sources.apply import apply_requests
    from inkwell.sources.snapshots import last_epochs, load_refused
    from inkwell.streaming.sale_stream import ADJUSTMENT_SCHEMA, REQUEST_LINE_SCHEMA, adjust_batch, post_batch
    root = str(tmp_path / "snap")
    publish_snapshot(spark, root, changed={
        "Inventory": _inv(spark, [(1, "a", 5, 0, None)]),
        "Store": spark.createDataFrame([(1, 1, None, "1", "x")], SCHEMAS["Store"]),
        "Book": spark.createDataFrame([(b, b, "s", Decimal("1.00"), 1, None) for b in "ab"], SCHEMAS["Book"]),
        "Sale": spark.createDataFrame([], SCHEMAS["Sale"]),
        "SaleItem": spark.createDataFrame([], SCHEMAS["SaleItem"]),
    })
    day = dt.date(2010, 1, 1)
    # the lines of request 3 disagree on the customer, those of 4 on a missing one
    sale = spark.createDataFrame([(1, 1, 1, "E", day, 1, "a", 2), (2, 1, 1, "E", day, 1, "a", 9),
                                  (3, 1, 1, "E", day, 1, "a", 1), (3, 1, 2, "E", day, 2, "b", 1),
                                  (4, 1, None, "E", day, 1, "a", 1), (4, 1, 1, "E", day, 2, "b", 1)], REQUEST_LINE_SCHEMA)
    adjust = spark.createDataFrame([(7, 1, "a", 1, -1), (8, 1, "a", 50, -1)], ADJUSTMENT_SCHEMA)
    assert post_batch(spark, root, sale, 0) is not None
    assert adjust_batch(spark, root, adjust, 0) is not None       # not taken for the sales' batch 0
    more = spark.createDataFrame([(1, 1, "b", 2, 0, None)], "RequestID int, StoreCode int, ISBN string, "
                                 "AvailableQuantity int, MinimumQuantity int, Description string")
    apply_requests(spark, root, "insert_inventory", more)         # without a batch id
    assert post_batch(spark, root, sale, 0) is None               # still known as posted
    assert last_epochs(spark, root) == {"sales": 0, "adjustments": 0}
    stock = {r.ISBN: r.AvailableQuantity for r in load_snapshot(spark, root)["Inventory"].collect()}
    assert stock == {"a": 2, "b": 2}
    refused = {(r.Source, r.RequestID, r.Reason) for r in load_refused(spark, root).collect()}
    assert refused == {("sales", 2, "insufficient_stock"), ("sales", 3, "conflicting_header"),
                       ("sales", 4, "conflicting_header"), ("adjustments", 8, "insufficient_stock")}


def test_apply_requests(spark, tmp_path):
    from inkwell.__main__ import main
    from inkwell.sources.apply import apply_requests
    root = str(tmp_path / "snap")
    publish_snapshot(spark, root, changed={
        "Inventory": _inv(spark, [(1, "a", 5, 0, None)]),
        "Store": spark.createDataFrame([(1, 1, None, "1", "x")], SCHEMAS["Store"]),
        "Book": spark.createDataFrame([(b, b, "s", Decimal("1.00"), 1, None) for b in "ab"], SCHEMAS["Book"]),
        "Author": spark.createDataFrame([(1, "W")], SCHEMAS["Author"]),
        "BookAuthor": spark.createDataFrame([("a", 1)], SCHEMAS["BookAuthor"]),
        "Publisher": spark.createDataFrame([(1, "P")], SCHEMAS["Publisher"]),
    })
    inv = spark.createDataFrame([(1, 1, "a", 9, 1, "x"), (2, 1, "b", 2, 0, None)],
                                "RequestID long, StoreCode int, ISBN string, AvailableQuantity int, "
                                "MinimumQuantity int, Description string")
    new, rejected = apply_requests(spark, root, "insert_inventory", inv, epoch=1)
    assert new == 2 and [r.Reason for r in rejected.collect()] == ["duplicate_key"]
    assert load_snapshot(spark, root)["Inventory"].count() == 2
    assert apply_requests(spark, root, "insert_inventory", inv, epoch=1)[0] is None     # replay skipped
    books = str(tmp_path / "books")
    spark.createDataFrame([(1, "c", "C", "s", Decimal("2.00"), "P", None, "W، New")],
                          "RequestID long, ISBN string, Title string, Subject string, Price decimal(18,2), "
                          "PublisherName string, PublicationYear short, Authors string").write.parquet(books)
    assert main(["apply", "insert_books", "--root", root, "--requests", books, "--epoch", "2"]) == 0
    t = load_snapshot(spark, root)
    assert t["Book"].count() == 3 and t["Author"].count() == 2 and t["BookAuthor"].count() == 3


def test_snapshot_from_stored_tables_then_post(spark, fixture_small, tmp_path):
    """The deployment path: stored tables -> first snapshot -> a posted batch."""
    from inkwell.plans.layout import write_tables
    from inkwell.schemas import TABLES
    from inkwell.sources.tables import load_tables
    from inkwell.streaming.sale_stream import REQUEST_LINE_SCHEMA, post_batch
    tables_root = str(tmp_path / "tables")
    write_tables(fixture_small, tables_root)
    t = load_tables(spark, tables_root)
    root = str(tmp_path / "snap")
    publish_snapshot(spark, root, changed={n: t[n] for n in TABLES})
    before = load_snapshot(spark, root)
    inv = before["Inventory"].filter("AvailableQuantity > 3").orderBy("StoreCode", "ISBN").first()
    sales = before["Sale"].count()
    top = before["Sale"].agg({"InvoiceNumber": "max"}).first()[0]
    batch = spark.createDataFrame([(1, inv.StoreCode, 1, "0000000010", dt.date(2010, 1, 1), 1, inv.ISBN, 2)],
                                  REQUEST_LINE_SCHEMA)
    assert post_batch(spark, root, batch, 0) == 2
    after = load_snapshot(spark, root)
    assert after["Sale"].count() == sales + 1
    assert after["Sale"].agg({"InvoiceNumber": "max"}).first()[0] == top + 1
    row = after["Inventory"].filter(f"StoreCode = {inv.StoreCode} and ISBN = '{inv.ISBN}'").first()
    assert row.AvailableQuantity == inv.AvailableQuantity - 2
