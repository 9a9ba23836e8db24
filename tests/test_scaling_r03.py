"""Steps that must not grow with more than the rows they need (round 3)."""

import contextlib
import io
import os

from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as entry
from inkwell.functions.ordinal import number_in_blocks
from inkwell.plans import registry as REG
from inkwell.session import ensure_checkpoint_dir
from tests.conftest import SF_SMALL


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def _written(spark) -> set[str]:
    root = ensure_checkpoint_dir(spark).removeprefix("file:")
    return set(os.listdir(root)) if os.path.isdir(root) else set()


def test_number_in_blocks_matches_row_number(spark):
    # one group over many blocks, shared and missing positions, a missing group
    df = spark.range(0, 3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(1)).when(F.col("id") % 101 != 0, F.col("id")).alias("g"),
        F.when(F.col("id") % 97 != 0, F.floor(F.col("id") / 2) - 200).cast("int").alias("p"), F.col("id").alias("o"))
    got = number_in_blocks(df, ["g"], "p", ["o"], "n", block_rows=64)
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("p", "o")))
    assert got.count() == 3000
    assert got.select("g", "p", "o", "n").exceptAll(want).count() == 0


def test_sale_items_are_numbered_only_where_the_number_is_read(spark):
    before = _written(spark)
    REG._TABLES.clear()
    items = REG.tables_for(spark, SF_SMALL)["SaleItem"]
    assert _written(spark) == before                    # nothing ran
    text = _plan(items.groupBy("InvoiceNumber").count())
    assert "Window" not in text and "Join" not in text  # and nothing is left of the numbering
    assert "Window" in _plan(items.groupBy("LineNumber").count())


def test_tagged_sales_shuffles_sales_once_per_key_not_per_rule(spark):
    before = _written(spark)
    REG._TABLES.clear()
    text = _plan(entry.queries()["c_tagged_sales"](spark, SF_SMALL))
    # no other table is computed, none but broken keys is written
    assert all("inkwell-broken" in name for name in _written(spark) - before)
    # the broken keys are known to be few: the sales themselves stay in place
    assert "hashpartitioning" not in text and "Window" not in text


def test_quality_summary_counts_one_owners_keys_at_a_time(spark):
    """No counter is held for another owner's facts: a line of a sale has one."""
    text = _plan(entry.queries()["c_quality_summary"](spark, SF_SMALL))
    assert "Generate" in text and "Owner#" not in text


def test_purchases_of_one_customer_are_taken_before_lines_are_numbered(spark):
    plan = _plan(entry.queries()["r08_customer_purchases"](spark, SF_SMALL))
    tree = plan[:plan.index("\n\n")]
    # below the numbering of the lines lies the semi join with the customer's sales
    assert "LeftSemi" in tree[tree.index("Window"):]


def _calls(monkeypatch, module, name="written_table"):
    labels = []
    real = getattr(module, name)
    monkeypatch.setattr(module, name, lambda df, label="table": (labels.append(label), real(df, label))[1])
    return labels


def test_posting_writes_only_what_is_read(spark, monkeypatch):
    from inkwell.functions import ordinal
    from inkwell.operators import posting
    written, ranked = _calls(monkeypatch, posting), _calls(monkeypatch, ordinal)
    for name, labels in (("w1_certain_rejects", ["headers", "batch", "rejected"]),
                         ("w1_contested_pairs", ["headers", "batch", "rejected"]),
                         ("w1_certain_accepts", ["headers", "batch", "rejected", "contested"])):
        written.clear()
        entry.queries()[name](spark, SF_SMALL).count()
        assert written == labels
    assert not ranked                        # nothing was numbered
    entry.queries()["w1_stock_after"](spark, SF_SMALL).count()
    assert not ranked                        # neither for the stock
    entry.queries()["w1_post_sales_outcome"](spark, SF_SMALL).count()
    assert len(ranked) == 1                  # once for the invoices, not for their lines


def test_lines_of_a_few_books_are_not_shuffled_by_book(spark):
    """The posting lines name 20 books: they do not travel by ISBN."""
    from inkwell.plans.registry import tables_for
    t = tables_for(spark, SF_SMALL)
    from inkwell.operators import posting
    seen = []
    parts = posting.classify_requests(t.posting_tables(), t.post_headers(), t.post_lines())
    seen.append(_plan(parts["live_lines"]))
    seen.append(_plan(entry.queries()["w5_invoice_totals"](spark, SF_SMALL)))
    assert "hashpartitioning(ISBN" not in seen[0] and "part.parquet" not in seen[0]
    assert "LeftSemi" in seen[1]             # only the books asked for meet the lines


def test_single_adjustments_are_decided_without_a_walk(spark, monkeypatch):
    from inkwell.operators import sequential
    events = spark.createDataFrame([(1, 1, -5, 3), (2, 1, -2, 3), (3, 1, 4, 0), (4, 1, -1, 4), (4, 2, -4, 4), (4, 3, 1, 4)],
                                   "k int, o long, d long, s long").selectExpr("*", "k * 10 + o as e")
    walked = []
    real = sequential._walk_chunks
    monkeypatch.setattr(sequential, "_walk_chunks", lambda hard, chunk: (walked.append(hard.count()), real(hard, chunk))[1])
    got = {r.e: r.Accepted for r in sequential.bounded_walk(events, ["k"], "o", "d", "s", "e").collect()}
    assert got == {11: False, 21: True, 31: True, 41: True, 42: False, 43: True}
    assert walked == [3]                     # the key with several events alone


def test_gate_judges_requests_once(spark, monkeypatch):
    from inkwell.operators import gate
    from inkwell.operators import upserts
    written = _calls(monkeypatch, gate)
    monkeypatch.setattr(upserts, "written_table", gate.written_table)
    text = _plan(entry.queries()["w7_inventory_gate"](spark, SF_SMALL))
    assert written == ["gated", "judged"]
    assert "regexp_replace" not in text and "orders.parquet" not in text
