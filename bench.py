"""Benchmark: headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

1. ``derive_and_store``: derive the twelve bookstore tables from the
   driver's parquet files and write them once with the layout of
   ``inkwell.plans.layout`` (the stored tables are what a deployment reads),
   under ``$BENCH_SCRATCH`` (default: a new local scratch folder).
2. Each headline query runs against the stored tables: one warm-up, then the
   median of ``$BENCH_RUNS`` (default 3) runs, each written to Spark's
   ``noop`` sink so the whole result is computed and nothing is collected.
3. ``post_sales`` posts the survey's request batch (derived from lineitem)
   against the dense posting stock.

Prints one JSON line: {"metric", "value" (sum of medians), "unit", "queries", "sf"}.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from inkwell.operators import posting as P  # noqa: E402
from inkwell.operators import quality as Q  # noqa: E402
from inkwell.operators import reports as R  # noqa: E402
from inkwell.operators import views as V  # noqa: E402
from inkwell.plans import registry as REG  # noqa: E402
from inkwell.plans.layout import write_tables  # noqa: E402
from inkwell.session import local_session  # noqa: E402
from inkwell.sources.fixture import fixture_tables  # noqa: E402
from inkwell.sources.tables import load_tables  # noqa: E402


def _noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def _timed(fn) -> float:
    t0 = time.perf_counter()
    fn()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus=cpus, shuffle_partitions=max(8, cpus * 2), app="inkwell-bench")
    # where the derived tables are stored (a shared folder on a cluster)
    scratch = os.environ.get("BENCH_SCRATCH") or tempfile.mkdtemp(prefix="inkwell-bench-")
    root = f"{scratch}/tables"

    results: dict[str, float] = {}
    fx = fixture_tables(spark, sf_dir)
    results["derive_and_store"] = round(_timed(lambda: write_tables(fx, root)), 3)
    t = load_tables(spark, root)

    headline = {
        "r01_stores_in_city": lambda: R.stores_in_city(t, REG.CITY),
        "r02_stores_without_author": lambda: R.stores_without_author(t, REG.AUTHOR),
        "r03_store_sales": lambda: R.store_sales(t, REG.STORE, REG.SALES_START, REG.SALES_END),
        "r03_store_sales_all": lambda: R.store_sales_all(t, REG.SALES_START, REG.SALES_END),
        "r04_employees_of_store": lambda: R.employees_of_store(t, REG.STORE),
        "r05_employee_sales": lambda: R.employee_sales(t, REG.EMPLOYEE),
        "r06a_books_by_author": lambda: R.books_by_author(t, REG.AUTHOR_TEXT),
        "r06b_books_by_subject": lambda: R.books_by_subject(t, REG.SUBJECT_TEXT),
        "r06c_books_by_author_or_subject": lambda: R.books_by_author_or_subject(t, REG.SUBJECT_TEXT),
        "r07_debtors_above": lambda: R.debtors_above(t, REG.DEBT),
        "r08_customer_purchases": lambda: R.customer_purchases(t, REG.CUSTOMER),
        "r09_unsold_books": lambda: R.unsold_books(t, REG.UNSOLD_START, REG.UNSOLD_END),
        "r10_stores_short_of_book": lambda: R.stores_short_of_book(t, REG.SHORT_ISBN),
        "r11_publisher_debt": lambda: R.publisher_debt(t, REG.PUBLISHER),
        "v1_book_catalogue": lambda: V.book_catalogue(t),
        "v3_inventory_list": lambda: V.inventory_list(t),
        "v4_low_stock": lambda: V.low_stock(t),
        "c_quality_summary": lambda: Q.quality_summary(t),
    }
    for name, build in headline.items():
        _noop(build())                                   # warm-up
        times = [_timed(lambda: _noop(build())) for _ in range(runs)]
        results[name] = round(statistics.median(times), 3)

    def post():
        res = P.post_sales(fx.posting_tables(), fx.post_headers(), fx.post_lines())
        _noop(res.sales)
        _noop(res.items)
        _noop(res.inventory)
        _noop(res.rejected)
    post()                                               # warm-up
    results["w1_post_sales"] = round(statistics.median(_timed(post) for _ in range(runs)), 3)

    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    total = round(sum(v for k, v in results.items() if k != "derive_and_store"), 3)
    print(json.dumps({"metric": "sum_of_median_query_seconds", "value": total, "unit": "sec",
                      "queries": results, "sf": sf, "cpus": cpus, "runs": runs}))


if __name__ == "__main__":
    main()
