"""Write the formatted physical plans of the headline queries to PLANS.md.

    python tools/explain_plans.py [sf_dir]

The tables are derived from ``sf_dir`` (default sf0.1), stored once with the
layout of ``inkwell.plans.layout`` (scratch folder), and each query's plan is
printed after one run, so AQE's final plan (broadcasts chosen from measured
sizes) is what is shown.
"""

from __future__ import annotations

import contextlib
import io
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from inkwell.operators import quality as Q  # noqa: E402
from inkwell.operators import reports as R  # noqa: E402
from inkwell.operators import views as V  # noqa: E402
from inkwell.plans import registry as REG  # noqa: E402
from inkwell.plans.layout import write_tables  # noqa: E402
from inkwell.session import local_session  # noqa: E402
from inkwell.sources.fixture import fixture_tables  # noqa: E402
from inkwell.sources.tables import load_tables  # noqa: E402


def _plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session(cpus=8, shuffle_partitions=16, app="inkwell-plans")
    root = tempfile.mkdtemp(prefix="inkwell-plans-") + "/tables"
    write_tables(fixture_tables(spark, sf_dir), root)
    t = load_tables(spark, root)
    queries = {
        "R3 store sales (SaleLine: year folders pruned, store/date pushed)":
            R.store_sales(t, REG.STORE, REG.SALES_START, REG.SALES_END),
        "R3 all stores": R.store_sales_all(t, REG.SALES_START, REG.SALES_END),
        "R5 employee sales (SaleLine bloom-filter column pushed)": R.employee_sales(t, REG.EMPLOYEE),
        "R8 customer purchases": R.customer_purchases(t, REG.CUSTOMER),
        "R9 unsold books (anti join on pre-aggregated ISBNs)": R.unsold_books(t, REG.UNSOLD_START, REG.UNSOLD_END),
        "R2 stores without author (anti join)": R.stores_without_author(t, REG.AUTHOR),
        "R6c author or subject": R.books_by_author_or_subject(t, REG.SUBJECT_TEXT),
        "V1 book catalogue (ordered string aggregate)": V.book_catalogue(t),
        "C quality summary, one reference check": Q.orphan_counts(t, [fk for fk in Q.FOREIGN_KEYS
                                                                      if fk.name == "saleitem_book"][0]),
    }
    out = ["# Physical plans", "",
           f"Generated by `tools/explain_plans.py` on `{sf_dir}` (`local[8]`, 16 shuffle partitions), "
           "after one run of each query, so the AQE plans are final.", ""]
    for title, df in queries.items():
        out += [f"## {title}", "", "```", _plan(df).strip(), "```", ""]
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md")
    with open(path, "w") as fh:
        fh.write("\n".join(out))
    print(path)


if __name__ == "__main__":
    main()
