"""Jobs give the same results when tasks fail and are re-run.

Runs in a subprocess on ``local[4,3]`` (up to three attempts per task). A
pandas UDF upstream fails the first attempt of every even partition, so each
stage that reads it is retried; the ordinal numbering and a posting batch
must still be exact.
"""

import os
import subprocess
import sys
import textwrap

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = textwrap.dedent(f"""
    import sys, datetime as dt
    from decimal import Decimal
    sys.path.insert(0, {REPO!r})
    from pyspark import TaskContext
    from pyspark.sql import SparkSession, Window, functions as F
    from pyspark.sql.functions import pandas_udf
    spark = (SparkSession.builder.master("local[4,3]").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", "6").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    from inkwell.functions.ordinal import with_ordinal, number_within
    from inkwell.operators import posting as P
    from inkwell.schemas import SCHEMAS

    @pandas_udf("long")
    def flaky(v):
        tc = TaskContext.get()
        if tc.attemptNumber() == 0 and tc.partitionId() % 2 == 0:
            raise RuntimeError("injected task failure")
        return v

    df = spark.range(0, 20000, numPartitions=4).select(flaky((F.col("id") * 7919) % 20011).alias("k"))
    got = with_ordinal(df, ["k"], "n")
    want = df.withColumn("n", F.row_number().over(Window.orderBy("k")))
    assert got.select("k", "n").exceptAll(want.select("k", F.col("n").cast("long"))).count() == 0
    g = df.select((F.col("k") % 7).alias("g"), "k")
    got = number_within(g, ["g"], ["k"], "n")
    want = g.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("k")))
    assert got.select("g", "k", "n").exceptAll(want.select("g", "k", "n")).count() == 0

    # posting: 400 requests on 5 stores x 3 books, lines pass through the flaky UDF
    stock = {{(s, b): 6 for s in range(5) for b in "abc"}}
    reqs = [(r, r % 5, [("abc"[r % 3], 1 + r % 4), ("abc"[(r * 7) % 3], 1)]) for r in range(1, 401)]
    lines = spark.createDataFrame([(r, b, q, i) for r, _, ls in reqs for i, (b, q) in enumerate(ls)],
                                  "RequestID long, ISBN string, Quantity int, LinePos int").repartition(4)
    lines = lines.withColumn("RequestID", flaky(F.col("RequestID")))
    heads = spark.createDataFrame([(r, s, 1, "E", dt.date(2010, 1, 1)) for r, s, _ in reqs],
                                  "RequestID long, StoreCode int, CustomerCode int, "
                                  "EmployeeNationalCode string, InvoiceDate date")
    t = {{"Inventory": spark.createDataFrame([(s, b, q, 0, None) for (s, b), q in stock.items()],
                                             SCHEMAS["Inventory"]),
         "Book": spark.createDataFrame([(b, b, "s", Decimal("1.00"), 1, None) for b in "abc"], SCHEMAS["Book"]),
         "Sale": spark.createDataFrame([], SCHEMAS["Sale"])}}
    res = P.post_sales(t, heads, lines, chunk=30)
    s2 = dict(stock); ok = []
    for rid, store, ls in sorted(reqs):
        need = {{}}
        for b, q in ls:
            need[b] = need.get(b, 0) + q
        if all(s2[(store, b)] >= q for b, q in need.items()):
            for b, q in need.items():
                s2[(store, b)] -= q
            ok.append(rid)
    acc = sorted((r.RequestID, r.InvoiceNumber) for r in res.accepted.collect())
    assert [a for a, _ in acc] == ok, "accepted set differs"
    assert [n for _, n in acc] == list(range(1, len(ok) + 1))
    inv = {{(r.StoreCode, r.ISBN): r.AvailableQuantity for r in res.inventory.collect()}}
    assert inv == s2
    print("RETRIES-OK", len(ok))
""")


def test_results_survive_task_retries(tmp_path):
    script = tmp_path / "retry_job.py"
    script.write_text(SCRIPT)
    # run from a folder outside the repository: Python workers cannot import
    # the package, so the pandas steps must reach them by value
    out = subprocess.run([sys.executable, str(script)], capture_output=True, text=True, timeout=900,
                         cwd=str(tmp_path))
    assert "RETRIES-OK" in out.stdout, (out.stdout[-2000:], out.stderr[-4000:])
