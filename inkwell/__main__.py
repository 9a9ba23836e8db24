"""Command-line jobs over stored tables (``spark-submit -m inkwell`` or
``python -m inkwell``):

    python -m inkwell report r03_store_sales --root /data/bookstore \\
        --param store=4545 --param start=2009-01-01 --param end=2011-01-01 \\
        [--headings] [--csv /out/r03] [--show 20]
    python -m inkwell quality --root /data/bookstore [--csv /out/quality]
    python -m inkwell post --root /data/snapshots --requests /in/batch.parquet
    python -m inkwell adjust --root /data/snapshots --requests /in/adjustments.parquet
    python -m inkwell apply insert_books --root /data/snapshots --requests /in/books.parquet

``report`` runs one of the eleven reports (parameters typed from the report
function's signature) and shows it or exports it as the reference's CSV;
``quality`` writes the rule summary; ``post`` posts a batch of sale request
lines, and ``adjust`` a batch of stock adjustments, against the current
snapshot and publishes the next one; ``apply`` runs one of the insert / edit
/ delete operators on a request file and publishes the tables it changes.
"""

from __future__ import annotations

import argparse
import datetime as dt
import inspect
import sys
from decimal import Decimal

from pyspark.sql import functions as F

from inkwell.functions.headings import REPORT_HEADINGS, localise
from inkwell.operators import quality, reports
from inkwell.session import apply_cluster_defaults, ensure_checkpoint_dir
from inkwell.sources.export import export_csv
from inkwell.sources.tables import load_tables


def _convert(value: str, annotation) -> object:
    kind = str(annotation)
    if kind == "bool":
        return value.strip().lower() in ("1", "true", "yes")
    if "int" in kind and "Decimal" not in kind:
        return int(value)
    if "Decimal" in kind:
        return Decimal(value.replace(",", ""))
    if "date" in kind:
        return dt.date.fromisoformat(value)
    return value


def report_params(name: str, pairs: list[str]) -> dict[str, object]:
    """``["store=45", ...]`` -> typed keyword arguments of the report."""
    sig = inspect.signature(reports.REPORTS[name])
    out: dict[str, object] = {}
    for pair in pairs:
        key, _, value = pair.partition("=")
        if key not in sig.parameters:
            raise SystemExit(f"{name} has no parameter {key!r}; it takes "
                             f"{[p for p in sig.parameters if p != 't']}")
        out[key] = _convert(value, sig.parameters[key].annotation)
    return out


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="inkwell")
    sub = ap.add_subparsers(dest="cmd", required=True)
    rp = sub.add_parser("report")
    rp.add_argument("name", choices=sorted(reports.REPORTS))
    rp.add_argument("--root", required=True)
    rp.add_argument("--param", action="append", default=[])
    rp.add_argument("--headings", action="store_true", help="the reference's column headings")
    rp.add_argument("--csv")
    rp.add_argument("--show", type=int, default=20)
    qp = sub.add_parser("quality")
    qp.add_argument("--root", required=True)
    qp.add_argument("--csv")
    qp.add_argument("--violations", help="folder for the rows that break a rule, with the rules")
    pp = sub.add_parser("post")
    pp.add_argument("--root", required=True, help="snapshot root")
    pp.add_argument("--requests", required=True, help="parquet sale request lines")
    pp.add_argument("--epoch", type=int, default=None)
    adj = sub.add_parser("adjust")
    adj.add_argument("--root", required=True, help="snapshot root")
    adj.add_argument("--requests", required=True, help="parquet stock adjustments")
    adj.add_argument("--epoch", type=int, default=None)
    apl = sub.add_parser("apply")
    from inkwell.sources.apply import OPERATIONS
    apl.add_argument("operation", choices=sorted(OPERATIONS))
    apl.add_argument("--root", required=True, help="snapshot root")
    apl.add_argument("--requests", required=True, help="parquet requests")
    apl.add_argument("--epoch", type=int, default=None)
    args = ap.parse_args(argv)

    from pyspark.sql import SparkSession
    spark = apply_cluster_defaults(SparkSession.builder.appName(f"inkwell-{args.cmd}").getOrCreate())
    ensure_checkpoint_dir(spark)

    if args.cmd == "report":
        df = reports.REPORTS[args.name](load_tables(spark, args.root), **report_params(args.name, args.param))
        if args.headings and args.name in REPORT_HEADINGS:
            df = localise(df, args.name)
        if args.csv:
            export_csv(df, args.csv)
        else:
            df.show(args.show, truncate=False)
    elif args.cmd == "quality":
        tables = load_tables(spark, args.root)
        if args.violations:
            for rule, rows in quality.write_violations(tables, args.violations).items():
                print(f"{rule}\t{rows}")
            return 0
        df = quality.quality_summary(tables)
        if args.csv:
            export_csv(df, args.csv)
        else:
            df.show(100, truncate=False)
    elif args.cmd == "apply":
        from inkwell.sources.apply import apply_requests
        new, rejected = apply_requests(spark, args.root, args.operation,
                                       spark.read.parquet(args.requests), args.epoch)
        print(f"published snapshot {new}" if new is not None else f"batch {args.epoch} already applied")
        rejected.groupBy("Reason").count().show(truncate=False)
    else:
        from inkwell.sources.snapshots import last_epochs, load_refused
        from inkwell.streaming import sale_stream as S
        schema, apply, source = ((S.REQUEST_LINE_SCHEMA, S.post_batch, S.SALES) if args.cmd == "post"
                                 else (S.ADJUSTMENT_SCHEMA, S.adjust_batch, S.ADJUSTMENTS))
        batch = spark.read.schema(schema).parquet(args.requests)
        last = last_epochs(spark, args.root).get(source, -1)
        epoch = args.epoch if args.epoch is not None else last + 1
        new = apply(spark, args.root, batch, epoch)
        print(f"published snapshot {new}" if new is not None else f"batch {epoch} already posted")
        if new is not None:
            refused = load_refused(spark, args.root).filter(F.col("snapshot") == new)
            refused.groupBy("Reason").count().show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
