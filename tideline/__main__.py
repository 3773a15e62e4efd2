"""Run reports over a folder of source relations and store their result cells.

    python -m tideline \\
        --sources s3a://lake/product --out s3a://lake/cells --report-date 2024-01-30

``--to`` turns the run into a backfill over all report dates up to that day, one job per
report. A report that fails is logged and keeps its earlier cells; the exit status counts
such reports.
"""

from __future__ import annotations

import argparse
import sys
from datetime import date, timedelta

from pyspark.sql import SparkSession

from tideline.plans.registry import REPORTS
from tideline.sources.snapshots import snapshot_reports
from tideline.sources.warehouse import Warehouse


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tideline", description=__doc__.splitlines()[0])
    parser.add_argument("--sources", required=True, help="folder with one parquet table per relation")
    parser.add_argument("--out", required=True, help="folder of the stored cells")
    parser.add_argument("--report-date", required=True, type=date.fromisoformat)
    parser.add_argument("--to", type=date.fromisoformat, help="last report date of a backfill")
    parser.add_argument("--reports", nargs="*", choices=list(REPORTS), help="default: all")
    parser.add_argument("--max-rows", type=int, help="rows a day above which a stored result counts as an error")
    args = parser.parse_args(argv)

    spark = SparkSession.builder.appName("tideline").getOrCreate()
    sources = Warehouse(spark, args.sources)
    names = args.reports or list(REPORTS)
    errors = snapshot_reports(
        spark, sources, args.report_date + timedelta(days=1), args.out, names, args.max_rows, args.to
    )
    for name, error in errors.items():
        print(f"{name}: {error}", file=sys.stderr)
    return len(errors)


if __name__ == "__main__":
    sys.exit(main())
