"""Command line for the user flows (run with spark-submit or ``python -m salescope``).

  report   --out DIR FILE...                      per-file cleaning report (counts and matrix)
  save     --tables DIR --prefix P [--mode strict] [--buckets N] FILE...
  countries --tables DIR --prefix P [--rank top|all|flop] [--year Y] [--country C] [--out DIR]
  products  --tables DIR --prefix P [--rank top|all|flop] [--year Y] [--product CODE] [--out DIR]

Results are written whole to ``--out`` as Parquet when given; otherwise the
first rows are shown.
"""

from __future__ import annotations

import argparse
import sys

from salescope.plans import workflows
from salescope.plans.params import DashboardParams
from salescope.session import build_session

SHOW_ROWS = 50


def _emit(df, out: str | None, name: str) -> None:
    if out:
        df.write.mode("overwrite").parquet(f"{out.rstrip('/')}/{name}")
    else:
        df.show(SHOW_ROWS, truncate=False)


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="salescope", description=__doc__,
                                 formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = ap.add_subparsers(dest="cmd", required=True)
    rep = sub.add_parser("report", help="per-file cleaning report")
    rep.add_argument("--out", help="write feedback and feedback_matrix as Parquet below this folder")
    rep.add_argument("files", nargs="+", help="CSV files, folders or globs")
    sav = sub.add_parser("save", help="load files into the stored star tables")
    sav.add_argument("--tables", required=True, help="folder of the star tables")
    sav.add_argument("--prefix", required=True, help="table name prefix in the catalog")
    sav.add_argument("--mode", choices=["insert_new", "strict"], default="insert_new",
                     help="strict: a clash rejects the file's whole batch")
    sav.add_argument("--buckets", type=int, default=64, help="buckets for invoices and lines")
    sav.add_argument("files", nargs="+", help="CSV files, folders or globs")
    for name in ("countries", "products"):
        p = sub.add_parser(name, help=f"{name} ranking with its drill-down")
        p.add_argument("--tables", required=True, help="folder of the star tables")
        p.add_argument("--prefix", required=True, help="table name prefix in the catalog")
        p.add_argument("--rank", choices=["top", "all", "flop"], default="top")
        p.add_argument("--year", type=int, help="one year (default: all years)")
        p.add_argument("--country", default=DashboardParams().country, help="country for the drill-down")
        p.add_argument("--product", default=DashboardParams().product_code, help="product code for the drill-down")
        p.add_argument("--out", help="write the view as Parquet below this folder")
    args = ap.parse_args(argv)

    spark = build_session(app_name=f"salescope-{args.cmd}")
    if args.cmd == "report":
        counts, matrix = workflows.upload_report(spark, args.files)
        _emit(counts, args.out, "feedback")
        _emit(matrix, args.out, "feedback_matrix")
    elif args.cmd == "save":
        verdict = workflows.save_batch(spark, args.files, args.tables, args.prefix, n_buckets=args.buckets,
                                       mode=args.mode)
        verdict.show(SHOW_ROWS, truncate=False)
    else:
        star = workflows.stored_star(spark, args.tables, args.prefix)
        params = DashboardParams(mode=args.rank, year=args.year, country=args.country,
                                 product_code=args.product)
        view = workflows.country_view if args.cmd == "countries" else workflows.product_view
        _emit(view(star, params), args.out, args.cmd)
    return 0


if __name__ == "__main__":
    sys.exit(main())
