"""Full build from the command line: inputs -> quality gate -> every table exported.

    python -m deliverix --testdata /root/testdata/sf0.1 --out /shared/out
    python -m deliverix --csv /landing/raw --out /shared/out --order-buckets 512

The gates (unique keys, minimum number of clean orders) stop the run before
any result is written, as the reference's build does.
"""

from __future__ import annotations

import argparse
import json

from deliverix.params import Params


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="deliverix")
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--testdata", help="folder with the star-schema parquet tables")
    src.add_argument("--csv", help="folder with the raw CSV exports")
    ap.add_argument("--out", required=True, help="output folder (shared storage on a cluster)")
    ap.add_argument("--materialize", default="table", choices=["table", "persist", "checkpoint", "none"])
    ap.add_argument("--order-buckets", type=int, default=None, help="bucket order-keyed tables at ingest")
    ap.add_argument("--min-clean-rows", type=int, default=Params().min_clean_rows)
    ap.add_argument("--publish", action="store_true", help="export to a new numbered version with a manifest instead of in place")
    ap.add_argument("--master", default=None)
    args = ap.parse_args(argv)

    from deliverix.operators.quality import STRUCTURAL_GATES
    from deliverix.plans.build import Build
    from deliverix.session import get_session
    from deliverix.sources import csv_ingest
    from deliverix.sources.testdata import load_testdata

    spark = get_session(master=args.master)
    if args.testdata:
        tables = load_testdata(spark, args.testdata)
    else:
        res = csv_ingest.ingest_csv(spark, args.csv, f"{args.out}/tables", order_buckets=args.order_buckets)
        print(json.dumps({"ingest": [r.asDict() for r in res.counts.collect()]}))
        tables = csv_ingest.market_tables(res)
    b = Build(spark, tables, Params(min_clean_rows=args.min_clean_rows), materialize=args.materialize)
    b.check_gates([*STRUCTURAL_GATES, "orders_clean_min_rows"])
    if args.publish:
        from deliverix.sources.published import Published
        version = b.publish(f"{args.out}/kpi")
        print(json.dumps({"version": version, "exported": Published(spark, f"{args.out}/kpi", version).rows}))
    else:
        manifest = b.export(f"{args.out}/kpi")
        print(json.dumps({"exported": {r.table_name: r.rows for r in manifest.collect()}}))
    spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
