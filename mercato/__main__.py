"""Command line for schedulers and ad-hoc runs (``spark-submit`` / ``python -m mercato``).

    python -m mercato refresh                      # daily snapshot refresh
    python -m mercato archive --target DB.TABLE    # daily stock archive
    python -m mercato sales --initial 2024-03-01 --final 2024-03-15 --out PATH
    python -m mercato items --out PATH             # item master

Report commands write JSON lines (one object per row) to ``--out``; nothing
is collected to the driver.
"""

from __future__ import annotations

import argparse
from datetime import date, datetime

from mercato.params import DEFAULT_MIN_DATE
from mercato.plans.service import ReportService
from mercato.session import build_session
from mercato.sinks.json_lines import SALE_FIELDS, SHIPMENT_FIELDS, STOCK_FIELDS, write_json_lines
from mercato.sinks.snapshot import SnapshotStore

FIELDS = {"sales": SALE_FIELDS, "stock": STOCK_FIELDS, "shipments": SHIPMENT_FIELDS}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="mercato")
    parser.add_argument("command", choices=["refresh", "archive", "sales", "stock", "shipments", "items"])
    parser.add_argument("--initial")
    parser.add_argument("--final")
    parser.add_argument("--out", help="output directory for report commands")
    parser.add_argument("--target", help="archive table (or directory with --path-target)")
    parser.add_argument("--path-target", action="store_true")
    parser.add_argument("--as-of", help="yyyy-MM-dd[THH:MM]; default: now")
    parser.add_argument("--skip-max-period", action="store_true")
    parser.add_argument("--min-date", type=date.fromisoformat, default=DEFAULT_MIN_DATE, help="earliest day a report may ask for")
    parser.add_argument("--months-back", type=int, help="load months and calendar months that the extracts reach back")
    parser.add_argument("--half-open", action="store_true", help="ranges end at midnight after the final day, not at 23:59")
    parser.add_argument("--incremental", action="store_true", help="refresh sales by the load months that changed")
    parser.add_argument("--keep", type=int, help="snapshot versions to keep (default: all)")
    parser.add_argument("--hive", action="store_true", help="tables of a Hive metastore")
    parser.add_argument("--master", default=None)
    parser.add_argument("--shuffle-partitions", type=int, default=None)
    args = parser.parse_args(argv)
    if args.command == "archive" and not args.target:
        parser.error("archive needs --target")
    if args.command in ("sales", "stock", "shipments", "items") and not args.out:
        parser.error(f"{args.command} needs --out")
    as_of = datetime.fromisoformat(args.as_of) if args.as_of else datetime.now()

    if args.keep is not None and args.keep < 1:
        parser.error("--keep needs at least 1")

    spark = build_session(master=args.master, shuffle_partitions=args.shuffle_partitions, hive=args.hive)
    svc = ReportService(spark, as_of=as_of, store=SnapshotStore(spark, keep=args.keep), skip_max_period=args.skip_max_period,
                        min_date=args.min_date, months_back=args.months_back, half_open=args.half_open,
                        incremental=args.incremental)
    if args.command == "refresh":
        svc.refresh()
    elif args.command == "archive":
        svc.archive(args.target, today=as_of.date(), is_table=not args.path_target)
    elif args.command == "items":
        items = svc.items()
        write_json_lines(items, items.columns, args.out)
    else:
        write_json_lines(getattr(svc, args.command)(args.initial, args.final), FIELDS[args.command], args.out)


if __name__ == "__main__":
    main()
