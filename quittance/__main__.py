"""Command line: ``spark-submit`` or ``python -m quittance <command> --root <folder>``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from quittance.plans import export, publish
from quittance.sources import csv_files


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="quittance")
    parser.add_argument(
        "command",
        choices="load dev deploy status views check export prune clean".split(),
    )
    parser.add_argument("--root", required=True, help="warehouse folder")
    parser.add_argument("--csv", help="folder with the raw extracts (load)")
    parser.add_argument("--wide-ids", action="store_true", help="64-bit ids in the extracts (load)")
    parser.add_argument(
        "--line-breaks",
        nargs="?",
        const="split",
        choices=["split", "whole"],
        help="accept line breaks within quotes; 'whole': a task per file, stray quotes too (load)",
    )
    parser.add_argument("--keep", type=int, default=2, help="versions to keep (prune)")
    parser.add_argument("--schema", help="slot to audit, by default the live one (check)")
    parser.add_argument("--out", help="folder to write to (export)")
    parser.add_argument("--ordered", action="store_true", help="sort by invoice (export)")
    parser.add_argument("--min-rows", type=int, default=0, help="fewest rows to publish (deploy)")
    args = parser.parse_args(argv)
    for command, needed in (("load", "csv"), ("export", "out")):
        if args.command == command and getattr(args, needed) is None:
            parser.error(f"{command} needs --{needed}")
    return args


def main(argv: list[str] | None = None) -> int:
    """Run one command; 1 when a build or audit found failures."""
    args = _arguments(argv)
    spark = SparkSession.builder.appName("quittance").getOrCreate()
    wh = publish.Warehouse(spark, args.root)
    raw_folder = f"{args.root.rstrip('/')}/raw"
    if args.command == "load":
        raw = csv_files.load_raw(spark, args.csv, raw_folder, args.wide_ids, args.line_breaks)
        csv_files.load_manifest(raw).show(truncate=False)
    elif args.command in ("dev", "deploy"):
        raw = csv_files.read_raw(spark, raw_folder)
        target = "dev" if args.command == "dev" else None
        result = publish.build(wh, raw, target, min_rows=args.min_rows)
        bad = [r for r in result.results if r["status"] in ("error", "fail", "skipped")]
        for r in bad:
            print(f"{r['status']:8} {r['check_id']} {r['failures']}")
        if result.published:
            publish.register_views(wh)
        print(f"target {result.target}: {'published' if result.published else 'not published'}")
        return int(bool(bad) or (args.command == "deploy" and not result.published))
    elif args.command == "views":
        publish.register_views(wh)
        publish.register_slot(wh, publish.deployment_status(wh).first()["active_schema"])
    elif args.command == "status":
        publish.deployment_status(wh).show(truncate=False)
    elif args.command == "check":
        schema = args.schema or publish.deployment_status(wh).first()["active_schema"]
        if schema == "unknown":
            print("nothing is deployed; name a slot with --schema")
            return 1
        report = publish.recheck(wh, schema)
        for r in report.orderBy("check_id").collect():  # a row per check
            print(f"{r['status']:8} {r['check_id']} {r['failures']}")
        return int(publish.status_tally(report).first()["total_failures"] > 0)
    elif args.command == "export":
        export.export_json(wh, args.out, ordered=args.ordered).show()
    elif args.command == "prune":
        publish.prune(wh, args.keep)
        csv_files.prune(spark, raw_folder, args.keep)
    else:
        publish.reset(wh)
    return 0


if __name__ == "__main__":
    sys.exit(main())
