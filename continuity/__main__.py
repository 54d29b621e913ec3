"""Jobs for ``spark-submit``: ``python -m continuity ingest ...`` and ``... sync ...``."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from continuity.plans.ingest import ingest_flights, ingest_flights_stream
from continuity.plans.status import outcome
from continuity.plans.sync import SyncOptions, run_sync
from continuity.sources import read_inventory
from continuity.workspace import run_id


def _arguments(argv: Sequence[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="continuity")
    jobs = parser.add_subparsers(dest="job", required=True)

    ingest = jobs.add_parser("ingest", help="append flight files to <database>.flights_raw")
    ingest.add_argument("--path", required=True)
    ingest.add_argument("--catalog", help="leave out for the session catalog")
    ingest.add_argument("--database", default="flights_dev")
    ingest.add_argument("--table", default="flights_raw")
    ingest.add_argument("--limit", type=int)
    ingest.add_argument("--checkpoint", help="run as a stream with this checkpoint folder")
    ingest.add_argument("--max-bytes", type=int, help="size of one micro-batch")

    sync = jobs.add_parser("sync", help="bring the target in step with the source")
    sync.add_argument("--source-inventory", required=True, help="folder of the exported inventory")
    sync.add_argument("--target-inventory", required=True)
    sync.add_argument("--source-database", default="{catalog}_share__{schema}")
    sync.add_argument("--target-database", default="{catalog}__{schema}")
    sync.add_argument("--folder", required=True, help="root of the copies made by name")
    sync.add_argument("--output", required=True, help="folder for status, grants and volumes")
    sync.add_argument("--workers", type=int, default=8)
    sync.add_argument("--direct-grants", action="store_true")
    sync.add_argument("--least-grants", action="store_true")
    sync.add_argument("--skip-unchanged", action="store_true")
    sync.add_argument("--fail-fast", action="store_true")
    sync.add_argument("--journal", help="folder of this run's journal; start again with it to go on")
    return parser.parse_args(argv)


def _ingest(spark: SparkSession, args: argparse.Namespace) -> None:
    table = ".".join(part for part in (args.catalog, args.database, args.table) if part)
    if args.checkpoint:
        ingest_flights_stream(
            spark, args.path, table, args.checkpoint, max_bytes_per_trigger=args.max_bytes
        ).awaitTermination()
    else:
        ingest_flights(spark, args.path, table, args.limit)
    print(f"appended {args.path} to {table}")


def _sync(spark: SparkSession, args: argparse.Namespace) -> None:
    options = SyncOptions(
        source_database=lambda c, s: args.source_database.format(catalog=c, schema=s),
        target_database=lambda c, s: args.target_database.format(catalog=c, schema=s),
        folder=args.folder,
        workers=args.workers,
        effective=not args.direct_grants,
        least=args.least_grants,
        skip_unchanged=args.skip_unchanged,
        fail_fast=args.fail_fast,
        journal=args.journal,
    )
    result = run_sync(
        spark,
        read_inventory(spark, args.source_inventory),
        read_inventory(spark, args.target_inventory),
        options,
    )
    parts = {
        "status": result.status,
        "volumes": result.volumes,
        "grant_changes": result.grant_changes,
        "grants": result.grants,
    }
    # Volumes and grants are states: a folder for each run, so no state holds another's rows.
    run = run_id()
    for name, frame in parts.items():
        frame.write.parquet(f"{args.output}/run_{run}/{name}")
    print(f"results in {args.output}/run_{run}")
    result.status.groupBy("kind", outcome().alias("outcome")).count().show(200, truncate=False)


def main(argv: Sequence[str] | None = None) -> None:
    args = _arguments(argv)
    spark = SparkSession.builder.appName(f"continuity {args.job}").getOrCreate()
    {"ingest": _ingest, "sync": _sync}[args.job](spark, args)


if __name__ == "__main__":
    main()
