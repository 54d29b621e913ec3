"""Time the headline queries on the test tables and print one JSON line.

``python bench.py`` runs the headline queries, ``python bench.py all`` every query,
``python bench.py NAME ...`` the named ones. Each is run once to warm up, then three times;
the median counts. Results go to the ``noop`` sink, so every row is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from continuity.session import local_session  # noqa: E402
from continuity.workload.queries import QUERIES  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
# Timed once after the warm-up.
HEAVY = {"sync_run"}
HEADLINE = (
    "flagship", "delay_type_labels", "csv_declared_scan", "ingest_flights_run", "stream_ingest",
    "stream_delay_type", "append_batch", "top_orders", "inventory_external", "location_remap",
    "clone_plan", "volume_registry_after", "grant_diff", "grant_changes", "grant_status",
    "grants_after", "effective_grants", "replicate_table", "replicate_partitioned",
    "replicate_external", "replicate_view", "sync_status", "sync_run",
)


def main() -> None:
    chosen = sys.argv[1:] or list(HEADLINE)
    if chosen == ["all"]:
        chosen = list(QUERIES)
    shared = tempfile.mkdtemp(prefix="bench-")
    spark = local_session(
        CPUS,
        int(CPUS) if CPUS.isdigit() else 8,
        **{"spark.checkpoint.dir": shared, "spark.sql.warehouse.dir": f"{shared}/warehouse"},
    )
    timings = {}
    for name in chosen:
        laps = []
        for _ in range(1 + (1 if name in HEAVY else RUNS)):
            start = time.perf_counter()
            QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            laps.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(laps[1:]), 4)
        print(f"{name}: {timings[name]}", file=sys.stderr)
    spark.stop()
    report = {
        "metric": "total_query_time",
        "value": round(sum(timings.values()), 4),
        "unit": "sec",
        "queries": timings,
        "sf": Path(SF_DIR).name.removeprefix("sf"),
    }
    print(json.dumps(report))


if __name__ == "__main__":
    main()
