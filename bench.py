"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from evifuse.plans import registry
from evifuse.session import get_spark

HEADLINE = (
    "observation_query trust_annotation import_dedupe replace_by_version cluster_scores cross_verify event_fusion geofence_alerts "
    "latest_run_per_source change_outcomes source_status storage_report camera_endpoints claim_assessment materiality prominence "
    "network_relationships inventory_diff canonical_urls html_signals entity_resolution archive_round_trip stream_watch_outcomes"
).split()


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    spark = get_spark("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="8g", spark__ui__showConsoleProgress="false", spark__checkpoint__dir=tempfile.mkdtemp(prefix="evifuse-bench-"))
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = registry.queries(), {}
    queries["table_counts"](spark, sf_dir).collect()  # start the workers
    for name in HEADLINE:
        began = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
