"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: prints one JSON line.

Each query is written to Spark's noop sink, so all rows are computed and none reach the driver. One warm-up, then the median of
$BENCH_RUNS runs (3).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

ROOT = str(Path(__file__).resolve().parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))

HEADLINE = [
    "a03_series_latest", "a03_series_points", "a04_roll_up", "j03_without_row", "j07_precedence", "j08_snapshot_diff", "j09_nearest", "j10_k_nearest", "j11_as_of",
    "k02_upsert_fold", "w02_first_per_key", "w03_islands", "w09_evict", "f03_search", "p17_slugs", "t04_alerts", "extra_rollup", "extra_pricing",
]


def main() -> None:
    from fieldloom.plans import catalog
    from fieldloom.session import local_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session("bench")
    known, seconds = catalog.queries(), {}
    for name in [n for n in HEADLINE if n in known]:
        took = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            known[name](spark, sf).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        seconds[name] = round(median(took[1:]), 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, sum of medians", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf.rsplit("/", 1)[1]}))


if __name__ == "__main__":
    main()
