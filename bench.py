"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The derivation of all tables is timed by itself, then each query's first run and the median of three warm ones.
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (HERE, os.environ.get("PYTHONPATH", "")) if x)

HEADLINE = [
    "top_hosts", "visits", "sessions", "foreground_time", "range_stats", "period_delta", "surging_hosts", "hubs", "next_hops", "reciprocal_pairs",
    "top_pages", "session_event_join", "merged_stream", "rhythm", "session_chains", "session_flow", "communities", "bridges",
]
WARM = 3


def main() -> None:
    from pyspark.sql import SparkSession

    from trailmark.registry import QUERIES

    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def timed(name: str) -> float:
        began = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        return round(time.time() - began, 3)

    took = {"derivation": timed("visits")}
    first = {name: timed(name) for name in HEADLINE}
    took |= {name: round(median(timed(name) for _ in range(WARM)), 3) for name in HEADLINE}
    print(json.dumps({"metric": "derivation of all tables once, then headline queries, median of three warm runs", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "first_runs": first, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
