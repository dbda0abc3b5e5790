"""Seconds of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
HEADLINE = ["fact", "psp_weekly", "segment_mart", "segment_rates", "cause_mart", "worst_week", "query_transactions", "kpis", "alert_frame", "money_leak", "quality_metrics", "all_tests", "segment_lineitem", "event_matches", "daily_volume_flags"]


def main() -> None:
    from pyspark.sql import SparkSession

    from tallyspark.queries import QUERIES

    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "4")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "6g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    # the first query of a session pays for starting executors and compiling; the smallest table set takes that over
    began, small = time.time(), Path(sf).parent / "sf0.001"
    if small.exists():
        QUERIES["fact"](spark, str(small)).write.format("noop").mode("overwrite").save()
    warm_up = round(time.time() - began, 2)
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 2)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 2), "unit": "sec", "queries": took, "sf": sf, "warm_up": warm_up, "note": "fact is built cold; the other queries read the fact that it leaves held"}))


if __name__ == "__main__":
    main()
