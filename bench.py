"""Runs the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
HEADLINE = (
    "price_summary_by_currency", "price_summary_by_reference", "price_medians_by_year", "price_trend_2y", "evidence_dedup", "evidence_statistics", "bid_cost", "affordable_bid",
    "exposure_by_currency_event", "collection_totals", "own_comparables", "queue_closing_soon", "want_matches", "lot_duplicates", "merge_lww_rows", "alias_closure", "alert_reconcile", "event_session_windows",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from quaestor.plans.queries import QUERIES
    from quaestor.session import configure

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    builder = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    spark = configure(builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run(HEADLINE[0])  # compiles and reads once
    took = {}
    for name in HEADLINE:
        begin = time.perf_counter()
        run(name)
        took[name] = round(time.perf_counter() - begin, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(sf_dir).name}))
    spark.stop()


if __name__ == "__main__":
    main()
