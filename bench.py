"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line. Best of two after one warm-up run of each."""

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from tracewright.plans import registry

HEADLINE = ["q0_flagship", "e1_anchored_windows", "e3_nearest_link", "e4_components", "e9_rollup", "e12_context_asof", "n3_gross_usd", "c11_intent", "m6_forward_returns", "m8_pre_event_context", "b7_stats", "b10_bh", "i4_delta_merge", "i6_checkpoints", "q8_histogram", "s5_coverage"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g")).config("spark.local.dir", tempfile.mkdtemp(prefix="spark-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        query, best = registry.queries()[name], float("inf")
        for k in range(3):
            began = time.perf_counter()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began) if k else best
        took[name] = round(best, 3)
    print(json.dumps({"metric": "total of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
