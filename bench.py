"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from rillmark.plans import catalog, queries as q

HEADLINE = ("cmp_partition_counts", "jn_pattern_fanout", "ret_combined_status", "vw_rebuild", "cur_committed_prefix", "ord_fetch_greedy", "agg_distribution", "agg_throughput_rollup", "idm_dedup", "txn_visible")
#: Counterparts of micro-benchmarks: 3,000 lookups among 10,000 patterns, and a partition's offsets by subject.
MORE = ("jn_large_index", "src_subject_offsets")


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g", "spark.sql.session.timeZone": "UTC"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    queries = q.queries() | catalog.queries()
    for name in (*HEADLINE, *MORE):
        best = float("inf")
        for _ in range(2):
            t = time.time()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            best = min(best, time.time() - t)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took[k] for k in HEADLINE), 3), "unit": "sec", "queries": took, "sf": sf.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
