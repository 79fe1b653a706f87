"""Wall-clock seconds of the headline questions, one JSON line: BENCH_SF_DIR, BENCH_CPUS."""

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

from pyspark.sql import SparkSession  # noqa: E402

from fabriq.plans import registry  # noqa: E402

HEADLINE = ["lpm_routes", "lpm_route_counts", "table_diff", "main_rib", "bgp_best_path", "rib_delta", "prefix_longer", "space_union", "test_filters", "filter_line_reachability", "compare_filters", "edges_layer3", "ospf_shortest_paths", "bgp_path_vector", "broadcast_domains", "test_route_policies"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", "/tmp/fabriq-bench/warehouse").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = registry.queries(), {}
    queries["answer_metrics"](spark, sf).collect()  # the JVM's start isn't counted
    for name in HEADLINE:
        began = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
