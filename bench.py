"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the input, ``BENCH_CPUS`` the local cores, ``BENCH_ALL=1``
times every registered query. Each query is written to the no-op sink, so
nothing but the query itself is measured.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from logloom.plans import registry  # noqa: E402

HEADLINE = (
    "agg_fl_01", "agg_fl_counters", "agg_fl_13", "agg_fl_14", "rul_fl_01", "rul_fl_all", "rnk_06", "rnk_11_flows",
    "agg_lb_counters", "agg_lb_21", "agg_lb_22", "tsr_01", "tsr_06", "hlt_01", "rnk_11_lb",
    "agg_wf_counters", "agg_wf_19", "rul_wf_all", "rnk_11_waf",
    "agg_ob_counters", "rul_ob_all", "rnk_11_objects",
    "agg_ct_counters", "rul_ct_all", "rnk_05", "rnk_11_audit",
    "src_13", "src_18", "src_19", "src_20", "snk_03", "snk_06", "met_01", "met_02",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    runs = registry.queries()
    names = list(runs) if os.environ.get("BENCH_ALL") else [n for n in HEADLINE if n in runs]
    # One untimed query starts the JVM's code paths and the file listing.
    runs["agg_fl_02"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        started = time.perf_counter()
        runs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
