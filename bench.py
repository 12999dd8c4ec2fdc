"""Times the headline queries, warm, over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Of each query the median of up to three runs counts: all are run once, and again while BUDGET seconds are left.
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

from pyspark.sql import SparkSession

HEADLINE = [
    "outliers_single_pmcod", "outliers_single_slicing", "outliers_single_advanced", "outliers_single_advanced_extended", "outliers_single_pmcod_net", "outliers_single_naive",
    "outliers_rk_amcod", "outliers_rk_sop", "outliers_rk_psod", "outliers_rk_pmcsky", "outliers_rkws_sop", "outliers_rkws_psod", "outliers_rkws_pmcsky",
    "outliers_3d", "outliers_3d_by_value", "outliers_embedding", "outlier_points", "range_neighbours", "knn",
]
#: Seconds after which no further round of runs begins, and rounds at most.
BUDGET, ROUNDS = 240, 3


def main() -> None:
    from panewise.queries import QUERIES

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    QUERIES[names[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts executors and loads classes
    runs: dict[str, list[float]] = {name: [] for name in names}
    start = time.perf_counter()
    for k in range(ROUNDS):
        if k and time.perf_counter() - start > BUDGET:
            break
        for name in names:
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs[name].append(time.perf_counter() - began)
    seconds = {name: round(median(found), 3) for name, found in runs.items()}
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
