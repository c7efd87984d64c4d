"""Seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], as one line of JSON."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

HEADLINE = (
    "suttffp", "pr_curve", "pair_counts", "blosum_matrix", "transition_matrix", "nhot_counts", "aligned_edges", "jaccard_pairs", "knn_graph",
    "nearest_centroid", "spearman", "grid_best", "concordance", "dihedral_angle", "spherical_bins", "cigar_expand", "sim_matrix", "sw_align",
)
RUNS = int(os.environ.get("BENCH_RUNS", "2"))


def main() -> None:
    from pyspark.sql import SparkSession

    from motifgrid.plans import catalog

    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        took = []
        for _ in range(RUNS):
            began = time.time()
            catalog.QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
            took.append(time.time() - began)
        seconds[name] = round(statistics.median(took) if RUNS > 2 else min(took), 3)
    print(json.dumps({"metric": "seconds of all headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(d.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
