"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

RUNS = 3
HEADLINE = ["score_tnorm", "score_znorm", "score_tznorm", "score_cosine", "segment_subtract", "segment_overlap", "frame_meanvar", "frame_histogram", "frame_cdf_warp", "frame_shifted_delta", "gmm_llk", "gmm_em_stats", "covariance_total", "vector_lda", "ngram_counts", "gmm_train_em", "ivector_extract"]


def main() -> None:
    from pyspark.sql import SparkSession

    from segspark.catalog import QUERIES

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    for name in HEADLINE:
        times = []
        for _ in range(RUNS + 1):  # the first warms up
            begin = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.time() - begin)
        took[name] = round(median(times[1:]), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
