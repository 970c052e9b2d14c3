"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from txrisk.catalog import QUERIES  # noqa: E402

HEADLINE = [
    "account_features",
    "account_features_full",
    "touching_transactions",
    "incidence_counts",
    "recent_k",
    "page_history",
    "tx_gaps",
    "first_n_sequence",
    "latest_sequence",
    "profile_sequence",
    "pooled_sequence",
    "undersample",
    "stratified_split",
    "impute_median",
    "scale_features",
    "assemble_training",
    "softmax_verdict",
    "analysis_row",
    "explanation_prompts",
    "explorer_records",
    "batch_scan",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("txrisk-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", os.environ.get("BENCH_SHARED_DIR") or tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    timings = {}
    for name in names:
        # First run: compilation and file listing; second run: the work.
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            timings[name] = round(time.perf_counter() - start, 3)
    accounts = spark.read.parquet(
        f"{sf_dir}/customer.parquet"
    ).count()
    print(
        json.dumps(
            {
                "metric": "total time of headline queries, warm",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "accounts_per_sec_batch_scan": round(accounts / timings["batch_scan"], 1)
                if "batch_scan" in timings
                else None,
            }
        )
    )


if __name__ == "__main__":
    main()
