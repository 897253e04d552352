"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Each query runs once to warm up and is
then timed; results are fully computed and discarded.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from clickloom.plans.catalogue import QUERIES
from clickloom.session import get_spark

HEADLINE = [
    "enable_frequency_map",
    "category_frequency_customers",
    "training_set",
    "coded_categories",
    "profile_slots",
    "profile_cosine_pairs",
    "profile_dot_topk",
    "embedding_transpose",
    "auc",
    "confusion",
    "lr_score",
    "lr_gradient",
    "lr_gd",
    "lr_sgd_avg",
    "fm_predict",
    "fm_gd_step",
    "fm_sgd_avg",
    "ftrl_batch_step",
    "tdap_batch_step",
    "ftrl_per_user",
    "mixed_score",
    "mixed_random_step",
    "best_split",
    "boosted_fit",
    "kv_upsert",
    "kv_latest_model",
    "rank_candidates",
    "pagerank4",
    "path_contains",
    "is_increasing",
]


def run(fn, spark, sf_dir: str) -> float:
    begin = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = get_spark(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        run(QUERIES[name], spark, sf_dir)
        seconds[name] = round(statistics.median(run(QUERIES[name], spark, sf_dir) for _ in range(repeats)), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
